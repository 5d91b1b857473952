"""Scalar text functions. All are Catalyst expressions except the NFC step."""
import unicodedata
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kgloom import vocab as V

# most characters lie outside the first two ranges and are told apart by these alone
_SPACE = f"[\\x00-\\x20\\x7f-\\x{{10ffff}}&&[{V.SPACE_CLASS}]]"
# the same characters one by one, none of which lies beyond U+3000
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def strip(col) -> Column:
    """Removes leading and trailing Unicode whitespace."""
    return F.btrim(_c(col), F.lit(_SPACES))


def words(col) -> Column:
    """Whitespace-separated words as an array (empty array for blank text)."""
    # a stripped text has no empty word but the one of a blank text
    c = strip(col)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, f"{_SPACE}+"))


def normalize_unicode(col) -> Column:
    """NFC, then control characters other than newline and tab removed.

    Text made only of characters below U+0300 is already in NFC, so only rows
    holding a later character are sent to the Arrow-batched function.
    """
    c = _c(col)
    composed = F.coalesce(_nfc(F.when(c.rlike(r"[^\x00-\x{2ff}]"), c)), c)
    return F.regexp_replace(composed, f"[{V.CONTROL_CLASS}]", "")


def normalize_whitespace(col) -> Column:
    """Unifies line ends, collapses blanks and runs of 3+ newlines, strips."""
    c = F.replace(F.replace(_c(col), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    # a single blank stays as it is
    c = F.regexp_replace(F.replace(c, F.lit("\t"), F.lit(" ")), r" {2,}", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(c)


def clean_text(col, remove_urls=False, remove_emails=False, lowercase=False) -> Column:
    """Unicode, then whitespace, then the optional removals, then dash and dot runs."""
    c = normalize_whitespace(normalize_unicode(col))
    if remove_urls:
        c = F.regexp_replace(c, V.URL_PATTERN, "")
    if remove_emails:
        c = F.regexp_replace(c, V.EMAIL_PATTERN, "")
    if lowercase:
        c = F.lower(c)
    c = F.regexp_replace(c, r"-{3,}", "—")
    c = F.regexp_replace(c, r"\.{3,}", "…")
    return strip(c)


def word_count(col) -> Column:
    return F.size(words(col))


def tokens_of(n_words) -> Column:
    """Token estimate of so many words."""
    return F.floor(n_words * F.lit(0.75)).cast("int")


def count_tokens(col) -> Column:
    """Token estimate: three quarters of the word count, rounded down."""
    return tokens_of(word_count(col))


def truncate_to_tokens(col, max_tokens: int) -> Column:
    """First ``max_tokens`` tokens at four characters per token."""
    return F.substring(_c(col), 1, max_tokens * 4)


def sentences(col) -> Column:
    """Sentences ending in . ! or ?, stripped, blanks dropped."""
    parts = F.split(_c(col), f"(?<=[.!?]){_SPACE}+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def strip_fences(col) -> Column:
    """Body of a response wrapped in one code fence with any tag; else the stripped text."""
    c = strip(col)
    fenced = r"(?s)\A```[a-zA-Z]*\n?(.*?)\n?```\z"
    return F.when(c.rlike(fenced), strip(F.regexp_extract(c, fenced, 1))).otherwise(c)


def strip_json_fences(col) -> Column:
    """Removes a leading ``` or ```json fence and a trailing fence."""
    c = F.regexp_replace(strip(col), f"\\A```(?:json)?{_SPACE}*", "")
    return strip(F.regexp_replace(c, f"{_SPACE}*```\\z", ""))


def safe_filename(col) -> Column:
    """Keeps letters, digits and ``._- ``, then strips."""
    return strip(F.regexp_replace(_c(col), r"[^\p{L}\p{N}._\- ]", ""))


def safe_label(col) -> Column:
    """Node label from an entity type: parts capitalised and joined; empty gives Entity."""
    parts = F.split(F.regexp_replace(_c(col), "[- ]", "_"), "_")
    joined = F.array_join(
        F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))), "")
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("Entity"))


def fixed(col, places: int) -> Column:
    """Number as text with a fixed count of decimals."""
    scale = float(10 ** places)
    return F.format_string(f"%.{places}f", F.floor(_c(col) * scale + 0.5) / scale)


def to_json_text(col) -> Column:
    """Struct or map as JSON text; non-ASCII characters and NULL fields are kept."""
    return F.to_json(col, {"ignoreNullFields": "false"})


def html_to_text(col) -> Column:
    """Visible text of an HTML page."""
    c = F.regexp_replace(_c(col), r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    c = unescape_entities(c)
    return strip(F.regexp_replace(c, f"{_SPACE}+", " "))


def unescape_entities(col) -> Column:
    """Named (those of HTML 4), decimal and hexadecimal character references replaced, each once; anything else stays."""
    named = F.create_map(*[F.lit(x) for kv in sorted({**name2codepoint, "apos": 39}.items()) for x in kv])
    parts = F.split(_c(col), "&")

    def replaced(p):
        ref = F.regexp_extract(p, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        code = (F.when(F.lower(F.substr(ref, F.lit(1), F.lit(2))) == "#x", F.conv(F.substr(ref, F.lit(3)), 16, 10))
                .when(F.startswith(ref, F.lit("#")), F.substr(ref, F.lit(2))).otherwise(F.try_element_at(named, ref).cast("string"))).try_cast("int")
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(valid, F.concat(char, F.substr(p, F.length(ref) + 2))).otherwise(F.concat(F.lit("&"), p))
    whole = F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), replaced), ""))
    # most texts hold no reference at all
    return F.when(F.contains(_c(col), F.lit("&")), whole).otherwise(_c(col))


def _raw(pattern: str) -> str:
    """Pattern as a raw SQL string literal."""
    return "r'" + pattern + "'"


def _replace_sql(x: str, pattern: str, by: str = "''") -> str:
    return f"regexp_replace({x}, {_raw(pattern)}, {by})"


def _strip_sql(x: str) -> str:
    return _replace_sql(x, f"^{_SPACE}+|{_SPACE}+\\z")


def words_sql(x: str) -> str:
    return f"filter(split({x}, {_raw(_SPACE + '+')}), w -> w <> '')"


def sentences_sql(x: str) -> str:
    return f"filter(transform(split({x}, {_raw('(?<=[.!?])' + _SPACE + '+')}), s -> {_strip_sql('s')}), s -> s <> '')"


def count_tokens_sql(x: str) -> str:
    return f"cast(floor(size({words_sql(x)}) * 0.75D) as int)"


def _whitespace_sql(x: str) -> str:
    x = _replace_sql(x, r"\r\n|\r", "chr(10)")
    x = _replace_sql(x, r"[ \t]+", "' '")
    return _strip_sql(_replace_sql(x, r"\n{3,}", "concat(chr(10), chr(10))"))


def _language_sql(x: str) -> str:
    votes = ", ".join(
        "named_struct('rank', -size(filter(" + words_sql(f"lower({x})") + ", w -> w in (" + ", ".join(f"'{w}'" for w in stop)
        + f"))), 'code', '{code}')" for code, stop in sorted(V.STOP_WORDS.items()))
    return f"if(size({words_sql(x)}) >= 5 and array_min(array({votes})).rank < 0, array_min(array({votes})).code, null)"


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Makes the scalar functions callable from ``spark.sql`` under ``kg_*`` names.

    All but ``kg_nfc`` are SQL expressions that the optimizer inlines;
    ``kg_clean_text`` takes text that is in NFC already, e.g. ``kg_clean_text(kg_nfc(x))``.
    """
    spark.udf.register("kg_nfc", _nfc)
    cleaned = _whitespace_sql(_replace_sql("x", f"[{V.CONTROL_CLASS}]"))
    cleaned = _strip_sql(_replace_sql(_replace_sql(cleaned, r"-{3,}", "'—'"), r"\.{3,}", "'…'"))
    fenced = r"(?s)\A```[a-zA-Z]*\n?(.*?)\n?```\z"
    unfenced = f"regexp_extract({_strip_sql('x')}, {_raw(fenced)}, 1)"
    bodies = {
        "kg_strip": ("x STRING", "STRING", _strip_sql("x")),
        "kg_words": ("x STRING", "ARRAY<STRING>", words_sql("x")),
        "kg_word_count": ("x STRING", "INT", f"size({words_sql('x')})"),
        "kg_count_tokens": ("x STRING", "INT", count_tokens_sql("x")),
        "kg_truncate": ("x STRING, n INT", "STRING", "substring(x, 1, n * 4)"),
        "kg_normalize_whitespace": ("x STRING", "STRING", _whitespace_sql("x")),
        "kg_clean_text": ("x STRING", "STRING", cleaned),
        "kg_detect_language": ("x STRING", "STRING", _language_sql("x")),
        "kg_sentences": ("x STRING", "ARRAY<STRING>", sentences_sql("x")),
        "kg_safe_filename": ("x STRING", "STRING", _strip_sql(_replace_sql("x", r"[^\p{L}\p{N}._\- ]"))),
        "kg_safe_label": ("x STRING", "STRING",
                          "coalesce(nullif(array_join(transform(split(replace(replace(x, '-', '_'), ' ', '_'), '_'), "
                          "p -> concat(upper(left(p, 1)), lower(substr(p, 2)))), ''), ''), 'Entity')"),
        "kg_strip_json_fences": ("x STRING", "STRING", _strip_sql(_replace_sql(_replace_sql(
            _strip_sql("x"), rf"\A```(?:json)?{_SPACE}*"), rf"{_SPACE}*```\z"))),
        "kg_strip_fences": ("x STRING", "STRING", f"if({_strip_sql('x')} rlike {_raw(fenced)}, {_strip_sql(unfenced)}, {_strip_sql('x')})"),
    }
    for name, (args, ret, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {ret} RETURN {body}")
    return ["kg_nfc", *bodies]
