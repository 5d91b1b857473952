import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kgloom.functions import chunking as K
from kgloom.functions import language as L
from kgloom.functions import text as T
from kgloom.functions.matching import close_strings
from kgloom.functions.places import window_places

SPACE = "[\t-\r\x1c- \x85\xa0  -     　]+"


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x"))).first()[0]


def test_cleaning_steps(spark):
    assert one(spark, "é a\x00b\x85c\r\nd", T.normalize_unicode) == "é abc\nd"
    assert one(spark, " a\r\n\r\rb \t c\n\n\n\nd ", T.normalize_whitespace) == "a\n\nb c\n\nd"
    # control characters go first, so a lone carriage return disappears
    assert one(spark, "a\rb", T.clean_text) == "ab"
    full = lambda c: T.clean_text(c, remove_urls=True, remove_emails=True, lowercase=True)
    assert one(spark, "See HTTPS://x.org https://y.org/a?b=1 Or mail A.b+c@d-e.org -- --- .... End", full) == \
        "see https://x.org  or mail  -- — … end"


def test_unicode_spaces_and_tokens(spark):
    assert one(spark, "a b　c\x1cd  e", T.words) == ["a", "b", "c", "d", "e"]
    assert one(spark, "   ", T.word_count) == 0
    assert one(spark, "a b c d e", T.count_tokens) == 3
    assert one(spark, "abcdefghij", lambda c: T.truncate_to_tokens(c, 2)) == "abcdefgh"


def test_sentences_and_labels(spark):
    assert one(spark, "One. Two!  Three?\nFour.Five. ", T.sentences) == ["One.", "Two!", "Three?", "Four.Five."]
    for raw, want in [("PersonName", "Personname"), ("legal-entity type", "LegalEntityType"), ("", "Entity"), ("__", "Entity")]:
        assert one(spark, raw, T.safe_label) == want
    assert one(spark, " a/b:c?.t xt ", T.safe_filename) == "abc.t xt"


@pytest.mark.parametrize("raw", ["```json\n{\"a\": 1}\n```", "```\n{\"a\": 1}\n```", "{\"a\": 1}"])
def test_fences(spark, raw):
    assert one(spark, raw, T.strip_fences) == '{"a": 1}'
    assert one(spark, raw, T.strip_json_fences) == '{"a": 1}'


def test_html(spark):
    page = '<html><head><title>A &amp; B</title><script>var t="</p>";</script></head><body><!-- x --><p>1 &lt; 2 &amp;lt;</p>\n<b>c</b></body>'
    assert one(spark, page, T.html_to_text) == "A & B 1 < 2 &lt; c"


def test_language(spark):
    assert one(spark, "the cat and the dog are in the house", L.detect_language) == "en"
    assert one(spark, "der Hund und die Katze sind nicht im Haus", L.detect_language) == "de"
    assert one(spark, "the cat", L.detect_language) is None
    # the whole text counts, not its start
    assert one(spark, "x " * 3000 + "le chat est dans la maison", L.detect_language) == "fr"


def plain_windows(text, max_tokens, overlap):
    ws = [w for w in re.split(SPACE, text) if w]
    size, step = int(max_tokens / 1.3), int(max(1, max_tokens - overlap) / 1.3)
    out, at = [], 0
    for i, s in enumerate(range(0, len(ws), step)):
        body = " ".join(ws[s:s + size])
        p = text.find(body, at)
        out.append((i, body, int(len(body.split()) * 0.75), max(0, p), p + len(body) if p >= 0 else 0))
        at = max(0, p)
    return out


def plain_sentences(text, budget):
    sents = [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]
    groups, cur, tok = [], [], 0
    for s in sents:
        n = int(len(s.split()) * 0.75)
        if cur and tok + n > budget:
            groups.append((" ".join(cur), tok))
            cur, tok = [], 0
        cur.append(s)
        tok += n
    if cur:
        groups.append((" ".join(cur), tok))
    out, pos = [], 0
    for i, (body, tok) in enumerate(groups):
        p = text.find(body, pos)
        pos = max(0, p + len(body))
        out.append((i, body, tok, max(0, p), pos))
    return out


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    out = ["", "   ", "one", "a. b. c."]
    for _ in range(40):
        ws = []
        for _ in range(rnd.randint(1, 120)):
            ws.append(rnd.choice(["alpha", "b", "Gamma,", "dee.", "eh!", "f?"]) + rnd.choice([" ", " ", " ", "\n", "  "]))
        out.append("".join(ws))
    return out


def test_sliding_chunks_match_plain_python(spark, rows, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, raw_text string")
    for max_tokens, overlap in [(20, 5), (13, 3), (40, 0)]:
        got = rows(K.sliding_chunks(df, max_tokens, overlap), "document_id", "chunk_index", "text", "token_count", "start_char", "end_char")
        want = sorted(((d, *c) for d, t in enumerate(texts) for c in plain_windows(t, max_tokens, overlap)), key=repr)
        assert got == want
    with pytest.raises(ValueError):
        K.sliding_chunks(df, 10, 9)


def plain_places(text, size, step):
    words, out, at = text.split(), [], 0
    for s in range(0, len(words), step):
        p = text.find(" ".join(words[s:s + size]), at)
        out.append(p + 1)
        at = max(0, p)
    return out


@given(st.lists(st.sampled_from(["a", "b", "ab", "a ", " ", " b ", "\n", "\u3000", "é ", "\U0001f600 "]), max_size=90).map("".join), st.integers(1, 8), st.integers(1, 8))
@settings(max_examples=400, deadline=None)
def test_window_places_are_first_occurrences(text, size, step):
    assert window_places(text, size, step) == plain_places(text, size, step)


def test_places_of_a_very_long_text_take_linear_time():
    rnd = random.Random(7)

    def seconds(n):
        text = " ".join(f"w{rnd.randrange(50000)}" + "\n" * (i % 700 == 0) for i in range(n))
        start = time.perf_counter()
        assert sum(p > 0 for p in window_places(text, 769, 692)) < 5
        return time.perf_counter() - start
    small = min(seconds(100_000) for _ in range(3))
    # a search from the front takes 100 times as long
    assert seconds(1_000_000) < 40 * small


def test_long_texts_have_the_same_offsets(spark, rows, texts, monkeypatch):
    df = spark.createDataFrame([*enumerate(texts), (99, "x y  z " * 200)], "id int, raw_text string")
    cols = ["document_id", "chunk_index", "start_char", "end_char"]
    fold = rows(K.sliding_chunks(df.filter("id < 99"), 13, 3), *cols)
    monkeypatch.setattr(K, "LONG_TEXT", 0)
    assert rows(K.sliding_chunks(df.filter("id < 99"), 13, 3), *cols) == fold
    got = rows(K.sliding_chunks(df.filter("id = 99"), 13, 3), *cols)
    assert got == sorted(((99, i, a, e) for i, _, _, a, e in plain_windows("x y  z " * 200, 13, 3)), key=repr)


def test_chunkers_as_table_functions(spark, rows, texts):
    K.register_chunk_functions(spark)
    df = spark.createDataFrame([*enumerate(texts), (98, None), (99, "x y z " * 300)], "id int, raw_text string")
    df.createOrReplaceTempView("texts_to_cut")
    for a, b in [(20, 5), (13, 3), (40, 0)]:
        assert rows(spark.sql(f"select d.id, c.* from texts_to_cut d, lateral kg_sliding_chunks(d.raw_text, {a}, {b}) c")) == rows(K.sliding_chunks(df, a, b))
    for budget in (1, 4, 10, 1000):
        assert rows(spark.sql(f"select d.id, c.* from texts_to_cut d, lateral kg_sentence_chunks(d.raw_text, {budget}) c")) == rows(K.sentence_chunks(df, budget))
    assert [tuple(r) for r in spark.sql("select text, start_char from kg_sentence_chunks('A b. C d.', 1)").collect()] == [("A b.", 0), ("C d.", 5)]
    with pytest.raises(Exception, match="at least 2 tokens"):
        spark.sql("select * from kg_sliding_chunks('a b c', 10, 9)").collect()


def test_sentence_chunks_match_plain_python(spark, rows, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, raw_text string")
    for budget in (1, 4, 10, 1000):
        got = rows(K.sentence_chunks(df, budget), "document_id", "chunk_index", "text", "token_count", "start_char", "end_char")
        want = sorted(((d, *c) for d, t in enumerate(texts) for c in plain_sentences(t, budget)), key=repr)
        assert got == want


def edits(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_close_strings_is_exact(spark, rows):
    rnd = random.Random(5)
    names = ["".join(rnd.choice("abc") for _ in range(rnd.randint(0, 6))) for _ in range(60)]
    left, right = sorted(set(names[:30])), sorted(set(names[30:]))
    for bound in (0, 1, 2):
        got = rows(close_strings(spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string"), bound))
        want = sorted(((a, b, edits(a, b)) for a in left for b in right if edits(a, b) <= bound), key=repr)
        assert got == want


def test_sql_functions(spark):
    T.register_sql_functions(spark)
    row = spark.sql("select kg_safe_label('a-b c'), kg_word_count(' x  y '), kg_sentences('A. B.'), kg_strip_fences('```json\n1\n```'), "
                    "kg_normalize_whitespace(' a \t b '), kg_nfc('é'), kg_count_tokens('a b c d'), kg_truncate('abcdefgh', 1), kg_safe_filename('a/b'), "
                    "kg_clean_text('a\\u0001  b....'), kg_detect_language('the cat and the dog are in')").first()
    assert list(row) == ["ABC", 2, ["A.", "B."], "1", "a b", "é", 3, "abcd", "ab", "a b…", "en"]


def test_sql_fences_equal_column(spark):
    from kgloom.functions import text as T
    T.register_sql_functions(spark)
    cases = ["abc ```x``` ", "```json\n{}\n```", "```x```", " ```\na```b\n``` ", "", "plain", "```"]
    df = spark.createDataFrame([(c,) for c in cases], "x string")
    assert [r[0] for r in df.selectExpr("kg_strip_fences(x)").collect()] == [r[0] for r in df.select(T.strip_fences("x")).collect()]
    assert [r[0] for r in df.selectExpr("kg_strip_json_fences(x)").collect()] == [r[0] for r in df.select(T.strip_json_fences("x")).collect()]


def test_json_keeps_null_fields(spark):
    from kgloom.functions import text as T
    assert spark.range(1).select(T.to_json_text(F.struct(F.lit(None).cast("string").alias("a"), F.lit(1).alias("b")))).first()[0] == '{"a":null,"b":1}'


def test_ids_of_different_keys_differ(spark):
    from kgloom.session import stable_id
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("a\\", "b|c"), (None, "c"), ("", "c"), ("\\0", "c")], "x string, y string")
    assert df.select(stable_id("x", "y")).distinct().count() == 6


def test_character_references(spark):
    from kgloom.functions import text as T
    cases = {"a&#8217;b &#x41;&eacute; &amp;lt; &lt;": "a\u2019b A\u00e9 &lt; <", "&": "&", "": "", "&#0; &#xD800; &#9999999; &nope; & x;": "&#0; &#xD800; &#9999999; &nope; & x;",
             "&#128512;&apos;": "\U0001f600'"}
    df = spark.createDataFrame([(c,) for c in cases], "x string")
    assert [r[0] for r in df.select(T.unescape_entities("x")).collect()] == list(cases.values())


def test_chunks_count_their_words_without_splitting_their_texts(spark, rows):
    docs = spark.createDataFrame([(1, " a b \n" * 700), (2, "x " * 461), (3, ""), (4, None), (5, "one")], "id int, raw_text string")
    for offsets in (True, False):
        got = K.sliding_chunks(docs, 600, 50, offsets=offsets)
        assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
        assert got.filter(got.token_count != T.count_tokens("text")).isEmpty() and got.count() > 4


def test_cleaning_is_written_out_once_below_the_windows(spark, capsys):
    docs = spark.createDataFrame([(1, "a  b\tc ∑"), (2, None)], "id long, raw_text string").withColumn("raw_text", T.clean_text("raw_text"))
    for chunks in (K.sliding_chunks(docs, 1000, 100), K.sentence_chunks(docs, 1000)):
        assert chunks.select("document_id", "text").collect() == [(1, "a b c ∑")]
        chunks.explain("formatted")
        # each pattern stands in the plan once, not inside the function of every window
        assert capsys.readouterr().out.count("-{3,}") == 1


def test_words_of_blank_and_padded_texts(spark):
    texts = [None, "", " \u2003\n", "\x85a \u3000b\t", "a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(T.words("t")).collect()] == [None, [], [], ["a", "b"], ["a"]]
