"""Exact dedup by progressive refinement, with built-in functions only.

Texts are equal when identical after each run of white space became one space.
Texts are narrowed by length first; only those that share a length get a hash of their
first characters, and only those that share length and prefix hash are hashed in full.
What is shared goes to the next scan as a bitmap of fixed size, sent to every task: a
clash of bits costs a needless hash and never loses a copy. All groupings are
aggregates that combine before the shuffle, and only narrow rows (no text) are shuffled.

Defined cases: a null text counts as empty; of equal texts the smallest doc_id
stays, null ids last; rows that repeat a doc_id of the same text share its fate;
an empty table gives no rows; other columns are not read. When copies are dropped,
a row is named by its doc_id and its text, so that other texts of the same id stay,
and of equal texts that all lack an id one row stays.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import cut_lineage, without_rows
from kgloom.session import broadcast_if_small

PREFIX_CHARS = 64
# bits of a bitmap; as words of 64 bits it has at most 131 072 rows, whatever the corpus
BITS = 1 << 23
# fixed value: white space that is made equal
BLANKS = r"[\x20\x09-\x0D]+"


def normalized(text: Column) -> Column:
    """The text, null as empty, with each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_hash: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept and, with ``with_hash``, text_sha256.

    ``with_hash`` hashes every document, for its digest; without it, texts that are
    alone with their length or prefix are not hashed. Groups are the same either way:
    only documents of shared pairs are compared.
    """
    out = _groups(docs, id_col, text_col, with_hash)
    return out if with_hash else out.drop("text_sha256")


def _digest(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


def _bit(keys: list) -> tuple[Column, Column]:
    """(word, place in it) of the bit that stands for the keys in a bitmap."""
    h = F.pmod(F.xxhash64(*keys), F.lit(BITS))
    return F.shiftright(h, 6), F.pmod(h, F.lit(64)).cast("int")


def _bitmap(df: DataFrame, keys: list) -> DataFrame:
    """The keys that occur more than once as a bitmap of fixed size: its words that hold a bit."""
    word, at = _bit(keys)
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return cut_lineage(repeated.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), at).alias("_bit"))
                       .groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))


def _marked(df: DataFrame, bitmap: DataFrame, keys: list, name: str) -> DataFrame:
    """``df`` with a flag whether the keys may occur more than once; always true if they do. No row is shuffled."""
    word, at = _bit(keys)
    flag = F.call_function("shiftright", F.col("_bits"), at).bitwiseAND(F.lit(1).cast("long")) == 1
    return (df.withColumn("_word", word).join(F.broadcast(bitmap), "_word", "left")
            .withColumn(name, F.coalesce(flag, F.lit(False))).drop("_word", "_bits"))


def _groups(docs: DataFrame, id_col: str, text_col: str, with_hash: bool) -> DataFrame:
    """The rows of ``exact_groups``; without ``with_hash`` text_sha256 is null where length or prefix show that a text has no equal."""
    rows = docs.select(F.col(id_col).alias("doc_id"), normalized(F.col(text_col)).alias("norm")).withColumn("len", F.length("norm"))
    prefix = F.xxhash64(F.substring("norm", 1, PREFIX_CHARS))
    sized = _marked(rows, _bitmap(rows.select("len"), ["len"]), ["len"], "same_length")
    prefixed = sized.withColumn("prefix", F.when(F.col("same_length"), prefix))
    pairs = _bitmap(prefixed.filter("same_length").select("len", "prefix"), ["len", "prefix"])
    marked = _marked(prefixed, pairs, ["len", "prefix"], "same_prefix").withColumn("shared", F.col("same_length") & F.col("same_prefix"))
    full = _digest(F.col("norm"))
    refined = cut_lineage(marked.select("doc_id", "prefix", "shared", (full if with_hash else F.when(F.col("shared"), full)).alias("text_sha256")))
    groups = refined.filter("shared").groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = broadcast_if_small(cut_lineage(groups.filter("group_size > 1")))
    keep = F.when(F.col("group_size").isNotNull(), F.col("keep_id")).otherwise(F.col("doc_id"))
    # rows that are alone get evenly spread keys that match nothing
    alone = F.concat(F.lit("-"), F.xxhash64("doc_id", "prefix").cast("string"))
    return (refined.withColumn("_key", F.when(F.col("shared"), F.col("text_sha256")).otherwise(alone))
           .join(groups.withColumnRenamed("text_sha256", "_key"), "_key", "left")
           .select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                   F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text has no equal with a smaller id, nulls last; all columns as they are."""
    dropped = _groups(docs, id_col, text_col, with_hash=False).filter(~F.col("kept")).select("doc_id", F.col("text_sha256").alias("key"))
    return without_rows(docs, dropped, id_col, _digest(normalized(F.col(text_col))))


SQL = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents),
g as (select norm, min(doc_id) as keep_id, count(*) as group_size from t group by norm)
select t.doc_id, g.keep_id, g.group_size, t.doc_id is not distinct from g.keep_id as kept, sha256(t.norm) as text_sha256
from t join g using (norm)
"""
