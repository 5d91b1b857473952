"""Spelling variant grouping: words one edit apart, found by asymmetric chunks.

One word of a pair, the shorter one, is cut into two disjoint chunks. A single edit
leaves one of them as it is, so the other word holds it at the same place or shifted
by one. The chunks of one side therefore meet the positional grams of the other side
by an equi join on (length, chunk, text). A chunk that many words share is cut again:
what is left of the word outside it holds the edit and is halved in the same way,
until few words share all of it. No group is compared whole, however common its chunk.
Pairs are then verified by their edit distance.

Words are counted in the tasks first, so a frequent word is one row per task and flush.

Defined cases: a null or empty text has no words; a null id counts as empty text in
the checksum; rows that repeat an id, and repeated rows, all count; a run of any
length is a word; ties of count go to the smaller word in code-point order; an empty
table gives no rows; further columns are not read.
"""
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import cut_lineage, slices
from kgloom.session import broadcast_if_small

LEAST_LENGTH = 5
LEAST_COUNT = 3
# a word is a variant of a near one that occurs at least this many times as often
RATIO = 2
# one run in so many, by checksum, loses a code point
NOISE = 97
# fixed value: letters of a word after A-Z are lower-cased
WORD = re.compile("[a-zÀ-ÿ]+")
# distinct words that a task holds, and characters of a text that are searched at a time
HELD = 200_000
BLOCK = 1 << 20
# pairs of rows with one key from which the key is cut further
PAIRS = 256


def _runs(text: str) -> Counter:
    """How often each run occurs; a long text is searched in blocks that end between runs."""
    found, at = Counter(), 0
    while at < len(text):
        end = at + BLOCK
        while end < len(text) and WORD.match(text, end):  # on to the end of the run
            end = WORD.match(text, end).end()
        found.update(WORD.findall(text, at, end))
        at = end
    return found


def _noisy(doc_id, run: str, noise: int) -> str:
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if noise and h % noise == 0:
        at = h % len(run)
        return run[:at] + run[at + 1:]
    return run


def _count(noise: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out
        for batch in batches:
            for part in slices(batch, "text") if batch.num_rows else ():
                for doc_id, raw in zip(part.column("id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
                    # bytes are lower-cased in A-Z only
                    for found, n in _runs(raw.lower().decode() if raw else "").items():
                        total[_noisy(doc_id, found, noise)] += n
                    if len(total) >= HELD:
                        yield rows()
        if total:
            yield rows()
    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = NOISE, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the words that are long and frequent enough."""
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    counted = texts.mapInArrow(_count(noise), "word string, n long").filter(F.length("word") >= least_length)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


# the part a word plays: it gives chunks, or grams to words of its length, or to words shorter by one
CHUNKS, GRAMS, LONGER = 0, 1, 2


def _halves(rows: DataFrame) -> DataFrame:
    """Cuts the open part (``start``, ``size`` in the chunk word) of every row in two: each half in turn is kept, the other stays open.

    The open part of a longer word has one character more, so its second half begins
    one place later. ``key`` stands for the length and all that is kept.
    """
    half, more = F.floor(F.col("size") / 2).cast("int"), (F.col("side") == LONGER).cast("int")
    first = F.struct(F.lit(0).alias("which"), (F.col("start") + half).alias("start"), (F.col("size") - half).alias("size"),
                     F.substring("word", F.col("start") + 1, half).alias("kept"))
    second = F.struct(F.lit(1).alias("which"), F.col("start").alias("start"), half.alias("size"),
                      F.substring("word", F.col("start") + half + more + 1, F.col("size") - half).alias("kept"))
    cut = rows.withColumn("h", F.explode(F.array(first, second)))
    return cut.select("word", "side", "h.start", "h.size", F.xxhash64("key", "h.which", "h.kept").alias("key"))


def near_pairs(words: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(a, b): all pairs of words (column ``word``, distinct) that differ by one inserted, deleted or replaced code point, a shorter or smaller."""
    length = F.length("word")
    roles = F.array(*[F.struct(F.lit(side).alias("side"), (length - (1 if side == LONGER else 0)).alias("size")) for side in (CHUNKS, GRAMS, LONGER)])
    open_rows = words.select("word", F.explode(roles).alias("r")).select("word", "r.side", F.lit(0).alias("start"), "r.size", F.xxhash64("r.size").alias("key")).filter("size > 0")
    found = None
    while True:
        rows = cut_lineage(_halves(open_rows))
        sides = rows.groupBy("key").agg(F.count_if(F.col("side") == CHUNKS).alias("chunks"), F.count_if(F.col("side") != CHUNKS).alias("grams"), F.min("size").alias("left"))
        # the word itself is among the grams of its own chunk
        sides = cut_lineage(sides.filter("chunks > 0 and grams > 1").withColumn("shared", (F.col("chunks") * F.col("grams") > pairs) & (F.col("left") > 1)))
        ready = rows.join(sides.filter("not shared").select("key"), "key")
        a = ready.filter(F.col("side") == CHUNKS).select("key", F.col("word").alias("a"))
        b = ready.filter(F.col("side") != CHUNKS).select("key", "side", F.col("word").alias("b"))
        verified = ((F.col("side") == LONGER) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
        step = cut_lineage(a.join(b, "key").filter(verified).select("a", "b").distinct())
        found = step if found is None else found.union(step)
        open_rows = rows.join(sides.filter("shared").select("key"), "key")
        if not sides.filter("shared").limit(1).count():
            return found.distinct()


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO, **counting) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs``.

    ``form`` is the most frequent near word if it occurs at least ``ratio`` times as
    often, ``root`` the last word on the way from form to form.
    """
    words = cut_lineage(word_counts(docs, id_col, text_col, **counting))
    near = cut_lineage(near_pairs(words.select("word")))
    both = near.select(F.col("a").alias("word"), F.col("b").alias("other")).union(near.select("b", "a"))
    other = broadcast_if_small(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = both.join(other, "other").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min_by(F.struct(F.col("other").alias("form"), F.col("other_n").alias("form_n")), F.struct(-F.col("other_n"), "other")).alias("best"))
    known = words.join(best, "word", "left")
    chosen = F.col("best.form_n") >= ratio * F.col("n")
    table = cut_lineage(known.select("word", F.when(chosen, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                     F.when(chosen, F.col("best.form_n")).alias("form_n")))
    # counts at least double from form to form, so ways are short and hold no circle; each round doubles the steps taken
    way = cut_lineage(table.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = broadcast_if_small(way.select(F.col("word").alias("root"), F.col("root").alias("next")))
        stepped = cut_lineage(way.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        way = stepped.select("word", "root")
        if not stepped.filter("moved").limit(1).count():
            break
    return table.join(broadcast_if_small(way), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
