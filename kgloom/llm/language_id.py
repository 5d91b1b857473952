"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of every labelled text per language and hash bucket; tasks
count in numpy, Spark adds the counts up. The matrix of log probabilities has a
fixed number of cells and is broadcast. The n-grams of a batch of texts are one sparse
matrix, whose product with it scores all texts of the batch, block by block.

Defined cases: a null text or one without a letter is ``und`` with score 0; a text
is read whole; ties go to the first language in alphabetical order; without any
labelled text every document is ``und``; repeated rows get equal results; an empty
table gives no rows; a column that has the name of the result is an error.
"""
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from kgloom.llm.common import add_columns, free_name, held_out

SIZES = (1, 2, 3)
# cells of the matrix at most; buckets are halved until buckets x languages fits, so a broadcast has at most 16 MB
CELLS = 1 << 22
BUCKETS = 1 << 16
BLOCK = 1 << 18
SMOOTHING = 0.5
# evidence of this many n-grams makes a prediction certain; more of it is scaled down
EVIDENCE = 50.0
UNDETERMINED = "und"
# a pipeline keeps documents from this score on
LEAST_SCORE = 0.5


def hashed_grams(part: np.ndarray, here: int, buckets: int) -> Iterator[np.ndarray]:
    """Buckets of the n-grams that begin at the first ``here`` characters of ``part``, one array per size; those past its end are left out."""
    hashed = np.zeros(len(part), dtype=np.uint32)
    for n in range(1, max(SIZES) + 1):
        hashed = (hashed[:max(0, len(part) - n + 1)] * np.uint32(0x01000193)) ^ (part[n - 1:] * np.uint32(0x9E3779B1))
        if n in SIZES:
            mixed = hashed[:here] ^ (hashed[:here] >> np.uint32(15))
            yield (mixed * np.uint32(0x85EBCA6B) >> np.uint32(32 - int(buckets).bit_length() + 1)).astype(np.int32)


def gram_buckets(text: str, buckets: int) -> Iterator[np.ndarray]:
    """Hash buckets of all character n-grams of the lower-cased text, in blocks; blocks overlap so that none is lost."""
    codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    for at in range(0, len(codes), BLOCK):
        yield from hashed_grams(codes[at:at + BLOCK + max(SIZES) - 1], min(BLOCK, len(codes) - at), buckets)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict:
    """Languages in order and the matrix of log probabilities (buckets x languages), from all labelled texts."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    langs = sorted(r[0] for r in rows.select("lang").distinct().limit(CELLS // 256 + 1).collect())
    if len(langs) > CELLS // 256:
        raise ValueError(f"more than {CELLS // 256} languages: the table of log probabilities would have no fixed size")
    buckets = BUCKETS
    while buckets > 256 and buckets * len(langs) > CELLS:
        buckets //= 2
    if not langs:
        return {"langs": [], "matrix": np.zeros((buckets, 0), dtype=np.float32)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # one row of counts per language of the task
        seen: dict = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"]):
                total = seen.setdefault(lang, np.zeros(buckets, dtype=np.int64))
                for ids in gram_buckets(text, buckets):
                    if len(ids) > buckets // 8:
                        total += np.bincount(ids, minlength=buckets)
                    else:
                        np.add.at(total, ids, 1)
        for lang, total in seen.items():
            hit = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": hit, "n": total[hit]})

    counts = rows.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    matrix = np.full((buckets, len(langs)), SMOOTHING)
    matrix[counts["bucket"].to_numpy(dtype=np.int64), np.searchsorted(np.array(langs), counts["lang"].to_numpy(dtype=str))] += counts["n"].to_numpy(dtype=float)
    return {"langs": langs, "matrix": np.log(matrix / matrix.sum(axis=0)).astype(np.float32)}


def scores(texts: list[str], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log probabilities texts x languages, number of n-grams) of a batch.

    The batch is one sparse matrix, texts x buckets with an entry for each n-gram; its
    product with the dense matrix of log probabilities is summed up block by block.
    """
    coded = [np.frombuffer((" " + t.lower() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    sizes = np.array([len(c) for c in coded])
    codes, owner = np.concatenate(coded), np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters to the end of the text
    total, grams, longest = np.zeros((len(texts), matrix.shape[1])), np.zeros(len(texts), dtype=np.int64), max(SIZES)
    for at in range(0, len(codes), BLOCK):
        here = min(BLOCK, len(codes) - at)
        for n, found in zip(SIZES, hashed_grams(codes[at:at + BLOCK + longest - 1], here, len(matrix))):
            inside = left[at:at + len(found)] >= n  # an n-gram belongs to one text
            found, own = found[inside], owner[at:at + len(found)][inside]
            if len(found):
                starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                total[own[starts]] += np.add.reduceat(np.take(matrix, found, axis=0), starts, axis=0, dtype=np.float64)
                grams[own[starts]] += np.diff(np.append(starts, len(own)))
    return total, grams


def classify(texts: list, langs: list, matrix: np.ndarray) -> tuple[list, np.ndarray]:
    """Language and score of each text of a batch."""
    found, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    known = [i for i, t in enumerate(texts) if langs and t and any(map(str.isalpha, t))]
    if known:
        total, grams = scores([texts[i] for i in known], matrix)
        best = total.argmax(axis=1)
        scale = np.minimum(1.0, EVIDENCE / grams)[:, None]
        score[known] = 1.0 / np.exp((total - total.max(axis=1, keepdims=True)) * scale).sum(axis=1)
        for i, b in zip(known, best.tolist()):
            found[i] = langs[b]
    return found, score


def identify(docs: DataFrame, model: dict, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct of lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast((model["langs"], model["matrix"]))
    kind = StructType().add("lang_pred", StringType()).add("score", DoubleType())

    def make(texts: list) -> list:
        found, score = classify(texts, *sent.value)
        return [pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(score)], names=kind.names)]
    return add_columns(docs, text_col, StructType().add(out, kind), make)


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from labelled documents that are not held out."""
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id", 4, 2))
    model = train(rows.filter(~F.col("held_out")))
    return identify(rows, model).select("doc_id", "held_out", "language.lang_pred", "language.score")


def keep_identified(docs: DataFrame, model: dict, least: float = LEAST_SCORE, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose language is determined with at least this score; all columns as they are."""
    name = free_name(docs, "_language")
    known = identify(docs, model, text_col, name)
    return known.filter((F.col(f"{name}.lang_pred") != UNDETERMINED) & (F.col(f"{name}.score") >= least)).drop(name)
