"""Toxicity scores from a bidirectional gated network with attention pooling.

The network (``gated_net``) sees characters and words, is trained in numpy on a
bounded sample of labelled documents, and scores all overlapping windows of every
whole text; a text is as toxic as its worst window. Labels belong to documents, not
windows: a toxic document is learned from the words whose character grams are most
typical of toxic documents; clean documents give random windows first, then also
those that the network finds most toxic.

Scoring is map-only with one broadcast of fixed size; a task holds a slice of a batch
and a bounded table of words.

Defined cases: a null or blank text scores 0; labels other than 0 and 1, and labels
of unknown documents, are ignored; without labels of both kinds every score is 0;
repeated rows get equal scores; an empty table gives no rows; other columns pass through,
and one that has the name of the result is an error.
"""
import math
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from kgloom.llm import gated_net as net
from kgloom.llm.common import add_columns, free_name, held_out, no_cycle_collection

# the sample to fit: so many labelled documents per class at most, none longer than this
TOXIC_SAMPLE, CLEAN_SAMPLE, SAMPLE_CHARS = 900, 2400, 40_000
REJECT = 0.7
SEED, RATE, BATCH, STEPS = 7, 0.01, 64, 400
# characters per gram, and documents a word must be in for a vector of its own
GRAM, COMMON = 5, 3


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic of documents that are not held out: of each class those with the smallest hash of the id, a bounded number in one partition."""
    ids = labels.select("doc_id", "toxic").filter(~held_out("doc_id", 3, 1) & F.col("doc_id").isNotNull())
    picked = [ids.filter(F.col("toxic") == y).select("doc_id", "toxic").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
              for y, n in ((1, TOXIC_SAMPLE), (0, CLEAN_SAMPLE))]
    picked = F.broadcast(picked[0].union(picked[1]).withColumnRenamed("doc_id", "_id"))
    rows = docs.select("doc_id", "text").filter(F.length("text").between(1, SAMPLE_CHARS)).join(picked, F.col("doc_id") == F.col("_id"))
    # repeated ids could make more rows than were picked
    return rows.select("doc_id", "text", "toxic").orderBy("doc_id", "text").limit(TOXIC_SAMPLE + CLEAN_SAMPLE).select("text", F.col("toxic").cast("int").alias("toxic"))


def _grams(word: str) -> set[str]:
    word = f"^{word}$"
    return {word[i:i + GRAM] for i in range(max(1, len(word) - GRAM + 1))}


def _marked_words(lists: list[list[str]], labels: np.ndarray) -> list[list[int]]:
    """Per toxic document, the places of the words whose grams are most typical of toxic documents."""
    counts = [Counter(), Counter()]
    for y in (1, 0):
        for words, own in zip(lists, labels):
            if own == y:  # of clean documents only grams count that toxic ones have
                counts[y].update({g for w in set(words) for g in _grams(w) if y or g in counts[1]})
    sizes = [max(1, int((labels == y).sum())) for y in (0, 1)]
    weight = {g: math.log((n + 0.1) / sizes[1]) - math.log((counts[0][g] + 1.0) / sizes[0]) for g, n in counts[1].items() if n > 1}
    marks = []
    for words, y in zip(lists, labels):
        found = [max(weight.get(g, -9.0) for g in _grams(w)) for w in words] if y else []
        least = max(found, default=0.0) - 1.0
        marks.append([i for i, x in enumerate(found) if x >= least])
    return marks


def train(sample: list[tuple[str, int]], steps: int = STEPS) -> dict | None:
    """The network and its table of common words, with a shift that puts the rejection limit between the classes; None without both classes.

    Half of the toxic examples are windows around a marked word; the others are a
    marked word with few neighbours put into the window of a clean document, so that
    the network learns the words and not what happens to stand around them.
    """
    rows = [([net.bare(w) for w in words], y) for words, y in ((net.words_of(t), y) for t, y in sample) if words]
    labels = np.array([y for _, y in rows], dtype=np.int64)
    if not 0 < labels.sum() < len(labels):
        return None
    lists = [w for w, _ in rows]
    rng, params = np.random.default_rng(SEED), net.new_params(SEED)
    adam = net.Adam(params, RATE)
    toxic, clean = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    marks = _marked_words(lists, labels)
    seen = Counter(net.word_bucket(w) for words in lists for w in set(words))
    common = np.zeros(net.WORD_BUCKETS, dtype=bool)
    common[[b for b, n in seen.items() if n >= COMMON]] = True
    hard: list[list[str]] = []

    def clean_window() -> list[str]:
        if hard and rng.random() < 0.5:
            return hard[rng.integers(len(hard))]
        words = lists[rng.choice(clean)]
        start = int(rng.integers(0, max(1, len(words) - net.WINDOW + 1)))
        return words[start:start + net.WINDOW]

    def toxic_window(j: int) -> list[str]:
        words, mark = lists[j], int(rng.choice(marks[j]))
        if rng.random() < 0.5:
            start = max(0, min(mark - int(rng.integers(0, net.WINDOW)), len(words) - net.WINDOW))
            return words[start:start + net.WINDOW]
        span = words[max(0, mark - int(rng.integers(0, 3))):mark + 1 + int(rng.integers(0, 3))]
        around = list(clean_window())
        at = int(rng.integers(0, max(1, len(around) - len(span) + 1)))
        around[at:at + len(span)] = span
        return around[:net.WINDOW]

    for step in range(steps):
        if step in (steps // 3, steps // 2, 2 * steps // 3, 5 * steps // 6):
            hard = _worst_windows(net.Scorer(params, common), [lists[j] for j in clean])
        y = (np.arange(BATCH) < BATCH // 2).astype(np.float32)
        batch = [toxic_window(j) for j in rng.choice(toxic, BATCH // 2)] + [clean_window() for _ in range(BATCH - BATCH // 2)]
        adam.rate = RATE * min(1.0, 2 * (1 - step / steps) + 0.02)
        adam.step(net.gradients(params, batch, y, common)[1])
    # the limit goes between the largest windows of clean and of toxic texts
    scorer = net.Scorer(params, common)
    logits = np.concatenate([scorer.texts([" ".join(w) for w in lists[a:a + 100]]) for a in range(0, len(lists), 100)])
    params["out_b"] = params["out_b"] + np.float32(math.log(REJECT / (1 - REJECT)) - _boundary(logits, labels))
    return {"params": params, "common": common}


def _worst_windows(scorer: net.Scorer, lists: list[list[str]]) -> list[list[str]]:
    """The window of each clean text that the network finds most toxic, worst texts first, a quarter of them."""
    worst = []
    for a in range(0, len(lists), 100):
        part = lists[a:a + 100]
        logits, owner = scorer.windows([" ".join(w) for w in part])
        for j, words in enumerate(part):
            own = np.flatnonzero(owner == j)
            top = int(logits[own].argmax())
            worst.append((float(logits[own[top]]), words[top * net.STRIDE:top * net.STRIDE + net.WINDOW]))
    worst.sort(key=lambda x: -x[0])
    return [w for _, w in worst[:max(30, len(worst) // 4)]]


def _boundary(logits: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the gap that separates the classes with the fewest weighted errors."""
    order = np.argsort(logits)
    x, y = logits[order], labels[order]
    lost = np.concatenate([[0], np.cumsum(y)]) / max(1, y.sum())
    kept = np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]]) / max(1, (1 - y).sum())
    at = np.flatnonzero(np.isclose(lost + kept, (lost + kept).min()))
    edges = np.concatenate([[x[0] - 1], x, [x[-1] + 1]])
    return float(max(((edges[i + 1] - edges[i], (edges[i + 1] + edges[i]) / 2) for i in at.tolist()), key=lambda g: g[0])[1])


def score_toxicity(docs: DataFrame, model: dict | None, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text, from 0 to 1."""
    sent = docs.sparkSession.sparkContext.broadcast({"model": model})

    def make(texts: list) -> list:
        state = sent.value
        if state["model"] is None:
            return [pa.array(np.zeros(len(texts)))]
        if "scorer" not in state:
            state["scorer"] = net.Scorer(**state["model"])
        with np.errstate(over="ignore"):
            return [pa.array(1.0 / (1.0 + np.exp(-state["scorer"].texts(texts))))]
    return add_columns(docs, text_col, StructType().add(out, DoubleType()), make)


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sample = [(t, y) for b in batches for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist())]
    with no_cycle_collection():
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(sample))], pa.binary())], names=["model"])


def fit(docs: DataFrame, labels: DataFrame) -> dict | None:
    """The model of ``train``: one task fits it on the bounded sample, the driver gets its parameters only."""
    models = labelled_sample(docs, labels).coalesce(1).mapInArrow(_fit, "model binary").collect()
    return pickle.loads(models[0]["model"]) if models else None


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score_toxicity(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = REJECT) -> DataFrame:
    """Rows of ``docs`` that score below the limit; all columns as they are."""
    name = free_name(docs, "_toxicity")
    return score_toxicity(docs, fit(docs, labels), out=name).filter(F.col(name) < limit).drop(name)
