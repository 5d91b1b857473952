"""Hard negatives by Kronecker-packed inner products.

The candidates of a block are biased to non-negative numbers, and component j of all
of them is packed into separated fields of one wide integer. The inner products of an
anchor with the whole block then take one multiplication per anchor component: the
sum of (anchor component x packed component) holds every product sum in a field of
its own. A constant is added so that no field is negative, fields are unpacked, and
bias and constant taken off. Fields are as wide as the largest possible sum, so the
scores are exact for any components.

Two visits of all anchors to all groups: the first finds the positives among the rows
of the anchor's label, the second the best rows of other labels inside the window of
each positive. Blocks hold rows of one label, so either visit multiplies only blocks
that can matter. A group gives at most ``negatives`` rows per positive.

Defined cases: rows with a null label, null vectors, vectors with null or non-finite
components and rows without id take no part; vectors of different lengths do not
meet; empty vectors score 0; rows that repeat an id are rows of their own; equal
scores go to the smaller vec_id; a positive with a negative score has no window, as
its bounds cross; an empty table gives no rows; further columns are not read.
"""
from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import cut_lineage
from kgloom.llm.vector_cells import group_count, in_cells, integer_vectors, matrices, numbers, top_rows, visits

SCALE = 256
EVERY = 100
POSITIVES, NEGATIVES = 5, 10
# window of a negative's score, in percent of the positive's
LOW, HIGH = 30, 90
# candidates per packed integer
BLOCK = 256
LONG = (-(1 << 63), (1 << 63) - 1)


class PackedBlock:
    """Up to ``BLOCK`` vectors of one length, component by component in fields of one integer each."""

    def __init__(self, matrix: np.ndarray):
        self.count, self.dims = matrix.shape
        low, high = (int(matrix.min()), int(matrix.max())) if matrix.size else (0, 0)
        self.bias, self.largest = -low, high - low
        self.matrix, self.packed, self.width = matrix, None, 0

    def _pack(self, width: int) -> None:
        """Packs all components in fields of ``width`` bytes."""
        if self.packed is not None and self.width == width:
            return
        if width <= 8:
            fields = (self.matrix + self.bias).T.astype(f"<u{width}")
            self.packed = [int.from_bytes(row.tobytes(), "little") for row in np.ascontiguousarray(fields)]
        else:
            self.packed = [int.from_bytes(b"".join((int(x) + self.bias).to_bytes(width, "little") for x in row), "little") for row in self.matrix.T]
        self.ones = int.from_bytes((b"\1" + bytes(width - 1)) * self.count, "little")
        self.width = width

    def scores(self, anchor: list[int]):
        """Inner products with ``anchor``: int64 if every one is sure to fit, else Python integers."""
        reach = sum(map(abs, anchor)) * self.largest + 1
        width = next((w for w in (4, 8) if 2 * reach < 1 << (8 * w)), (2 * reach).bit_length() // 8 + 1)
        if self.width < width:  # wider fields serve later anchors as well
            self._pack(width)
        width = self.width
        total = sum(map(mul, anchor, self.packed), reach * self.ones).to_bytes(width * self.count, "little")
        offset = reach + self.bias * sum(anchor)
        if width <= 8 and abs(offset) < 1 << 62 and 2 * reach < 1 << 62:
            return np.frombuffer(total, dtype=f"<u{width}").astype(np.int64) - offset
        return np.array([int.from_bytes(total[i:i + width], "little") - offset for i in range(0, len(total), width)], dtype=object)


class _Group:
    """Blocks of a group by vector length and label, with ids and rows in one array each per (length, label)."""

    def __init__(self, table: pa.Table):
        ids, rows, labels = numbers(table, "vec_id"), numbers(table, "row"), np.array(table.column("label").to_pylist(), dtype=object)
        self.parts: dict = {}
        for own, matrix in matrices(table):
            names, inverse = np.unique(labels[own], return_inverse=True)
            for at, label in enumerate(names):
                inside = np.flatnonzero(inverse == at)
                inside = inside[np.lexsort((rows[own][inside], ids[own][inside]))]
                blocks = [PackedBlock(matrix[inside[c:c + BLOCK]]) for c in range(0, len(inside), BLOCK)]
                self.parts.setdefault(matrix.shape[1], {})[label] = (blocks, ids[own][inside], rows[own][inside])

    def scored(self, anchor: list[int], label, same: bool):
        """Scores, ids and rows of all rows with the anchor's label, or of all others."""
        for name, (blocks, ids, rows) in self.parts.get(len(anchor), {}).items():
            if (name == label) == same:
                found = [b.scores(anchor) for b in blocks]
                yield (np.concatenate(found) if all(f.dtype != object for f in found) else np.concatenate([f.astype(object) for f in found])), ids, rows


def _first(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, equal scores by id."""
    if len(scores) > 4 * k and scores.dtype != object:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, level = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        if len(level) > k:
            level = level[np.lexsort((rows[level], ids[level]))[:k]]
        kept = np.concatenate([above, level])
    else:
        kept = np.arange(len(scores))
    order = sorted(kept.tolist(), key=lambda i: (-scores[i], ids[i], rows[i])) if scores.dtype == object else kept[np.lexsort((rows[kept], ids[kept], -scores[kept]))]
    return np.asarray(order[:k], dtype=np.int64)


def _put_together(parts: list):
    scores = [s for s, _, _ in parts]
    if any(s.dtype == object for s in scores):
        scores = [s.astype(object) for s in scores]
    return np.concatenate(scores), np.concatenate([i for _, i, _ in parts]), np.concatenate([r for _, _, r in parts])


POSITIVE = "anchor_row long, anchor_id long, positive_id long, positive_row long, positive_score long"


def _clamped(x) -> int:
    return max(LONG[0], min(LONG[1], int(x)))


def _find_positives(k: int):
    def ask(held: _Group, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for anchor_id, own, label, comps in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "row", "label", "comps"))):
            for scores, ids, rows in held.scored(comps, label, True):
                best = [i for i in _first(scores, ids, rows, k + 1).tolist() if rows[i] != own][:k]
                out += [(own, anchor_id, int(ids[i]), int(rows[i]), _clamped(scores[i])) for i in best]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=[c.split()[0] for c in POSITIVE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from visits(batches, _Group, ask)
    return run


NEGATIVE = POSITIVE + ", negative_id long, negative_row long, negative_score long"


def window(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """Least and greatest whole score s with low x score <= 100 s <= high x score."""
    return -(-low * score // 100), high * score // 100


def _find_negatives(k: int, low: int, high: int):
    def ask(held: _Group, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for anchor_id, own, label, comps, positives in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "row", "label", "comps", "positives"))):
            spans = {p["positive_score"]: window(p["positive_score"], low, high) for p in positives}
            spans = {p: s for p, s in spans.items() if s[0] <= s[1]}
            if not spans:
                continue
            least, most = min(s[0] for s in spans.values()), max(s[1] for s in spans.values())
            parts = []
            for scores, ids, rows in held.scored(comps, label, False):
                near = np.flatnonzero((scores >= least) & (scores <= most))
                if len(near):
                    parts.append((scores[near], ids[near], rows[near]))
            if not parts:
                continue
            scores, ids, rows = _put_together(parts)
            best = {}
            for p, (a, b) in spans.items():
                inside = np.flatnonzero((scores >= a) & (scores <= b))
                best[p] = inside[_first(scores[inside], ids[inside], rows[inside], k)]
            out = [(own, anchor_id, p["positive_id"], p["positive_row"], p["positive_score"], int(ids[i]), int(rows[i]), _clamped(scores[i]))
                   for p in positives for i in best.get(p["positive_score"], ())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=[c.split()[0] for c in NEGATIVE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from visits(batches, _Group, ask)
    return run


def hard_negatives(vectors: DataFrame, label=None, positives: int = POSITIVES, negatives: int = NEGATIVES, every: int = EVERY, scale: float = SCALE,
                   low: int = LOW, high: int = HIGH, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``; ``label`` is an expression
    that replaces the label column.
    """
    named = F.col(label_col) if label is None else label
    rows = integer_vectors(vectors.filter(named.isNotNull()), scale, named.alias("label"), id_col=id_col, vector_col=vector_col)
    groups = group_count(rows)
    grouped = rows.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
    anchors = rows.filter(F.col("vec_id") % every == 0)
    found = top_rows(in_cells(grouped, anchors, groups, []).mapInArrow(_find_positives(positives), POSITIVE),
                     ["anchor_row"], [F.col("positive_score").desc(), "positive_id", "positive_row"], positives)
    chosen = found.groupBy(F.col("anchor_row").alias("row")).agg(F.collect_list(F.struct("positive_id", "positive_row", "positive_score")).alias("positives"))
    asked = cut_lineage(anchors.join(chosen, "row"))
    mined = top_rows(in_cells(grouped, asked, groups, []).mapInArrow(_find_negatives(negatives, low, high), NEGATIVE),
                     ["anchor_row", "positive_row"], [F.col("negative_score").desc(), "negative_id", "negative_row"], negatives)
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def shifted_labels(classes: int = 10, every: int = 7):
    """The label, one further (around ``classes``) where vec_id is divisible by ``every``."""
    return F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % classes).otherwise(F.col("label"))


def mined_negatives(vectors: DataFrame) -> DataFrame:
    """Hard negatives of the labels with a seventh of them shifted."""
    return hard_negatives(vectors, shifted_labels())


SQL = """
with v as (select vec_id, case when vec_id%7=0 then (label+1)%10 else label end as label, list_transform(embedding, lambda x: floor(256*x::double)) as c from embeddings
           where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x)))=0),
s as (select a.vec_id as anchor_id, v.vec_id, a.label=v.label as same, list_inner_product(a.c, v.c)::bigint as score from v a join v on v.vec_id<>a.vec_id where a.vec_id%100=0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id)<=5)
select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by score desc, vec_id))::int as rank, vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 100*score between 30*positive_score and 90*positive_score qualify rank<=10"""
