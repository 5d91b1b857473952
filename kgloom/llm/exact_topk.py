"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors are put in an order in which alike ones follow each other, and cut into
blocks of consecutive vectors. A block keeps its vectors as a forward index and, per
component, the largest and smallest value. For a query, the sum over components of
the greater of (query x largest, query x smallest) bounds every score of the block.
A query takes the blocks of a group in descending order of this bound, scores whole
blocks, and stops where bounds fall below its k-th score.

Two visits: in the first a query scores the most promising block of every group only.
The k-th best of those scores is a floor for the second visit, in which a group gives
only rows that reach it. What fails the floor of one group is pruned in all others.

Scores are exact: in double precision where no sum can leave 53 bits, else in whole
numbers of any size (given back as the nearest 64-bit number).

Defined cases: null vectors, vectors with null or non-finite components and rows
without id take no part; vectors of different lengths do not meet; empty vectors
score 0; rows that repeat an id are rows of their own, each a candidate of the others
and, if its id is a query's, a query; equal scores go to the smaller vec_id; an empty
table gives no rows; further columns are not read.
"""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import cut_lineage
from kgloom.llm.vector_cells import group_count, in_cells, integer_vectors, matrices, numbers, top_rows, visits

SCALE = 1024
K = 10
EVERY = 100
BLOCK = 128
# signs of random directions that order the vectors; a sample of this many places gives the borders of groups
SIGNS, SEED, SAMPLED = 20, 7, 20_000
# queries that are worked on at once, and blocks per wave at most
QUERIES, WAVE = 512, 64
EXACT = float(1 << 53)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds where a vector stands in the order: the signs along some directions as a number, and a fraction that splits equal ones."""
    for batch in batches:
        place = np.zeros(batch.num_rows)
        for own, matrix in matrices(batch):
            directions = np.random.default_rng(SEED).standard_normal((matrix.shape[1], SIGNS))
            place[own] = (matrix @ directions >= 0) @ (1 << np.arange(SIGNS)[::-1]) if matrix.shape[1] else 0
        place += batch.column("part").to_numpy()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, "place"])


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of the rows of two integer matrices, in double precision if that holds them, else as Python integers."""
    largest = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(1, a.shape[1])
    return a.astype(np.float64) @ b.T.astype(np.float64) if largest < EXACT else a.astype(object) @ b.T.astype(object)


class _Blocks:
    """Vectors of one length in a group: forward indexes of blocks and their component bounds."""

    def __init__(self, matrix, ids, rows):
        cuts = range(0, len(ids), BLOCK)
        self.parts = []
        for c in cuts:
            inside = c + np.lexsort((rows[c:c + BLOCK], ids[c:c + BLOCK]))  # ties of a block go to the first row
            self.parts.append((matrix[inside], ids[inside], rows[inside]))
        self.top = np.stack([m.max(axis=0) for m, _, _ in self.parts])
        self.low = np.stack([m.min(axis=0) for m, _, _ in self.parts])

    def bounds(self, asked: np.ndarray) -> np.ndarray:
        return _dot(np.maximum(asked, 0), self.top) + _dot(np.minimum(asked, 0), self.low)

    def score(self, at: int, asked: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int):
        """(query, score, id, row) of the k best of a block for each query that reach its floor."""
        matrix, ids, rows = self.parts[at]
        scores = _dot(matrix, asked)
        order = np.argsort(-scores, axis=0, kind="stable")[:k + 1]
        best = np.take_along_axis(scores, order, axis=0)
        good = (best >= floor) & (rows[order] != own)
        place, query = np.nonzero(good)
        taken = order[place, query]
        return query, best[place, query], ids[taken], rows[taken]


def _best(query, score, ids, rows, k):
    """The k best entries of each query, and their order by query."""
    order = np.lexsort((rows, ids, -score, query)) if score.dtype != object else np.array(
        sorted(range(len(query)), key=lambda i: (query[i], -score[i], ids[i], rows[i])), dtype=np.int64)
    query, score, ids, rows = query[order], score[order], ids[order], rows[order]
    first = np.searchsorted(query, query)
    keep = np.arange(len(query)) - first < k
    return query[keep], score[keep], ids[keep], rows[keep]


def search_blocks(blocks: _Blocks, asked: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int, waves: int | None = None):
    """(query, score, id, row): per query the k best rows that reach its floor, block by block in descending order of bounds."""
    bounds = blocks.bounds(asked)
    order = np.argsort(-bounds, axis=1, kind="stable")
    kind = bounds.dtype
    floor = floor.astype(kind)
    held = (np.zeros(0, np.int64), np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.int64))
    at, width, done = 0, 1, 0
    while at < order.shape[1] and (waves is None or done < waves):
        wave = order[:, at:at + width]
        wanted = np.take_along_axis(bounds, wave, axis=1) >= floor[:, None]
        if not wanted[:, 0].any():
            break
        query, _ = np.nonzero(wanted)
        block = wave[wanted]
        found = [held]
        for b in np.unique(block).tolist():
            who = query[block == b]
            q, s, i, r = blocks.score(b, asked[who], own[who], floor[who], k)
            found.append((who[q], s.astype(kind), i, r))
        held = _best(*[np.concatenate(x) for x in zip(*found)], k)
        full, counts = np.unique(held[0], return_counts=True)
        last = np.searchsorted(held[0], full, side="right") - 1
        enough = counts == k
        floor[full[enough]] = np.maximum(floor[full[enough]], held[1][last[enough]])
        at, width, done = at + width, min(WAVE, width * 2), done + 1
    return held


def _as_longs(score: np.ndarray) -> pa.Array:
    if score.dtype == object:
        return pa.array([max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in score], pa.int64())
    return pa.array(score.astype(np.int64))


FOUND = "query_row long, query_id long, vec_id long, row long, score long"


def _search(k: int, first_only: bool):
    def hold(table: pa.Table) -> dict:
        ids, rows = numbers(table, "vec_id"), numbers(table, "row")
        return {m.shape[1]: _Blocks(m, ids[own], rows[own]) for own, m in matrices(table)}

    def ask(held: dict, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, rows = numbers(batch, "vec_id"), numbers(batch, "row")
        # a floor at the end of 64 bits may stand for any lower one
        floors = np.array([-(1 << 200) if f is None or f == -(1 << 63) else f for f in batch.column("floor").to_pylist()], dtype=object)
        for own, asked in matrices(batch):
            if asked.shape[1] not in held:
                continue
            for a in range(0, len(own), QUERIES):
                part = own[a:a + QUERIES]
                q, s, i, r = search_blocks(held[asked.shape[1]], asked[a:a + QUERIES], rows[part], floors[part], k, 1 if first_only else None)
                if len(q):
                    yield pa.RecordBatch.from_arrays([pa.array(rows[part][q]), pa.array(ids[part][q]), pa.array(i), pa.array(r), _as_longs(s)],
                                                     names=["query_row", "query_id", "vec_id", "row", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from visits(batches, hold, ask)
    return run


def _grouped(rows: DataFrame, groups: int) -> DataFrame:
    """Rows with ``place`` and the group of their stretch of the order."""
    part = F.pmod(F.xxhash64("row"), F.lit(1 << 20)) / float(1 << 21)
    placed = rows.withColumn("part", part)
    schema = placed.withColumn("place", F.lit(0.0)).schema
    placed = cut_lineage(placed.mapInArrow(_places, schema))
    # a bounded number of places gives the borders; they only decide how evenly groups are filled
    seen = sorted(r[0] for r in placed.orderBy(F.xxhash64("row")).select("place").limit(SAMPLED).collect())
    borders = [seen[len(seen) * g // groups] for g in range(1, groups)] if seen else []
    at = F.array(*[F.lit(b) for b in borders]) if borders else F.array().cast("array<double>")
    # borders ascend, so the number of those below the place is the group
    return placed.withColumn("grp", F.size(F.filter(at, lambda b: b <= F.col("place")))).drop("part")


def exact_topk(vectors: DataFrame, k: int = K, every: int = EVERY, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of highest inner product for each row whose id is divisible by ``every``."""
    rows = integer_vectors(vectors, scale, id_col=id_col, vector_col=vector_col)
    groups = group_count(rows)
    grouped = cut_lineage(_grouped(rows, groups))
    queries = rows.filter(F.col("vec_id") % every == 0).select("row", "vec_id", "comps")

    def visit(asked: DataFrame, first_only: bool) -> DataFrame:
        return in_cells(grouped, asked, groups, ["place"]).mapInArrow(_search(k, first_only), FOUND)
    best = ["query_row"], [F.col("score").desc(), "vec_id", "row"]
    seeds = top_rows(visit(queries.withColumn("floor", F.lit(None).cast("long")), True), *best, k)
    floors = seeds.filter(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").alias("floor"))
    asked = cut_lineage(queries.join(floors, "row", "left"))
    found = top_rows(visit(asked, False), *best, k)
    return found.select("query_id", "rank", "vec_id", "score")


SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024*x::double)) as c from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x)))=0),
s as (select q.vec_id as query_id, v.vec_id, list_inner_product(q.c, v.c)::bigint as score from v q join v on v.vec_id<>q.vec_id where q.vec_id%100=0)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s qualify rank<=10"""
