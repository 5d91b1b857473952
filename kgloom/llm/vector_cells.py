"""Integer vectors in groups of bounded size, and the queries that visit them.

A group holds a bounded number of components and is what a task keeps in memory;
the number of groups grows with the table. Queries are a small part of the rows; they
are dealt out to every group and pass through it in batches, so no task or driver
holds all queries, and the rows of a group are moved once.
"""
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.llm.common import cut_lineage

# components that a group holds at most, on average
GROUP_COMPONENTS = 1 << 23
# groups per core of a small table
LEAST_PER_CORE = 2


def integer_vectors(vectors: DataFrame, scale: float, *keep: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """row, vec_id, ``keep``, comps (floor of ``scale`` times each component) of the vectors that take part.

    Rows without id, null vectors, and vectors with null or non-finite components
    take no part. Components beyond 64 bits become the nearest such number.
    """
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.filter(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & finite)
    comps = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))))
    return cut_lineage(rows.select(F.col(id_col).cast("long").alias("vec_id"), *keep, comps.alias("comps")).withColumn("row", F.monotonically_increasing_id()))


def group_count(rows: DataFrame, limit: int = GROUP_COMPONENTS) -> int:
    total = rows.agg(F.sum(F.size("comps"))).first()[0] or 0
    return max(LEAST_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism, -(-total // limit))


def in_cells(rows: DataFrame, queries: DataFrame, groups: int, order: list) -> DataFrame:
    """Rows (with a column ``grp``) and, in every group, all queries after them; rows in the given order."""
    dealt = queries.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    both = rows.withColumn("asks", F.lit(False)).unionByName(dealt.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    return both.repartition(groups, "grp").sortWithinPartitions("grp", "asks", *order)


def visits(batches: Iterator[pa.RecordBatch], hold: Callable, ask: Callable) -> Iterator:
    """Runs ``hold(table)`` on the rows of each group, then yields from ``ask(held, batch)`` for every batch of its queries."""
    group, waiting, held = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        grp, asks = batch.column("grp").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((grp[1:] != grp[:-1]) | (asks[1:] != asks[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(grp)]):
            part = batch.slice(a, b - a)
            if grp[a] != group:
                group, waiting, held = grp[a], [], None
            if not asks[a]:
                waiting.append(part)
                continue
            if held is None:
                held, waiting = hold(pa.Table.from_batches(waiting, batch.schema).combine_chunks()), []
            yield from ask(held, part)


def matrices(table) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, integer matrix) of the rows of each vector length."""
    column = table.column("comps")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    starts = np.cumsum(sizes) - sizes
    return [(own, flat[starts[own][:, None] + np.arange(n)]) for n in np.unique(sizes).tolist() for own in [np.flatnonzero(sizes == n)]]


def numbers(table, name: str) -> np.ndarray:
    column = table.column(name)
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).to_numpy(zero_copy_only=False)


def top_rows(df: DataFrame, keys: list, order: list, k: int) -> DataFrame:
    """The first ``k`` rows per key with their ``rank``; cut in the tasks before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
