"""Near-duplicate vectors: sign hashing in several tables, exact cosines, connected components.

Vectors of equal label and equal direction form a class, so copies are compared
once. Each table hashes a class by the signs of some random hyperplanes. Only
classes that share a bucket of a table are compared, by their exact cosine in
double precision; a pair that meets in several tables counts in the first of them.
A bucket that is larger than a block is dealt out as pairs of blocks, so no task
holds more than two blocks however large a bucket is, and no pair list is written:
a task returns link counts per class and a spanning forest of the links it found.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows without label, link with nothing and are their own component;
vectors of different lengths never link; rows that repeat an id are vectors like
others; an empty table gives no rows.
"""
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import cut_lineage, pairs_within, whole_groups
from kgloom.llm.components import connected_components

THRESHOLD = 0.93
# a pair at the threshold agrees in one bit with probability 0.88, in all bits of one of these tables with 0.98
TABLES = 48
BITS = 20
SEED = 42
# classes of a bucket per block
BLOCK = 512


def _hyperplanes(dims: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dims, TABLES * BITS))


def _matrices(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix in double precision) per vector length; null vectors are left out, null components are NaN."""
    if column.null_count:
        kept = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        column = column.take(pa.array(kept))
    else:
        kept = np.arange(len(column))
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    return [(kept[own], flat[starts[own][:, None] + np.arange(n)]) for n in np.unique(sizes) for own in [np.flatnonzero(sizes == n)] if n]


def _hash_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the vector at unit length, a digest of it and one bucket per table; unusable vectors get nulls."""
    planes: dict = {}
    powers = (1 << np.arange(BITS)).astype(np.int64)
    for batch in batches:
        labelled = batch.column("label").is_valid().to_numpy(zero_copy_only=False)
        units, digests, buckets = ([None] * batch.num_rows for _ in range(3))
        for rows, matrix in _matrices(batch.column("embedding")):
            largest = np.abs(matrix).max(axis=1)
            good = np.isfinite(largest) & (largest > 0) & labelled[rows]
            rows, unit = rows[good], matrix[good] / largest[good, None]
            unit /= np.sqrt((unit * unit).sum(axis=1))[:, None]
            dims = matrix.shape[1]
            if dims not in planes:
                planes[dims] = _hyperplanes(dims)
            hashed = (unit @ planes[dims] >= 0).reshape(-1, TABLES, BITS) @ powers
            for at, u, h in zip(rows.tolist(), unit, hashed):
                units[at], digests[at], buckets[at] = u, blake2b(u.tobytes(), digest_size=16).hexdigest(), h
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(units, pa.list_(pa.float64())), pa.array(digests, pa.string()),
                                          pa.array(buckets, pa.list_(pa.int64()))], names=["vec_id", "label", "unit", "digest", "buckets"])


GROUP = ["dims", "label", "table", "bucket", "low", "high"]


def _links(rows: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """Link counts and a spanning forest of the links inside the groups of ``rows``, which are sorted by group."""
    for n in rows.column("dims").unique().to_pylist():
        own = rows.filter(pa.compute.equal(rows.column("dims"), n)).combine_chunks()
        unit = own.column("unit").combine_chunks().flatten().to_numpy().reshape(-1, n)
        seen = own.column("buckets").combine_chunks().flatten().to_numpy().reshape(-1, TABLES)
        cls, copies, block, table, group = (own.column(c).to_numpy() for c in ("cls", "copies", "block", "table", "group"))
        across = own.column("low").to_numpy() != own.column("high").to_numpy()
        counts = np.zeros(len(cls), dtype=np.int64)
        left, right = [], []
        for a, b in pairs_within(group):
            near = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
            a, b = a[near], b[near]
            # rows of two blocks are compared across them only; a pair counts in the first table where it meets
            new = (~across[a] | (block[a] != block[b])) & ~((seen[a] == seen[b]) & (np.arange(TABLES) < table[a][:, None])).any(axis=1)
            a, b = a[new], b[new]
            counts += np.bincount(a, copies[b], len(cls)).astype(np.int64) + np.bincount(b, copies[a], len(cls)).astype(np.int64)
            left.append(a)
            right.append(b)
        a, b = np.concatenate(left) if left else np.zeros(0, int), np.concatenate(right) if right else np.zeros(0, int)
        root = np.arange(len(cls))
        while True:
            lower, least = root.copy(), np.minimum(root[a], root[b])
            np.minimum.at(lower, a, least)
            np.minimum.at(lower, b, least)
            lower = lower[lower]
            if (lower == root).all():
                break
            root = lower
        hit, tied = np.flatnonzero(counts), np.flatnonzero(root < np.arange(len(cls)))
        none = pa.nulls
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([cls[hit], cls[tied]])), pa.concat_arrays([none(len(hit), pa.int64()), pa.array(cls[root[tied]])]),
                                          pa.concat_arrays([pa.array(counts[hit]), none(len(tied), pa.int64())])], names=["cls", "partner", "links"])


def _compare(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, GROUP):
            yield from _links(table, threshold)
    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    kind = rows.schema["label"].dataType.simpleString()
    hashed = cut_lineage(rows.mapInArrow(_hash_vectors, f"vec_id long, label {kind}, unit array<double>, digest string, buckets array<long>")
                         .withColumn("row", F.monotonically_increasing_id()))
    usable = hashed.filter("unit is not null")
    classes = cut_lineage(usable.groupBy("label", "digest").agg(F.min("row").alias("cls"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("low")))
    member = usable.join(classes, ["label", "digest"]).select("row", "vec_id", "cls", "copies")
    member = cut_lineage(member)
    held = usable.join(classes.select(F.col("cls").alias("row"), "copies"), "row").select(
        F.col("row").alias("cls"), "label", "unit", "buckets", "copies", F.size("unit").alias("dims"))
    held = cut_lineage(held)
    in_bucket = ["dims", "label", "table", "bucket"]
    placed = held.select("cls", "dims", "label", F.posexplode("buckets").alias("table", "bucket"))
    crowded = cut_lineage(placed.groupBy(*in_bucket).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = placed.join(crowded.withColumn("blocks", blocks), in_bucket).withColumn("block", F.pmod(F.xxhash64("cls"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cls", "dims", "label", "table", "bucket", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    dealt = cut_lineage(dealt)
    full = dealt.join(held.select("cls", "unit", "buckets", "copies"), "cls")
    together = full.select(*GROUP, "cls", "block", "unit", "buckets", "copies").repartition(*GROUP).sortWithinPartitions(*GROUP)
    found = cut_lineage(together.mapInArrow(_compare(threshold), "cls long, partner long, links long"))
    counts = cut_lineage(found.filter("links is not null").groupBy("cls").agg(F.sum("links").alias("links")))
    joined = connected_components(found.filter("partner is not null"), "cls", "partner")
    # classes of one component, copies of one class and rows of one id share a component: the smallest id of all
    member = member.join(counts, "cls", "left").join(joined.withColumnRenamed("node", "cls"), "cls", "left").withColumn("group", F.coalesce("component", "cls"))
    member = cut_lineage(member)
    lowest = cut_lineage(member.groupBy("group").agg(F.min("vec_id").alias("component_id")))
    linked = member.join(lowest, "group").select("row", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    return hashed.select("row", "vec_id").join(linked, "row", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id")).alias("kept"))

