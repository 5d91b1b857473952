"""What several operators share: lineage cuts, free column names, tokenizer tables for tasks."""
import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kgloom.llm import merges
from kgloom.session import broadcast_if_small, cut_lineage

# bytes of input that are worked on, and sent on, at a time
SLICE_BYTES = 2 << 20


def held_out(id_col: str, n: int, rest: int):
    """Whether crc32 of the id as text leaves ``rest`` modulo ``n``; a null id counts as not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % n == rest, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; set here only where nothing is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        cut_lineage(spark.range(0))  # local sessions get a folder with their first checkpoint
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def tokenizer_path(name: str) -> str:
    """File of a public tokenizer; every operator takes another path as a parameter."""
    return public_tokenizers.path(name)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def new_name(df: DataFrame, name: str) -> str:
    """``name``, which must not be a column of ``df`` yet: an operator neither hides nor replaces a caller's column."""
    if free_name(df, name) != name:
        raise ValueError(f"there is a column {name} already; name another one for the result")
    return name


def without_rows(docs: DataFrame, dropped: DataFrame, id_col: str, key: Column) -> DataFrame:
    """``docs`` without the rows named in ``dropped`` (doc_id, key) by id and ``key`` of their text.

    Of rows without id that have one key, the first by all columns stays.
    """
    name = free_name(docs, "_text_key")
    dropped = broadcast_if_small(cut_lineage(dropped.select(F.col("doc_id").alias("_dropped"), F.col("key").alias("_dropped_key")).distinct()))
    keyed = docs.withColumn(name, key)
    named = keyed.filter(F.col(id_col).isNotNull()).join(dropped, (F.col(id_col) == F.col("_dropped")) & (F.col(name) == F.col("_dropped_key")), "left_anti")
    whole = F.struct(*docs.columns)
    # columns that have no order, such as maps, are compared as text
    unnamed = keyed.filter(F.col(id_col).isNull()).groupBy(name).agg(F.min_by(whole, F.to_json(whole)).alias("_row")).select("_row.*", name)
    lost = dropped.filter("_dropped is null").select(F.col("_dropped_key").alias(name))
    return named.unionByName(unnamed.join(lost, name, "left_anti")).select(*docs.columns)


class SharedEncoder:
    """Tables of a tokenizer file, read on the driver and broadcast (a few MB, whatever the corpus).

    The encoder a worker makes of them is kept with the broadcast value, so later
    tasks of that worker find its cache filled.
    """

    def __init__(self, spark: SparkSession, path: str, **extra):
        self.sent = spark.sparkContext.broadcast({**merges.load(path), **extra})

    def get(self, make=merges.Encoder):
        tables = self.sent.value
        if "made" not in tables:
            tables["made"] = make(tables)
        return tables["made"]


def hand_back():
    """Gives freed memory back to the system: a worker lives on after its task, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)


@contextmanager
def no_cycle_collection():
    """Pauses Python's cycle collector for code that makes many strings and no cycles; freed memory is handed back in the end."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()
        hand_back()


def slices(batch: pa.RecordBatch, column: str, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of about ``size`` bytes (``SLICE_BYTES``) of a text or binary column, at least a row each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // (size or SLICE_BYTES)
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def add_columns(df: DataFrame, source: str, added: StructType, make: Callable[[list], list[pa.Array]]) -> DataFrame:
    """``df`` with columns that ``make`` derives from the values of ``source``, a bounded part of a batch at a time; their names must be free."""
    for name in added.names:
        new_name(df, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with no_cycle_collection():
            for batch in batches:
                for part in slices(batch, source) if batch.num_rows else ():
                    yield pa.RecordBatch.from_arrays([*part.columns, *make(part.column(source).to_pylist())], names=[*batch.schema.names, *added.names])
    return df.mapInArrow(run, StructType([*df.schema.fields, *added.fields]))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list) -> Iterator[pa.Table]:
    """Rows sorted by ``keys`` in tables that hold whole groups, numbered in a column ``group``; a group that goes on in the next batch waits for it."""
    waiting = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if waiting is not None:
            table = pa.concat_tables([waiting, table]).combine_chunks()
        if not table.num_rows:
            continue
        change = np.zeros(table.num_rows, dtype=bool)
        for name in keys:
            codes = table.column(name).combine_chunks().dictionary_encode()
            codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
            change[1:] |= codes[1:] != codes[:-1]
        last = int(np.flatnonzero(change)[-1]) if change.any() else 0
        waiting = table.slice(last)
        if last:
            yield table.slice(0, last).append_column("group", pa.array(np.cumsum(change[:last])))
    if waiting is not None and waiting.num_rows:
        yield waiting.append_column("group", pa.array(np.zeros(waiting.num_rows, dtype=np.int64)))


# pairs of rows that a task looks at at once
PAIRS = 1 << 18


def pairs_within(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (left, right) of all pairs inside runs of equal ``group``, about ``PAIRS`` at a time; nothing is sent on."""
    sizes = np.diff(np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group)))
    ends = np.cumsum(sizes)
    after = np.repeat(ends, sizes) - np.arange(ends[-1]) - 1
    edges = np.searchsorted(np.cumsum(after), np.arange(0, after.sum(), PAIRS), side="left")
    for a, b in zip(edges, [*edges[1:].tolist(), len(after)]):
        part = after[a:b]
        left = np.repeat(np.arange(a, b), part)
        yield left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(part) - part, part)
