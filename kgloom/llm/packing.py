"""Best-fit packing of documents into training sequences of a fixed number of tokens.

Only a document longer than a sequence is cut. Packing is hierarchical: every
partition packs its own pieces best-fit, longest first; bins that are nearly full
are emitted; the underfull bins of several partitions then meet as items of the
next, smaller round (those that stay underfull there are opened and packed anew),
until one bounded partition is left or a round saves nothing.
A bin carries its members (at most one per token), so no join is needed, only
underfull bins move, and a round is one map over a checkpointed table.

Defined cases: a null text is an empty one and gives one piece that holds only the
end id; rows without id and repeated rows are packed like any other; an empty
table gives no rows.
"""
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from kgloom.llm.common import SharedEncoder, cut_lineage, hand_back, no_cycle_collection, slices, tokenizer_path
from kgloom.llm.merges import BulkEncoder

CAPACITY = 2048
END_ID = 0
# bytes of text that are cut at a time
CUT_BYTES = 1 << 20
# a bin is emitted when its room is at most this part of the capacity
NEARLY = 1 / 512
# bins that one task packs at most, and partitions that meet in one of the next round
BINS_PER_TASK = 100_000
FAN_IN = 8
# a round at full task size that saves less than this share of its bins is the last
LEAST_SAVING = 0.001

def least_full(capacity: int) -> int:
    return capacity - int(capacity * NEARLY)


PIECE = StructType([StructField("doc_id", LongType()), StructField("piece", IntegerType()), StructField("start", LongType()),
                    StructField("length", LongType()), StructField("ids_crc32", LongType())])


def _cut(shared: SharedEncoder, capacity: int):
    """Pieces of the texts of a task, a bounded part of a batch at a time."""
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.get(BulkEncoder)
        with no_cycle_collection():
            for batch in batches:
                for part in slices(batch, "text", CUT_BYTES) if batch.num_rows else ():
                    at, sizes, sums = [], [], []
                    for row, ids in enumerate(encoder.encode_all([text or "" for text in part.column("text").to_pylist()])):
                        ids = memoryview(ids + end)
                        for c in range(0, len(ids), 4 * capacity):
                            at.append(row)
                            sizes.append(len(ids[c:c + 4 * capacity]) // 4)
                            sums.append(zlib.crc32(ids[c:c + 4 * capacity]))
                    at = np.array(at, dtype=np.int64)
                    piece = np.arange(len(at)) - np.searchsorted(at, at)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(piece * capacity),
                                                      pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], names=PIECE.names)
    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. The end id follows the last token."""
    rows = _texts(docs, id_col, text_col)
    return rows.mapInArrow(_cut(SharedEncoder(docs.sparkSession, path), capacity), _piece_schema(rows))


def _piece_schema(rows: DataFrame) -> StructType:
    """Columns of a piece, the id of the type it has."""
    return StructType([rows.schema["doc_id"], *PIECE.fields[1:]])


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each item, longest items first, each into the fullest bin that has room.

    Bins are kept by their room; one integer with a bit per room that occurs gives
    the tightest fit in one step.
    """
    bins = np.empty(len(lengths), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, made = 0, 0
    for at in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[at])
        fitting = rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            stack = by_room[room]
            number = stack.pop()
            if not stack:
                rooms ^= 1 << room
        else:
            room, number, made = capacity, made, made + 1
        bins[at] = number
        room -= need
        if room:
            by_room[room].append(number)
            rooms |= 1 << room
    return bins


def _gathered(members: pa.ListArray, number: np.ndarray) -> pa.ListArray:
    """Members of the bins with equal number, put together in the order of the numbers."""
    order = np.argsort(number, kind="stable")
    taken = members.take(pa.array(order))
    count = np.bincount(number[order], weights=np.diff(taken.offsets.to_numpy())).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), taken.flatten(), type=members.type)


def _levels(members: pa.ListArray) -> np.ndarray:
    lengths = members.flatten().field("length").to_numpy()
    return np.bincount(np.repeat(np.arange(len(members)), np.diff(members.offsets.to_numpy())), weights=lengths, minlength=len(members)).astype(np.int64)


def _merge_round(capacity: int):
    """Packs all bins of a partition into fewer.

    First whole bins are put together best-fit. Bins that are still underfull are
    then opened, and their pieces packed anew among themselves where that saves bins.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column("members") for b in batches if b.num_rows]
        if not parts:
            return
        # the encoder's freed memory goes back before the bins are made
        hand_back()
        members = pa.concat_arrays(parts)
        del parts
        members = _gathered(members, best_fit(_levels(members), capacity))
        levels = _levels(members)
        full = levels >= least_full(capacity)
        rest = members.filter(pa.array(~full))
        if len(rest):
            pieces = rest.flatten()
            single = pa.ListArray.from_arrays(pa.array(np.arange(len(pieces) + 1, dtype=np.int32)), pieces, type=members.type)
            anew = _gathered(single, best_fit(_levels(single), capacity))
            rest = anew if len(anew) < len(rest) else rest
            members = pa.concat_arrays([members.filter(pa.array(full)), rest])
        yield pa.RecordBatch.from_arrays([pa.array(_levels(members)), members], names=["level", "members"])
    return run


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per member with its place in the sequence."""
    for batch in batches:
        members = batch.column("members")
        flat = members.flatten()
        sizes = np.diff(members.offsets.to_numpy())
        lengths = flat.field("length").to_numpy()
        before = np.cumsum(lengths) - lengths
        first = np.cumsum(sizes) - sizes
        place = before - np.repeat(before[first], sizes) if len(flat) else before
        sequence = np.repeat(batch.column("sequence_id").to_numpy(), sizes)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        yield pa.RecordBatch.from_arrays([*[flat.field(n) for n in names], pa.array(sequence), pa.array(place)], names=[*names, "sequence_id", "offset"])


def _as_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every piece as a bin of its own."""
    for batch in batches:
        members = pa.StructArray.from_arrays(batch.columns, names=batch.schema.names)
        one = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32)), members)
        yield pa.RecordBatch.from_arrays([batch.column("length"), one], names=["level", "members"])


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, bins_per_task: int = BINS_PER_TASK) -> DataFrame:
    """``pieces`` with sequence_id and offset: every sequence holds at most ``capacity`` tokens, without gaps."""
    rows, merge = pieces.select(PIECE.names), _merge_round(capacity)
    return _pack(lambda schema: rows.mapInArrow(lambda batches: merge(_as_bins(batches)), schema), rows.schema, capacity, bins_per_task)


def _pack(first_round, piece: StructType, capacity: int, bins_per_task: int = BINS_PER_TASK) -> DataFrame:
    """Sequences from the bins that ``first_round(schema)`` makes of the pieces of each partition."""
    merge, schema = _merge_round(capacity), StructType([StructField("level", LongType()), StructField("members", ArrayType(piece))])
    bins = cut_lineage(first_round(schema))
    done, nearly = [], F.col("level") >= least_full(capacity)
    parts = max(1, bins.rdd.getNumPartitions())
    while True:
        done.append(bins.filter(nearly))
        underfull = bins.filter(~nearly)
        count = underfull.count()
        least = max(1, -(-count // bins_per_task))
        if count < 2 or parts == 1:
            break
        last, parts = parts <= least, max(least, -(-parts // FAN_IN))
        bins = cut_lineage(underfull.repartition(parts).mapInArrow(merge, schema))
        if last and bins.count() > (1 - LEAST_SAVING) * count:
            underfull = bins
            break
    done.append(underfull)
    packed = done[0]
    for more in done[1:]:
        packed = packed.unionAll(more)
    out = StructType([*piece.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return packed.select(F.monotonically_increasing_id().alias("sequence_id"), "members").mapInArrow(_offsets, out)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their sequence and offset; a task cuts its texts and packs its pieces in one pass."""
    rows = _texts(docs, id_col, text_col)
    cut, merge = _cut(SharedEncoder(docs.sparkSession, path or tokenizer_path("word_bpe_49k.json")), capacity), _merge_round(capacity)
    return _pack(lambda schema: rows.mapInArrow(lambda batches: merge(_as_bins(cut(batches))), schema), _piece_schema(rows), capacity)
