"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Documents of equal text form a group. A group that is a sizeable part of a shard is
an item of its own, and one larger than a shard's fair share is split; all other
groups are hashed into a fixed number of bundles. So the driver places a bounded
number of items (independent of the corpus): each, largest first, into the shard
where the dot product with the residual capacity is highest. Documents get their
shard by two joins with that bounded placement; slots are numbered by ranges.

Defined cases: a null text has size 8 and no crc bytes (crc of the empty string);
null and empty texts are one group; repeated rows get slots of their own; rows
without id come first; an empty table gives no rows.
"""
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import cut_lineage
from kgloom.session import number_within

SHARDS = 24
RECORD_OVERHEAD = 8
# bundles of small groups per shard; a group from this part of a shard on is placed by itself
BUNDLES_PER_SHARD = 256
OWN_PART = 64
# pieces per fair share that a group larger than a shard is split into
PIECES_PER_SHARE = 8

# what tokens and rows may exceed their fair share by
LEEWAY = 0.02
DIMS = ["size", "tokens", "rows"]


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (rows of amounts per dimension).

    Residual capacity starts at the fair share of each dimension, scaled to one;
    dimensions other than bytes have ``LEEWAY`` more, so that bytes come out even.
    Largest items first; among shards with room in every dimension the one with
    the highest dot product, else the one with the most room for bytes.
    """
    share = items.sum(axis=0) / shards
    scaled = items / np.where(share > 0, share, 1.0)
    room = np.full((shards, items.shape[1]), 1 + LEEWAY)
    room[:, 0] = 1
    chosen = np.empty(len(items), dtype=np.int64)
    for at in np.lexsort((np.arange(len(items)), -scaled.sum(axis=1), -scaled.max(axis=1))):
        need = scaled[at]
        left = room - need
        fits = (left >= 0).all(axis=1)
        if fits.any():
            pick = np.where(fits, room @ need, -np.inf).argmax()
        else:
            pick = left[:, 0].argmax()
        room[pick] -= need
        chosen[at] = pick
    return chosen


def assign_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, tokens, text_crc32 and shard of every document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut_lineage(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + RECORD_OVERHEAD).cast("long").alias("size"),
        F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("tokens"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key")))
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens")]
    groups = cut_lineage(rows.groupBy("key").agg(*sums, F.count(F.lit(1)).alias("rows")))
    total = groups.agg(*[F.sum(d).alias(d) for d in DIMS]).first()
    if total["rows"] is None:
        return rows.select("doc_id", "size", "tokens", "text_crc32", F.lit(0).alias("shard"))
    part = F.greatest(*[F.col(d) * shards / F.lit(float(max(total[d], 1))) for d in DIMS])
    # at most 3 x shards x OWN_PART groups are this large
    own = F.broadcast(cut_lineage(groups.filter(part >= 1 / OWN_PART).select(
        F.col("key").alias("own_key"), F.when(part > 1, F.ceil(part * PIECES_PER_SHARE)).otherwise(F.lit(1)).cast("long").alias("pieces"))))
    bundles = shards * BUNDLES_PER_SHARD
    item = F.when(F.col("pieces").isNull(), F.concat(F.lit("b"), F.pmod("key", F.lit(bundles)).cast("string"))).otherwise(
        F.concat_ws("/", F.col("key").cast("string"), F.pmod(F.xxhash64("doc_id"), "pieces").cast("string")))
    rows = rows.join(own, F.col("key") == F.col("own_key"), "left").withColumn("item", item)
    amounts = rows.groupBy("item").agg(*sums, F.count(F.lit(1)).alias("rows")).orderBy("item").toPandas()
    amounts["shard"] = place(amounts[DIMS].to_numpy(dtype=float), shards).astype("int32")
    placed = F.broadcast(rows.sparkSession.createDataFrame(amounts[["item", "shard"]], "item string, shard int"))
    return rows.join(placed, "item").select("doc_id", "size", "tokens", "text_crc32", "shard")


def shard_report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    numbered = number_within(assign_shards(docs, shards), ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot") - 1).cast("long").alias("slot"),
                           F.lit(None).cast("int").alias("grown_shard"))
