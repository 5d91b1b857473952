"""Session settings, lineage cuts and deterministic ids."""
import gc
import re
import tempfile
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def build_session(app="kgloom", master=None, **conf):
    """A session with adaptive execution on, for scripts and tests."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df``.

    Files go to the cluster's ``spark.checkpoint.dir`` so a lost executor loses
    nothing. Without one, a scratch folder serves a local master only: on a cluster
    its files would stay on the executors' own disks.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="kgloom-ckpt-"))
    _free_files(spark)
    return df.checkpoint(eager=True)


# seconds between two collections in the driver
FREE_EVERY = 15
_freed_at = time.monotonic()


def _free_files(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of finished steps, and checkpoints where it is set to.

    Spark deletes them once the driver has collected the frames they belong to, which a
    heap with room to spare does not do for half an hour (``spark.cleaner.periodicGC.interval``).
    """
    global _freed_at
    if time.monotonic() - _freed_at >= FREE_EVERY:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _freed_at = time.monotonic()


# frames up to this many rows may be sent to every task
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows, else unchanged.

    Counting stops at the limit. For narrow frames that are cheap to evaluate,
    such as checkpointed ones.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


# bits of a set of ids that goes to every task, whatever the graph
BITS = 1 << 26


def _bit(key: str) -> tuple[Column, Column]:
    """(word, place in it) of the bit that stands for an id."""
    h = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BITS))
    return F.shiftright(h, 6), F.pmod(h, F.lit(64)).cast("int")


def id_bits(ids: DataFrame, key: str) -> DataFrame:
    """The ids as a bitmap of fixed size: its words that hold a bit."""
    word, at = _bit(key)
    return cut_lineage(ids.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), at).alias("_bit"))
                       .groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))


def may_be(df: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """Rows whose ``key`` may be one of the ids of ``id_bits``: all that are and few others. No row is shuffled."""
    word, at = _bit(key)
    near = df.withColumn("_word", word).join(F.broadcast(bits), "_word")
    return near.filter(F.call_function("shiftright", F.col("_bits"), at).bitwiseAND(F.lit(1).cast("long")) == 1).drop("_word", "_bits")


def stable_id(*cols) -> Column:
    """Deterministic row id from a natural key, so re-runs give the same ids.

    Parts are joined by bars; a bar or backslash inside a part is escaped and NULL
    has a mark of its own, so different keys never give one text.
    """
    def part(c):
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        return F.coalesce(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\\0"))
    return F.sha2(F.concat_ws("|", *[part(c) for c in cols]), 256)


def number_within(df: DataFrame, keys: list, order: list, name: str = "seq_no") -> DataFrame:
    """Row numbers from 1 within each key, in the given total order.

    Rows are range-partitioned by key and order, so one huge key is cut into many
    ranges. Numbers are made inside each range and shifted by the number of
    earlier rows of the key, taken from one count per (range, key).
    """
    ranged = df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    inner = Window.partitionBy("_range", *keys).orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_range", *keys).agg(F.count(F.lit(1)).alias("_n"))
    shifts = counts.select("_range", *[F.col(k).alias(f"_k_{k}") for k in keys], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    numbered = ranged.withColumn("_at", F.row_number().over(inner))
    return (numbered.join(shifts.withColumnRenamed("_range", "_r"), (F.col("_range") == F.col("_r")) & same)
            .withColumn(name, F.col("_at") + F.col("_shift")).select(*df.columns, name))


def next_within(df: DataFrame, keys: list, order: list, value: str, name: str) -> DataFrame:
    """``value`` of the next row of the same keys in the given total order, null after the last.

    Rows are range-partitioned by key and order, so one huge key is cut into many
    ranges. Only the last row of a range can be followed by a row of another range:
    the first one of the next range, carried over in a table of one row per range.
    """
    ranged = cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    inner = Window.partitionBy("_range", *keys).orderBy(*order)
    heads = ranged.groupBy("_range").agg(F.min(F.struct(*keys, *order, F.struct(F.col(value).alias("v")).alias("_value"))).alias("h"))
    ahead = heads.select("_range", F.lead("h").over(Window.orderBy("_range")).alias("_ahead"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_ahead.{k}"))
    following = F.coalesce(F.lead(F.struct(F.col(value).alias("v"))).over(inner), F.when(same, F.col("_ahead._value")))
    return (ranged.join(F.broadcast(ahead), "_range", "left").withColumn(name, following["v"]).select(*df.columns, name))


# pages that end beyond this row are cut from ranges instead of one sorted head
DEEP_PAGE = 100_000


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """Rows offset+1 .. offset+limit in a total order.

    A page near the start is a top-n. Far from it the rows are range-partitioned
    and numbered, so no task or driver ever holds all rows before the page.
    """
    if offset + limit <= DEEP_PAGE:
        return df.orderBy(*order).offset(offset).limit(limit)
    numbered = number_within(df, [], order, "_pos")
    return numbered.filter((F.col("_pos") > offset) & (F.col("_pos") <= offset + limit)).orderBy("_pos").drop("_pos")
