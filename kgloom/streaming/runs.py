"""Streaming run monitor over run events."""
from datetime import timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kgloom.operators.runs import EVENT_SCHEMA
from kgloom.streaming.batches import BatchNumbers


def read_run_events(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = EVENT_SCHEMA, files_per_batch: int = 100) -> DataFrame:
    """Run events arriving as files."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def stream_run_status(events: DataFrame, late: str = "1 hour", span: str = "30 days") -> DataFrame:
    """Latest state per run and time span: run_id, status, current_step, last_ts, finished.

    For update mode. The aggregate combines map-side, so one very chatty run is
    no hot spot. The span is part of the key only to let the watermark drop old
    state; a run crossing a border gives two rows, of which the later ``last_ts``
    counts (``latest_status``).
    """
    last = F.struct("ts", "event_id")
    g = (events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
         .groupBy(F.window("ts", span), "run_id").agg(F.max_by(F.struct("type", "step"), last).alias("l"), F.max("ts").alias("last_ts")))
    kind = F.col("l.type")
    state = F.when(kind == "run_complete", "completed").when(kind == "run_failed", "failed").otherwise("running")
    return g.select("run_id", state.alias("status"), F.when(kind == "step_start", F.col("l.step")).alias("current_step"), "last_ts",
                    kind.isin("run_complete", "run_failed").alias("finished"))


def latest_status(updates: DataFrame) -> DataFrame:
    """Current row per run from the emitted updates."""
    cols = [c for c in updates.columns if c != "run_id"]
    # of two updates with the same time, the one emitted last is kept
    order = F.struct("last_ts", "batch") if "batch" in updates.columns else F.col("last_ts")
    return updates.groupBy("run_id").agg(F.max_by(F.struct(*cols), order).alias("u")).select("run_id", "u.*")


def stuck_in_stream(updates: DataFrame, now, minutes: int = 15) -> DataFrame:
    """Runs whose latest update is older than ``minutes`` and which have not finished."""
    at = F.to_timestamp(F.lit(now))
    return latest_status(updates).filter((F.col("status") == "running") & (F.col("last_ts") + F.make_dt_interval(mins=F.lit(minutes)) < at))


ALERT_SCHEMA = "run_id bigint, current_step string, last_ts timestamp, stuck_at timestamp"
_ENDS = ("run_complete", "run_failed")


def _last_of_runs(batches):
    """Newest event per run of each Arrow batch; a chatty run leaves one row per batch before the shuffle."""
    for b in batches:
        yield b.sort_values(["ts", "event_id"]).drop_duplicates("run_id", keep="last")


class _StuckRuns(StatefulProcessor):
    """One timer per open run: set at each newer event, dropped at the end of the run."""

    def __init__(self, wait_ms: int, keep_ms: int, wall_clock: bool):
        self.wait, self.keep, self.wall = wait_ms, keep_ms, wall_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts timestamp, event_id bigint, type string, step string, told boolean")

    def handleInputRows(self, key, rows, timerValues):
        old = self.last.get() if self.last.exists() else None
        best = None if old is None else (_utc(old[0]), old[1], old[2], old[3])
        for frame in rows:
            for ts, event_id, kind, step in zip(frame["ts"], frame["event_id"], frame["type"], frame["step"]):
                event = (_utc(ts), int(event_id), kind, step)
                if best is None or event[:2] > best[:2]:
                    best = event
        if best is not None and (old is None or best[:2] > (_utc(old[0]), old[1])):
            self.last.update((best[0].to_pydatetime(), best[1], best[2], best[3], False))
            self._wait_from(timerValues.getCurrentProcessingTimeInMs() if self.wall else int(best[0].timestamp() * 1000),
                            self.keep if best[2] in _ENDS else self.wait)
        return iter(())

    def _wait_from(self, now_ms: int, wait_ms: int) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(now_ms + wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at = expiredTimerInfo.getExpiryTimeInMs()
        ts, event_id, kind, step, told = self.last.get()
        if told or kind in _ENDS:
            self.last.clear()
            return iter(())
        # the alert is given once; the state stays a while for late events of the run
        self.last.update((ts, event_id, kind, step, True))
        self.handle.registerTimer(at + self.keep)
        stuck_at = pd.Timestamp(at, unit="ms")
        row = {"run_id": [key[0]], "current_step": [step if kind == "step_start" else None], "last_ts": [_utc(ts).tz_localize(None)], "stuck_at": [stuck_at]}
        return iter([pd.DataFrame(row)])

    def close(self) -> None:
        pass


def _utc(ts) -> pd.Timestamp:
    t = pd.Timestamp(ts)
    return t.tz_localize(timezone.utc) if t.tzinfo is None else t.tz_convert(timezone.utc)


def stuck_run_alerts(events: DataFrame, minutes: float = 15, late: str = "1 hour", keep: str = "1 day", wall_clock: bool = False) -> DataFrame:
    """One row per run that stays silent for ``minutes`` without an end: run_id, current_step, last_ts, stuck_at.

    The row comes from a timer of the run, so the run needs no further event. By default time
    is that of the events: a timer ends when the watermark, ``late`` behind the newest event of
    any run, has passed it. With ``wall_clock`` it ends that long after the event was read.
    An event after the alert opens the run again. Finished and told runs are forgotten after
    ``keep``. Rows without run_id, time or number are left out. For append or update mode.
    """
    named = events.select("event_id", "run_id", "type", "step", F.col("ts").cast("timestamp").alias("ts"))
    named = named.filter("event_id is not null and run_id is not null and ts is not null")
    few = named.mapInPandas(_last_of_runs, named.schema)
    if not wall_clock:
        few = few.withWatermark("ts", late)
    span = _milliseconds(events.sparkSession, keep)
    return few.groupBy("run_id").transformWithStateInPandas(
        _StuckRuns(int(minutes * 60_000), span, wall_clock), ALERT_SCHEMA, "append", "processingTime" if wall_clock else "eventTime")


def _milliseconds(spark: SparkSession, span: str) -> int:
    got = spark.sql(f"select interval {span} as s").first()["s"]
    return int(got / timedelta(milliseconds=1))


def watch_runs(events: DataFrame, path: str, checkpoint: str, available_now: bool = True, **options):
    """Starts the alerts of ``stuck_run_alerts``, appended to parquet under ``path``; each alert is written exactly once.

    Timers need the state store that keeps state on disk, which is set on the session.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass",
                                 "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = stuck_run_alerts(events, **options).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def monitor_runs(events: DataFrame, path: str, checkpoint: str, **options):
    """Starts the monitor; each batch of updates is written to its own folder, so a repeated batch overwrites itself."""
    numbers = BatchNumbers(events.sparkSession, path.rstrip("/"), checkpoint)

    def save(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{path}/batch={numbers.number(epoch)}")
    return (stream_run_status(events, **options).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .foreachBatch(save).trigger(availableNow=True).start())
