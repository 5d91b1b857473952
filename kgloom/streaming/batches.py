"""Numbers for the folders of micro-batches that keep growing over restarts."""
import json

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

# batches of one checkpoint are counted in 32 bits
SPAN = 1 << 32


class BatchNumbers:
    """Number of a batch: the run of its checkpoint, then the batch id.

    A checkpoint is known by the id that the stream wrote into it. Batches of a new
    checkpoint start at 0 again; they get a run of their own, above all runs before,
    so they never overwrite stored batches and the newest number is the newest batch.
    Runs are kept in a small table beside the batches.
    """

    def __init__(self, spark: SparkSession, path: str, checkpoint: str):
        self.spark, self.table, self.checkpoint, self.run = spark, f"{path}_runs", checkpoint, None

    def _find(self) -> int:
        own = json.loads(self.spark.read.text(f"{self.checkpoint}/metadata").first()[0])["id"]
        try:
            runs = {r["id"]: r["run"] for r in self.spark.read.parquet(self.table).collect()}
        except AnalysisException:
            runs = {}
        if own not in runs:
            runs[own] = max(runs.values(), default=-1) + 1
            self.spark.createDataFrame([(own, runs[own])], "id string, run long").write.mode("append").parquet(self.table)
        return runs[own]

    def number(self, epoch: int) -> int:
        if self.run is None:
            self.run = self._find()
        return self.run * SPAN + epoch
