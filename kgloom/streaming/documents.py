"""Streaming upkeep of the chunk, entity and document tables.

Every micro-batch is written under its own ``batch=`` folder and the newest batch
of a document is the valid one. Writing costs as much as the batch, never as much
as the stored table, and a repeated batch overwrites exactly its own folder. Numbers
go on growing when a stream restarts with a new checkpoint.
"""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom import vocab as V
from kgloom.functions import text as T
from kgloom.functions.chunking import sliding_chunks
from kgloom.operators import extraction as X
from kgloom.operators import vectors as E
from kgloom.streaming.batches import BatchNumbers

TABLES = ("documents", "chunks", "entities")


def clean_documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("raw_text", T.clean_text("raw_text"))


def document_tables(docs: DataFrame, gazetteer: DataFrame, embedder=E.hashed_bag_of_words, cleaner=clean_documents, chunker=sliding_chunks) -> dict[str, DataFrame]:
    """Cleaned documents, embedded chunks and entities of (id, filename, raw_text) rows.

    ``cleaner`` (docs -> docs) and ``chunker`` (called like ``sliding_chunks``) replace
    the preprocessing.
    """
    clean = cleaner(docs)
    rows = clean.select(F.col("id").alias("document_id"), "filename", "raw_text", T.word_count("raw_text").alias("word_count"),
                        F.sha2("raw_text", 256).alias("sha256"))
    return {"documents": rows, "chunks": E.embed_chunks(clean, embedder, chunker=chunker),
            "entities": X.extract_entities(chunker(clean, *V.ENTITY_WINDOW, offsets=False), gazetteer)}


def stream_documents(arriving: DataFrame, gazetteer: DataFrame, path: str, checkpoint: str, embedder=E.hashed_bag_of_words,
                     late: str | None = None, available_now: bool = True, cleaner=clean_documents, chunker=sliding_chunks):
    """Starts the upkeep of the tables under ``path`` for a stream of (id, filename, raw_text[, ts]) rows.

    Of several versions of a document in one batch the last by ``ts`` (else by
    text) counts. With ``late`` set, rows repeating a content fingerprint within
    that time of each other are skipped; their state is dropped by the watermark.
    """
    stream = arriving
    if late is not None:
        stream = (arriving.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
                  .withColumn("_f", F.sha2(F.concat_ws("|", F.col("id").cast("string"), "raw_text"), 256)).dropDuplicatesWithinWatermark(["_f"]).drop("_f"))

    numbers = BatchNumbers(arriving.sparkSession, path.rstrip("/"), checkpoint)

    def save(batch, epoch):
        order = F.struct("ts", "raw_text") if "ts" in batch.columns else F.col("raw_text")
        one = batch.groupBy("id").agg(F.max_by(F.struct("filename", "raw_text"), order).alias("d")).select("id", "d.*").persist()
        tables = document_tables(one, gazetteer, embedder, cleaner, chunker)
        number = numbers.number(epoch)
        # the document list makes a batch valid, so it is written last
        for name in reversed(TABLES):
            tables[name].write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        one.unpersist()
    w = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def current_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The valid rows of a streamed table: those of the newest batch of their document."""
    docs = spark.read.parquet(f"{path}/documents")
    newest = docs.groupBy("document_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{path}/{name}").join(newest, ["document_id", "batch"]).drop("batch")


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Valid rows of every table rewritten under ``target``."""
    for name in TABLES:
        current_table(spark, path, name).withColumn("batch", F.lit(-1)).write.mode("overwrite").partitionBy("batch").parquet(f"{target}/{name}")


def read_text_stream(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """Text files arriving in a folder as (id, filename, raw_text, ts) rows; a file's id is the hash of its path."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).load(path)
    return files.select(F.sha2("path", 256).alias("id"), F.element_at(F.split("path", "/"), -1).alias("filename"),
                        F.expr("make_valid_utf8(cast(content as string))").alias("raw_text"), F.col("modificationTime").alias("ts"))
