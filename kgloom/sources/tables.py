"""Table maintenance: deletes, upserts, paging and graph export."""
from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.session import page

OWNED = ("chunks", "entities", "relationships")
REFERRING = ("ontology_versions", "runs", "issues")


def cascade_delete(tables: dict[str, DataFrame], doc_ids: DataFrame) -> dict[str, DataFrame]:
    """Tables without the given documents.

    Rows owned by a document go with it; rows that only refer to it stay, with
    document_id set to NULL. ``doc_ids`` has one column, ``document_id``.
    """
    gone = doc_ids.select("document_id").distinct()
    out = dict(tables)
    if "documents" in tables:
        out["documents"] = tables["documents"].join(gone.withColumnRenamed("document_id", "id"), "id", "left_anti")
    for name in OWNED:
        if name in tables:
            out[name] = tables[name].join(gone, "document_id", "left_anti")
    for name in REFERRING:
        if name in tables:
            cols = tables[name].columns
            hit = tables[name].join(gone.withColumn("_gone", F.lit(True)), "document_id", "left")
            out[name] = hit.withColumn("document_id", F.when(F.col("_gone").isNull(), F.col("document_id"))).select(cols)
    return out


def replace_by_key(existing: DataFrame, incoming: DataFrame, key="document_id") -> DataFrame:
    """Existing rows of every key present in ``incoming`` are replaced by the incoming rows."""
    keys = [key] if isinstance(key, str) else list(key)
    return existing.join(incoming.select(keys).distinct(), keys, "left_anti").unionByName(incoming)


# column that holds the bucket of a row's key in stored tables
BUCKET = "key_bucket"


def _file_system(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def _exists(spark: SparkSession, path: str) -> bool:
    files, where = _file_system(spark, path)
    return files.exists(where)


def _put_in_place(spark: SparkSession, path: str, pending: str) -> None:
    """Overwrites the buckets that occur in the finished pending rows, then drops these."""
    rows = spark.read.parquet(pending)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    files, where = _file_system(spark, pending)
    files.delete(where, True)


def write_by_key(incoming: DataFrame, path: str, key="document_id", buckets: int = 256) -> None:
    """``replace_by_key`` on a stored table: only buckets that hold a key of ``incoming`` are rewritten.

    The table is parquet under ``path``, partitioned by a hash of the key into ``buckets``; the
    number belongs to the table and must stay. Other buckets are neither read nor written. A NULL key is a key like any
    other, so a repeated call changes nothing. Empty input changes nothing, but makes the empty table if there is none.

    New buckets are first written whole beside the table. If a call is broken off while they
    are put in place, the next call (or ``finish_write``) does that first, so no row is lost.
    One writer at a time.
    """
    spark = incoming.sparkSession
    path = path.rstrip("/")
    finish_write(spark, path)
    keys = [key] if isinstance(key, str) else list(key)
    placed = incoming.withColumn(BUCKET, F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int"))
    if not _exists(spark, path):
        if incoming.isEmpty():
            placed.limit(0).write.parquet(path)
            return
        fresh = placed
    else:
        # at most ``buckets`` numbers
        touched = [r[0] for r in placed.select(BUCKET).distinct().collect()]
        if not touched:
            return
        stored = spark.read.schema(placed.schema).parquet(path).filter(F.col(BUCKET).isin(touched))
        new_keys = placed.select(BUCKET, *[F.col(k).alias(f"_new_{k}") for k in keys]).distinct().withColumnRenamed(BUCKET, "_new_bucket")
        same = F.col(BUCKET) == F.col("_new_bucket")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_new_{k}"))
        fresh = stored.join(new_keys, same, "left_anti").unionByName(placed)
    # rows of a bucket come together, a crowded bucket is spread over several tasks
    fresh.hint("rebalance", BUCKET).write.mode("overwrite").parquet(f"{path}_pending")
    _put_in_place(spark, path, f"{path}_pending")


def finish_write(spark: SparkSession, path: str) -> bool:
    """Ends a ``write_by_key`` that was broken off after its rows were written; False if there was none."""
    pending = f"{path.rstrip('/')}_pending"
    if not _exists(spark, f"{pending}/_SUCCESS"):
        return False
    _put_in_place(spark, path.rstrip("/"), pending)
    return True


def read_by_key(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def append_rows(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Plain append; re-running a document duplicates its rows."""
    return existing.unionByName(incoming, allowMissingColumns=True)


def paginate(df: DataFrame, order, limit: int, offset: int = 0) -> DataFrame:
    """One page in the given total order, with the full row count in ``total``."""
    total = df.agg(F.count(F.lit(1)))
    return page(df, order, limit, offset).withColumn("total", total.scalar())


_NODE, _PROP, _TYPE = "urn:kg:node:", "urn:kg:prop:", "urn:kg:type:"
_RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"


def _iri(prefix, col):
    return F.concat(F.lit("<"), _name(prefix, col), F.lit(">"))


def _name(prefix, col):
    """Percent-encoded name, the same in every export; NULL for NULL."""
    return F.concat(F.lit(prefix), F.replace(F.url_encode(col), F.lit("+"), F.lit("%20")))


def _literal(col):
    c = col
    for raw, esc in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(raw), F.lit(esc))
    return F.concat(F.lit('"'), c, F.lit('"'))


def ntriples(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph as N-Triples lines, column ``value``: type and name of nodes, one triple per edge.

    A statement with a NULL part is left out.
    """
    def line(*parts):
        return F.concat(*[x for p in parts for x in (p, F.lit(" "))], F.lit("."))
    subject = _iri(_NODE, F.col("id"))
    node_lines = nodes.select(F.explode(F.array(
        line(subject, F.lit(_RDF_TYPE), _iri(_TYPE, F.col("label"))),
        line(subject, F.lit(f"<{_PROP}name>"), _literal(F.col("name"))),
    )).alias("value"))
    edge_lines = edges.select(line(_iri(_NODE, F.col("src")), _iri(_PROP, F.col("type")), _iri(_NODE, F.col("tgt"))).alias("value"))
    return node_lines.unionByName(edge_lines).filter("value is not null")


def jsonld(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph as JSON-LD objects, one line each, column ``value``; nodes and terms have the names of ``ntriples``.

    Rows without an id or end are left out.
    """
    context = F.struct(F.lit(_PROP).alias("@vocab")).alias("@context")

    def ref(prefix, col):
        return F.struct(_name(prefix, F.col(col)).alias("@id"))
    node_rows = nodes.filter("id is not null").select(F.to_json(F.struct(
        context, _name(_NODE, F.col("id")).alias("@id"), _name(_TYPE, F.col("label")).alias("@type"), F.col("name").alias("name"))).alias("value"))
    edge_rows = edges.filter("src is not null and tgt is not null and type is not null").select(F.to_json(F.struct(
        context, _name(_NODE, F.col("src")).alias("@id"), ref(_PROP, "type").alias("relation"), ref(_NODE, "tgt").alias("target"))).alias("value"))
    return node_rows.unionByName(edge_rows)


def export_ntriples(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    ntriples(nodes, edges).write.mode("overwrite").text(path)


def export_jsonld(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    jsonld(nodes, edges).write.mode("overwrite").text(path)
