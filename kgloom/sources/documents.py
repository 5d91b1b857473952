"""Document sources: files, stored pages, raw text rows."""
import io
import zipfile
import zlib
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom import vocab as V
from kgloom.functions import text as T
from kgloom.session import stable_id

DOCUMENT_FIELDS = ["id", "filename", "mime_type", "raw_text", "word_count", "language"]


def read_files(spark: SparkSession, path: str, suffixes: list[str] | None = None) -> DataFrame:
    """Files under ``path``: path, content, length. With ``suffixes`` files are picked by name, before any content is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if suffixes:
        either = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes]
        reader = reader.option("pathGlobFilter", "*{" + ",".join(either) + "}")
    return reader.load(path).select("path", "content", "length")


def _suffixes(mime: str) -> list[str]:
    return [s for s, m in V.SUPPORTED_MIME.items() if m.startswith(mime)]


def _as_documents(df: DataFrame) -> DataFrame:
    """path, mime_type, raw_text -> document rows."""
    name = F.element_at(F.split("path", "/"), -1)
    return df.select(
        stable_id("path").alias("id"), name.alias("filename"), "mime_type", "raw_text",
        T.word_count("raw_text").alias("word_count"), F.lit("en").alias("language"))


def detect_mime(path_col="path", content_col=None):
    """MIME type from leading bytes when content is given, else from the extension."""
    ext = F.lower(F.regexp_extract(path_col, r"(\.[A-Za-z0-9]+)$", 1))
    known = F.create_map(*[F.lit(x) for kv in V.SUPPORTED_MIME.items() for x in kv])
    by_ext = F.coalesce(F.element_at(known, ext), F.lit("application/octet-stream"))
    if content_col is None:
        return by_ext
    head = F.hex(F.substring(F.col(content_col).cast("binary"), 1, 5))
    return (F.when(head == "255044462D", V.SUPPORTED_MIME[".pdf"])
            .when(head.startswith("D0CF11E0"), V.SUPPORTED_MIME[".doc"])
            .when(head.startswith("504B0304") & (ext != ".docx"), "application/zip")
            .otherwise(by_ext))


def route_by_mime(files: DataFrame, path_col="path", content_col="content") -> tuple[DataFrame, DataFrame]:
    """(supported, rejected) files, each with its ``mime_type``."""
    typed = files.withColumn("mime_type", detect_mime(path_col, content_col))
    ok = F.col("mime_type").isin(*V.SUPPORTED_MIME.values())
    return typed.filter(ok), typed.filter(~ok)


def text_from_files(files: DataFrame) -> DataFrame:
    """Text and markdown files as documents; invalid UTF-8 becomes replacement characters."""
    text = F.expr("make_valid_utf8(cast(content as string))")
    return _as_documents(files.select("path", detect_mime("path").alias("mime_type"), text.alias("raw_text")))


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    files, _ = route_by_mime(read_files(spark, path, _suffixes("text/")))
    return text_from_files(files.filter(F.col("mime_type").startswith("text/")))


_PARA = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _docx_text(blob: bytes) -> str | None:
    try:
        with zipfile.ZipFile(io.BytesIO(blob)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, zlib.error, EOFError, NotImplementedError, RuntimeError):
        return None
    paras = ("".join(t.text or "" for t in p.iter(_PARA + "t")) for p in root.iter(_PARA + "p"))
    return "\n\n".join(p for p in paras if p.strip())


def docx_from_files(files: DataFrame) -> DataFrame:
    """Word files as documents: non-blank paragraphs with a blank line between them.

    A file that is damaged or no Word file has NULL text; a build reports it as failed.
    """
    def parse(batches):
        for pdf in batches:
            pdf["raw_text"] = pdf["content"].map(lambda b: _docx_text(bytes(b)))
            yield pdf[["path", "mime_type", "raw_text"]]
    typed = files.select("path", F.lit(V.SUPPORTED_MIME[".docx"]).alias("mime_type"), "content")
    return _as_documents(typed.mapInPandas(parse, "path string, mime_type string, raw_text string"))


def read_docx_documents(spark: SparkSession, path: str) -> DataFrame:
    files, _ = route_by_mime(read_files(spark, path, [".docx"]))
    return docx_from_files(files.filter(F.col("mime_type") == V.SUPPORTED_MIME[".docx"]))


class IngesterChain:
    """Ordered (predicate, transform) pairs; each file goes to the first match.

    ``predicate`` is a Column over path and mime_type, ``transform`` maps a files
    DataFrame to document rows. Files nobody takes are left out.
    """

    def __init__(self, pairs=None):
        self.pairs = pairs or [
            (F.col("mime_type").startswith("text/"), text_from_files),
            (F.col("mime_type") == V.SUPPORTED_MIME[".docx"], docx_from_files),
        ]

    def ingest(self, files: DataFrame) -> DataFrame:
        rest, out = route_by_mime(files)[0], None
        taken = F.lit(False)
        for predicate, transform in self.pairs:
            part = transform(rest.filter(predicate & ~taken))
            out = part if out is None else out.unionByName(part)
            taken = taken | predicate
        return out


def ingest_text(df: DataFrame, text_col: str, filename_col: str | None = None, id_cols=None) -> DataFrame:
    """Raw text rows as documents; blank rows are rejected."""
    clean = T.strip(text_col)
    name = F.coalesce(F.col(filename_col), F.lit("raw_text")) if filename_col else F.lit("raw_text")
    rows = df.withColumn("_t", clean).filter(F.col("_t") != "")
    ident = stable_id(*id_cols) if id_cols else stable_id("_t")
    return rows.select(
        ident.alias("id"), name.alias("filename"), F.lit("text/plain").alias("mime_type"), F.col("_t").alias("raw_text"),
        T.word_count("_t").alias("word_count"), F.lit("en").alias("language"))


def html_to_documents(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """Stored web pages as documents: id, url, host, title, raw_text, word_count."""
    title = T.html_to_text(F.regexp_extract(html_col, r"(?is)<title[^>]*>(.*?)</title>", 1))
    docs = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"),
                        F.try_parse_url(F.col(url_col), F.lit("HOST")).alias("host"),
                        title.alias("title"), T.html_to_text(html_col).alias("raw_text"))
    return docs.withColumn("word_count", T.word_count("raw_text"))


def fingerprint(df: DataFrame, text_col="raw_text") -> DataFrame:
    return df.withColumn("sha256", F.sha2(F.col(text_col), 256))


def dedup_exact(df: DataFrame, text_col="raw_text", id_col="id") -> DataFrame:
    """One row per distinct content, the one with the lowest id.

    Only (hash, id) is aggregated, with map-side combine, so a content that fills
    a third of the corpus costs no more than any other; texts are then kept by id.
    """
    keep = df.groupBy(F.sha2(F.col(text_col), 256).alias("sha256")).agg(F.min(id_col).alias(id_col))
    return df.join(keep, id_col)


def list_documents(docs: DataFrame, order_col="created_at") -> DataFrame:
    """Listing view, newest first."""
    return docs.orderBy(F.col(order_col).desc(), "id").select(
        "id", F.when(F.col("filename") == "raw_text", "text").otherwise("file").alias("source_type"),
        "filename", "mime_type", F.round(F.octet_length("raw_text") / 1024, 2).alias("size_kb"),
        "word_count", "language", F.col(order_col).alias("ingested_at"), F.lit("ingested").alias("status"))


def get_document(docs: DataFrame, doc_id, order_col="created_at") -> DataFrame:
    return list_documents(docs.filter(F.col("id") == doc_id), order_col)
