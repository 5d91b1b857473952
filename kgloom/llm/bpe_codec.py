"""BPE encoding and decoding of whole texts by a public tokenizer file.

Pre-tokens are merged with a priority queue of ranks over a doubly linked symbol
list (``merges.Encoder.merge``); decoding puts vocabulary strings together. Both
are map-only: nothing is shuffled, and a task holds one Arrow batch and a bounded
cache of merged words.

Defined cases: a null text encodes like an empty one (no ids, decoded as the empty
string); special strings of the file inside a text become their own ids; repeated
rows, rows without id and an empty table are encoded like any other; a text of any
length is encoded whole; other columns pass through, and one that has the name of the
result is an error.
"""
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructType

from kgloom.llm.common import SharedEncoder, add_columns, tokenizer_path


def encode(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with a binary column of token ids, little-endian unsigned 32-bit integers.

    With ``decoded`` the ids are decoded again in the same pass, into a column of that name.
    """
    shared = SharedEncoder(docs.sparkSession, path)

    def make(texts: list) -> list:
        encoder = shared.get()
        ids = [encoder.encode(t or "") for t in texts]
        return [pa.array(ids, pa.binary()), *([pa.array(map(encoder.decode, ids), pa.string())] if decoded else [])]
    added = StructType().add(out, BinaryType())
    return add_columns(docs, text_col, added.add(decoded, StringType()) if decoded else added, make)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids; special tokens are kept."""
    shared = SharedEncoder(df.sparkSession, path)

    def make(ids: list) -> list:
        encoder = shared.get()
        return [pa.array([encoder.decode(i or b"") for i in ids], pa.string())]
    return add_columns(df, ids_col, StructType().add(out, StringType()), make)


def codec_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    coded = encode(docs.select("doc_id", "text"), path or tokenizer_path("word_bpe_49k.json"), decoded="decoded")
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
