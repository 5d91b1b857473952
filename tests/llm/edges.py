"""Documents with every awkward case, for all operators."""
from pyspark.sql.types import LongType, StringType, StructField, StructType

LONG = "word " * 40_000 + "x" * 30_000 + " idiot"

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a", 60),
    (2, None, "en", "a", None),
    (3, "", None, "a", 0),
    (4, LONG, "en", None, len(LONG)),
    (5, "The quick  brown fox\njumps over the lazy dog again and again.", "en", "a", 61),
    (6, "The quick brown fox jumps over the lazy dog again and again.", None, "b", 60),
    (None, "A row without an id.", "en", "b", 20),
    (7, " \t\n ", "en", "b", 4),
    (8, "¿Dónde está la biblioteca? <|endoftext|> İstanbul ΑΣ ﬁ é \U0001f600", "es", "b", 60),
    (9, "123 456 --- !!!", "en", "b", 15),
    (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a", 60),
]
SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                     StructField("source", StringType()), StructField("n_chars", LongType())])
# names that operators use for columns of their own
CLASHING = ["score", "kept", "ids", "decoded", "n_tokens", "shard", "size", "_language", "_toxicity", "component_id", "length", "key", "row", "p"]


def documents(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def with_clashes(df):
    from pyspark.sql import functions as F
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])
