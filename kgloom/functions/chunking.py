"""Chunking of documents. A document's chunks are built inside its own row, so no shuffle is needed."""
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from kgloom import vocab as V
from kgloom.functions import text as T
from kgloom.functions.arrays import bound_rows, explode_rows
from kgloom.functions.places import window_places

# in texts with more windows than this, places come from an index over the words
LONG_TEXT = 64
# array of 1-based positions found so far; 0 marks "not found"
_FOLD_PLACES = ("aggregate({c}, cast(array() as array<int>), (acc, c) -> "
                "concat(acc, array(locate(c, {t}, greatest(1, coalesce(try_element_at(acc, -1), 1))))))")


def window_sizes(max_tokens: int, overlap: int) -> tuple[int, int]:
    """Words per chunk and words per step for a token window."""
    per_chunk = int(max_tokens / V.WORD_TOKEN_RATIO)
    step = int(max(1, max_tokens - overlap) / V.WORD_TOKEN_RATIO)
    if step < 1:
        raise ValueError("max_tokens - overlap must be at least 2 tokens")
    return per_chunk, step


@F.pandas_udf(ArrayType(IntegerType()))
def _window_places(text: pd.Series, size: pd.Series, step: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else window_places(t, int(n), int(k)) for t, n, k in zip(text, size, step)])


def sliding_chunks(df: DataFrame, max_tokens: int = V.EMBED_WINDOW[0], overlap: int = V.EMBED_WINDOW[1],
                   id_col: str = "id", text_col: str = "raw_text", offsets: bool = True) -> DataFrame:
    """Overlapping word windows: document_id, chunk_index, text, token_count, start_char, end_char.

    Windows start at word 0, step, 2*step, ... as long as words remain. The start
    offset is the first verbatim occurrence at or after the previous chunk's
    start; a chunk that does not occur verbatim has offsets 0 and 0. They are searched
    by built-in functions, in long texts by ``window_places``, whose time is linear.
    """
    per_chunk, step = window_sizes(max_tokens, overlap)
    base = bound_rows(df, [F.col(id_col).alias("document_id")], F.col(text_col), lambda t: F.struct(t.alias("_t"), T.words(t).alias("_w"))).select("document_id", "_b.*")
    # blank documents get a NULL array, which gives no rows below
    starts = F.when(F.size("_w") > 0, F.sequence(F.lit(1), F.size("_w"), F.lit(step)))
    base = base.withColumn("_c", F.transform(starts, lambda s: F.array_join(F.slice("_w", s, per_chunk), " ")))
    # the words of a window are counted by its place, so its text is not split again
    size, first = F.size("_w"), F.col("chunk_index") * step
    tokens = T.tokens_of(F.least(F.lit(per_chunk), F.col("_size") - first)).alias("token_count")
    if offsets:
        long_text = F.when(F.size("_w") > LONG_TEXT * step, F.col("_t"))
        base = base.withColumn("_p", _window_places(long_text, F.lit(per_chunk), F.lit(step)))
        found = F.coalesce("_p", F.expr(_FOLD_PLACES.format(c="_c", t="_t")))
        base = explode_rows(base, ["document_id", size.alias("_size")], F.arrays_zip(F.col("_c").alias("text"), found.alias("at")), "_z", "chunk_index")
        at, body = F.col("_z.at"), F.col("_z.text")
        return base.select(
            "document_id", "chunk_index", body.alias("text"), tokens,
            F.greatest(at - 1, F.lit(0)).alias("start_char"),
            F.when(at > 0, at - 1 + F.length(body)).otherwise(0).alias("end_char"))
    base = explode_rows(base, ["document_id", size.alias("_size")], "_c", "text", "chunk_index")
    return base.select("document_id", "chunk_index", "text", tokens)


@F.pandas_udf(ArrayType(IntegerType()))
def _group_ends(tokens: pd.Series, max_tokens: pd.Series) -> pd.Series:
    """Sentence token counts of a document -> end index of each greedy group."""
    out = []
    for row, budget in zip(tokens, max_tokens):
        cum = np.concatenate(([0], np.cumsum(np.asarray(() if row is None else row, dtype=np.int64))))
        n, at, stops = len(cum) - 1, 0, []
        while at < n:
            at = max(at + 1, int(np.searchsorted(cum, cum[at] + int(budget), side="right")) - 1)
            stops.append(at)
        out.append(stops)
    return pd.Series(out)


_GROUPS = ("transform(_e, (e, i) -> named_struct("
           "'text', array_join(slice(_s, if(i = 0, 0, _e[i - 1]) + 1, e - if(i = 0, 0, _e[i - 1])), ' '),"
           "'token_count', aggregate(slice(_n, if(i = 0, 0, _e[i - 1]) + 1, e - if(i = 0, 0, _e[i - 1])), 0, (a, x) -> a + x)))")
# 0-based starts; the search continues after the previous group's end
_FOLD_GROUP_PLACES = ("aggregate(_g, cast(array() as array<struct<s:int,e:int>>), (acc, g) -> concat(acc, transform("
                      "array(locate(g.text, _t, coalesce(try_element_at(acc, -1).e, 0) + 1) - 1),"
                      " p -> named_struct('s', p, 'e', greatest(0, p + length(g.text))))))")


def sentence_chunks(df: DataFrame, max_tokens: int = V.EMBED_WINDOW[0], id_col: str = "id",
                    text_col: str = "raw_text", offsets: bool = True) -> DataFrame:
    """Whole sentences grouped greedily up to ``max_tokens``; a longer sentence stands alone."""
    base = bound_rows(df, [F.col(id_col).alias("document_id")], F.col(text_col), lambda t: F.struct(t.alias("_t"), T.sentences(t).alias("_s")),
                      lambda b: F.struct(b["_t"], b["_s"], F.transform(b["_s"], T.count_tokens).alias("_n"))).select("document_id", "_b.*")
    base = base.withColumn("_e", _group_ends("_n", F.lit(max_tokens)))
    base = base.withColumn("_g", F.expr(_GROUPS))
    if not offsets:
        base = explode_rows(base, ["document_id"], "_g", "_g", "chunk_index")
        return base.select("document_id", "chunk_index", F.col("_g.text").alias("text"), F.col("_g.token_count").alias("token_count"))
    found = F.expr(_FOLD_GROUP_PLACES)
    base = explode_rows(base, ["document_id"], F.arrays_zip("_g", found.alias("at")), "_z", "chunk_index")
    return base.select("document_id", "chunk_index", F.col("_z._g.text").alias("text"),
                       F.col("_z._g.token_count").alias("token_count"),
                       F.greatest(F.col("_z.at.s"), F.lit(0)).alias("start_char"), F.col("_z.at.e").alias("end_char"))


def _let(name: str, value: str, body: str) -> str:
    """SQL expression ``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def register_chunk_functions(spark: SparkSession) -> list[str]:
    """Makes the chunkers table functions of ``spark.sql``, for use in FROM.

    ``kg_sliding_chunks(text, max_tokens, overlap)`` and ``kg_sentence_chunks(text, max_tokens)``
    give chunk_index, text, token_count, start_char, end_char of one text; with LATERAL, of each
    row: ``SELECT d.id, c.* FROM docs d, LATERAL kg_sliding_chunks(d.raw_text, 1000, 100) c``.
    Rows equal those of ``sliding_chunks`` and ``sentence_chunks``. They are built-in functions
    only, so places in very long texts take longer here than there. NULL and blank texts give none.
    """
    size, step = f"int(max_tokens / {V.WORD_TOKEN_RATIO}D)", f"int(greatest(1, max_tokens - overlap) / {V.WORD_TOKEN_RATIO}D)"
    checked = f"if({step} < 1, raise_error('max_tokens - overlap must be at least 2 tokens'), {step})"
    tokens = T.count_tokens_sql("c")
    windows = _let("w", T.words_sql("x"), f"if(size(w) > 0, transform(sequence(1, size(w), {checked}), s -> array_join(slice(w, s, {size}), ' ')), null)")
    placed = _let("p", _FOLD_PLACES.format(c="_c", t="x"), f"transform(_c, (c, i) -> named_struct('i', i, 'c', c, 'n', {tokens}, "
                  "'s', greatest(p[i] - 1, 0), 'e', if(p[i] > 0, p[i] - 1 + length(c), 0)))")
    # ends of the greedy groups: a sentence that does not fit closes the group before it
    ends = ("aggregate(_n, named_struct('k', 0, 'sum', 0, 'e', cast(array() as array<int>)), (a, n) -> named_struct('k', a.k + 1, "
            "'sum', if(a.sum + n > max_tokens, 0, a.sum) + n, 'e', if(a.sum + n > max_tokens and a.k > coalesce(try_element_at(a.e, -1), 0), "
            "concat(a.e, array(a.k)), a.e)), a -> if(a.k > 0, concat(a.e, array(a.k)), a.e))")
    located = _let("p", _FOLD_GROUP_PLACES.replace("_t", "x"), "transform(_g, (g, i) -> named_struct('i', i, 'c', g.text, 'n', g.token_count, "
                   "'s', greatest(p[i].s, 0), 'e', p[i].e))")
    groups = _let("_g", _let("_e", ends, _GROUPS), located)
    sentences = _let("_s", T.sentences_sql("x"), _let("_n", f"transform(_s, c -> {tokens})", groups))
    columns = "TABLE(chunk_index INT, text STRING, token_count INT, start_char INT, end_char INT)"
    bodies = {"kg_sliding_chunks": ("x STRING, max_tokens INT, overlap INT", _let("_c", windows, placed)),
              "kg_sentence_chunks": ("x STRING, max_tokens INT", sentences)}
    for name, (args, array) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {columns} RETURN SELECT inline({array})")
    return list(bodies)
