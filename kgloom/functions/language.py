"""Language vote by stop words, over the whole text."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from kgloom import vocab as V
from kgloom.functions import text as T


def language_of(lower_words: Column, profiles=None) -> Column:
    """Code whose stop words occur most often; ties go to the lower code.

    NULL for texts of fewer than five words or without any hit.
    """
    profiles = profiles or V.STOP_WORDS

    known = sorted({w for stop in profiles.values() for w in stop})

    def vote(code, stop, hits):
        n = F.size(F.filter(hits, lambda w: w.isin(stop)))
        return F.struct((-n).alias("rank"), F.lit(code).alias("code"))

    def winner(hits):
        return F.array_min(F.array(*[vote(code, stop, hits) for code, stop in sorted(profiles.items())]))
    # one pass picks the stop words of any language, the votes then run over those few
    hits = F.filter(lower_words, lambda w: w.isin(known))
    best = F.element_at(F.transform(F.array(hits), winner), 1)
    return F.when((F.size(lower_words) >= 5) & (best["rank"] < 0), best["code"])


def detect_language(col, profiles=None) -> Column:
    return language_of(T.words(F.lower(col)), profiles)


def preprocess(df, max_tokens=V.EMBED_WINDOW[0], overlap=V.EMBED_WINDOW[1], id_col="id", text_col="raw_text"):
    """Cleaned text, language and word count per document, with its sliding chunks."""
    from kgloom.functions.chunking import sliding_chunks
    docs = df.select(F.col(id_col).alias("document_id"), T.clean_text(text_col).alias("clean"))
    docs = docs.withColumn("_w", T.words(F.lower("clean"))).select(
        "document_id", "clean", language_of(F.col("_w")).alias("language"), F.size("_w").alias("word_count"))
    return docs, sliding_chunks(docs, max_tokens, overlap, "document_id", "clean")
