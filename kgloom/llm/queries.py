"""The registered queries of this subpackage: one per operator, over whole tables, and the pipeline."""
import corpus_pipeline
from kgloom.llm import (
    bpe_codec, exact_dedup, exact_topk, hard_negatives, language_id, ngram_join, packing, sharding, spelling, token_counts, toxicity, url_filters, vector_dedup)


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _embeddings(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _url_filters(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filters.filter_urls(url_filters.page_captures(pages), url_filters.page_lists(pages))


QUERIES = {
    "op1_toxicity": lambda spark, sf: toxicity.toxicity_report(_documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")),
    "op2_vector_dedup": lambda spark, sf: vector_dedup.near_duplicate_vectors(_embeddings(spark, sf)),
    "op3_bpe_codec": lambda spark, sf: bpe_codec.codec_digests(_documents(spark, sf)),
    "op4_sharding": lambda spark, sf: sharding.shard_report(_documents(spark, sf)),
    "op5_url_filters": _url_filters,
    "op6_ngram_join": lambda spark, sf: ngram_join.similar_groups(_documents(spark, sf)),
    "op7_best_fit_packing": lambda spark, sf: packing.pack_documents(_documents(spark, sf)),
    "op8_language_id": lambda spark, sf: language_id.language_report(_documents(spark, sf)),
    "op9_exact_dedup": lambda spark, sf: exact_dedup.exact_groups(_documents(spark, sf)),
    "op10_token_counts": lambda spark, sf: token_counts.token_report(_documents(spark, sf)),
    "op11_hard_negatives": lambda spark, sf: hard_negatives.mined_negatives(_embeddings(spark, sf)),
    "op12_spelling_variants": lambda spark, sf: spelling.spelling_variants(_documents(spark, sf)),
    "op13_exact_topk": lambda spark, sf: exact_topk.exact_topk(_embeddings(spark, sf)),
    "pipeline": corpus_pipeline.run,
}
SQL = {"op5_url_filters": url_filters.SQL, "op9_exact_dedup": exact_dedup.SQL,
       "op11_hard_negatives": hard_negatives.SQL, "op13_exact_topk": exact_topk.SQL}
