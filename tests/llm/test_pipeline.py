"""The pipeline's stages, each judged on its own input."""
import re

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from kgloom.llm import language_id, ngram_join, toxicity
from kgloom.llm.common import held_out, tokenizer_path

from .edges import documents, with_clashes
from .test_dedup import brute_groups
from .test_tokens import check_packing

SF = "/root/testdata/sf0.001"


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input of every stage, and the result."""
    folder = tmp_path_factory.mktemp("stages")
    tables = [spark.read.parquet(f"{SF}/documents.parquet")]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, tables[-1], SF).write.parquet(f"{folder}/{k}")
        tables.append(spark.read.parquet(f"{folder}/{k}"))
    return tables


def test_order_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "language_id", "exact_dedup", "ngram_join", "packing"]
    assert all(t.columns == stages[0].columns for t in stages[:-1])


def test_toxicity_stage(spark, stages):
    scores = {r.doc_id: r.score for r in toxicity.toxicity_report(stages[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert set(texts(stages[1])) == {d for d, s in scores.items() if s < toxicity.REJECT}


def test_language_stage(stages):
    model = language_id.train(stages[1].filter(~held_out("doc_id", 4, 2)))
    known = {r.doc_id for r in language_id.identify(stages[1], model).collect() if r.language.lang_pred != "und" and r.language.score >= language_id.LEAST_SCORE}
    assert set(texts(stages[2])) == known and len(known) > 150


def test_exact_stage(stages):
    first = {}
    for d, t in sorted(texts(stages[2]).items()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), d)
    assert sorted(texts(stages[3])) == sorted(first.values())


def test_near_stage(stages):
    want = {d for d, (_, c) in brute_groups(sorted(texts(stages[3]).items())).items() if c == d}
    assert set(texts(stages[4])) == want


def test_packing_stage(stages):
    rows = stages[5].collect()
    sequences, by_doc = check_packing(rows, 2048)
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    lengths = {d: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in texts(stages[4]).items()}
    assert {d: sum(p[2] for p in parts) for d, parts in by_doc.items()} == lengths
    assert sequences <= -(-sum(lengths.values()) // 2048) + 1


def test_run_gives_the_same(spark, stages):
    got = pipeline.run(spark, SF)
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert got.columns == stages[5].columns and sorted(map(tuple, got.select(*keys).collect())) == sorted(map(tuple, stages[5].select(*keys).collect()))


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
@pytest.mark.parametrize("rows", ["edges", "none"])
def test_awkward_documents(spark, name, rows):
    docs = with_clashes(documents(spark))
    docs = docs.limit(0) if rows == "none" else docs
    out = dict(pipeline.STAGES)[name](spark, docs, SF)
    if name != "packing":
        assert out.columns == docs.columns
    assert (out.count() == 0) == (rows == "none")


def test_near_copies_of_repeated_ids(spark):
    docs = documents(spark, [(1, "a b c d e f g", "en", "s", 1), (1, "h i j k l m n", "en", "s", 1), (2, "A B C D E F G", "en", "s", 1)])
    out = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_groups(docs).select("*").withColumn("x", F.lit(1)).collect()}
    assert out == {(1, 3, 1), (2, 3, 1)}
