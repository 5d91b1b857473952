"""Every registered query against its SQL twin at the smallest scale (some of them only with FEW_QUERIES=1)."""
import math
import os

import pytest

import __spark_entry__ as entry
from kgloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["ontology_class_patterns", "quality_metrics", "chunk_sliding_window", "extract_entities_by_gazetteer", "graph_neighborhood_edges",
          "vector_search_all_pairs", "relations_dedup", "validation_shapes", "run_steps_folded", "proposals_applied"]


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_query_has_a_twin():
    assert set(catalogue.QUERIES) == set(catalogue.SQL)
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(catalogue.SQL) <= set(entry.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", SAMPLE if os.environ.get("FEW_QUERIES") else sorted(catalogue.QUERIES))
def test_twin(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == sorted(tuple(norm(r[i]) for i in order) for r in cur.fetchall())
