"""Results stay whole when one key holds a third of all rows."""
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kgloom.operators import extraction as X
from kgloom.operators import graph as G
from kgloom.operators import ontology as O
from kgloom.operators import quality as Q
from kgloom.operators import traversal as R
from kgloom.operators import validation as C

N = 6000


@pytest.fixture(scope="module")
def hot(spark):
    """Entities of which a third share name and document, relationships of which a third touch one hub."""
    i = F.col("id")
    third = i % 3 == 0
    e = spark.range(N).select(
        F.format_string("e%05d", i).alias("id"), F.when(third, "hot").otherwise(F.format_string("d%d", i % 100)).alias("document_id"),
        F.when(third, "same").otherwise(F.format_string("n%d", i)).alias("name"), F.when(i % 2 == 0, "Company").otherwise("person").alias("entity_type"),
        ((i * 37) % 100 / 100.0).alias("confidence"), F.create_map(F.lit("k"), F.lit("v")).alias("attributes"), i.alias("pos"))
    r = spark.range(1, N).select(
        F.format_string("r%05d", i).alias("id"), F.lit("d").alias("document_id"), F.format_string("e%05d", i).alias("source_entity_id"),
        F.when(third, F.lit("e00000")).otherwise(F.format_string("e%05d", (i * 7) % N)).alias("target_entity_id"),
        F.lit("USES").alias("relationship_type"), (i % 10 / 10.0).alias("confidence"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield e, r
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_best_per_key(hot):
    e, _ = hot
    kept = Q.drop_duplicate_entities(e)
    assert kept.count() == N - N // 3 + 1
    top = kept.filter("document_id = 'hot'").first()
    best = min(((-((i * 37) % 100) / 100.0, i) for i in range(0, N, 3)))
    assert top.id == f"e{best[1]:05d}" and top.confidence == -best[0]


def test_patterns_merge_and_degrees(hot, rows):
    e, r = hot
    kind = lambda i: "Company" if i % 2 == 0 else "person"
    ends = [(i, 0 if i % 3 == 0 else (i * 7) % N) for i in range(1, N)]
    want = Counter((kind(s), "USES", kind(t)) for s, t in ends)
    assert rows(O.class_patterns(e, r)) == sorted(((*k, v) for k, v in want.items()), key=repr)
    nodes, edges = G.nodes_from(e), G.edges_from(r)
    merged, counts = G.merge_edges(edges.limit(0), nodes, r)
    assert rows(counts) == [(N - 1, 0, 0)] and merged.count() == N - 1
    deg = Counter(x for p in ends for x in p)
    assert dict(rows(C.degrees(edges)))["e00000"] == deg[0]
    start = edges.sparkSession.createDataFrame([("e00000",)], "start_id string")
    near, _ = R.neighborhood(nodes, edges, start, 1)
    assert near.count() == len({s for s, t in ends if t == 0} | {t for s, t in ends if s == 0} | {0})


def test_first_entities_and_profile(hot, rows):
    e, _ = hot
    got = rows(X.template_relations(e).filter("document_id = 'hot'"), "source_entity_id", "relationship_type", "target_entity_id")
    first = [f"e{i:05d}" for i in range(0, 15, 3)]
    assert (first[0], "WORKS_FOR", first[1]) in got and (first[1], "GOVERNED_BY", first[4]) in got and len(got) == 5
    prof = {p.entity_type: p for p in O.type_profile(e).collect()}
    assert prof["Company"].instances == N // 2 and prof["Company"].sample.startswith("same, n2, n4, n8")
