"""Views of the test tables against plain Python."""
import os
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kgloom.plans import catalogue
from kgloom.plans import lenses as N
from kgloom.plans import ontology_queries as OQ
from kgloom.plans import retrieval_queries as RQ
from kgloom.session import next_within

SF = "/root/testdata/sf0.001"


def test_next_event_over_days_and_for_every_user(spark, tmp_path):
    start = datetime(2024, 1, 1, 22)
    # users 10 and 20 divide by ten, and events are seven hours apart, so many successors are past midnight
    events = [(k, start + timedelta(hours=7 * (k // 3)), (10, 20, 3)[k % 3], ("click", "purchase", "view")[k % 5 % 3], 50.0, "{}") for k in range(60)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    by_user = defaultdict(list)
    for e in events:
        by_user[e[2]].append((e[1], e[0], e[3]))
    want = {(f"e:{a[1]}", f"e:{b[1]}") for rows in by_user.values() for a, b in zip(sorted(rows), sorted(rows)[1:]) if a[2] != "view"}
    got = [(r.source_entity_id, r.target_entity_id) for r in N.mention_relationships(spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want)


def test_next_within_one_hot_key(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(6000).select(F.when(F.col("id") % 100 == 0, F.col("id")).otherwise(7).alias("k"), (F.col("id") * 7919 % 6007).alias("o")).withColumn("v", F.when(F.col("o") % 5 > 0, F.col("o")))
        got = {(r.k, r.o): r.n for r in next_within(df.repartition(7), ["k"], ["o"], "v", "n").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = defaultdict(list)
    for k, o in got:
        rows[k].append(o)
    assert len(got) == 6000
    assert all(got[k, a] == (b if b is not None and b % 5 else None) for k, os in rows.items() for a, b in zip(sorted(os), [*sorted(os)[1:], None]))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_profile_has_a_line_for_every_type(spark):
    lines = [r.line for r in catalogue.QUERIES["ontology_profile_lines"](spark, SF).collect()]
    both = [r for view in (N.star_entities, N.mention_entities) for r in view(spark, SF).select("name", "entity_type", "pos").collect()]
    companies = [r.name for r in sorted(both, key=lambda r: r.pos) if r.entity_type == "Company"]
    names = list(dict.fromkeys(companies))
    assert f"  Company ({len(companies)} instances): {', '.join(names[:10])} (+{len(names) - 10} more)" in lines
    assert {x.split()[0] for x in lines if " instances): " in x} == {r.entity_type for r in both}


def test_graph_has_pattern_entities_and_classes_have_phrases(spark, tmp_path):
    passage = "quarterly delivery agreement between northern suppliers and retail partners under annual pricing terms for warehouse storage capacity"
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "delivery was late, write to ann@mail.org or see https://mail.org/x for the agreement", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, "user", f"Who knows of the {passage}?")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    sf = str(tmp_path)
    nodes, edges = RQ._text_graph(spark, sf)
    assert {"ann@mail.org", "https://mail.org/x", "delivery", "agreement"} <= {r.name for r in nodes.collect()}
    assert edges.count() == nodes.count() - 1
    phrases = {r.name for r in N.gazetteer(spark, sf).filter("instr(name, ' ') > 0").collect()}
    assert phrases and phrases <= {r.name for r in OQ.question_classes(spark, sf).collect()}
    assert phrases <= {r.class_name for r in catalogue.QUERIES["ontology_classes_of_questions"](spark, sf).collect()}
