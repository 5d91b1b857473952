import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kgloom.operators import graph as G
from kgloom.operators import ontology as O
from kgloom.operators import quality as Q
from kgloom.operators import traversal as R
from kgloom.operators import validation as C
from kgloom.session import number_within
from kgloom.sources import tables as S

ENT = "id string, document_id string, entity_type string, name string, confidence double, attributes map<string,string>, pos int"
EDGE = "id string, src string, tgt string, type string, confidence double"


def graph(spark, seed, n=14, m=16):
    rnd = random.Random(seed)
    nodes = spark.createDataFrame([("L", f"n{i:02d}", f"name{i}", "T", 1.0) for i in range(n)], "label string, id string, name string, entity_type string, confidence double")
    raw = [(f"e{j}", f"n{rnd.randrange(n):02d}", f"n{rnd.randrange(n):02d}", "R", round(rnd.random(), 2)) for j in range(m)]
    return nodes, spark.createDataFrame(raw, EDGE), raw, [f"n{i:02d}" for i in range(n)]


def bfs(raw, start):
    adj = defaultdict(set)
    for _, s, t, *_ in raw:
        adj[s].add(t)
        adj[t].add(s)
    dist, frontier = {start: 0}, [start]
    while frontier:
        nxt = []
        for u in frontier:
            for v in adj[u]:
                if v not in dist:
                    dist[v] = dist[u] + 1
                    nxt.append(v)
        frontier = nxt
    return dist


def test_neighborhood_matches_brute_force(spark, rows):
    for seed in (1, 2):
        nodes, edges, raw, ids = graph(spark, seed)
        starts = spark.createDataFrame([(i,) for i in ids[:4] + ["unknown"]], "start_id string")
        for k in (0, 1, 3):
            n, e = R.neighborhood(nodes, edges, starts, k)
            want_n, want_e = [], []
            for s in ids[:4]:
                d = bfs(raw, s)
                want_n += [(s, v, x) for v, x in d.items() if x <= k]
                want_e += [(s, r[0]) for r in raw if min(d.get(r[1], 99), d.get(r[2], 99)) <= k - 1]
            assert rows(n, "start_id", "id", "dist") == sorted(want_n, key=repr)
            assert rows(e, "start_id", "id") == sorted(want_e, key=repr)


def test_shortest_paths(spark):
    nodes, edges, raw, ids = graph(spark, 4)
    pairs = spark.createDataFrame([(a, b) for a in ids[:3] for b in ids], "from_id string, to_id string")
    got = {(r.from_id, r.to_id): (r.hops, r.path.split("->")) for r in R.shortest_paths(nodes, edges, pairs, 3).collect()}
    linked = {frozenset((r[1], r[2])) for r in raw}
    want = {(a, b): d for a in ids[:3] for b, d in bfs(raw, a).items() if d <= 3}
    assert {k: v[0] for k, v in got.items()} == want
    for (a, b), (hops, path) in got.items():
        assert path[0] == a and path[-1] == b and len(path) == hops + 1
        assert all(frozenset(p) in linked for p in zip(path, path[1:]))


def components(raw):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for _, s, t, *_ in raw:
        a, b = find(s), find(t)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def test_components_and_weak_clusters(spark, rows):
    _, edges, raw, _ = graph(spark, 7, n=40, m=34)
    assert rows(R.connected_components(edges)) == sorted(components(raw).items(), key=repr)
    chain = [(f"c{i}", f"x{i:03d}", f"x{i + 1:03d}", "R", 0.1) for i in range(60)] + [("loop", "z", "z", "R", 0.2)]
    assert dict(rows(R.connected_components(spark.createDataFrame(chain, EDGE)))) == components(chain)
    low = 0.6
    groups = defaultdict(list)
    for r in raw:
        groups[components(raw)[r[1]]].append(r[4])
    want = sorted((c, len(v), max(v)) for c, v in groups.items() if max(v) < low)
    assert rows(C.low_confidence_clusters(edges, low), "component", "edge_count", "max_confidence") == want


def entities(spark, data):
    return spark.createDataFrame([(i, "d", t, n, c, {}, p) for p, (i, t, n, c) in enumerate(data)], ENT)


def test_merge_is_idempotent_and_counts(spark, rows):
    e = entities(spark, [("1", "legal-entity", "A", 0.5), ("2", "Person", "B", 0.5), ("1", "legal-entity", "A2", 0.6)])
    none = G.nodes_from(e).limit(0)
    nodes, counts = G.merge_nodes(none, e)
    assert rows(counts) == [(2, 1)] and rows(nodes, "label", "id", "name", "was_created") == [("LegalEntity", "1", "A2", True), ("Person", "2", "B", True)]
    again, counts = G.merge_nodes(nodes, e)
    assert rows(counts) == [(0, 3)] and rows(again, "label", "id", "name", "was_created") == [("LegalEntity", "1", "A2", False), ("Person", "2", "B", False)]
    # a new type gives a second node under the same id
    more, _ = G.merge_nodes(nodes, entities(spark, [("2", "Company", "B", 0.5)]))
    assert rows(more, "label", "id") == [("Company", "2"), ("LegalEntity", "1"), ("Person", "2")]
    r = spark.createDataFrame([("r1", "1", "2", "USES", 0.5, "d"), ("r2", "1", "9", "USES", 0.5, "d"), ("r3", None, "2", "USES", 0.5, "d")],
                              "id string, source_entity_id string, target_entity_id string, relationship_type string, confidence double, document_id string")
    edges, counts = G.merge_edges(G.edges_from(r).limit(0), nodes, r)
    assert rows(counts) == [(1, 0, 1)] and rows(edges, "id", "was_created") == [("r1", True)]


def test_replace_by_key_is_idempotent(spark, rows):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "document_id string, v int")
    new = spark.createDataFrame([("a", 9), ("c", 4)], "document_id string, v int")
    once = S.replace_by_key(old, new)
    assert rows(once) == [("a", 9), ("b", 3), ("c", 4)] == rows(S.replace_by_key(once, new))


def test_cascade_delete(spark, rows):
    docs = spark.createDataFrame([("a",), ("b",)], "id string")
    child = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", None)], "id string, document_id string")
    out = S.cascade_delete({"documents": docs, "entities": child, "issues": child}, spark.createDataFrame([("a",)], "document_id string"))
    assert rows(out["documents"]) == [("b",)] and rows(out["entities"], "id", "document_id") == [("2", "b"), ("3", None)]
    assert rows(out["issues"], "id", "document_id") == [("1", None), ("2", "b"), ("3", None)]


def test_corrections_settle(spark, rows):
    e = entities(spark, [("1", "company", "A", 0.5), ("2", "Company", "A", 0.9), ("3", "PERSON", "B", 0.5), ("4", "Gadget", "C", 0.5), ("0", "Person", "B", 0.5)])
    fixed, n = Q.auto_correct(e)
    assert rows(n) == [(2,)] and rows(fixed, "id", "entity_type") == [("0", "Person"), ("2", "Company"), ("4", "Gadget")]
    assert rows(Q.auto_correct(fixed)[1]) == [(0,)]


def test_seed_fallback_and_empty(spark, rows):
    e = entities(spark, [("1", "Company", "A", 0.5), ("2", "Person", None, 0.5)])
    nodes = G.nodes_from(e)
    assert rows(G.seed_nodes(nodes, ["company"]), "id", "name") == [("1", "A")]
    assert rows(G.seed_nodes(nodes, ["nothing"]), "id", "name") == [("1", "A"), ("2", "(unnamed)")]
    assert G.seed_nodes(nodes, []).count() == 0


def test_typed_edges_round_trip(spark, rows, tmp_path):
    _, edges, raw, _ = graph(spark, 3)
    path = str(tmp_path / "edges")
    G.write_typed_edges(edges.withColumn("type", F.when(F.col("confidence") > 0.5, "A").otherwise("B")), path, rows_per_task=3)
    back = spark.read.parquet(path)
    assert back.count() == len(raw) and rows(back.select("type").distinct()) == [("A",), ("B",)]
    G.reset_graph(back, str(tmp_path / "empty"))
    assert spark.read.parquet(str(tmp_path / "empty")).count() == 0


def test_number_within_one_hot_key(spark, rows):
    df = spark.range(2000).select(F.when(F.col("id") % 10 == 0, None).otherwise("hot").alias("k"), ((F.col("id") * 7919) % 2000).alias("o"))
    got = number_within(df.repartition(7), ["k"], ["o"], "n")
    want = []
    for k in (None, "hot"):
        os_ = sorted((i * 7919) % 2000 for i in range(2000) if (i % 10 == 0) == (k is None))
        want += [(k, o, n + 1) for n, o in enumerate(os_)]
    assert rows(got) == sorted(want, key=repr)


def test_report_after_clean_build(spark, rows):
    e = entities(spark, [("1", "Company", "A", 0.5), ("2", "Person", "B", 0.5)])
    r = spark.createDataFrame([("r", "1", "2", "USES", "d")], "id string, source_entity_id string, target_entity_id string, relationship_type string, document_id string")
    v = C.consistency_violations(e, r)
    assert v.count() == 0
    assert C.report_summary(C.validation_report(v, e, r)).first().summary == "Validation PASSED: 0 errors, 0 warnings across 3 items"


def test_deep_pages_equal_shallow_ones(spark, rows, monkeypatch):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("g")).repartition(6)
    order = [F.col("g").desc(), "id"]
    want = sorted(((-(i % 7), i) for i in range(500)))[120:150]
    assert [r.id for r in S.paginate(df, order, 30, 120).collect()] == [i for _, i in want]
    monkeypatch.setattr("kgloom.session.DEEP_PAGE", 10)
    deep = S.paginate(df, order, 30, 120).collect()
    assert [r.id for r in deep] == [i for _, i in want] and deep[0].total == 500


def test_last_edge_wins_by_order(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    rels = spark.createDataFrame([("e", "a", "b", "OWNS", 0.5, "d", 2), ("e", "a", "b", "USES", 0.5, "d", 1)],
                                 "id string, source_entity_id string, target_entity_id string, relationship_type string, confidence double, document_id string, seq int")
    edges, _ = G.merge_edges(G.edges_from(rels).limit(0), nodes, rels, order="seq")
    assert [r.type for r in edges.collect()] == ["OWNS"]


def test_weak_edges_are_cut_after_the_names(spark):
    nodes = spark.createDataFrame([("a", "A", "T"), ("b", "B", "T")], "id string, name string, entity_type string")
    edges = spark.createDataFrame([("1", "x", "y", "R", 0.1), ("2", "a", "b", "R", 0.2)], "id string, src string, tgt string, type string, confidence double")
    assert [r.edge_id for r in G.low_confidence_edges(nodes, edges, limit=1).collect()] == ["2"]


def test_a_target_may_carry_several_types(spark):
    from kgloom.operators import validation
    nodes = spark.createDataFrame([("a", "Person", "d", {"k": "v"}), ("b", "Person", "d", {"k": "v"}), ("b", "Company", "d", {"k": "v"})], "id string, entity_type string, document_id string, attributes map<string,string>")
    edges = spark.createDataFrame([("1", "a", "b", "WORKS_FOR", "d"), ("2", "b", "a", "WORKS_FOR", "d"), ("3", "b", "zz", "WORKS_FOR", "d")], "id string, src string, tgt string, type string, document_id string")
    rules = spark.createDataFrame([("r", "class", "Company", "WORKS_FOR", None)], "rule_id string, kind string, target_class string, property string, argument string")
    assert sorted(r.node_id for r in validation.shape_violations(nodes, edges, rules).collect()) == ["2", "3"]


def test_few_rules_move_neither_nodes_nor_all_types(spark, rows, capsys):
    nodes = spark.createDataFrame([("a", "Person", "d", {"k": "v"}), ("b", "Company", "d", {"k": "7"}), ("c", None, None, None)], "id string, entity_type string, document_id string, attributes map<string,string>")
    edges = spark.createDataFrame([("1", "a", "b", "USES", "d"), ("2", "b", "a", "USES", None), ("3", "b", None, "USES", "d"), ("4", "a", "c", "OWNS", "d")],
                                  "id string, src string, tgt string, type string, document_id string")
    rules = spark.createDataFrame([("r", "class", "Company", "USES", None), ("n", "class", None, "OWNS", None), ("i", "datatype", "Person", "k", "integer"), ("m", "minCount", "Company", "x", None),
                                   ("p", "pattern", "Company", "k", "^[a-z]$")], "rule_id string, kind string, target_class string, property string, argument string")
    found = C.shape_violations(nodes, edges, rules)
    assert rows(found, "rule_id", "severity", "message", "node_id", "document_id") == [
        ("i", "error", "Property 'k' is not of type integer", "a", "d"), ("m", "error", "Required property 'x' is missing", "b", "d"),
        ("n", "warning", "Target of OWNS is not a null", "4", "d"), ("p", "warning", "Property 'k' does not match ^[a-z]$", "b", "d"),
        ("r", "warning", "Target of USES is not a Company", "2", None), ("r", "warning", "Target of USES is not a Company", "3", "d")]
    found.explain("formatted")
    plan = capsys.readouterr().out
    # rules are sent to nodes and edges, and types of nodes are not gathered
    assert "collect_set" not in plan and plan.count("BroadcastHashJoin Inner") >= 2


def test_all_ancestors(spark):
    from kgloom.operators import ontology
    chain = [(f"c{i}", f"c{i + 1}") for i in range(8)] + [("x", "y"), ("y", "x"), ("top", None)]
    classes = spark.createDataFrame(chain, "name string, parent_class string")
    got = {(r.child, r.ancestor): r.distance for r in ontology.ancestor_pairs(classes).collect()}
    assert got["c0", "c8"] == 8 and got["x", "x"] == 2 and got["x", "y"] == 1 and len(got) == 36 + 4
    assert max(r.distance for r in ontology.ancestor_pairs(classes, 5).collect()) == 5


def _all_paths(edges, start, goal, depth):
    """Shortest path by search, lowest ids walking back from the goal."""
    near = {start: 0}
    layer = [start]
    nbr = {}
    for a, b in edges:
        if a != b:
            nbr.setdefault(a, set()).add(b)
            nbr.setdefault(b, set()).add(a)
    for d in range(1, depth + 1):
        layer = sorted({b for a in layer for b in nbr.get(a, ()) if b not in near})
        near.update(dict.fromkeys(layer, d))
    if goal not in near:
        return None
    path = [goal]
    while path[-1] != start:
        path.append(min(b for b in nbr[path[-1]] if near.get(b) == near[path[-1]] - 1))
    return near[goal], "->".join(reversed(path))


@pytest.mark.parametrize("depth", [1, 2, 3, 5, 6])
def test_paths_from_both_ends_equal_search(spark, rows, depth):
    rng = random.Random(depth)
    ids = [f"v{i:02d}" for i in range(40)]
    links = [(rng.choice(ids), rng.choice(ids)) for _ in range(48)] + [(ids[0], i) for i in ids[1:9]]
    nodes = spark.createDataFrame([("L", i, i, "T", 1.0) for i in ids], "label string, id string, name string, entity_type string, confidence double")
    edges = spark.createDataFrame([(f"e{k}", a, b, "R") for k, (a, b) in enumerate(links)], "id string, src string, tgt string, type string")
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(60)] + [("nobody", ids[0]), (ids[0], "nobody"), (ids[3], ids[3])]
    got = rows(R.shortest_paths(nodes, edges, spark.createDataFrame(pairs, "from_id string, to_id string"), depth))
    want = [(a, b, *found) for a, b in set(pairs) if a in ids and b in ids and (found := _all_paths(links, a, b, depth))]
    assert got == sorted(want, key=repr) and len(want) > 3


def test_ontology_parts_make_the_document(spark):
    schema = "id string, document_id string, entity_type string, name string, confidence double, attributes map<string,string>"
    e = spark.createDataFrame([(f"e{i}", "d", f'T"{i % 7}é', f"n{i}", 0.5, {"age": str(i), "x\\y": "a"} if i % 2 else {}) for i in range(30)], schema)
    r = spark.createDataFrame([(f"r{i}", "d", f"e{i}", f"e{(i * 5) % 30}", f"R{i % 4}", 0.5) for i in range(30)],
                              "id string, document_id string, source_entity_id string, target_entity_id string, relationship_type string, confidence double")
    whole = O.ontology_document(e, r, 'a "b"}').first().ontology_json
    for per_part in (1, 3, 1000):
        parts = O.ontology_parts(e, r, 'a "b"}', per_part).orderBy("part").collect()
        assert [p.part for p in parts] == list(range(len(parts)))
        assert "".join(p.text for p in parts) == whole
    none = O.ontology_parts(e.limit(0), r.limit(0)).orderBy("part").collect()
    assert "".join(p.text for p in none) == '{"domain":"derived","classes":[],"relationships":[]}'


def test_patterns_are_counted_before_names_are_looked_up(spark, rows):
    from kgloom.operators import ontology as O
    e = spark.createDataFrame([("a", "A", "X", 1), ("b", "B", "", 2), ("c", "B", "Y", 3)], "id string, name string, entity_type string, pos int")
    r = spark.createDataFrame([("1", "a", "b", "R", "A", "B"), ("2", "a", "z", "R", "A", "z"), ("3", "y", "c", "R", "B", "B"), ("4", "y", None, "R", None, None)],
                              "id string, source_entity_id string, target_entity_id string, relationship_type string, source_entity_name string, target_entity_name string")
    got = O.class_patterns(e, r)
    assert rows(got) == sorted([("X", "R", "Y", 1), ("X", "R", "Unknown", 1), ("Y", "R", "Y", 1), ("Unknown", "R", "Unknown", 1)], key=repr)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("count(1)") > plan.index("_n#")


def test_edges_away_from_many_asked_nodes_are_not_shuffled(spark, rows, monkeypatch):
    nodes = spark.createDataFrame([(f"n{i}", f"name {i}", "T" if i < 30 else "U", None, 1.0) for i in range(1000)],
                                  "id string, name string, entity_type string, label string, confidence double")
    edges = spark.createDataFrame([(f"e{i:04d}", f"n{i}", f"n{(i * 7) % 1000}", "R") for i in range(1000)] + [("a", "n1", "gone", "R"), ("b", None, "n1", "R")],
                                  "id string, src string, tgt string, type string")
    want = rows(G.touching_edges(edges, nodes, ["t"], None))
    assert {r[0] for r in want} == {f"e{i:04d}" for i in range(1000) if i < 30 or (i * 7) % 1000 < 30}
    first = rows(G.touching_edges(edges, nodes, ["t"], 5))
    asked = nodes.filter("entity_type = 'T'").select(F.col("id").alias("end"))
    near = G._may_be(edges.withColumn("end", F.col("src")), "end", G._bits(asked, "end"))
    assert 30 <= near.filter("id like 'e%'").count() < 40 and near.filter("id = 'a'").count() == 1
    # the same edges if the asked nodes are too many to be sent to every task
    monkeypatch.setattr(G, "BROADCAST_ROWS", 0)
    assert rows(G.touching_edges(edges, nodes, ["t"], None)) == want and rows(G.touching_edges(edges, nodes, ["t"], 5)) == first


def _joins(df):
    return sum(line.lstrip(" :+-").startswith("Join") for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_edge_counts_look_up_the_ends_once(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    rels = spark.createDataFrame([("r1", "a", "b"), ("r1", "a", "b"), ("r2", "a", "x"), ("r3", "y", "x"), ("r4", None, "b"), ("r5", "b", "a")],
                                 "id string, source_entity_id string, target_entity_id string").selectExpr("*", "'USES' as relationship_type", "0.5D as confidence", "'d' as document_id")
    old = G.edges_from(rels.filter("id = 'r5'"))
    _, counts = G.merge_edges(old, nodes, rels)
    assert [tuple(r) for r in counts.collect()] == [(1, 2, 2)]
    assert _joins(counts) == 3
    _, counts = G.merge_edges(old, nodes, rels.limit(0))
    assert [tuple(r) for r in counts.collect()] == [(0, 0, 0)]


def test_names_of_both_ends_are_taken_from_one_pass(spark):
    names = spark.createDataFrame([("1", "A"), ("2", None)], "k string, n string")
    rels = spark.createDataFrame([("r", "1", "2"), ("s", "1", "1")], "id string, a string, b string").join(names.toDF("a", "source_entity_name"), "a").join(
        names.toDF("b", "target_entity_name"), "b").withColumn("relationship_type", F.lit("USES"))
    entities = spark.createDataFrame([("a", "Company", 1)], "name string, entity_type string, pos long")
    nodes, _ = G.name_graph(rels, entities)
    assert sorted((r.name or "", r.entity_type) for r in nodes.collect()) == [("", None), ("A", "Company")]
    assert _joins(nodes) == 3


def _recorded(monkeypatch, module):
    """Frames that ``module`` cuts from their lineage, in order."""
    seen, cut = [], module.cut_lineage
    monkeypatch.setattr(module, "cut_lineage", lambda df: seen.append(cut(df)) or seen[-1])
    return seen


def test_last_ring_of_paths_holds_only_places_of_the_trees(spark, rows, monkeypatch):
    from kgloom.operators import traversal as R
    # a start, two places between, and a target with 500 neighbours that lie on no path
    links = [("s", "m"), ("m", "n"), ("n", "t"), ("m", "t2"), *[("t", f"x{i}") for i in range(500)], *[(f"x{i}", f"y{i}") for i in range(500)]]
    edges = spark.createDataFrame(links, "src string, tgt string")
    nodes = spark.createDataFrame([(i,) for i in sorted({x for p in links for x in p})], "id string")
    pairs = spark.createDataFrame([("s", "t"), ("s", "t2"), ("s", "x1"), ("t", "s")], "from_id string, to_id string")
    seen = _recorded(monkeypatch, R)
    got = rows(R.shortest_paths(nodes, edges, pairs, 3))
    assert got == sorted([("s", "t", 3, "s->m->n->t"), ("s", "t2", 2, "s->m->t2"), ("t", "s", 3, "t->n->m->s")], key=repr)
    rings = [f.count() for f in seen if f.columns == ["to_id", "at", "way"]]
    assert len(rings) == 2 and rings[1] < 20


def test_first_edges_of_frequent_types_come_from_the_head(spark, rows, monkeypatch):
    nodes = spark.createDataFrame([(f"n{i}", f"name {i}", "rare" if i == 990 else ("A", "B")[i % 2], ("a", None)[i % 2], 1.0) for i in range(1000)] + [("n5", "other", "C", "zz", 1.0)],
                                  "id string, name string, entity_type string, label string, confidence double")
    edges = spark.createDataFrame([(f"{i * 7919 % 1000:04d}", f"n{i}", f"n{(i * 7) % 1000}", "R") for i in range(1000)]
                                  + [("0000", "n1", "gone", "R"), ("0001", "n2", "n4", "A"), (None, "n1", "n3", "R"), ("0002", None, "n1", "R")], "id string, src string, tgt string, type string")
    keys = spark.createDataFrame([("a",), ("b",), ("rare",), ("none",), ("zz",)], "match_key string")
    seen = _recorded(monkeypatch, G)
    got = rows(G.first_touching(edges, nodes, keys, 6))
    # ends of a few edges only, none of the thousand nodes; the rare types meet all edges
    assert max(f.count() for f in seen) < 600
    assert {(r[0]): sum(x[0] == r[0] for x in got) for r in got} == {"a": 6, "b": 6, "rare": 2, "zz": 2}
    monkeypatch.setattr(G, "_head_border", lambda *_: None)
    assert rows(G.first_touching(edges, nodes, keys, 6)) == got
    monkeypatch.setattr(G, "BROADCAST_ROWS", 0)
    assert rows(G.first_touching(edges, nodes, keys, 6)) == got
    monkeypatch.undo()
    monkeypatch.setattr(G, "BROADCAST_ROWS", 0)
    assert rows(G.first_touching(edges, nodes, keys, 6)) == got


def test_numbers_of_ids_rise_with_them(spark):
    ids = ["", "a", "a0", "a00000000", "ab", "ab\u00e9", "b", "\u00e9", "x0123456789", "x0123456798", "x2"]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "id string").orderBy("id").select(G._id_number("id")).collect()]
    assert got == sorted(got) and got[0] == 0 and len(set(got)) >= 8


def test_finished_shuffles_are_freed_between_checkpoints(spark, monkeypatch):
    from kgloom import session
    called = []
    monkeypatch.setattr(session.gc, "collect", lambda: called.append(1))
    monkeypatch.setattr(session, "_freed_at", session.time.monotonic() - session.FREE_EVERY - 1)
    for _ in range(3):
        assert session.cut_lineage(spark.range(3)).count() == 3
    assert len(called) == 1
