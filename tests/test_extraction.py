import json
import random

import pytest
from pyspark.sql import functions as F

from kgloom import vocab as V
from kgloom.operators import extraction as X

ENT = "id string, document_id string, entity_type string, name string, confidence double, pos int"
REL = "id string, source_entity_id string, relationship_type string, target_entity_id string, confidence double, seq int"


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([
        ("1", "d", "Company", "Acme Corp", 0.9, 0), ("2", "d", "Person", "Alice Smith", 0.9, 1), ("3", "d", "Technology", "Kubernetes", 0.9, 2),
        ("4", "d", "Regulation", "GDPR", 0.9, 3), ("5", "d", "Location", "New York", 0.9, 4)], ENT)


def test_dedup_keeps_highest_confidence(spark, rows):
    r = spark.createDataFrame([("x", "a", "WORKS_FOR", "b", 0.6, 0), ("y", "A", "WORKS_FOR", "b", 0.9, 1), ("z", "a", "WORKS_FOR", "B", 0.4, 2),
                               ("o", "a", "OWNS", "b", None, 3), ("p", "a", "OWNS", "b", 0.0, 4)], REL)
    # None counts as 0, so the first of the two OWNS rows stays
    assert rows(X.dedup_relations(r), "id") == [("o",), ("y",)]


def response(items):
    return json.dumps({"relations": items})


def rel_item(s, t, o, conf=0.9):
    return {"source": s, "type": t, "target": o, "evidence": " e ", "confidence": conf}


def test_relations_resolve_names_and_types(spark, rows, people):
    resp = spark.createDataFrame([
        ("d", 0, "```json\n" + response([rel_item("alice smith", "works_for", "ACME CORP", 7), rel_item("Alice Smith", "USES", "Ghost"),
                                         rel_item("Acme Corp", "ACQUIRED_BY", "GDPR"), rel_item("Acme Corp", " uses ", "Kubernetes", "high")]) + "\n```"),
        ("d", 1, response([])), ("d", 2, "not json"), ("other", 0, response([rel_item("Alice Smith", "USES", "GDPR")]))],
        "document_id string, chunk_index int, response string")
    got = rows(X.relations_from_responses(resp, people), "source_entity_id", "relationship_type", "target_entity_id", "confidence", "evidence_text")
    assert got == [("1", "USES", "3", 0.8, "e"), ("2", "WORKS_FOR", "1", 1.0, "e")]
    assert X.parse_responses(resp, X.RELATION_RESPONSE)[1].count() == 1


def test_entities_from_responses(spark, rows):
    body = json.dumps({"entities": [
        {"name": " Acme ", "type": "Company", "attributes": {"k": "v"}, "evidence": "x" * 600, "confidence": -1},
        {"name": "Acme", "type": "Company", "attributes": "none"}, {"name": "low", "type": "company"}, {"name": "  ", "type": "Person"}]})
    e = X.entities_from_responses(spark.createDataFrame([("d", 3, body)], "document_id string, chunk_index int, response string"))
    got = [(r.name, r.confidence, len(r.evidence_chunk), r.attributes.get("k"), "_evidence" in r.attributes) for r in e.orderBy("pos").collect()]
    assert got == [("Acme", 0.0, 600, "v", True), ("Acme", 0.8, 0, None, True)]


def test_chunks_with_one_visible_name_are_skipped(spark, rows, people):
    chunks = spark.createDataFrame([("d", 0, "Alice Smith went home"), ("d", 1, "Alice Smith left ACME CORPoration for New York")], "document_id string, chunk_index int, text string")
    assert rows(X.visible_entities(chunks, people), "chunk_index", "name", "chunk_names") == [(1, "Acme Corp", 3), (1, "Alice Smith", 3), (1, "New York", 3)]


def test_visible_entities_match_brute_force(spark, rows):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 7)))
    ents, chunks = [], []
    for d in range(4):
        for i in range(25):
            ents.append((f"{d}-{i}", f"d{d}", "Person", " ".join(word() for _ in range(rnd.randint(1, 3))).capitalize(), 0.5, i))
        for c in range(6):
            chunks.append((f"d{d}", c, " ".join(word() for _ in range(40))))
    last = {(e[1], e[3].lower()): e[0] for e in ents}
    want = []
    for d, c, text in chunks:
        seen = [i for (dd, n), i in last.items() if dd == d and n in text.lower()]
        want += [(d, c, i) for i in seen] if len(seen) >= 2 else []
    got = rows(X.visible_entities(spark.createDataFrame(chunks, "document_id string, chunk_index int, text string"), spark.createDataFrame(ents, ENT)),
               "document_id", "chunk_index", "entity_id")
    assert got == sorted(want, key=repr) and got


def test_template_relations(spark, rows, people):
    got = rows(X.template_relations(people), "source_entity_id", "relationship_type", "target_entity_id", "confidence")
    assert got == sorted((str(s + 1), p, str(t + 1), c) for p, s, t, c, _ in V.RELATION_TEMPLATES)
    assert X.template_relations(people.limit(1)).count() == 0
    assert rows(X.template_relations(people.filter("pos < 2")), "relationship_type") == [("WORKS_FOR",)]


def test_gazetteer_and_cues(spark, rows):
    chunks = spark.createDataFrame([("d", 0, "Yesterday acme bought new kubernetes tools; acme uses kubernetes, mail bob@x.org")], "document_id string, chunk_index int, text string")
    gaz = spark.createDataFrame([("Acme", "Company", 0.9), ("Kubernetes", "Technology", 1.5), ("new kubernetes", "Product", 0.5)], "name string, entity_type string, confidence double")
    e = X.extract_entities(chunks, gaz)
    assert rows(e, "name", "entity_type", "confidence") == [("Acme", "Company", 0.9), ("Kubernetes", "Technology", 1.0), ("bob@x.org", "Person", 0.6), ("new kubernetes", "Product", 0.5)]
    cues = spark.createDataFrame([("uses", "USES", "Company", "Technology", 0.7), ("bought", "OWNS", "Company", "Person", 0.7)],
                                 "cue string, relationship_type string, source_type string, target_type string, confidence double")
    r = X.extract_relations(chunks, e, cues)
    names = {x.id: x.name for x in e.collect()}
    assert [(names[x.source_entity_id], x.relationship_type, names[x.target_entity_id]) for x in r.orderBy("seq").collect()] == [
        ("Acme", "OWNS", "bob@x.org"), ("Acme", "USES", "Kubernetes")]


def test_plugin_extractor(spark, rows):
    chunks = spark.createDataFrame([("d", 0, "a b"), ("d", 1, "c")], "document_id string, chunk_index int, text string")

    def first_word(batches):
        for pdf in batches:
            pdf["name"] = pdf["text"].str.split().str[0]
            yield pdf[["document_id", "name"]]
    assert rows(X.run_extractor(chunks, first_word, "document_id string, name string")) == [("d", "a"), ("d", "c")]


def test_listing_bounds(spark, people):
    with pytest.raises(ValueError):
        X.list_entities(people, limit=501)
    df = people.withColumn("attributes", F.lit("broken")).withColumn("evidence_chunk", F.lit("ev")).withColumn("created_at", F.current_timestamp())
    row = X.list_entities(df, entity_type="Person").first()
    assert row.attributes == {} and row.evidence_chunk == "ev"


def test_names_of_any_length(spark, rows):
    schema = "document_id string, chunk_index int, text string"
    chunks = spark.createDataFrame([("d", 0, "We met Acme Corp and GDPR today with node.js"), (None, 1, "Acme (Corp) uses Node.js"), (None, 1, "Acme (Corp) uses Node.js"), ("d", 2, "acme corporation")], schema)
    gaz = spark.createDataFrame([("Acme Corp", "Company", 0.9), ("Node.js", "Technology", 0.9), ("GDPR", "Regulation", 0.9), ("corp", "Policy", 0.9), ("!!", "Policy", 0.9), ("never seen", "Policy", 0.9)],
                                "name string, entity_type string, confidence double")
    got = rows(X.mentions(chunks, gaz), "document_id", "chunk_index", "word_pos", "name")
    assert got == sorted([("d", 0, 3, "Acme Corp"), ("d", 0, 4, "corp"), ("d", 0, 6, "GDPR"), ("d", 0, 9, "Node.js"), *[(None, 1, 1, "Acme Corp"), (None, 1, 2, "corp"), (None, 1, 4, "Node.js")] * 2], key=repr)


def test_relation_between_names_of_several_words(spark):
    chunks = spark.createDataFrame([("d", 0, "Bob joined Acme Corp"), (None, 7, "Bob joined Acme Corp")], "document_id string, chunk_index int, text string")
    ents = spark.createDataFrame([("1", "d", "Person", "Bob", 0.9, 0), ("2", "d", "Company", "Acme Corp", 0.9, 1), ("3", None, "Person", "Bob", 0.9, 0), ("4", None, "Company", "Acme Corp", 0.9, 1)], ENT)
    cues = spark.createDataFrame([("joined", "WORKS_FOR", "Person", "Company", 0.7), ("joined", "WORKS_FOR", "Person", "Product", 0.7)],
                                 "cue string, relationship_type string, source_type string, target_type string, confidence double")
    got = sorted((r.source_entity_id, r.relationship_type, r.target_entity_id) for r in X.extract_relations(chunks, ents, cues).collect())
    assert got == [("1", "WORKS_FOR", "2"), ("3", "WORKS_FOR", "4")]


def test_places_do_not_overlap(spark):
    row = spark.createDataFrame([(0, 2_000_000, 1, 0)], "a int, at int, b int, first int").select(
        X.place("a", "at").alias("x"), X.place("a", F.lit(X.AFTER_WORDS)).alias("p"), X.place("b", "first").alias("y")).first()
    assert row.x < row.p < row.y


def _brute_occurrences(chunks, names):
    import re
    out = []
    for doc, at, text in chunks:
        t = re.findall(r"[^\W_]+", text.lower())
        for name in names:
            w = re.findall(r"[^\W_]+", name.lower())
            out += [(doc, at, i + 1, name) for i in range(len(t) - len(w) + 1) if w and t[i:i + len(w)] == w]
    return sorted(out, key=repr)


def test_few_and_many_names_give_the_same_places(spark, rows):
    import random
    rng = random.Random(4)
    words = ["alpha", "beta", "corp", "delta", "new", "york"]
    chunks = [(d if d else None, c, " ".join(rng.choices(words, k=30)) + ("." if c else "")) for d in range(6) for c in (0, 0, 1)]
    names = ["corp", "new york", "York New", "alpha beta corp", "zq corp", "corp corp", "...", "beta alpha"]
    table = X._token_table(spark.createDataFrame(chunks, "document_id long, chunk_index int, text string"))
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    want = _brute_occurrences(chunks, names)
    for limit in (0, 1000):
        for evidence in (False, True):
            got = X._occurrences(table, frame, "name", evidence=evidence, limit=limit)
            assert rows(got, "document_id", "chunk_index", "word_pos", "name") == want
    per_doc = spark.createDataFrame([(1, "corp"), (None, "new york"), (7, "alpha")], "document_id long, name string")
    for limit in (0, 1000):
        got = rows(X._occurrences(table, per_doc, "name", ["document_id"], limit=limit), "document_id", "name")
        assert got == sorted([(d, n) for d, _, _, n in want if (d, n) in ((1, "corp"), (None, "new york"))], key=repr)


def test_names_with_an_absent_word_are_not_looked_up(spark):
    chunks = spark.createDataFrame([(i, 0, "the corp of corp") for i in range(50)], "document_id long, chunk_index int, text string")
    names = spark.createDataFrame([(f"zq{i} corp",) for i in range(200)] + [("of corp",)], "name string")
    found = X._occurrences(X._token_table(chunks), names, "name", limit=0)
    assert found.count() == 50
    joins = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in joins and "NestedLoop" not in joins


def test_visible_names_by_substrings_null_documents_and_repeated_keys(spark, rows):
    texts = [(None, 0, "Prefixation and prefixes abound in new york"), (None, 0, "nothing of that"), (1, 0, "prefixes, prefixed new york"), (1, 0, "prefixes again new  york"), (2, None, "ab abc prefixed")]
    chunks = spark.createDataFrame(texts, "document_id long, chunk_index int, text string")
    entities = [(f"e{k}", d, n, "T", k) for k, (d, n) in enumerate([(None, "prefix"), (None, "New York"), (None, "prefixless"), (1, "prefixes"), (1, "new york"), (1, "ed"), (2, "ab"), (2, "c"), (2, "prefixed"), (2, "")])]
    frame = spark.createDataFrame(entities, "id string, document_id long, name string, entity_type string, pos long")
    want = []
    for d, c, text in texts:
        seen = [(e, n) for e, doc, n, _, _ in entities if doc == d and n and n.lower() in text.lower()]
        want += [(d, c, e, n, len(seen)) for e, n in seen] if len(seen) >= 2 else []
    assert rows(X.visible_entities(chunks, frame), "document_id", "chunk_index", "entity_id", "name", "chunk_names") == sorted(want, key=repr) and len(want) == 8


def test_an_answer_is_read_once(spark, capsys):
    resp = spark.createDataFrame([(1, 0, '{"entities":[]}'), (2, 0, "{"), (3, 0, None)], "document_id long, chunk_index int, response string")
    ok, broken = X.parse_responses(resp, X.ENTITY_RESPONSE)
    assert [r["document_id"] for r in ok.collect()] == [1] and sorted(r["document_id"] for r in broken.collect()) == [2, 3]
    ok.explain("formatted")
    # neither filter reads the answer again
    assert capsys.readouterr().out.count("from_json(") == 1


def test_few_names_are_looked_up_while_the_chunks_are_read(spark, rows):
    chunks = spark.createDataFrame([(1, 0, "old corp of corp"), (1, 0, "new corp"), (2, 0, None)], "document_id long, chunk_index int, text string")
    names = spark.createDataFrame([("old corp", "T", 0.5), ("corp", "T", 0.5), ("corp of", "T", 0.5)], "name string, entity_type string, confidence double")
    found = X.mentions(chunks, names)
    assert rows(found, "word_pos", "name", "evidence") == sorted([
        (1, "old corp", "old corp of corp"), (2, "corp", "new corp"), (2, "corp", "old corp of corp"), (2, "corp of", "old corp of corp"), (4, "corp", "old corp of corp")], key=repr)
    # no table of tokens is stored, and none is counted, before the lookup
    assert "regexp_extract_all" in found._jdf.queryExecution().executedPlan().toString()


def test_rules_are_searched_in_one_pass(spark, rows):
    chunks = spark.createDataFrame([(1, 0, "b@x.org a@x.org b@x.org http://x.org/a#1"), (1, 1, "#1 none"), (2, 0, None)], "document_id long, chunk_index int, text string")
    none = spark.createDataFrame([], "name string, entity_type string, confidence double")
    rules = [*X.DEFAULT_PATTERNS, ("#[0-9]", "Policy", 1, "#")]
    found = X.extract_entities(chunks, none, rules)
    assert rows(found, "chunk_index", "name", "entity_type", "confidence", (F.col("pos") - F.col("chunk_index") * X.CHUNK_SPAN - X.AFTER_WORDS).alias("p")) == [
        (0, "#1", "Policy", 1.0, 0), (0, "a@x.org", "Person", 0.6, 1), (0, "b@x.org", "Person", 0.6, 0), (0, "http://x.org/a#1", "Technology", 0.6, 0), (1, "#1", "Policy", 1.0, 0)]
    assert X.extract_entities(chunks, none, []).count() == 0
    # answer of both rules and of the lookup: two passes over the chunks
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD [document_id") == 2


def test_relations_are_the_same_for_few_and_many_names(spark, rows):
    rng = random.Random(5)
    names = ["Bob", "Acme Corp", "acme", "York", "New York"]
    kinds = ["Person", "Company", "Company", "Location", "Location"]
    ents = [(f"{d}-{i}", d, kinds[i], names[i], 0.9, i) for d in ("d", "e", None) for i in rng.sample(range(5), 4)]
    words = ["bob", "acme corp", "new york", "joined", "left", "and"]
    chunks = [(rng.choice(["d", "e", None, "f"]), rng.randint(0, 2), " ".join(rng.choices(words, k=12))) for _ in range(40)]
    cues = spark.createDataFrame([("joined", "WORKS_FOR", "Person", "Company", 0.7), ("left", "USES", "Person", "Location", 0.7), ("left", "OWNS", "Company", "Location", 0.4)],
                                 "cue string, relationship_type string, source_type string, target_type string, confidence double")
    made = [rows(X.extract_relations(spark.createDataFrame(chunks, "document_id string, chunk_index int, text string"), spark.createDataFrame(ents, ENT), cues, dedup=False, limit=n)) for n in (0, 1000)]
    assert made[0] == made[1] and len({r[1] for r in made[0]}) == 3


@pytest.mark.parametrize("pairs", [0, 60, 1 << 18])
def test_visible_names_of_small_and_large_documents(spark, rows, pairs):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))
    ents = [(f"{d}-{i}", d, "Person", " ".join(word() for _ in range(rng.randint(1, 2))).upper(), 0.5, i) for d in (1, 2, None) for i in range(3 + 10 * (d or 0))]
    chunks = [(d, c, " ".join(word() for _ in range(12))) for d in (1, 2, 3, None) for c in (0, 0, 1, 2)]
    last = {(e[1], e[3].lower()): e[0] for e in ents}
    want = []
    for d, c, text in chunks:
        seen = [i for (doc, n), i in last.items() if doc == d and n in text]
        want += [(d, c, i, len(seen)) for i in seen] if len(seen) >= 2 else []
    got = X.visible_entities(spark.createDataFrame(chunks, "document_id long, chunk_index int, text string"),
                             spark.createDataFrame(ents, "id string, document_id long, entity_type string, name string, confidence double, pos int"), pairs=pairs)
    assert rows(got, "document_id", "chunk_index", "entity_id", "chunk_names") == sorted(want, key=repr) and want


def test_attributes_that_are_no_object(spark):
    given = ['" {\\"a\\":1}"', '"none"', '"[{\\"a\\":1}]"', '""', "null", '{"a":"b"}']
    body = '{"entities":[' + ",".join('{"name":"n","type":"Person","attributes":%s}' % g for g in given) + "]}"
    resp = spark.createDataFrame([(1, 0, body)], "document_id long, chunk_index int, response string")
    got = [r.attributes.get("a") for r in X.entities_from_responses(resp).orderBy("pos").collect()]
    assert got == ["1", None, None, None, None, "b"]


def test_ids_keep_their_parts_apart(spark):
    import hashlib
    from kgloom.session import stable_id
    df = spark.createDataFrame([("a|b", "c\\"), ("a", "b|c\\"), (None, "\\0")], "x string, y string")
    want = [hashlib.sha256(t.encode()).hexdigest() for t in ("a\\|b|c\\\\", "a|b\\|c\\\\", "\\0|\\\\0")]
    assert [r[0] for r in df.select(stable_id("x", "y")).collect()] == want


def test_found_entities_are_stored_without_what_follows_from_them(spark, rows):
    chunks = spark.createDataFrame([("d", 0, "Acme met Bob. acme@x.org wrote to Acme"), ("d", 0, "see Acme"), (None, 1, "Bob"), ("e", 2, None)], "document_id string, chunk_index int, text string")
    names = spark.createDataFrame([("Acme", "Company", 1.5), ("Bob", "Person", 0.5)], "name string, entity_type string, confidence double")
    found = X.found_entities(chunks, names)
    assert not {"id", "attributes", "pos"} & set(found.columns)
    columns = ["id", "document_id", "chunk_index", "entity_type", "name", "confidence", "evidence_chunk", "pos"]
    got = rows(X.entity_rows(found), *columns)
    assert got == rows(X.extract_entities(chunks, names), *columns) and len({r[0] for r in got}) == len(got) == 4
    assert {r[4]: r[5] for r in got} == {"Acme": 1.0, "Bob": 0.5, "acme@x.org": 0.6}
    assert all(r.attributes == {"_evidence": r.evidence_chunk} for r in X.entity_rows(found).collect())


def test_last_entity_of_a_name_comes_with_the_fields_asked_for(spark, rows):
    e = spark.createDataFrame([("a", "d", "Company", "Acme", 1), ("b", "d", "Person", "ACME", 2), ("c", "d", "Policy", "acme", 2), ("n", None, None, "acme", None)], "id string, document_id string, entity_type string, name string, pos int")
    assert rows(X.name_map(e).select("document_id", "key", "entity.*")) == sorted([("d", "acme", "c", "acme", "Policy"), (None, "acme", "n", "acme", None)], key=repr)
    assert X.name_map(e, ()).schema["entity"].dataType.names == ["id"]


def test_types_of_ends_come_with_their_names(spark, rows):
    from kgloom.operators.corpus import document_ontologies
    e = spark.createDataFrame([("a", "d", "Company", "A"), ("a", "d", "Person", "A2"), ("b", "d", None, "B"), ("c", "d", "Policy", None)], "id string, document_id string, entity_type string, name string")
    e = e.withColumn("attributes", F.create_map(F.lit("k"), F.lit("1")))
    r = spark.createDataFrame([("1", "d", "a", "b", "USES"), ("2", "d", "a", "a", "OWNS"), ("3", "d", "c", "gone", "USES"), ("4", "d", None, "a", "USES"), ("5", None, "a", "c", "USES")],
                              "id string, document_id string, source_entity_id string, target_entity_id string, relationship_type string").withColumn("confidence", F.lit(0.5))
    plain, typed = X.relationship_rows(r, e), X.relationship_rows(r, e, types=True)
    assert rows(typed.drop(*X.END_TYPES)) == rows(plain) and typed.count() == 11
    a, b = (document_ontologies(e, x, "2024-01-01 00:00:00") for x in (plain, typed))
    assert rows(a) == rows(b) and [x.relationships_count for x in b.collect()] == [6]
    joins = [sum(line.lstrip(" :+-").startswith("Join") for line in x._jdf.queryExecution().optimizedPlan().toString().splitlines()) for x in (a, b)]
    assert joins[0] == joins[1] + 2
