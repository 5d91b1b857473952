"""Class tables, type profiles, derived ontologies, versions and class matching."""
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgloom import vocab as V
from kgloom.functions.arrays import explode_rows
from kgloom.functions.matching import close_strings
from kgloom.operators.quality import latest_version_classes
from kgloom.session import cut_lineage, number_within, page

CLASS_SCHEMA = "id string, name string, description string, parent_class string, properties array<string>, synonyms array<string>"


def default_classes(spark: SparkSession) -> DataFrame:
    """The five seed classes."""
    return spark.createDataFrame([(n.lower(), n, None, p, [], []) for n, p in V.DEFAULT_CLASSES], CLASS_SCHEMA)


def add_classes(classes: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class table, rejected): new classes whose name exists, ignoring case, are rejected; the first of equal new names is taken."""
    keyed = new.withColumn("_k", F.lower("name"))
    first = keyed.groupBy("_k").agg(F.min("id").alias("id"))
    have = classes.select(F.lower("name").alias("_k")).distinct()
    ok = keyed.join(first, ["_k", "id"], "left_semi").join(have, "_k", "left_anti")
    rejected = keyed.join(ok.select("id"), "id", "left_anti")
    return classes.unionByName(ok.drop("_k"), allowMissingColumns=True), rejected.drop("_k")


def drop_classes(classes: DataFrame, ids: DataFrame) -> DataFrame:
    return classes.join(ids.select("id"), "id", "left_anti")


def class_by_name(classes: DataFrame, name: str) -> DataFrame:
    return classes.filter(F.lower("name") == name.lower())


def class_by_id(classes: DataFrame, class_id: str) -> DataFrame:
    return classes.filter(F.col("id") == class_id)


def add_properties(properties: DataFrame, new: DataFrame) -> DataFrame:
    """Property table (id, name, domain_class, range_type, required, description) with defaults filled in."""
    filled = new.withColumns({
        "range_type": F.coalesce(F.col("range_type") if "range_type" in new.columns else F.lit(None).cast("string"), F.lit("string")),
        "required": F.coalesce(F.col("required") if "required" in new.columns else F.lit(None).cast("boolean"), F.lit(False))})
    return properties.unionByName(filled, allowMissingColumns=True)


def list_properties(properties: DataFrame, domain_class: str | None = None) -> DataFrame:
    return properties if domain_class is None else properties.filter(F.col("domain_class") == domain_class)


def is_subclass_of(classes: DataFrame, child: str, parent: str) -> DataFrame:
    """One row per class named ``child``: whether ``parent`` is its direct parent."""
    return classes.filter(F.col("name") == child).select("id", "name", F.coalesce(F.col("parent_class") == parent, F.lit(False)).alias("is_subclass"))


def ancestor_pairs(classes: DataFrame, levels: int | None = None) -> DataFrame:
    """child, ancestor, distance for all parents, or for those up to ``levels`` steps up. A cycle ends where it meets a known pair."""
    up = cut_lineage(classes.filter("parent_class is not null").select(F.col("name").alias("child"), F.col("parent_class").alias("ancestor")).distinct())
    parents = up.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("_up"))
    out, step, n = up.withColumn("distance", F.lit(1)), up, 1
    while (levels is None or n < levels) and step.limit(1).count():
        n += 1
        step = cut_lineage(step.join(parents, "ancestor").select("child", F.col("_up").alias("ancestor")).distinct()
                           .join(out.select("child", "ancestor"), ["child", "ancestor"], "left_anti"))
        out = out.unionByName(step.withColumn("distance", F.lit(n)))
    return out


# -- profiles --------------------------------------------------------------

def type_profile(e: DataFrame, sample: int = 10) -> DataFrame:
    """entity_type, instances, distinct_names, sample (first names in first-seen order), more.

    Names are folded to one row per (type, name) before anything is ranked, and
    only ``sample`` names per type are ever collected.
    """
    names = e.groupBy("entity_type", "name").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    totals = names.groupBy("entity_type").agg(F.sum("n").alias("instances"), F.count(F.lit(1)).alias("distinct_names"))
    w = Window.partitionBy("entity_type").orderBy("first", "name")
    top = names.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= sample)
    shown = top.groupBy("entity_type").agg(F.array_sort(F.collect_list(F.struct("rn", "name"))).alias("s"))
    return (totals.join(shown, "entity_type").select(
        "entity_type", "instances", "distinct_names", F.array_join(F.transform("s", lambda x: x["name"]), ", ").alias("sample"),
        F.greatest(F.col("distinct_names") - sample, F.lit(0)).alias("more")).orderBy("entity_type"))


def class_patterns(e: DataFrame, r: DataFrame) -> DataFrame:
    """source_type, relationship_type, target_type, cnt: how often which types are related, most frequent first.

    A type is taken by entity id, else by name (the last entity of a name wins),
    else it is Unknown.
    """
    ids = e.select("id", "entity_type")
    named = "source_entity_name" in r.columns
    # the side that was joined last is still dealt out by its ids
    sides, rows = ("target", "source"), r
    for side in sides:
        rows = rows.join(ids.select(F.col("id").alias(f"{side}_entity_id"), F.nullif("entity_type", F.lit("")).alias(f"{side}_type")),
                         f"{side}_entity_id", "left")
    keys = ["source_type", "relationship_type", "target_type"]
    if named:
        # typed ends need no name: relationships are counted before the names of the rest are looked up
        names = [F.when(F.col(f"{s}_type").isNull(), F.col(f"{s}_entity_name")).alias(f"{s}_name") for s in sides]
        rows = rows.select(*keys, *names).groupBy(*keys, *[f"{s}_name" for s in sides]).agg(F.count(F.lit(1)).alias("n"))
        by_name = e.groupBy(F.col("name").alias("_n")).agg(F.max_by("entity_type", "pos").alias("_t"))
        for side in sides:
            # rows already typed get keys that match nothing and are spread evenly
            key = F.coalesce(f"{side}_name", F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*keys, "source_name", "target_name"), F.lit(4096)).cast("string")))
            rows = rows.withColumn("_n", key).join(by_name, "_n", "left").withColumn(f"{side}_type", F.coalesce(f"{side}_type", "_t")).drop("_n", "_t")
    else:
        rows = rows.withColumn("n", F.lit(1))
    typed = rows.select(F.coalesce("source_type", F.lit("Unknown")).alias("source_type"), "relationship_type",
                        F.coalesce("target_type", F.lit("Unknown")).alias("target_type"), "n")
    return (typed.groupBy(*keys).agg(F.sum("n").cast("bigint").alias("cnt"))
            .orderBy(F.col("cnt").desc(), "source_type", "relationship_type", "target_type"))


def render_profile(e: DataFrame, r: DataFrame, domain_hint: str | None = None) -> DataFrame:
    """The profile as text lines, in reading order by (part, k2, k1)."""
    types = type_profile(e).select(F.lit(2).alias("part"), F.col("entity_type").alias("k1"), F.lit(0).cast("bigint").alias("k2"), F.concat(
        F.lit("  "), "entity_type", F.lit(" ("), F.col("instances").cast("string"), F.lit(" instances): "), "sample",
        F.when(F.col("more") > 0, F.concat(F.lit(" (+"), F.col("more").cast("string"), F.lit(" more)"))).otherwise("")).alias("line"))
    pats = class_patterns(e, r)
    rels = pats.select(F.lit(4).alias("part"), F.concat_ws("|", "source_type", "relationship_type", "target_type").alias("k1"), (-F.col("cnt")).alias("k2"), F.concat(
        F.lit("  "), "source_type", F.lit(" --"), "relationship_type", F.lit("--> "), "target_type", F.lit("  ("), F.col("cnt").cast("string"),
        F.when(F.col("cnt") == 1, " occurrence)").otherwise(" occurrences)")).alias("line"))
    heads = e.sparkSession.createDataFrame(
        [(0, "", 0, f"Domain hint: {domain_hint or 'infer from data'}"), (0, "a", 1, ""), (1, "", 0, "Entity types observed:"),
         (3, "", 0, ""), (3, "a", 1, "Relationship patterns observed:")], "part int, k1 string, k2 bigint, line string")
    none = rels.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(
        F.lit(4).alias("part"), F.lit("").alias("k1"), F.lit(0).cast("bigint").alias("k2"), F.lit("  (none)").alias("line"))
    return heads.unionByName(types).unionByName(rels).unionByName(none).orderBy("part", "k2", "k1")


def value_type(col) -> Column:
    """Type name of an attribute value given as text."""
    c = F.col(col) if isinstance(col, str) else col
    return (F.when(c.rlike(r"^[+-]?\d+$"), "integer").when(c.rlike(r"^[+-]?\d*\.\d+$"), "float")
            .when(F.lower(c).isin("true", "false"), "boolean").when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), "date").otherwise("string"))


def derive_ontology(e: DataFrame, r: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, attributes, relationships) observed in the tables.

    An attribute's type is the common type of its values; integer and float give
    float, any other mix gives string.
    """
    classes = e.filter("entity_type is not null and entity_type <> ''").groupBy(F.col("entity_type").alias("name")).agg(F.count(F.lit(1)).alias("instances"))
    kv = e.select(F.col("entity_type").alias("class_name"), F.explode_outer("attributes").alias("attribute", "value")).filter(
        "attribute is not null and attribute <> '_evidence' and class_name <> ''")
    kinds = kv.groupBy("class_name", "attribute", value_type("value").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    attrs = kinds.groupBy("class_name", "attribute").agg(
        F.when(F.count(F.lit(1)) == 1, F.min("kind")).when(F.bool_and(F.col("kind").isin("integer", "float")), "float").otherwise("string").alias("value_type"),
        F.sum("n").alias("seen"))
    rels = class_patterns(e, r).select(F.col("source_type").alias("source_class"), F.col("relationship_type").alias("predicate"),
                                       F.col("target_type").alias("target_class"), "cnt")
    return classes, attrs, rels


def _with_attributes(classes: DataFrame, attrs: DataFrame) -> DataFrame:
    per_class = attrs.groupBy("class_name").agg(F.array_sort(F.collect_list(F.struct(F.col("attribute").alias("name"), F.col("value_type").alias("type")))).alias("attributes"))
    return classes.join(per_class, classes["name"] == per_class["class_name"], "left").select("name", "attributes")


def _pieces(rows: DataFrame, order: list[str], per_part: int) -> DataFrame:
    """piece (from 0), text: the rows as comma-separated JSON objects in the given order, ``per_part`` of them per piece."""
    numbered = number_within(rows.select(*order, F.to_json(F.struct(*rows.columns)).alias("_json")), [], order, "_n")
    item = F.struct("_n", F.concat(F.when(F.col("_n") > 1, ",").otherwise(""), "_json").alias("t"))
    return (numbered.groupBy(F.floor((F.col("_n") - 1) / per_part).alias("piece"))
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), "").alias("text")))


def ontology_parts(e: DataFrame, r: DataFrame, domain_hint: str | None = None, per_part: int = 1000) -> DataFrame:
    """part (gapless from 0), text: the document of ``ontology_document`` cut into ranges; in order of part the texts make it whole.

    Classes and relationships are range-partitioned and numbered, so no task holds more than ``per_part`` of them at once.
    """
    classes, attrs, rels = derive_ontology(e, r)
    cls = cut_lineage(_pieces(_with_attributes(classes, attrs), ["name"], per_part))
    triple = ["source_class", "predicate", "target_class"]
    rel = cut_lineage(_pieces(rels.select(triple), triple, per_part))
    n_cls, n_rel = (d.agg(F.count(F.lit(1))).scalar() for d in (cls, rel))
    domain = F.to_json(F.struct(F.lit(domain_hint or "derived").alias("domain")))
    frame = F.array(F.struct(F.lit(0).cast("bigint").alias("part"), F.concat(F.substr(domain, F.lit(1), F.length(domain) - 1), F.lit(',"classes":[')).alias("text")),
                    F.struct((n_cls + 1).alias("part"), F.lit('],"relationships":[').alias("text")),
                    F.struct((n_cls + n_rel + 2).alias("part"), F.lit("]}").alias("text")))
    fixed = e.sparkSession.range(1).select(F.explode(frame).alias("f")).select("f.*")
    return (fixed.unionByName(cls.select((F.col("piece") + 1).alias("part"), "text"))
            .unionByName(rel.select((F.col("piece") + n_cls + 2).alias("part"), "text")))


def ontology_document(e: DataFrame, r: DataFrame, domain_hint: str | None = None) -> DataFrame:
    """The derived ontology as one JSON document with its class and relationship counts; ``ontology_parts`` where it may not fit a row."""
    classes, attrs, rels = derive_ontology(e, r)
    rows = _with_attributes(classes, attrs).select(F.struct("name", "attributes").alias("c"))
    cls = rows.agg(F.array_sort(F.collect_list("c")).alias("classes")).withColumn("_k", F.lit(1))
    rel = rels.agg(F.array_sort(F.collect_list(F.struct("source_class", "predicate", "target_class"))).alias("relationships")).withColumn("_k", F.lit(1))
    return cls.join(rel, "_k").select(
        F.to_json(F.struct(F.lit(domain_hint or "derived").alias("domain"), "classes", "relationships")).alias("ontology_json"),
        F.size("classes").alias("classes_count"), F.size("relationships").alias("relationships_count"))


ONTOLOGY_RESPONSE = ("struct<domain: string, classes: array<struct<name: string, description: string, attributes: array<struct<name: string, type: string, "
                     "description: string>>, synonyms: array<string>, parent_class: string>>, relationships: array<struct<source_class: string, "
                     "predicate: string, target_class: string, description: string>>>")


def ontology_from_responses(resp: DataFrame, id_col: str = "scope_id") -> dict[str, DataFrame]:
    """Tables classes, attributes, relationships and errors from one JSON answer per scope."""
    from kgloom.operators.extraction import parse_responses
    ok, bad = parse_responses(resp, ONTOLOGY_RESPONSE)
    cls = explode_rows(ok, [id_col], "parsed.classes", "c")
    att = explode_rows(cls, [id_col, F.col("c.name").alias("class_name")], "c.attributes", "a")
    rel = explode_rows(ok, [id_col], "parsed.relationships", "r")
    return {
        "classes": cls.select(id_col, "c.name", "c.description", "c.synonyms", "c.parent_class"),
        "attributes": att.select(id_col, "class_name", "a.name", "a.type", "a.description"),
        "relationships": rel.select(id_col, "r.source_class", "r.predicate", "r.target_class", "r.description"),
        "errors": bad.select(id_col, "response"),
    }


# -- versions --------------------------------------------------------------

def assign_versions(existing: DataFrame, new: DataFrame, order: str = "created_at") -> DataFrame:
    """New ontology rows numbered after the highest version of their document; no document is a scope of its own."""
    top = existing.groupBy("document_id").agg(F.max("version").alias("_max"))
    numbered = number_within(new, ["document_id"], [order, "id"], "_rn").alias("n")
    return (numbered.join(top.alias("t"), F.col("n.document_id").eqNullSafe(F.col("t.document_id")), "left")
            .select("n.*", (F.coalesce("_max", F.lit(0)) + F.col("_rn")).alias("version")).drop("_rn"))


def list_versions(versions: DataFrame, document_id=None, limit: int = 20, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    v = versions if document_id is None else versions.filter(F.col("document_id") == document_id)
    return page(v, [F.col("created_at").desc(), "id"], limit, offset).drop("ontology_json")


def get_version(versions: DataFrame, version_id) -> DataFrame:
    return versions.filter(F.col("id") == version_id).withColumn("content", F.from_json("ontology_json", ONTOLOGY_RESPONSE))


# -- alignment and class matching -----------------------------------------

def align_entities(e: DataFrame, classes: DataFrame, bound: int = 2) -> tuple[DataFrame, DataFrame]:
    """(entity_id, ontology_class, confidence), unresolved count.

    Types are aligned once each: by name (1.0), by synonym (0.9), else to the
    nearest class name within ``bound`` edits (1 - edits/length); then joined back.
    """
    types = e.filter("entity_type is not null and entity_type <> ''").select("entity_type").distinct().withColumn("a", F.lower("entity_type"))
    names = classes.select("name", F.lower("name").alias("b"))
    exact = types.join(names, types["a"] == names["b"]).select("entity_type", F.struct(F.lit(0).alias("rank"), F.lit(0).alias("dist"), F.col("name"), F.lit(1.0).alias("conf")).alias("m"))
    syn = explode_rows(classes, ["name"], "synonyms", "s").select("name", F.lower("s").alias("b"))
    by_syn = types.join(syn, types["a"] == syn["b"]).select("entity_type", F.struct(F.lit(1).alias("rank"), F.lit(0).alias("dist"), F.col("name"), F.lit(0.9).alias("conf")).alias("m"))
    near = close_strings(types.select("a"), names.select("b"), bound)
    by_edit = types.join(near, "a").join(names, "b").select("entity_type", F.struct(
        F.lit(2).alias("rank"), "dist", F.col("name"), F.round(1 - F.col("dist") / F.greatest(F.length("a"), F.length("b")), 4).alias("conf")).alias("m"))
    best = exact.unionByName(by_syn).unionByName(by_edit).groupBy("entity_type").agg(F.min("m").alias("m"))
    aligned = e.join(best, "entity_type").select(F.col("id").alias("entity_id"), F.col("m.name").alias("ontology_class"), F.col("m.conf").alias("confidence"))
    unresolved = e.join(best, "entity_type", "left_anti").agg(F.count(F.lit(1)).alias("unresolved"))
    return aligned, unresolved


def alignment_violations(e: DataFrame, alignments: DataFrame, classes: DataFrame) -> DataFrame:
    """entity_id, entity_text, ontology_class, message, severity. The last alignment of an entity (by ``pos``) counts."""
    last = alignments.groupBy("entity_id").agg(F.max_by("ontology_class", "pos").alias("ontology_class"), F.lit(True).alias("_has"))
    known = classes.select(F.lower("name").alias("_k"), F.lit(True).alias("_known")).distinct()
    rows = (e.select(F.col("id").alias("entity_id"), F.col("name").alias("entity_text")).join(last, "entity_id", "left")
            .withColumn("_k", F.lower("ontology_class")).join(known, "_k", "left"))
    missing = F.col("_has").isNull()
    foreign = F.col("ontology_class").isNotNull() & (F.col("ontology_class") != "") & F.col("_known").isNull()
    return rows.filter(missing | foreign).select(
        "entity_id", "entity_text", "ontology_class",
        F.when(missing, "Entity has no ontology alignment").otherwise(F.format_string("Aligned class '%s' does not exist in ontology", "ontology_class")).alias("message"),
        F.when(missing, "warning").otherwise("error").alias("severity"))


def available_classes(classes: DataFrame, versions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sorted names of the class table, of the stored versions and of the node types."""
    from_nodes = nodes.filter("entity_type is not null and entity_type <> ''").select(F.col("entity_type").alias("name")).distinct()
    return (classes.select("name").unionByName(latest_version_classes(versions).select("name")).unionByName(from_nodes)
            .distinct().orderBy("name"))


# asking for one of these names also asks for the other
PAIRED_CLASSES = [("company", "organization"), ("organization", "company")]


def match_classes(questions: DataFrame, names: DataFrame, synonyms: DataFrame | None = None, fallback: int = 3) -> DataFrame:
    """question_id, class_name: classes all of whose words occur in the question.

    ``names`` has one column ``name``; ``synonyms`` maps name to synonym. A question
    without any match gets the first ``fallback`` names. Matching is an equi join
    of question words with class words.
    """
    terms = names.select("name", F.col("name").alias("term"))
    if synonyms is not None:
        terms = terms.unionByName(synonyms.select("name", F.col("synonym").alias("term")))
    pairs = questions.sparkSession.createDataFrame(PAIRED_CLASSES, "term string, other string")
    pulled = names.withColumn("other", F.lower("name")).join(F.broadcast(pairs), "other").select("name", "term")
    terms = terms.unionByName(pulled)
    token = F.array_distinct(F.regexp_extract_all(F.lower("term"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    words = explode_rows(terms.withColumn("_t", token).filter(F.size("_t") > 0).withColumn("need", F.size("_t")), ["name", "term", "need"], "_t", "word")
    asked = explode_rows(questions, ["question_id"], F.array_distinct(F.regexp_extract_all(F.lower("question"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))), "word")
    hits = (asked.join(words, "word").groupBy("question_id", "name", "term", "need").agg(F.count(F.lit(1)).alias("got"))
            .filter("got = need").select("question_id", F.col("name").alias("class_name")).distinct())
    first = names.orderBy("name").limit(fallback).select(F.col("name").alias("class_name"), F.lit(1).alias("_k"))
    rest = questions.select("question_id").join(hits.select("question_id").distinct(), "question_id", "left_anti").withColumn("_k", F.lit(1))
    return hits.unionByName(rest.join(F.broadcast(first), "_k").drop("_k"))
