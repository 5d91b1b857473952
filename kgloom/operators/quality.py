"""Data-quality engine: issue detection, health metrics, corrections and vocabulary proposals."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom import vocab as V
from kgloom.functions.arrays import explode_rows
from kgloom.functions.matching import close_strings
from kgloom.functions.text import fixed
from kgloom.session import stable_id

ISSUE_COLUMNS = ["id", "issue_type", "severity", "entity_id", "relationship_id", "document_id",
                 "description", "detail_json", "status", "detected_at"]


def _issue(df: DataFrame, kind: str, severity: str, now, description: Column, detail: Column,
           entity=None, relationship=None, document=None) -> DataFrame:
    def text(c):
        return F.lit(None).cast("string") if c is None else F.col(c).cast("string")
    rows = df.select(
        F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity"), text(entity).alias("entity_id"),
        text(relationship).alias("relationship_id"), text(document).alias("document_id"), description.alias("description"),
        F.to_json(detail, {"ignoreNullFields": "false"}).alias("detail_json"), F.lit("open").alias("status"), F.to_timestamp_ntz(F.lit(now)).alias("detected_at"))
    ident = stable_id("issue_type", F.coalesce("entity_id", "relationship_id", "document_id"), "description")
    return rows.withColumn("id", ident).select(ISSUE_COLUMNS)


def _unknown(col: str, known: list[str]) -> Column:
    """Type present and not in the vocabulary, ignoring case."""
    return F.col(col).isNotNull() & (F.col(col) != "") & ~F.lower(col).isin([k.lower() for k in known])


def _first(df: DataFrame, limit: int | None, *order) -> DataFrame:
    """All rows, or with a limit the first so many in order."""
    return df if limit is None else df.orderBy(*order).limit(limit)


def low_confidence_entities(e: DataFrame, t: float = 0.5, limit: int | None = None) -> DataFrame:
    return _first(e.filter(F.col("confidence") < t), limit, "confidence", "id")


def low_confidence_relationships(r: DataFrame, t: float = 0.5, limit: int | None = None) -> DataFrame:
    return _first(r.filter(F.col("confidence") < t), limit, "confidence", "id")


def duplicate_groups(e: DataFrame) -> DataFrame:
    """name, document_id, cnt of every exact duplicate group."""
    return e.groupBy("name", "document_id").agg(F.count(F.lit(1)).alias("cnt")).filter("cnt > 1")


def duplicate_entities(e: DataFrame, limit: int | None = None) -> DataFrame:
    return _first(duplicate_groups(e), limit, "name", "document_id")


def referenced_ids(r: DataFrame) -> DataFrame:
    """Distinct entity ids at either end of a relationship."""
    return (r.select(F.col("source_entity_id").alias("id")).unionByName(r.select(F.col("target_entity_id").alias("id")))
            .filter("id is not null").distinct())


def all_orphans(e: DataFrame, r: DataFrame) -> DataFrame:
    return e.join(referenced_ids(r), "id", "left_anti")


def orphan_entities(e: DataFrame, r: DataFrame, limit: int | None = None) -> DataFrame:
    return _first(all_orphans(e, r), limit, "id")


def unknown_entity_types(e: DataFrame) -> DataFrame:
    return e.groupBy("entity_type").agg(F.count(F.lit(1)).alias("cnt")).filter(_unknown("entity_type", V.ENTITY_TYPES))


def unknown_relationship_types(r: DataFrame) -> DataFrame:
    return r.groupBy("relationship_type").agg(F.count(F.lit(1)).alias("cnt")).filter(_unknown("relationship_type", V.RELATIONSHIP_TYPES))


def sparse_documents(e: DataFrame, r: DataFrame) -> DataFrame:
    """Documents with more than five entities and fewer than two relationships."""
    ec = e.groupBy("document_id").agg(F.count(F.lit(1)).alias("entity_count")).filter("entity_count > 5")
    rc = r.groupBy("document_id").agg(F.count(F.lit(1)).alias("relationship_count"))
    return (ec.join(rc, "document_id", "left").withColumn("relationship_count", F.coalesce("relationship_count", F.lit(0)))
            .filter("relationship_count < 2"))


def find_issues(e: DataFrame, r: DataFrame, t: float, now) -> DataFrame:
    """The six detectors as issue rows. ``r`` carries the end names."""
    fmt = F.format_string
    conf = fixed("confidence", 2)
    low_e = _issue(low_confidence_entities(e, t), "low_confidence_entity", "warning", now,
                   fmt(f"Entity '%s' (%s) has confidence %s, below threshold {t}", "name", "entity_type", conf),
                   F.struct(F.col("name").alias("entity_name"), "entity_type", "confidence"), entity="id", document="document_id")
    low_r = _issue(low_confidence_relationships(r, t), "low_confidence_relationship", "warning", now,
                   fmt("Relationship '%s' -[%s]-> '%s' has confidence %s", "source_entity_name", "relationship_type", "target_entity_name", conf),
                   F.struct(F.col("source_entity_name").alias("source"), F.col("target_entity_name").alias("target"),
                            F.col("relationship_type").alias("type"), "confidence"), relationship="id", document="document_id")
    dup = _issue(duplicate_entities(e), "duplicate_entity", "error", now,
                 F.concat(F.lit("Entity '"), "name", F.lit("' appears "), F.col("cnt").cast("string"), F.lit(" times in document "),
                          F.substring(F.coalesce("document_id", F.lit("")), 1, 8), F.lit("…")),
                 F.struct(F.col("name").alias("entity_name"), "document_id", F.col("cnt").alias("count")), document="document_id")
    orphan = _issue(orphan_entities(e, r), "orphan_entity", "info", now,
                    fmt("Entity '%s' (%s) has no relationships", "name", "entity_type"),
                    F.struct(F.col("name").alias("entity_name"), "entity_type"), entity="id", document="document_id")
    unknown = _issue(unknown_entity_types(e), "unknown_entity_type", "warning", now,
                     fmt("Entity type '%s' is not in the known taxonomy (%s entities)", "entity_type", F.col("cnt").cast("string")),
                     F.struct("entity_type", F.col("cnt").alias("count")))
    sparse = _issue(sparse_documents(e, r), "sparse_relationships", "info", now,
                    fmt("Document has %s entities but only %s relationships — consider re-running relationship extraction",
                        F.col("entity_count").cast("string"), F.col("relationship_count").cast("string")),
                    F.struct("document_id", "entity_count", "relationship_count"), document="document_id")
    out = low_e
    for d in (low_r, dup, orphan, unknown, sparse):
        out = out.unionByName(d)
    return out


def detect_issues(e: DataFrame, r: DataFrame, existing: DataFrame, t: float, now) -> DataFrame:
    """New issue table: resolved and dismissed rows are kept, open ones replaced by a fresh scan."""
    return existing.filter("status <> 'open'").select(ISSUE_COLUMNS).unionByName(find_issues(e, r, t, now))


# -- metrics ---------------------------------------------------------------

METRICS = ["entity_count", "relationship_count", "entity_accuracy", "relationship_accuracy", "ontology_coverage",
           "graph_completeness", "low_confidence_entities", "low_confidence_relationships", "duplicate_entities",
           "orphan_entities", "unique_entity_types", "ontology_class_count", "node_count", "edge_count"]


def knowledge_metrics(e: DataFrame, r: DataFrame, classes: DataFrame, nodes: DataFrame | None, edges: DataFrame | None,
                      t: float = 0.5) -> DataFrame:
    """One row of 14 health metrics.

    Each input is reduced to one row of partial values; those rows are stacked
    and summed, so the whole is one job without joins between the totals.
    """
    one = F.count(F.lit(1))
    types = e.filter("entity_type is not null and entity_type <> ''").select(F.col("entity_type"), F.lower("entity_type").alias("k")).distinct()
    known = classes.select(F.lower("name").alias("k")).distinct().withColumn("hit", F.lit(1))
    parts = [
        e.agg(one.alias("e_n"), F.count_if(F.col("confidence") >= t).alias("e_high")),
        r.agg(one.alias("r_n"), F.count_if(F.col("confidence") >= t).alias("r_high")),
        types.join(known, "k", "left").agg(one.alias("types"), F.count("hit").alias("covered")),
        duplicate_groups(e).agg(one.alias("dups")),
        all_orphans(e, r).agg(one.alias("orphans")),
        classes.agg(one.alias("classes")),
    ]
    if nodes is not None:
        parts.append(nodes.agg(one.alias("nodes")))
    if edges is not None:
        parts.append(edges.agg(one.alias("edges")))
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p, allowMissingColumns=True)
    names = ["e_n", "e_high", "r_n", "r_high", "types", "covered", "dups", "orphans", "classes", "nodes", "edges"]
    row = stacked.agg(*[F.coalesce(F.sum(n) if n in stacked.columns else F.lit(None).cast("bigint"), F.lit(0)).alias(n) for n in names])

    def ratio(a, b):
        return F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4)).otherwise(F.lit(0.0))
    return row.select(
        F.col("e_n").alias("entity_count"), F.col("r_n").alias("relationship_count"),
        ratio("e_high", "e_n").alias("entity_accuracy"), ratio("r_high", "r_n").alias("relationship_accuracy"),
        ratio("covered", "types").alias("ontology_coverage"),
        F.round(F.col("r_n") / F.greatest("e_n", F.lit(1)), 4).alias("graph_completeness"),
        (F.col("e_n") - F.col("e_high")).alias("low_confidence_entities"), (F.col("r_n") - F.col("r_high")).alias("low_confidence_relationships"),
        F.col("dups").alias("duplicate_entities"), F.col("orphans").alias("orphan_entities"), F.col("types").alias("unique_entity_types"),
        F.col("classes").alias("ontology_class_count"), F.col("nodes").alias("node_count"), F.col("edges").alias("edge_count"))


# -- corrections -----------------------------------------------------------

def drop_duplicate_entities(e: DataFrame) -> DataFrame:
    """One entity per (name, document): the highest confidence, the lowest id on a tie.

    A min-by aggregate folds map-side, so a name repeated very often in one
    document is never gathered in one task. Rows without a name or document are kept.
    """
    keyed = e.filter("name is not null and document_id is not null")
    best = keyed.groupBy("name", "document_id").agg(
        F.min_by(F.struct(*e.columns), F.struct(F.col("confidence").isNull(), -F.col("confidence"), "id")).alias("_b"))
    return best.select("_b.*").unionByName(e.filter("name is null or document_id is null"))


def canonical_type(col) -> Column:
    """The vocabulary's spelling of a type, or the type itself."""
    spelling = F.create_map(*[F.lit(x) for t in V.ENTITY_TYPES for x in (t.lower(), t)])
    return F.coalesce(F.try_element_at(spelling, F.lower(col)), F.col(col))


def normalize_entity_types(e: DataFrame) -> DataFrame:
    return e.withColumn("entity_type", canonical_type("entity_type"))


def auto_correct(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(corrected entities, one-row count of corrections): dropped duplicates plus re-cased survivors."""
    kept = drop_duplicate_entities(e)
    recased = kept.agg(F.count(F.lit(1)).alias("n"), F.count_if(canonical_type("entity_type") != F.col("entity_type")).alias("recased"))
    total = e.agg(F.count(F.lit(1))).scalar()
    return normalize_entity_types(kept), recased.select((total - F.col("n") + F.col("recased")).alias("corrections"))


# -- proposals -------------------------------------------------------------

PROPOSAL_COLUMNS = ["id", "proposal_type", "status", "description", "rationale", "detail_json", "proposed_at", "applied_at"]


def vocabulary_drift(e: DataFrame, r: DataFrame) -> DataFrame:
    """kind (entity or relationship), type, cnt of types outside the vocabularies."""
    a = unknown_entity_types(e).select(F.lit("entity").alias("kind"), F.col("entity_type").alias("type"), "cnt")
    b = unknown_relationship_types(r).select(F.lit("relationship").alias("kind"), F.col("relationship_type").alias("type"), "cnt")
    return a.unionByName(b)


def latest_version_classes(versions: DataFrame, n: int | None = None) -> DataFrame:
    """Classes named in the ontology versions, or in the latest ``n`` of them: version_id, name, description."""
    last = _first(versions, n, F.col("created_at").desc(), "id")
    parsed = last.withColumn("_o", F.from_json("ontology_json", "struct<classes:array<struct<name:string,description:string>>>"))
    return (explode_rows(parsed, [F.col("id").alias("version_id")], "_o.classes", "_c", "pos")
            .select("version_id", "pos", F.col("_c.name").alias("name"), F.coalesce("_c.description", F.lit("")).alias("description"))
            .filter("name is not null and name <> ''"))


def _proposal(df: DataFrame, kind, description, rationale, detail, now, *key) -> DataFrame:
    rows = df.select(kind.alias("proposal_type"), F.lit("pending").alias("status"), description.alias("description"),
                     rationale.alias("rationale"), F.to_json(detail, {"ignoreNullFields": "false"}).alias("detail_json"),
                     F.to_timestamp_ntz(F.lit(now)).alias("proposed_at"), F.lit(None).cast("timestamp_ntz").alias("applied_at"),
                     stable_id(F.lit("proposal"), *key).alias("id"))
    return rows.select(PROPOSAL_COLUMNS)


def proposals_from_versions(versions: DataFrame, classes: DataFrame, now) -> DataFrame:
    """add_class for classes of the latest versions that the class table lacks; repeats across versions stay."""
    new = latest_version_classes(versions).withColumn("_k", F.lower("name")).join(
        classes.select(F.lower("name").alias("_k")).distinct(), "_k", "left_anti")
    return _proposal(
        new, F.lit("add_class"), F.format_string("Add ontology class '%s' discovered in extracted ontology", "name"),
        F.format_string("Class '%s' was discovered during ontology analysis but is not in the active ontology manager.", "name"),
        F.struct(F.col("name").alias("subject"), "description"), now, "version_id", "pos", "name")


def proposals_from_responses(resp: DataFrame, now, id_col="response_id", col="response") -> DataFrame:
    """Proposals from JSON arrays; items need a proposal_type, an unreadable answer gives none."""
    from kgloom.functions.text import strip_json_fences
    # an answer has to be an array; each item is read on its own, so one that is no object costs only itself
    body = strip_json_fences(col)
    items = F.when(F.startswith(body, F.lit("[")), F.from_json(body, "array<string>"))
    fields = "struct<proposal_type:string,subject:string,target:string,description:string,rationale:string>"
    rows = explode_rows(resp, [F.col(id_col).alias("_r")], items, "item", "pos").select(
        "_r", "pos", F.when(F.startswith("item", F.lit("{")), F.from_json("item", fields)).alias("p")).filter("p.proposal_type is not null")
    return _proposal(rows, F.col("p.proposal_type"), F.coalesce("p.description", F.lit("")), F.coalesce("p.rationale", F.lit("")),
                     F.struct(F.coalesce("p.subject", F.lit("")).alias("subject"), F.col("p.target").alias("target")), now, "_r", "pos")


def proposals_from_drift(drift: DataFrame, known_names: DataFrame, now, bound: int = 2) -> DataFrame:
    """Rule-made proposals for unknown types.

    Relationship types are added. An entity type equal to a known name apart from
    case and punctuation is renamed, one within ``bound`` edits of a known name is
    merged into it, any other is added.
    """
    def bare(c):
        return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    rel = drift.filter("kind = 'relationship'").select("kind", "type", "cnt", F.lit("add_relationship").alias("act"), F.lit(None).cast("string").alias("target"))
    ent = drift.filter("kind = 'entity'").withColumn("_b", bare("type"))
    known = known_names.select(F.col("name").alias("target"), bare("name").alias("_b")).filter("_b <> ''").distinct()
    same = ent.join(known, "_b").groupBy("kind", "type", "cnt").agg(F.min("target").alias("target"))
    rest = ent.join(same.select("type"), "type", "left_anti")
    near = close_strings(rest.select(F.col("_b").alias("a")), known.select(F.col("_b").alias("b")), bound)
    near = (near.join(known.withColumnRenamed("_b", "b"), "b").groupBy("a")
            .agg(F.min(F.struct("dist", "target")).alias("m")).select(F.col("a").alias("_b"), F.col("m.target").alias("target")))
    merged = rest.join(near, "_b", "left").select(
        "kind", "type", "cnt", F.when(F.col("target").isNull(), "add_class").otherwise("merge_class").alias("act"), "target")
    rows = rel.unionByName(same.select("kind", "type", "cnt", F.lit("rename_class").alias("act"), "target")).unionByName(merged)
    what = (F.when(F.col("act") == "add_relationship", F.format_string("Add relationship type '%s'", "type"))
            .when(F.col("act") == "rename_class", F.format_string("Rename '%s' to '%s'", "type", "target"))
            .when(F.col("act") == "merge_class", F.format_string("Merge '%s' into '%s'", "type", "target"))
            .otherwise(F.format_string("Add ontology class '%s'", "type")))
    return _proposal(rows, F.col("act"), what, F.format_string("%s rows use the unknown type '%s'", F.col("cnt").cast("string"), "type"),
                     F.struct(F.col("type").alias("subject"), "target"), now, "kind", "type")


def generate_proposals(existing: DataFrame, *new: DataFrame) -> DataFrame:
    """Proposal table with its pending rows replaced by the new ones."""
    out = existing.filter("status <> 'pending'").select(PROPOSAL_COLUMNS)
    for d in new:
        out = out.unionByName(d)
    return out


def apply_proposals(ids: DataFrame, proposals: DataFrame, classes: DataFrame, vocabulary: DataFrame, now):
    """Applies pending proposals by id, as sets. Returns (results, proposals, classes, vocabulary).

    results: id, success, message. ``vocabulary``: relationship_type. ``classes``
    is the class table of ``ontology.default_classes``.
    """
    detail = F.from_json("detail_json", "struct<subject:string,class_name:string,description:string>")
    asked = ids.select("id").distinct().join(proposals.withColumn("_d", detail), "id", "left")
    subject = F.when(F.col("proposal_type") == "add_class", F.coalesce(F.nullif("_d.subject", F.lit("")), F.nullif("_d.class_name", F.lit("")))
                     ).otherwise(F.nullif("_d.subject", F.lit("")))
    asked = asked.withColumn("subject", subject)
    todo = asked.filter("status = 'pending'")
    have = classes.select(F.lower("name").alias("_k"), F.lit(True).alias("_have")).distinct()
    # of several requests for one new class, the first by id creates it
    new = (todo.filter("proposal_type = 'add_class' and subject is not null").groupBy(F.lower("subject").alias("_k"))
           .agg(F.min_by(F.struct("id", F.col("subject").alias("name"), F.coalesce("_d.description", "description").alias("description")), "id").alias("c"))
           .join(have, "_k", "left_anti"))
    maker = new.select(F.col("c.id").alias("id"), F.lit(True).alias("_made"))
    judged = asked.join(maker, "id", "left")
    p, s = F.col("proposal_type"), F.col("subject")
    message = (
        F.when(p.isNull(), "Proposal not found")
        .when(F.col("status") != "pending", F.concat(F.lit("Proposal is already "), "status"))
        .when((p == "add_class") & s.isNull(), "No class name in proposal detail")
        .when((p == "add_class") & F.col("_made"), F.format_string("Added ontology class '%s'", "subject"))
        .when(p == "add_class", F.format_string("Class '%s' already exists — marked as applied", "subject"))
        .when((p == "add_relationship") & s.isNull(), "No relationship type in proposal detail")
        .when(p == "add_relationship", F.format_string("Registered relationship type '%s'", "subject"))
        .otherwise(F.format_string("Proposal marked applied — manual graph rebuild required to propagate %s", "proposal_type")))
    results = judged.select("id", (p.isNotNull() & (F.col("status") == "pending")).alias("success"), message.alias("message"))
    results = results.withColumn("success", F.coalesce("success", F.lit(False)))
    done = todo.select("id", F.lit(True).alias("_done"))
    after = proposals.join(done, "id", "left").select(
        *[F.when(F.col("_done"), "applied").otherwise(F.col("status")).alias(c) if c == "status"
          else F.when(F.col("_done"), F.to_timestamp_ntz(F.lit(now))).otherwise(F.col("applied_at")).alias(c) if c == "applied_at"
          else F.col(c) for c in PROPOSAL_COLUMNS])
    classes_after = classes.unionByName(new.select(
        stable_id(F.lit("class"), "_k").alias("id"), F.col("c.name").alias("name"), F.col("c.description").alias("description")), allowMissingColumns=True)
    fresh = (todo.filter("proposal_type = 'add_relationship' and subject is not null").groupBy(F.lower("subject").alias("_k"))
             .agg(F.max_by("subject", "id").alias("relationship_type"))
             .join(vocabulary.select(F.lower("relationship_type").alias("_k")).distinct(), "_k", "left_anti"))
    return results, after, classes_after, vocabulary.unionByName(fresh.select("relationship_type"))


def dismiss_proposals(ids: DataFrame, proposals: DataFrame) -> DataFrame:
    """Marks proposals dismissed whatever their status."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return proposals.join(hit, "id", "left").select(
        *[F.when(F.col("_hit"), "dismissed").otherwise(F.col("status")).alias(c) if c == "status" else F.col(c) for c in PROPOSAL_COLUMNS])


# -- listings and reports --------------------------------------------------

def list_issues(issues: DataFrame, status: str | None = "open", issue_type=None, severity=None) -> DataFrame:
    """Issues newest first with the detail parsed; unreadable detail gives an empty map."""
    for name, want in (("status", status), ("issue_type", issue_type), ("severity", severity)):
        if want is not None:
            issues = issues.filter(F.col(name) == want)
    detail = F.coalesce(F.from_json("detail_json", "map<string,string>"), F.expr("cast(map() as map<string,string>)"))
    return issues.withColumn("detail", detail).drop("detail_json").orderBy(F.col("detected_at").desc(), "id")


def list_proposals(proposals: DataFrame, status: str | None = None) -> DataFrame:
    if status is not None:
        proposals = proposals.filter(F.col("status") == status)
    return proposals.orderBy(F.col("proposed_at").desc(), "id")


def analyze(e: DataFrame, r: DataFrame, classes: DataFrame, versions: DataFrame, issues: DataFrame, proposals: DataFrame,
            nodes: DataFrame | None, edges: DataFrame | None, now, correct: bool = False, t: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(result row, entities after correction).

    Issues and proposals are taken before, metrics after the optional correction.
    The row holds the metrics and issues_detected, proposals_generated, auto_corrections_applied.
    """
    found = find_issues(e, r, t, now).agg(F.count(F.lit(1))).scalar()
    known = classes.select("name").unionByName(e.sparkSession.createDataFrame([(n,) for n in V.ENTITY_TYPES], "name string"))
    fresh = proposals_from_versions(versions, classes, now).unionByName(proposals_from_drift(vocabulary_drift(e, r), known, now))
    made = fresh.agg(F.count(F.lit(1))).scalar()
    after, count = auto_correct(e) if correct else (e, None)
    applied = count.scalar() if correct else F.lit(0).cast("bigint")
    row = knowledge_metrics(after, r, classes, nodes, edges, t)
    return row.withColumns({"issues_detected": found, "proposals_generated": made, "auto_corrections_applied": applied}), after


def confidence_by_type(e: DataFrame) -> DataFrame:
    """Rows and mean confidence per type, weakest type first."""
    return (e.groupBy("entity_type").agg(F.count(F.lit(1)).alias("cnt"), F.avg("confidence").alias("mean_confidence"))
            .orderBy("mean_confidence", "entity_type"))


def weakest_entities(e: DataFrame, below: float = 0.7, n: int = 20) -> DataFrame:
    return e.filter(F.col("confidence") < below).orderBy("confidence", "id").limit(n)
