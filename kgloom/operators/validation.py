"""Consistency and shape validation of entity, relationship and graph tables."""
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.functions.text import strip
from kgloom.operators.traversal import connected_components
from kgloom.session import broadcast_if_small, cut_lineage

VIOLATION_COLUMNS = ["rule_id", "severity", "message", "node_id", "property_name", "document_id"]


def _violations(df: DataFrame, rule: str, severity: str, message, node="id", prop=None) -> DataFrame:
    doc = F.col("document_id").cast("string") if "document_id" in df.columns else F.lit(None).cast("string")
    return df.select(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), message.alias("message"),
                     F.col(node).alias("node_id"), (F.lit(None).cast("string") if prop is None else F.col(prop)).alias("property_name"),
                     doc.alias("document_id"))


def consistency_violations(e: DataFrame, r: DataFrame) -> DataFrame:
    """Blank entity names, relationships with unknown ends, blank predicates."""
    ids = e.select("id")
    blank = _violations(e.filter(strip(F.coalesce("name", F.lit(""))) == ""), "ENT_001", "error", F.lit("Entity has empty text"))

    def dangling(col, rule, word):
        known = ids.select(F.col("id").alias(col)).distinct()
        lost = r.join(known, col, "left_anti")
        return _violations(lost, rule, "error", F.concat(F.lit(f"Relation {word} '"), F.coalesce(col, F.lit("None")), F.lit("' not found in entities")))
    nameless = _violations(r.filter(strip(F.coalesce("relationship_type", F.lit(""))) == ""), "REL_003", "warning", F.lit("Relation has empty predicate"))
    return reduce(DataFrame.unionByName, [blank, dangling("source_entity_id", "REL_001", "subject"),
                                          dangling("target_entity_id", "REL_002", "object"), nameless])


def validation_report(violations: DataFrame, e: DataFrame, r: DataFrame, rule_set: str = "consistency", per_document: bool = False) -> DataFrame:
    """document_id, rule_set, total_checked, error_count, warning_count, passed: one row, or one per document.

    Items and violations are reduced to counts first, stacked and summed.
    """
    keys = ["document_id"] if per_document else []

    def counted(df, **cols):
        return df.groupBy(*keys).agg(*[c.alias(n) for n, c in cols.items()])
    parts = [counted(e, checked=F.count(F.lit(1))), counted(r, checked=F.count(F.lit(1))),
             counted(violations, errors=F.count_if(F.col("severity") == "error"), warnings=F.count_if(F.col("severity") == "warning"))]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    total = stacked.groupBy(*keys).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("checked", "errors", "warnings")])
    doc = F.col("document_id") if per_document else F.lit(None).cast("string")
    return total.select(doc.alias("document_id"), F.lit(rule_set).alias("rule_set"), F.col("checked").alias("total_checked"),
                        F.col("errors").alias("error_count"), F.col("warnings").alias("warning_count"), (F.col("errors") == 0).alias("passed"))


def report_summary(report: DataFrame) -> DataFrame:
    """document_id, summary line and the report as JSON."""
    line = F.concat(F.lit("Validation "), F.when(F.col("passed"), "PASSED").otherwise("FAILED"), F.lit(": "), F.col("error_count").cast("string"),
                    F.lit(" errors, "), F.col("warning_count").cast("string"), F.lit(" warnings across "), F.col("total_checked").cast("string"), F.lit(" items"))
    return report.select("document_id", line.alias("summary"), F.to_json(F.struct(*report.columns), {"ignoreNullFields": "false"}).alias("report_json"))


def violations_json(violations: DataFrame) -> DataFrame:
    """Each violation as one JSON object."""
    return violations.select("document_id", F.to_json(F.struct("rule_id", "severity", "message", "node_id", "property_name"), {"ignoreNullFields": "false"}).alias("violation"))


def shape_violations(nodes: DataFrame, edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Violations of a rules table (rule_id, kind, target_class, property, argument).

    kinds: minCount (property must be present), datatype (argument integer, float,
    boolean or date), pattern (regular expression) on nodes of ``target_class``;
    class (edges of type ``property`` must end in ``target_class``). The rules are
    few and joined by class.
    """
    # what a message says depends on its rule alone, so it is written once per rule
    r = broadcast_if_small(cut_lineage(rules.select(
        "rule_id", "kind", "target_class", F.col("property").alias("prop"), "argument",
        F.when(F.col("kind") == "minCount", F.format_string("Required property '%s' is missing", "property"))
        .when(F.col("kind") == "datatype", F.format_string("Property '%s' is not of type %s", "property", "argument"))
        .when(F.col("kind") == "pattern", F.format_string("Property '%s' does not match %s", "property", "argument"))
        .otherwise(F.format_string("Target of %s is not a %s", "property", "target_class")).alias("message"))))
    value = F.try_element_at("attributes", F.col("prop"))
    on_nodes = nodes.join(r.filter("kind in ('minCount', 'datatype', 'pattern')"), F.col("entity_type") == F.col("target_class")).withColumn("value", value)
    bad_type = (F.when(F.col("argument") == "integer", F.col("value").try_cast("bigint").isNull())
                .when(F.col("argument") == "float", F.col("value").try_cast("double").isNull())
                .when(F.col("argument") == "boolean", ~F.lower("value").isin("true", "false"))
                .when(F.col("argument") == "date", F.col("value").try_cast("date").isNull()).otherwise(F.lit(False)))
    broken = (F.when(F.col("kind") == "minCount", F.col("value").isNull())
              .when(F.col("kind") == "datatype", F.col("value").isNotNull() & bad_type)
              .otherwise(F.col("value").isNotNull() & ~F.regexp_like("value", F.col("argument"))))
    shown = [F.col("id").alias("node_id"), F.col("prop").alias("property_name"), F.col("document_id").cast("string").alias("document_id")]
    bad_nodes = on_nodes.filter(broken).select("rule_id", F.when(F.col("kind") == "pattern", "warning").otherwise("error").alias("severity"), "message", *shown)
    # a node can carry several types; any of them will do. Only nodes of a wanted class meet the edges, and only edges under a rule are shuffled
    classes = r.filter("kind = 'class'")
    fitting = nodes.select(F.col("id").alias("_id"), F.col("entity_type").alias("_type")).join(classes.select(F.col("target_class").alias("_type")), "_type", "left_semi")
    on_edges = edges.join(classes, F.col("type") == F.col("prop")).select("rule_id", "message", "target_class", "tgt", *shown)
    lost = on_edges.join(fitting, (F.col("tgt") == F.col("_id")) & (F.col("target_class") == F.col("_type")), "left_anti")
    return bad_nodes.unionByName(lost.select("rule_id", F.lit("warning").alias("severity"), "message", "node_id", "property_name", "document_id"))


def contradicting_relations(r: DataFrame) -> DataFrame:
    """Pairs related by the same type in both directions: low_id, high_id, relationship_type, forward, backward, first_id.

    One aggregate over the unordered pair; relationships are never joined with
    each other, so repeated statements cannot multiply.
    """
    s, t = F.col("source_entity_id"), F.col("target_entity_id")
    pair = r.filter(s.isNotNull() & t.isNotNull() & (s != t))
    g = pair.groupBy(F.least(s, t).alias("low_id"), F.greatest(s, t).alias("high_id"), "relationship_type").agg(
        F.count_if(s < t).alias("forward"), F.count_if(s > t).alias("backward"), F.min("id").alias("first_id"))
    return g.filter("forward > 0 and backward > 0")


def duplicate_name_type(e: DataFrame) -> DataFrame:
    """Names that occur more than once with the same type."""
    return e.groupBy("name", "entity_type").agg(F.count(F.lit(1)).alias("cnt")).filter("cnt > 1")


def conflicting_types(e: DataFrame) -> DataFrame:
    """Names used with several types. Types are folded per (name, type) first."""
    pairs = e.filter("entity_type is not null and entity_type <> ''").groupBy("name", "entity_type").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("name").agg(F.count(F.lit(1)).alias("type_count"), F.array_join(F.array_sort(F.collect_list("entity_type")), ",").alias("types"),
                                     F.sum("n").alias("cnt")).filter("type_count > 1")


def missing_properties(e: DataFrame, expected: DataFrame) -> DataFrame:
    """(id, property) for every attribute its class expects and the entity lacks.

    ``expected``: class_name, property.
    """
    want = e.select("id", "entity_type", F.map_keys("attributes").alias("have")).join(
        expected.select(F.col("class_name").alias("entity_type"), "property"), "entity_type")
    return want.filter(~F.coalesce(F.array_contains("have", F.col("property")), F.lit(False))).select("id", "entity_type", "property")


def degrees(edges: DataFrame) -> DataFrame:
    """id, degree: edges touching a node (a self-loop counts twice)."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("tgt").alias("id")))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def sparse_entities(nodes: DataFrame, edges: DataFrame, minimum: int = 2) -> DataFrame:
    """Nodes with fewer than ``minimum`` connections, orphans included."""
    return (nodes.select("id", "name").join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
            .filter(F.col("degree") < minimum))


def low_confidence_clusters(edges: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Connected components whose edges all lie below ``threshold``: component, node_count, edge_count, max_confidence.

    Components are built from the weak edges only and dropped when one of their
    nodes also touches a stronger edge, so the strong part of the graph, usually
    the bulk, takes no part in the iteration.
    """
    e = edges.filter("src is not null and tgt is not null")
    weak = e.filter(F.coalesce("confidence", F.lit(0.0)) < threshold)
    strong = e.filter(F.coalesce("confidence", F.lit(0.0)) >= threshold)
    firm = strong.select(F.col("src").alias("id")).unionByName(strong.select(F.col("tgt").alias("id"))).distinct().withColumn("firm", F.lit(1))
    comp = connected_components(weak)
    size = comp.join(firm, "id", "left").groupBy("component").agg(F.count(F.lit(1)).alias("node_count"), F.count("firm").alias("firm"))
    size = size.filter("firm = 0").drop("firm")
    per_edge = weak.join(comp.select(F.col("id").alias("src"), "component"), "src").groupBy("component").agg(
        F.count(F.lit(1)).alias("edge_count"), F.max("confidence").alias("max_confidence"))
    return size.join(per_edge, "component")
