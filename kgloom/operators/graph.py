"""Property graph tables: building, merging and reading.

nodes: label, id, name, document_id, entity_type, confidence, attributes, was_created
edges: id, src, tgt, type, confidence, evidence, document_id, was_created
"""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom import vocab as V
from kgloom.functions.arrays import explode_rows
from kgloom.functions.text import safe_label
from kgloom.session import BROADCAST_ROWS, broadcast_if_small, cut_lineage, number_within
from kgloom.session import id_bits as _bits
from kgloom.session import may_be as _may_be

NODE_FIELDS = ["name", "document_id", "entity_type", "confidence", "attributes"]
EDGE_FIELDS = ["type", "confidence", "evidence", "document_id"]


def nodes_from(entities: DataFrame) -> DataFrame:
    """Entities as fresh nodes."""
    return entities.select(safe_label("entity_type").alias("label"), "id", *NODE_FIELDS, F.lit(True).alias("was_created"))


def edges_from(rels: DataFrame, *keep: str) -> DataFrame:
    """Relationships with both ends known as fresh edges; ``keep`` names further columns to carry along."""
    evidence = F.col("evidence_text") if "evidence_text" in rels.columns else F.lit("")
    return (rels.filter("source_entity_id is not null and target_entity_id is not null")
            .select(*keep, "id", F.col("source_entity_id").alias("src"), F.col("target_entity_id").alias("tgt"),
                    F.col("relationship_type").alias("type"), "confidence", evidence.alias("evidence"), "document_id",
                    F.lit(True).alias("was_created")))


def _merge(existing: DataFrame, incoming: DataFrame, keys: list[str], fields: list[str], order: str | None) -> tuple[DataFrame, DataFrame]:
    """Upsert on ``keys``; the last incoming row per key wins, by the column ``order``. Returns (table, counts).

    Rows that are equal in ``order``, or come without one, have no last row; the
    greatest field values are taken, so that the result is the same every time. The
    incoming side is folded per key first, so both join sides are unique on the key
    and no key can be hot.
    """
    order = F.col(order) if order else F.lit(0)
    new = incoming.groupBy(*keys).agg(
        F.max_by(F.struct(*fields), F.struct(order, *[F.col(f) for f in fields if f != "attributes"])).alias("_new"),
        F.count(F.lit(1)).alias("_rows"))
    old = existing.select(*keys, F.struct(*fields, "was_created").alias("_old"))
    both = old.join(new, keys, "full_outer")
    is_new = F.col("_old").isNull()
    merged = both.select(
        *keys, *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{f}")).otherwise(F.col(f"_old.{f}")).alias(f) for f in fields],
        F.when(F.col("_new").isNull(), F.col("_old.was_created")).otherwise(is_new).alias("was_created"))
    counts = both.agg(
        F.count_if(is_new).alias("created"),
        (F.coalesce(F.sum("_rows"), F.lit(0)) - F.count_if(is_new)).alias("updated"))
    return merged, counts


def merge_nodes(nodes: DataFrame, entities: DataFrame, order: str | None = "pos") -> tuple[DataFrame, DataFrame]:
    """Upserts entities as nodes keyed by (label, id); of several, the last by ``order``. Returns (nodes, counts)."""
    incoming = entities.withColumn("label", safe_label("entity_type"))
    return _merge(nodes, incoming, ["label", "id"], NODE_FIELDS, order)


def merge_edges(edges: DataFrame, nodes: DataFrame, rels: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Upserts relationships as edges keyed by (src, tgt, id); of several, the last by ``order``. Returns (edges, counts).

    Relationships with a NULL end are ignored; those whose end is not a node are
    counted in ``skipped``.
    """
    ids = nodes.select("id").distinct()
    incoming = edges_from(rels, *([order] if order else []))
    src_known = ids.select(F.col("id").alias("src"), F.lit(True).alias("_s"))
    tgt_known = ids.select(F.col("id").alias("tgt"), F.lit(True).alias("_t"))
    flagged = incoming.join(src_known, "src", "left").join(tgt_known, "tgt", "left")
    linked = F.col("_s").isNotNull() & F.col("_t").isNotNull()
    merged, counts = _merge(edges, flagged.filter(linked), ["src", "tgt", "id"], EDGE_FIELDS, order)
    # a row that is not skipped is counted above once, so the ends are not looked up again for those that are
    totals = _totals(["created", "updated", "rows"], counts, incoming.agg(F.count(F.lit(1)).alias("rows")))
    return merged, totals.select("created", "updated", (F.col("rows") - F.col("created") - F.col("updated")).alias("skipped"))


def _totals(names: list[str], *parts: DataFrame) -> DataFrame:
    """One row from one-row frames holding some of the named counts each."""
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p, allowMissingColumns=True)
    return stacked.agg(*[F.sum(n).alias(n) for n in names])


def merge_counts(node_counts: DataFrame, edge_counts: DataFrame) -> DataFrame:
    """One row: nodes_created, nodes_updated, edges_created, edges_updated, edges_skipped."""
    n = node_counts.select(*[F.col(c).alias(f"nodes_{c}") for c in ("created", "updated")])
    e = edge_counts.select(*[F.col(c).alias(f"edges_{c}") for c in ("created", "updated", "skipped")])
    return _totals(n.columns + e.columns, n, e)


def _ends_in_one_document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two ends belong to the same document, with that document in ``graph_document``."""
    where = nodes.filter("document_id is not null").select("id", "document_id").distinct()
    s = where.select(F.col("id").alias("src"), F.col("document_id").alias("graph_document"))
    t = where.select(F.col("id").alias("tgt"), F.col("document_id").alias("graph_document"))
    return edges.join(s, "src").join(t, ["tgt", "graph_document"])


def document_graph(nodes: DataFrame, edges: DataFrame, doc_id=None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) per document, for all documents or one; an edge needs both ends inside."""
    if doc_id is not None:
        nodes = nodes.filter(F.col("document_id") == doc_id)
    inside = _ends_in_one_document(nodes, edges)
    return (nodes.filter("id is not null").select("document_id", "id", "label", "name", "entity_type", "confidence", "attributes"),
            inside.select(F.col("graph_document").alias("document_id"),
                          F.coalesce("id", F.concat_ws("-", "src", "tgt")).alias("id"), "type",
                          F.col("src").alias("source_id"), F.col("tgt").alias("target_id")))


def document_graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """document_id, node_count, edge_count."""
    n, e = document_graph(nodes, edges)
    both = (n.groupBy("document_id").agg(F.count(F.lit(1)).alias("node_count"))
            .join(e.groupBy("document_id").agg(F.count(F.lit(1)).alias("edge_count")), "document_id", "left"))
    return both.withColumn("edge_count", F.coalesce("edge_count", F.lit(0)))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """label, nodes per label (most frequent first), with total node_count and edge_count."""
    per = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("cnt"))
    return (per.withColumn("node_count", nodes.agg(F.count(F.lit(1))).scalar())
            .withColumn("edge_count", edges.agg(F.count(F.lit(1))).scalar())
            .orderBy(F.col("cnt").desc(), "label"))


# -- retrieval slices ------------------------------------------------------

def _type_keys(*cols) -> Column:
    """The distinct lower-case match keys among type and label columns."""
    return F.array_distinct(F.array_compact(F.array(*[F.lower(c) for c in cols])))


def node_view(nodes: DataFrame) -> DataFrame:
    return nodes.filter("id is not null and id <> ''").select(
        "id", F.coalesce(F.nullif("name", F.lit("")), F.lit("(unnamed)")).alias("name"),
        F.coalesce(F.nullif("entity_type", F.lit("")), F.lit("Unknown")).alias("entity_type"), "label", "confidence")


EDGE_ID = "coalesce(id, concat_ws('-', src, tgt))"


def _ends(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """One (id, name, entity_type, label) row per node id among ``ids``, which are distinct."""
    # not a semi join, which the optimizer would move below a bitmap's test
    return nodes.join(ids, "id").groupBy("id").agg(F.max_by(F.struct("name", "entity_type", "label"), F.coalesce("label", F.lit(""))).alias("n")).select("id", "n.*")


def _ends_of(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``_ends`` of the edges in ``rows``. Few ids are sent to the nodes; of many a bitmap, so only nodes that may be an end are shuffled."""
    ids = cut_lineage(rows.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct())
    if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return _ends(nodes, F.broadcast(ids))
    return _ends(_may_be(nodes, "id", _bits(ids, "id")), ids)


def _edge_rows(edges: DataFrame) -> DataFrame:
    return edges.filter("src is not null and tgt is not null").select(
        F.expr(EDGE_ID).alias("id"), F.coalesce("type", F.lit("RELATES")).alias("type"), F.col("src").alias("source_id"), F.col("tgt").alias("target_id"))


def named_edges(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` (source_id, target_id, ...) whose two ends are nodes, with their names; for few rows the nodes are only scanned."""
    names = cut_lineage(_ends_of(rows, nodes).select("id", "name"))
    out = rows
    for side in ("source", "target"):
        out = out.join(broadcast_if_small(names).withColumnsRenamed({"id": f"{side}_id", "name": f"{side}_name"}), f"{side}_id")
    return out.select(*rows.columns, "source_name", "target_name")


def edges_around(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """question_id and edges with an end among that question's ends (question_id, n), an id once."""
    rows = _edge_rows(edges)
    met = rows.join(ends.withColumnRenamed("n", "source_id"), "source_id").unionByName(rows.join(ends.withColumnRenamed("n", "target_id"), "target_id"))
    return met.dropDuplicates(["question_id", "id"]).select("question_id", *rows.columns)


def _first_edges(hits: DataFrame, key: str, cap: int | None, *more: str) -> DataFrame:
    """The edges with the ``cap`` first ids of each key, an id once; the cut comes before the shuffle as well."""
    if cap is not None:
        w = Window.partitionBy(key).orderBy("id")
        hits = hits.withColumn("_rk", F.dense_rank().over(w)).filter(F.col("_rk") <= cap)
    return hits.groupBy(key, "id").agg(F.min(F.struct("type", "source_id", "target_id", *more)).alias("e")).select(key, "id", "e.*")


def _asked_nodes(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """(end, match_key): nodes with one of the given type or label keys (column match_key)."""
    typed = explode_rows(nodes, ["id"], _type_keys("entity_type", "label"), "match_key")
    ids = typed.join(broadcast_if_small(keys), "match_key", "left_semi").select("id").distinct()
    # a node with several labels counts with its last one
    ends = _ends(nodes, broadcast_if_small(cut_lineage(ids)))
    return explode_rows(ends, [F.col("id").alias("end")], _type_keys("entity_type", "label"), "match_key").join(broadcast_if_small(keys), "match_key", "left_semi")


def _with_known_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "tgt"), "tgt", "left_semi")


def _id_number(c: str) -> Column:
    """The first seven bytes of a text as a number, so that a lower text never has the higher number."""
    return F.conv(F.rpad(F.hex(F.substring(F.col(c).cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("bigint")


def _head_border(rows: DataFrame, wanted: int) -> int | None:
    """A number of ids at or below which ``wanted`` rows or more lie; None if these are more than a quarter of all."""
    shares = [2.0 ** -i for i in range(1, 13)]
    total, marks = rows.agg(F.count(F.lit(1)), F.percentile_approx(_id_number("id"), shares, 100_000)).first()
    fit = [m for share, m in zip(shares[1:], (marks or [])[1:]) if share * total >= wanted]
    return fit[-1] if fit and fit[-1] < marks[0] else None


def _first_of_head(head: DataFrame, nodes: DataFrame, keys: DataFrame, cap: int) -> DataFrame:
    """match_key and the first ``cap`` edges of ``head`` that touch it, both ends known, with their names."""
    ends = cut_lineage(_ends_of(head, nodes).select("id", "name", _type_keys("entity_type", "label").alias("keys")))
    rows = head
    for side in ("source", "target"):
        rows = rows.join(broadcast_if_small(ends).withColumnsRenamed({c: f"{side}_{c}" for c in ends.columns}), f"{side}_id")
    columns = [*head.columns, "source_name", "target_name"]
    met = explode_rows(rows, columns, F.array_distinct(F.concat("source_keys", "target_keys")), "match_key").join(broadcast_if_small(keys), "match_key", "left_semi")
    return _first_edges(met, "match_key", cap, "source_name", "target_name")


def first_touching(edges: DataFrame, nodes: DataFrame, keys: DataFrame, cap: int | None) -> DataFrame:
    """match_key and the first ``cap`` edges with an end of that type or label, with the names of their ends; all without a cap.

    Edges with the lowest ids meet their ends first: a type that finds ``cap`` of them has
    its cut, as every other edge has a higher id. Only types that find fewer are looked up in
    all edges: one scan of these meets the ids of the asked nodes; if they are many, only edges
    with an end in their bitmap are shuffled. Names are attached to what is left after the cut. Edges whose other end is no node do not count: if the cut
    holds one, it is made again among edges with known ends.
    """
    keys, settled = cut_lineage(keys.select("match_key").distinct()), None
    border = None if cap is None else _head_border(_edge_rows(edges), cap * keys.count())
    if border is not None:
        head = cut_lineage(_edge_rows(edges).filter(_id_number("id") <= border))
        found = cut_lineage(_first_of_head(head, nodes, keys, cap))
        full = broadcast_if_small(cut_lineage(found.groupBy("match_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= cap).select("match_key")))
        settled = found.join(full, "match_key", "left_semi")
        keys = cut_lineage(keys.join(full, "match_key", "left_anti"))
        if keys.isEmpty():
            return settled
    asked = cut_lineage(_asked_nodes(nodes, keys))
    few = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    bits = None if few else _bits(asked, "end")

    def cut(rows):
        ends = _edge_rows(rows).withColumn("end", F.explode(F.array("source_id", "target_id")))
        met = ends.join(F.broadcast(asked), "end") if few else _may_be(ends, "end", bits).join(asked, "end")
        return cut_lineage(_first_edges(met.drop("end"), "match_key", cap))
    rest = _named_cut(cut, edges, nodes)
    return rest if settled is None else settled.unionByName(rest)


def first_edges(edges: DataFrame, nodes: DataFrame, cap: int | None) -> DataFrame:
    """The first ``cap`` edges of all, with the names of their ends."""
    def cut(rows):
        rows = _edge_rows(rows).withColumn("_all", F.lit(1))
        few = rows if cap is None else rows.orderBy("id", "type", "source_id", "target_id").limit(cap)
        return cut_lineage(_first_edges(few, "_all", cap))
    return _named_cut(cut, edges, nodes).drop("_all")


def _named_cut(cut, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    found = cut(edges)
    named = cut_lineage(named_edges(found, nodes))
    if named.count() < found.count():
        named = cut_lineage(named_edges(cut(_with_known_ends(edges, nodes)), nodes))
    return named


def first_per(df: DataFrame, keys, order, n: int) -> DataFrame:
    """First ``n`` rows per key; the limit is applied before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


# numbers of rows that go to every task in lists of one key
LISTED = 1_000_000


def _per_question(wanted: DataFrame, keyed: DataFrame, cap: int | None) -> DataFrame:
    """Rows matching each question's types, an id once, at most ``cap`` per question in id order.

    The first ``cap`` rows of every single type are enough to answer any set of
    types, so a type that covers a third of the graph contributes ``cap`` rows. These
    are numbered by id; a question takes the lowest numbers of its types' lists, and
    rows are attached to what it takes. So questions, not their rows, are shuffled.
    """
    columns = [c for c in keyed.columns if c != "match_key"]
    if cap is None:
        return wanted.join(keyed, "match_key").drop("match_key").dropDuplicates(["question_id", "id"])
    keyed = keyed.withColumn("_row", F.to_json(F.struct(*columns)))
    ids = number_within(keyed.select("id").distinct(), [], ["id"], "_no")
    # an id may come with several labels
    variants = keyed.select("id", "_row").distinct().withColumn("_v", F.row_number().over(Window.partitionBy("id").orderBy("_row")))
    numbers = cut_lineage(variants.join(ids, "id").select("id", "_row", F.struct("_no", "_v").alias("_n")))
    lists = cut_lineage(keyed.join(numbers, ["id", "_row"]).groupBy("match_key").agg(F.array_sort(F.collect_set("_n")).alias("_list")))
    taken = (wanted.repartition("question_id").join(broadcast_if_small(lists, max(1, LISTED // max(cap, 1))), "match_key")
             .groupBy("question_id").agg(F.array_sort(F.flatten(F.collect_list("_list"))).alias("_all")))
    first = F.filter("_all", lambda n, i: (i == 0) | (F.get("_all", i - 1)["_no"] != n["_no"]))
    content = cut_lineage(keyed.join(numbers, ["id", "_row"]).dropDuplicates(["id", "_row"]).select("_n", *columns))
    return (taken.select("question_id", F.explode(F.slice(first, 1, cap)).alias("_n")).join(broadcast_if_small(content), "_n")
            .select("question_id", *columns))


def seed_slices(questions: DataFrame, nodes: DataFrame, edges: DataFrame,
                node_cap: int | None = V.NODE_CAP, edge_cap: int | None = V.EDGE_CAP) -> tuple[DataFrame, DataFrame]:
    """Nodes and touching edges for each (question_id, class_name) row.

    A question whose classes match no node gets the first nodes and edges of the
    whole graph; a question without classes gets nothing. A cap of None gives all.
    """
    wanted = cut_lineage(questions.select("question_id", F.lower("class_name").alias("match_key")).distinct())
    asked = wanted.select("question_id").distinct()
    keys = cut_lineage(wanted.select("match_key").distinct())
    view = node_view(nodes)
    keyed = explode_rows(view, view.columns, _type_keys("entity_type", "label"), "match_key").join(broadcast_if_small(keys), "match_key", "left_semi")
    keyed = cut_lineage(keyed if node_cap is None else first_per(keyed, ["match_key"], ["id"], node_cap))
    known = broadcast_if_small(cut_lineage(keyed.select("match_key").distinct()))
    empty = cut_lineage(asked.join(wanted.join(known, "match_key", "left_semi").select("question_id").distinct(), "question_id", "left_anti"))
    hit_nodes = _per_question(wanted, keyed, node_cap)
    hit_edges = _per_question(wanted.join(broadcast_if_small(empty), "question_id", "left_anti"), first_touching(edges, nodes, keys, edge_cap), edge_cap)
    if empty.isEmpty():
        return hit_nodes, hit_edges

    def everything(top):
        # the same list for each such question: joined on a constant key
        return empty.withColumn("_all", F.lit(1)).join(broadcast_if_small(cut_lineage(top.withColumn("_all", F.lit(1)))), "_all").drop("_all")
    first_nodes = view if node_cap is None else view.orderBy("id").limit(node_cap)
    return hit_nodes.unionByName(everything(first_nodes)), hit_edges.unionByName(everything(first_edges(edges, nodes, edge_cap)))


def seed_nodes(nodes: DataFrame, types: list[str], cap: int | None = V.NODE_CAP) -> DataFrame:
    """Nodes whose type or label is among ``types``; without any match, the first of all nodes. A cap of None gives all."""
    view = node_view(nodes)
    if not types:
        return view.limit(0)
    keys = [t.lower() for t in types]
    hit = F.lower("entity_type").isin(keys) | F.lower("label").isin(keys)
    if cap is None:
        return view if view.filter(hit).isEmpty() else view.filter(hit)
    # matches sort first, so the cut rows hold a match if there is one at all
    top = view.withColumn("_hit", hit).orderBy(F.col("_hit").desc(), "id").limit(cap)
    any_hit = top.agg(F.max("_hit")).scalar()
    return top.filter(F.col("_hit") | ~any_hit).drop("_hit")


def touching_edges(edges: DataFrame, nodes: DataFrame, types: list[str], cap: int | None = V.EDGE_CAP) -> DataFrame:
    """Edges with an end whose type or label is among ``types``; without any such node, the first of all edges. A cap of None gives all."""
    columns = ["id", "type", "source_id", "target_id", "source_name", "target_name"]
    if not types:
        return named_edges(_edge_rows(edges.limit(0)), nodes).select(columns)
    keys = [t.lower() for t in types]
    if nodes.filter(F.arrays_overlap(_type_keys("entity_type", "label"), F.array(*[F.lit(k) for k in keys]))).isEmpty():
        return first_edges(edges, nodes, cap).select(columns)
    asked = nodes.sparkSession.createDataFrame([(k,) for k in dict.fromkeys(keys)], "match_key string")
    found = first_touching(edges, nodes, asked, cap).dropDuplicates(["id"]).select(columns)
    return found if cap is None else found.orderBy("id").limit(cap)


# -- structured reads ------------------------------------------------------

_OPS = {
    "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v, "in": lambda c, v: c.isin(v),
}


def _conditions(nodes: DataFrame, entity_types, filters) -> Column:
    cond = F.lit(True)
    if entity_types:
        cond = cond & F.col("entity_type").isin(*entity_types)
    for name, want in (filters or {}).items():
        c = F.col(name) if name in nodes.columns else F.try_element_at("attributes", F.lit(name))
        for op, v in (want.items() if isinstance(want, dict) else [("eq", want)]):
            cond = cond & _OPS[op](c, v)
    return cond


def graph_find(nodes: DataFrame, entity_types=None, filters=None, limit: int = V.FIND_LIMIT) -> DataFrame:
    """Nodes of any of the types that satisfy all filters, e.g. ``{"confidence": {"gte": 0.7}}``."""
    return nodes.filter(_conditions(nodes, entity_types, filters)).orderBy("id", "label").limit(limit)


def graph_count(nodes: DataFrame, entity_types=None, filters=None) -> DataFrame:
    """Matching nodes per entity_type."""
    return nodes.filter(_conditions(nodes, entity_types, filters)).groupBy("entity_type").agg(F.count(F.lit(1)).alias("cnt"))


def graph_relate(nodes: DataFrame, edges: DataFrame, source_types=None, relations=None, target_types=None) -> DataFrame:
    """Typed source-edge-target rows: edge_id, source_id, source_name, type, target_id, target_name, confidence."""
    e = edges.filter(F.col("type").isin(*relations)) if relations else edges

    def side(types, key):
        n = nodes.filter(F.col("entity_type").isin(*types)) if types else nodes
        return n.select(F.col("id").alias(key), F.col("name").alias(key + "_name"))
    return (e.join(side(source_types, "src"), "src").join(side(target_types, "tgt"), "tgt")
            .select(F.col("id").alias("edge_id"), F.col("src").alias("source_id"), F.col("src_name").alias("source_name"),
                    "type", F.col("tgt").alias("target_id"), F.col("tgt_name").alias("target_name"), "confidence"))


def pattern(nodes: DataFrame, edges: DataFrame, src_type=None, rel=None, tgt_type=None) -> DataFrame:
    """Rows of one type-relation-type pattern; ``None`` matches anything."""
    return graph_relate(nodes, edges, [src_type] if src_type else None, [rel] if rel else None, [tgt_type] if tgt_type else None)


def type_distribution(nodes: DataFrame) -> DataFrame:
    return (nodes.filter("entity_type is not null").groupBy("entity_type").agg(F.count(F.lit(1)).alias("cnt"))
            .orderBy(F.col("cnt").desc(), "entity_type"))


def edges_of_documents(nodes: DataFrame, edges: DataFrame, doc_id=None) -> DataFrame:
    """Edges stored under a document with the names of their ends."""
    e = edges if doc_id is None else edges.filter(F.col("document_id") == doc_id)
    n = nodes.select("id", "name")
    return (e.join(n.select(F.col("id").alias("src"), F.col("name").alias("source_name")), "src")
            .join(n.select(F.col("id").alias("tgt"), F.col("name").alias("target_name")), "tgt")
            .select("document_id", F.col("id").alias("edge_id"), "source_name", "type", "target_name"))


def repeated_names(nodes: DataFrame) -> DataFrame:
    """Names carried by more than one node."""
    return nodes.groupBy("name").agg(F.count(F.lit(1)).alias("cnt")).filter("cnt > 1")


def low_confidence_edges(nodes: DataFrame, edges: DataFrame, threshold: float = 0.5, limit: int | None = None) -> DataFrame:
    """Edges below the threshold with the names of their ends, weakest first; with a limit, the first so many of them."""
    named = graph_relate(nodes, edges.filter(F.col("confidence") < threshold)).orderBy("confidence", "edge_id")
    return named if limit is None else named.limit(limit)


def orphan_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("tgt").alias("id"))).distinct()
    return nodes.join(ends, "id", "left_anti").select("id", "name", "entity_type")


def all_nodes(nodes: DataFrame, limit: int = 50) -> DataFrame:
    return nodes.orderBy("id", "label").limit(limit)


def induced_subgraph(nodes: DataFrame, edges: DataFrame, labels: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes with an active label (or none at all) and the edges with both ends among them."""
    kept = nodes.filter(F.col("label").isin(*labels) | F.col("label").isNull() | (F.col("label") == ""))
    ids = kept.select("id")
    e = (edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
         .join(ids.withColumnRenamed("id", "tgt"), "tgt", "left_semi"))
    return kept, e


def name_graph(rels: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph over names: nodes typed by lower-case name (last entity wins), edges labelled by relation."""
    # both names of a row at once, so the rows are not made a second time
    ends = rels.select(F.explode(F.array("source_entity_name", "target_entity_name")).alias("name")).distinct()
    types = entities.groupBy(F.lower("name").alias("_k")).agg(F.max_by("entity_type", "pos").alias("entity_type"))
    nodes = ends.withColumn("_k", F.lower("name")).join(types, "_k", "left").select("name", "entity_type")
    at = F.instr("relationship_type", "_")
    label = F.when(at > 0, F.overlay("relationship_type", F.lit(" "), at, F.lit(1))).otherwise(F.col("relationship_type"))
    edges = rels.select("id", F.col("source_entity_name").alias("source"), F.col("target_entity_name").alias("target"), label.alias("label"))
    return nodes, edges


def write_typed_edges(edges: DataFrame, path: str, rows_per_task: int = 2_000_000) -> None:
    """One folder per edge type; big types are split over tasks by edge id, so no type is written by one task alone."""
    per_type = edges.groupBy("type").agg(F.ceil(F.count(F.lit(1)) / rows_per_task).alias("_n"))
    spread = edges.join(per_type, "type").withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_n")))
    spread.repartition("type", "_b").drop("_n", "_b").write.mode("overwrite").partitionBy("type").parquet(path)


def reset_graph(edges: DataFrame, path: str) -> None:
    """Overwrites a stored graph with an empty table of the same schema."""
    edges.limit(0).write.mode("overwrite").parquet(path)
