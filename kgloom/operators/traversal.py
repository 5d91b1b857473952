"""Multi-hop reads: neighbourhoods, shortest paths, connected components.

Every hop is one join of the frontier with the adjacency list and one aggregate
with map-side combine; visited sets are checkpointed between hops so plans stay
linear and an executor loss repeats at most one hop.
"""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.session import broadcast_if_small, cut_lineage, id_bits, may_be


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b) pairs in both directions, without self-loops; parallel edges stay, as the aggregates after it fold them."""
    e = edges.filter("src is not null and tgt is not null and src <> tgt")
    return e.select(F.col("src").alias("a"), F.col("tgt").alias("b")).unionByName(e.select(F.col("tgt").alias("a"), F.col("src").alias("b")))


def distances(nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int, parents: bool = False) -> DataFrame:
    """start_id, id, dist (and parent) for everything within ``depth`` hops of each start.

    The parent is the lowest neighbour id one hop nearer to the start. A hop writes
    the rows it reaches first and no other. A frontier of few rows is broadcast, so
    the edge table is scanned and not shuffled; a large one is joined by shuffle,
    where skewed hubs are split at run time.
    """
    adj = undirected(edges)
    known = nodes.select(F.col("id").alias("start_id"))
    columns = ["start_id", "id", "dist", "parent"]
    frontier = cut_lineage(starts.select("start_id").distinct().join(known, "start_id", "left_semi").select(
        "start_id", F.col("start_id").alias("id"), F.lit(0).alias("dist"), F.lit(None).cast("string").alias("parent")))
    seen = frontier
    for d in range(1, depth + 1):
        if frontier.isEmpty():
            break
        near = frontier.select("start_id", F.col("id").alias("a"))
        step = adj.join(broadcast_if_small(near), "a").groupBy("start_id", F.col("b").alias("id")).agg(F.lit(d).alias("dist"), F.min("a").alias("parent"))
        # what a hop reaches again lies one or two hops back, as edges have no direction
        past = seen.filter(F.col("dist") >= d - 2).select("start_id", "id")
        frontier = cut_lineage(step.join(past, ["start_id", "id"], "left_anti").select(columns))
        seen = seen.unionByName(frontier)
    return seen if parents else seen.drop("parent")


def neighborhood(nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) within ``depth`` undirected hops of each start id.

    An edge belongs to the result when some walk of at most ``depth`` edges uses
    it, i.e. its nearer end is at most ``depth - 1`` away.
    """
    near = distances(nodes, edges, starts, depth)
    inner = broadcast_if_small(near.filter(F.col("dist") <= depth - 1).select("start_id", "id"))
    cols = ["start_id", "id", "type", "src", "tgt"]
    by_src = edges.join(inner.withColumnRenamed("id", "src"), "src").select(cols)
    by_tgt = edges.join(inner.withColumnRenamed("id", "tgt"), "tgt").select(cols)
    out_nodes = near.join(nodes.select("id", "label", "name", "entity_type", "confidence"), "id")
    return out_nodes, by_src.unionByName(by_tgt).distinct()


def shortest_paths(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """Shortest undirected path of at most ``depth`` hops per (from_id, to_id): hops and path (ids joined by ->).

    Both ends search: trees of half the depth grow around the starts, then hop by hop
    rings around those targets that have an open pair. A pair is done, and leaves, as
    soon as a ring meets the edge of its start's tree. Pairs without such a path are
    absent. Ties are broken by the lowest ids, walking back from the target.
    """
    open_pairs = cut_lineage(pairs.select("from_id", "to_id").distinct())
    half = (depth + 1) // 2
    tree = cut_lineage(distances(nodes, edges, pairs.select(F.col("from_id").alias("start_id")), half, parents=True).select(
        F.col("start_id").alias("from_id"), F.col("id").alias("at"), "dist", "parent"))
    known = nodes.select(F.col("id").alias("to_id")).distinct()
    adj = undirected(edges)
    # the ids from the target outward, the lowest of all ways to a place on the ring
    ring = cut_lineage(open_pairs.select("to_id").distinct().join(known, "to_id", "left_semi").select("to_id", F.col("to_id").alias("at"), F.array("to_id").alias("way")))
    past, met = ring.select("to_id", "at"), []
    for hop in range(depth - half + 1):
        if hop:
            last = hop == depth - half
            ring = ring.join(open_pairs.select("to_id").distinct(), "to_id", "left_semi")
            # what the last ring reaches beyond the edges of the trees meets nothing, and what it reaches again has met before
            ways = may_be(adj, "b", id_bits(tree.filter(F.col("dist") == half), "at")) if last else adj
            step = ways.join(broadcast_if_small(cut_lineage(ring.withColumnRenamed("at", "a"))), "a").select(
                "to_id", F.col("b").alias("at"), F.concat("way", F.array("b")).alias("way")).groupBy("to_id", "at").agg(F.min("way").alias("way"))
            ring = cut_lineage(step if last else step.join(past, ["to_id", "at"], "left_anti"))
            past = past.unionByName(ring.select("to_id", "at"))
        # a ring further out meets only the outermost places of a tree, else its pair were done
        edge = tree if hop == 0 else tree.filter(F.col("dist") == half)
        found = cut_lineage(open_pairs.join(ring, "to_id").join(edge.drop("parent"), ["from_id", "at"]).groupBy("from_id", "to_id").agg(
            F.min(F.struct("way", "at", F.col("dist").alias("dist"))).alias("m")).select("from_id", "to_id", (F.col("m.dist") + hop).alias("hops"), "m.at", F.reverse("m.way").alias("way")))
        met.append(found)
        open_pairs = cut_lineage(open_pairs.join(found, ["from_id", "to_id"], "left_anti"))
        if open_pairs.isEmpty():
            break
    cur = met[0]
    for more in met[1:]:
        cur = cur.unionByName(more)
    back = tree.select("from_id", "at", "parent")
    for _ in range(half):
        cur = cur.join(back, ["from_id", "at"], "left").select(
            "from_id", "to_id", "hops", F.coalesce("parent", "at").alias("at"),
            F.when(F.col("parent").isNotNull(), F.concat(F.array("parent"), F.col("way"))).otherwise(F.col("way")).alias("way"))
    return cur.select("from_id", "to_id", "hops", F.array_join("way", "->").alias("path"))


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """id, component (the lowest id in it) for every end of ``edges`` (src, tgt).

    Alternates the large-star and small-star steps (Kiveris et al., 2014): the
    number of rounds grows with the logarithm of the component size.
    """
    e = edges.filter("src is not null and tgt is not null").select(
        F.greatest("src", "tgt").alias("u"), F.least("src", "tgt").alias("v"))
    alone = e.filter("u = v").select(F.col("u").alias("id")).distinct()
    e = cut_lineage(e.filter("u <> v").distinct())
    before = _digest(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(floor, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(floor.select("u", F.col("m").alias("v"))).distinct())
        e = cut_lineage(small)
        after = _digest(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labels = e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    loops = alone.join(labels, "id", "left_anti").select("id", F.col("id").alias("component"))
    return labels.unionByName(loops)


def _digest(e: DataFrame):
    """Row count and order-free checksum, two numbers."""
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
