"""Connected components of a link table, for graphs of any size and degree.

Every node holds the smallest id it has heard of. A round sends labels over links
and folds them with a minimum that combines before the shuffle; then labels are
replaced by the labels of their nodes (pointer jumping), which shortens long chains.
Tables are checkpointed each round, so a lost executor costs one round at most.
The side that is unique on the key is sent to the tasks while it is small, else it
is a checkpointed table of its own, so that a join on a hub can be split. Small tables
are kept in few partitions, as a round has several stages.
"""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import cut_lineage
from kgloom.session import BROADCAST_ROWS


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node in a link, component being the smallest node reachable. Null ends are ignored."""
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a <> b")
    both = cut_lineage(pairs.union(pairs.select("b", "a")).distinct())
    # there are no more nodes than ends of links, in any round
    small = both.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    def kept(df: DataFrame) -> DataFrame:
        return cut_lineage(df.coalesce(df.sparkSession.sparkContext.defaultParallelism) if small else df)

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df
    both = both.coalesce(both.sparkSession.sparkContext.defaultParallelism) if small else both
    # the smallest neighbour, or the node itself
    labels = kept(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("component")))
    while True:
        known = sent(labels.select(F.col("node").alias("a"), "component"))
        heard = both.join(known, "a").groupBy(F.col("b").alias("node")).agg(F.min("component").alias("heard"))
        spread = kept(sent(labels).join(heard, "node").select("node", F.least("component", "heard").alias("component"), (F.col("heard") < F.col("component")).alias("moved")))
        jump = sent(spread.select(F.col("node").alias("at"), F.col("component").alias("next")))
        jumped = kept(spread.join(jump, spread["component"] == jump["at"]).select(
            "node", F.least("component", "next").alias("component"), "moved"))
        moved = jumped.filter("moved").limit(1).count()
        labels = jumped.select("node", "component")
        if not moved:
            return labels
