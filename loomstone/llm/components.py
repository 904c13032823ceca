"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.scratch import HOT_KEYS, cut, discard, sweep


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (columns u, v, both long); root: the smallest node reachable.

    Self links are ignored, repeated and reversed links count once; no edges give no rows. Each round
    is written to the shared scratch space and the round before it deleted. So is each half of a round: in one plan, the small star would
    hold the large star's plan once for each time that it reads it, and the driver plans in memory. Group minima are partly aggregated before
    their shuffle. Hubs, nodes with more than one in HOT_KEYS of all links' ends, of which there are fewer than HOT_KEYS, meet
    their minimum by broadcast, so no task gets all links of a hub.
    """

    def with_minimum(links: DataFrame, low: DataFrame, hubs: list[int]) -> DataFrame:
        if not hubs:
            return links.join(low, "u")
        hub = F.col("u").isin(hubs)
        return links.where(hub).join(F.broadcast(low.where(hub)), "u").union(links.where(~hub).join(low.where(~hub), "u"))

    def small(e: DataFrame, hubs: list[int]) -> DataFrame:
        # e: u > v. The smallest neighbour m of u below it; links (v, m) and (u, m).
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = with_minimum(e, low, hubs).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.union(low.select("u", F.col("m").alias("v"))).distinct()

    def large(e: DataFrame, both: DataFrame, hubs: list[int]) -> DataFrame:
        # For every u: its larger neighbours link to the smallest of u and its neighbours.
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        moved = with_minimum(e.select(F.col("v").alias("u"), F.col("u").alias("v")), low, hubs)
        return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()

    def state(e: DataFrame) -> tuple[int, int, int]:
        """Nodes that are not yet an end of one link or a root, links' ends, and the most that a node has."""
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
        nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        open_ = F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))
        return tuple(x or 0 for x in nodes.agg(open_, F.sum(F.col("up") + F.col("down")), F.max(F.col("up") + F.col("down"))).first())

    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), label)
    while True:
        # The links form stars around the smallest nodes when every node is an end of one link or a root.
        left, ends, most = state(e)
        if not left:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hubs = []
        if most * HOT_KEYS > ends:
            hubs = [r.u for r in both.groupBy("u").count().where(F.col("count") * HOT_KEYS > ends).collect()]  # fewer than HOT_KEYS
        far = cut(large(e, both, hubs), label)
        discard(e)
        e = cut(small(far, hubs), label)
        discard(far)
        sweep(e.sparkSession)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
