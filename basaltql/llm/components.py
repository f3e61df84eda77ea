"""Connected components of a link table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltql.llm.common import Scratch, spread_join

#: More rounds than any chain of billions of nodes needs; reaching it is an error, never a silent cut.
MAX_ROUNDS = 60


def connected_components(spark: SparkSession, links: DataFrame, scratch: Scratch) -> DataFrame:
    """links (a long, b long) to (id, component): for every id in a link to another id the smallest id it reaches.

    Every step is a partial-aggregated minimum and a join on its result: a centre with very many links is summed
    before the shuffle, and its links stay where they are (see spread_join).
    """
    edges = scratch.keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(MAX_ROUNDS):
        # Large star: each node sends its larger neighbours to the least node of its neighbourhood.
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = scratch.keep(spread_join(both, least, "u", both.count()).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        # Small star: each node sends its smaller neighbours and itself to the least of them.
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        after = spread_join(large, small, "a", large.count()).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        after = scratch.keep(after)
        # A star forest maps to itself: every node has one smaller neighbour, which has none.
        ends = after.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(after.select("b", F.lit(0), F.lit(1)))
        unsettled = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1")
        settled = unsettled.count() == 0
        scratch.drop(edges, large)
        edges = after
        if settled:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(edges.select("b", "b").distinct())
