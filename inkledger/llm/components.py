"""Connected components of a table of links, by alternating stars, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.llm.common import drop_stash, stash

#: A file of links holds about so many, so that few links do not make a file for each shuffle partition in every round.
LINKS_A_FILE = 20_000


def both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))


def large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours get linked to its smallest neighbour."""
    near = both_ways(links)
    least = near.groupBy(F.col("u").alias("of")).agg(F.min("v").alias("m")).select("of", F.least("of", "m").alias("m"))
    return near.filter("v > u").join(least, F.col("u") == F.col("of")).select(F.col("m").alias("a"), F.col("v").alias("b"))


def small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours get linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    least = down.groupBy(F.col("u").alias("of")).agg(F.min("v").alias("m"))
    moved = down.join(least, F.col("u") == F.col("of")).filter("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.unionAll(least.select(F.col("m").alias("a"), F.col("of").alias("b"))).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root: the smallest node reachable, for nodes (of any ordered type) that have links a, b."""
    now, mark = stash(links.select("a", "b").filter("a <> b").distinct(), "links"), None
    held = now.count()
    for _ in range(most_rounds):
        # all that a round reads is its links; a round makes at most two of one
        new = stash(small_star(large_star(now)).coalesce(1 + 2 * held // LINKS_A_FILE), "links")
        drop_stash(now)
        now = new
        # stars are stable when every link runs from a root that is nobody's leaf
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == mark:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        mark, held = seen, seen[0]
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
