"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Source s has weight w_s. Its share of demand changes over training time t in
[0, 1] as w_s * (1 + a_s * (2t - 1)); integrated, its cumulative demand is
target_s * (t + a_s * (t^2 - t)), which ends at its target. A source's
documents stand in hash order, pass after pass; the document whose words
begin at cumulative offset c is trained on at the time t where demand reaches
c, found by inverting that quadratic. `mix` orders by that time.

Targets share the total size by weight; none exceeds `most` times its source's
size, and what is cut off is shared again by weight (water filling).

Cumulative sums over a source are made in two levels: within buckets of the
hash order, then over bucket totals, so that one source with a third of all
rows still spreads over many tasks.

Cases: null text has size 0; null source is a source of its own, last; empty
documents take 0 words and get the position of their offset; a source without
words has target 0; equal hashes fall back to doc_id, and rows repeated in
full stand next to each other; rows of `mix` with equal doc_id and size are
placed alike, by the first of them; an empty table gives no rows; other
columns, of any name, pass through `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkledger.llm.common import WORD, stash, unused

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
#: Slope of a source's weight over time, by its place in code-point order.
SLOPES = (-0.6, 0.0, 0.6)
ROWS_A_BUCKET = 4096


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, n, weight, slope, target from one row per source (source, source_size, n)."""
    byname = W.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(byname) - 1
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("place") % len(xs) + 1).cast("int"))
    s = sizes.withColumn("place", place).withColumn("weight", pick(weights)).withColumn("slope", pick(SLOPES))
    s = s.withColumn("cap", F.col("source_size").cast("double") * most)
    # in order of cap/weight: the sources before the first whose cap is not reached stay at their caps
    filling = W.orderBy(F.col("cap") / F.col("weight"), "place")
    before, rest = filling.rowsBetween(W.unboundedPreceding, -1), filling.rowsBetween(W.currentRow, W.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(W.partitionBy()))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    s = s.withColumn("rank", F.row_number().over(filling))
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("rank", "level"))).over(W.partitionBy())
    s = s.withColumn("found", first["level"])
    share = F.coalesce(F.least(F.col("cap"), F.col("found") * F.col("weight")), F.col("cap"))
    return s.select("source", "source_size", "n", "weight", "slope", share.alias("target"))


def order_key(doc_id: Column) -> Column:
    """A number from 0 to 16^12 - 1 by hash of the doc_id."""
    return F.conv(F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 12), 16, 10).cast("long")


def time_of(offset: Column, target: Column, slope: Column) -> Column:
    """Invert target * (t + a * (t^2 - t)) = offset for t in [0, 1]."""
    share = F.when(target > 0, F.least(offset / target, F.lit(1.0))).otherwise(F.lit(1.0))
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share)
    return F.when(slope == 0, share).otherwise(2 * share / ((1 - slope) + root))


def positions(docs: DataFrame, text: str = "text", weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, position: one row per row of docs."""
    sized = stash(docs.select("doc_id", "source", words_in(F.col(text)).alias("size"), order_key(F.coalesce(F.col("doc_id"), F.lit(-1))).alias("key")), "sizes")
    by = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), weights, most)
    by = by.select(F.col("source").alias("of"), "source_size", "n", "slope", "target")
    rows = sized.join(by, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    parts = F.ceil(F.col("n") / ROWS_A_BUCKET)
    rows = rows.withColumn("bucket", F.floor(F.col("key") / F.lit(float(16**12)) * parts))
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    ahead = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("of"), F.col("bucket").alias("of_bucket"), F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("ahead"))
    rows = rows.join(totals, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("of_bucket")))
    inside = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # a pass takes a document if the middle of its words lies within the target
    taken_in = lambda p: F.col("source_size") * p + F.col("offset") + F.col("size") / 2 <= F.col("target")
    copies = sum((F.when(taken_in(p), 1).otherwise(0) for p in range(1, most)), F.when(taken_in(0), 1).otherwise(0))
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0))
    return rows.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies",
        time_of(F.col("offset"), F.col("target"), F.col("slope")).alias("position"),
        F.transform(F.sequence(F.lit(0), F.greatest(F.col("copies") - 1, F.lit(0))), lambda p: time_of(F.col("source_size") * p + F.col("offset"), F.col("target"), F.col("slope"))).alias("times"),
    )


def mix(docs: DataFrame, text: str = "text", weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """docs, each as often as it is taken, in the order of training."""
    of_id, of_size, at_time = (unused(c, docs) for c in ("mix_id", "mix_size", "mix_at"))
    at = positions(docs, text, weights, most).groupBy(F.col("doc_id").alias(of_id), F.col("size").alias(of_size)).agg(F.min(F.struct("position", "copies", "times")).alias("first"))
    at = at.filter("first.copies > 0").select(of_id, of_size, F.explode("first.times").alias(at_time))
    placed = docs.join(at, F.col("doc_id").eqNullSafe(F.col(of_id)) & (words_in(F.col(text)) == F.col(of_size)))
    return placed.orderBy(at_time, "doc_id").drop(of_id, of_size, at_time)
