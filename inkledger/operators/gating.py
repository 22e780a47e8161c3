"""Coverage against accuracy over a confidence threshold.

A distinct confidence is a threshold: it fills all covered rows at or above
it. Null confidence ranks below all. Rows are first counted per confidence, and
running sums are made in two levels, by buckets of the confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkledger.operators.ranks import BUCKETS, running, unit_bucket

SLACK = 1e-12
COVERAGES = (0.80, 0.90, 0.95, 1.00)
ACCURACIES = (0.95, 0.98, 0.99)
BY = ("method_label", "field_name")


def with_null_for_nan(rows: DataFrame) -> DataFrame:
    return rows.withColumn("confidence", F.nanvl("confidence", F.lit(None).cast("double")))


def downward(value: Column) -> Column:
    """The bucket of a confidence when the greatest come first and null last."""
    return F.coalesce(BUCKETS - 1 - unit_bucket(value), F.lit(BUCKETS))


def points(scored: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """by, threshold, filled, right, n, coverage, accuracy: one row per distinct threshold; null is the block without confidence."""
    counted = with_null_for_nan(scored).groupBy(*by, "confidence").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("covered").alias("c"), F.count_if(F.col("covered") & F.col("field_correct")).alias("k")
    )
    sums = {"seen": F.col("rows"), "filled": F.col("c"), "right": F.col("k")}
    run = running(counted, list(by), downward(F.col("confidence")), [F.col("confidence").desc_nulls_last()], sums).withColumnRenamed("all_seen", "n")
    return run.filter("c > 0").select(*by, F.col("confidence").alias("threshold"), "filled", "right", "n", (F.col("filled") / F.col("n")).alias("coverage"), (F.col("right") / F.col("filled")).alias("accuracy"))


def ranked(threshold: Column) -> Column:
    return F.coalesce(threshold, F.lit(float("-inf")))


def summary(scored: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Fill-all point, accuracy at coverages, greatest coverage at accuracies (0 and null if never reached)."""
    fill = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("covered").cast("int")).alias("fill_coverage"),
        F.try_divide(F.count_if(F.col("covered") & F.col("field_correct")), F.count_if("covered")).alias("fill_accuracy"),
        F.coalesce(F.bool_or(F.col("covered") & F.col("confidence").isNotNull() & ~F.isnan("confidence")), F.lit(False)).alias("has_confidence"),
    )
    name = lambda x: f"{round(100 * x)}"
    at = [F.max_by(F.when(F.col("coverage") >= c - SLACK, F.col("accuracy")), F.when(F.col("coverage") >= c - SLACK, ranked(F.col("threshold")))).alias(f"accuracy_at_{name(c)}") for c in COVERAGES]
    best = lambda a, value: F.max_by(F.when(F.col("accuracy") >= a - SLACK, value), F.when(F.col("accuracy") >= a - SLACK, F.col("coverage")))
    reach = [c for a in ACCURACIES for c in (F.coalesce(best(a, F.col("coverage")), F.lit(0.0)).alias(f"coverage_at_{name(a)}"), best(a, F.col("threshold")).alias(f"threshold_at_{name(a)}"))]
    curve = points(scored, by).groupBy(*[F.col(b).alias(f"of_{b}") for b in by]).agg(*at, *reach)
    on = [F.col(b).eqNullSafe(F.col(f"of_{b}")) for b in by]
    both = fill.join(curve, on, "left").drop(*[f"of_{b}" for b in by])
    # a method without confidence has one point only
    partial = [c for c in both.columns if "_at_" in c and c != "accuracy_at_100"]
    return both.select(*by, "n", "fill_coverage", "fill_accuracy", "has_confidence", "accuracy_at_100", *[F.when(F.col("has_confidence"), F.col(c)).alias(c) for c in partial])


def curve(scored: DataFrame, by: tuple[str, ...] = BY, most: int = 21) -> DataFrame:
    """At most `most` points of each curve, evenly by rank."""
    ranks = running(points(scored, by), list(by), downward(F.col("threshold")), [F.col("threshold").desc_nulls_last()], {"i": F.lit(1)})
    ranks = ranks.withColumn("i", F.col("i") - 1).withColumn("last", F.col("all_i") - 1).drop("all_i")
    wanted = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.bround(k * F.col("last") / (most - 1)).cast("bigint"))
    return ranks.filter(F.array_contains(wanted, F.col("i").cast("bigint"))).drop("i", "last")


def frozen(val: DataFrame, test: DataFrame, target: float, by: tuple[str, ...] = BY) -> DataFrame:
    """The threshold of most coverage that keeps `target` accuracy on val, and what it gives on test. Rows without confidence are never filled on test."""
    chosen = points(val, by).filter(F.col("accuracy") >= target - SLACK).groupBy(*by).agg(F.max_by(F.struct(ranked(F.col("threshold")).alias("t")), F.col("coverage")).alias("best"))
    groups = val.select(*by).distinct().join(chosen, list(by), "left").select(*by, F.col("best.t").alias("threshold"))
    joined = groups.join(test.select(*by, "covered", "field_correct", "confidence"), list(by), "left")
    filled = F.coalesce(F.col("covered") & (F.col("confidence") >= F.col("threshold")), F.lit(False))
    return joined.groupBy(*by).agg(
        F.nullif(F.first("threshold"), F.lit(float("-inf"))).alias("threshold"), F.count("covered").alias("n_test"),
        F.coalesce(F.try_divide(F.count_if(filled), F.count("covered")), F.lit(0.0)).alias("test_coverage"),
        F.try_divide(F.count_if(filled & F.col("field_correct")), F.count_if(filled)).alias("test_accuracy"),
    )


def agreement_rule(scored: DataFrame, floor: float = 0.9) -> DataFrame:
    """Coverage and accuracy when only rows at the floor or above are filled."""
    filled = F.coalesce(F.col("confidence") >= floor, F.lit(False))
    return scored.groupBy("method_label").agg(F.count(F.lit(1)).alias("n"), F.avg(filled.cast("int")).alias("coverage"), F.try_divide(F.count_if(filled & F.col("field_correct")), F.count_if(filled)).alias("accuracy"))


def most_coverage(scored: DataFrame, target: float, by: tuple[str, ...] = BY) -> DataFrame:
    """Greatest coverage at an accuracy, without slack; 0 if never reached."""
    reached = F.max(F.when(F.col("accuracy") >= target, F.col("coverage")))
    return points(scored, by).groupBy(*by).agg(F.coalesce(reached, F.lit(0.0)).alias("coverage"))


def top_half_accuracy(scored: DataFrame, by: tuple[str, ...], order: list[Column]) -> DataFrame:
    """Accuracy of the more confident half, at least one row."""
    rows = running(scored, list(by), downward(F.col("confidence")), [F.col("confidence").desc_nulls_last(), *order], {"i": F.lit(1)}).withColumnRenamed("all_i", "n")
    return rows.filter(F.col("i") <= F.greatest(F.lit(1), F.floor(F.col("n") / 2))).groupBy(*by).agg(F.avg(F.col("field_correct").cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def confidence_percentile(rows: DataFrame, reference: DataFrame, by: list[str]) -> DataFrame:
    """Share of the reference's confidences at or below each row's, by one running count over both."""
    both = rows.withColumn("ref", F.lit(0)).unionByName(reference.select(*by, "confidence").withColumn("ref", F.lit(1)), allowMissingColumns=True)
    counted = both.groupBy(*by, "confidence").agg(F.sum("ref").alias("r"))
    run = running(counted, by, F.coalesce(unit_bucket(F.col("confidence")), F.lit(-1)), ["confidence"], {"below": F.col("r")})
    return rows.join(run.select(*by, "confidence", F.try_divide("below", "all_below").alias("percentile")), [*by, "confidence"])
