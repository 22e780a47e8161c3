"""Predicted field boxes against true ones, and layout priors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.functions import geometry as g

HIT, COVER = 0.5, 0.95
BOX_STATUSES = ("ok", "too_small")


def layout_priors(boxes: DataFrame, by: str) -> DataFrame:
    """Per group and field of normalized boxes x0..y1: median box, search envelope, median height, presence among the group's checks.

    boxes: by, field_name, check_id, x0, y0, x1, y1.
    """
    checks = boxes.groupBy(F.col(by).alias("of")).agg(F.countDistinct("check_id").alias("checks"))
    p = lambda c, q: F.percentile(c, F.lit(q))
    found = boxes.filter("x0 is not null").groupBy(by, "field_name").agg(
        *[p(c, 0.5).alias(f"median_{c}") for c in ("x0", "y0", "x1", "y1")],
        p("x0", 0.005).alias("search_x0"), p("y0", 0.005).alias("search_y0"), p("x1", 0.995).alias("search_x1"), p("y1", 0.995).alias("search_y1"),
        p(F.col("y1") - F.col("y0"), 0.5).alias("median_height"), F.count(F.lit(1)).alias("boxes"),
    )
    return found.join(checks, F.col(by).eqNullSafe(F.col("of"))).drop("of").withColumn("presence", F.col("boxes") / F.col("checks"))


def score_boxes(checks: DataFrame, fields: list[str], truth: DataFrame, pred: DataFrame) -> DataFrame:
    """Every check by every field: kind scored, absent or excluded; IoU, hit, covered, area ratio.

    checks: check_id; truth: check_id, field_name, status, box; pred: check_id, field_name, pred_box.
    """
    grid = checks.select("check_id", F.explode(F.array(*map(F.lit, fields))).alias("field_name"))
    rows = grid.join(truth, ["check_id", "field_name"], "left").join(pred, ["check_id", "field_name"], "left")
    has = F.col("pred_box").isNotNull()
    kind = F.when(F.col("status").isNull(), "absent").when(F.col("status").isin(*BOX_STATUSES) & F.col("box").isNotNull(), "scored").otherwise("excluded")
    rows = rows.withColumn("kind", kind).withColumn("has_box", has)
    scored, b, p = F.col("kind") == "scored", F.col("box"), F.col("pred_box")
    iou = F.when(scored, F.when(has, g.box_iou(p, b)).otherwise(0.0))
    rows = rows.withColumn("iou", iou).withColumn("hit", F.col("iou") >= HIT)
    rows = rows.withColumn("covered", F.when(scored, F.when(has, g.box_cover(p, b) >= COVER).otherwise(False)))
    return rows.withColumn("area_ratio", F.when(scored & has, F.try_divide(g.box_area(p), g.box_area(b))))


def summarize(scored: DataFrame, by: list[str]) -> DataFrame:
    """Rates over scored rows, and the false-box rate over absent ones."""
    is_scored, absent = F.col("kind") == "scored", F.col("kind") == "absent"
    flag = lambda c: F.avg(F.when(is_scored, F.col(c).cast("int")))
    return scored.groupBy(*by).agg(
        F.count_if(is_scored).alias("scored_count"), F.avg("iou").alias("mean_iou"), flag("hit").alias("hit_rate"), flag("covered").alias("coverage_rate"),
        F.percentile("area_ratio", F.lit(0.5)).alias("median_area_ratio"), F.avg("area_ratio").alias("mean_area_ratio"), F.avg(F.when(is_scored, (~F.col("has_box")).cast("int"))).alias("no_box_rate"),
        F.count_if(absent).alias("absent_count"), F.avg(F.when(absent, F.col("has_box").cast("int"))).alias("false_box_rate"),
    )


def weighted_false_boxes(summary: DataFrame, by: list[str]) -> DataFrame:
    return summary.groupBy(*by).agg(F.try_divide(F.sum(F.col("absent_count") * F.col("false_box_rate")), F.sum("absent_count")).alias("false_box_rate"))
