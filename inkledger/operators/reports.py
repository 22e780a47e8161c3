"""Composed reports: all blocks of measures in one pass, gating blocks, comparisons and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkledger.operators import breakdowns, gating
from inkledger.operators.scoring import OK, TOO_SMALL

# Hard slices, the dimensions of breakdown tables, targets of comparisons, and corner errors in pixels that are counted below.
SLICES = ("handwritten", "handwritten_degraded", "printed_degraded")
EASY = "easy_printed"
DIMENSIONS = ("handwritten", "pen_font_id", "text_height_bin", "layout_family")
TARGETS = (0.95, 0.98, 0.99)
CORNER_CUTOFFS = (4, 8, 16)


def memberships(headline: Column, dimensions: tuple[str, ...]) -> Column:
    """The blocks a scored row is in, as structs (block, value)."""
    ok, hand = F.col("status") == OK, F.col("handwritten")
    slices = {s: ok & F.col(s) for s in SLICES} | {EASY: ok & ~hand & ~F.col("printed_degraded")}
    in_block = [(headline, "headline", F.lit("")), (ok & F.col("in_hard_set"), "hard_set", F.lit("")), (F.col("status") == TOO_SMALL, "too_small", F.lit("")), (F.lit(True), "status", F.col("status"))]
    in_block += [(c, "hard_slice", F.lit(s)) for s, c in slices.items()]
    in_block += [(headline, f"by_{d}", F.coalesce(F.col(d).cast("string"), F.lit("null"))) for d in dimensions]
    return F.array_compact(F.array(*[F.when(c, F.struct(F.lit(b).alias("block"), v.alias("value"))) for c, b, v in in_block]))


def blocks(scored: DataFrame, headline: Column, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Measures of every report block: method_label, block, value, field_name (with a total). One shuffle for all blocks.

    scored: scored rows with status, handwritten, hard-set flags and the dimensions; headline: which rows count.
    """
    each = scored.withColumn("_in", F.explode(memberships(headline, dimensions))).withColumn("block", F.col("_in.block")).withColumn("value", F.col("_in.value"))
    keys = [F.col(c) for c in ("method_label", "block", "value", "field_name")]
    both = each.groupingSets([keys, keys[:3]], *keys).agg(*breakdowns.measures(), F.grouping("field_name").alias("_total"))
    return both.withColumn("field_name", F.when(F.col("_total") == 1, F.lit(breakdowns.TOTAL)).otherwise(F.col("field_name"))).drop("_total")


def gating_blocks(scored: DataFrame, headline: Column) -> DataFrame:
    """Gating summaries of headline rows and of handwritten ok rows, told apart by block."""
    named = F.array_compact(F.array(F.when(headline, F.lit("gating")), F.when((F.col("status") == OK) & F.col("handwritten"), F.lit("gating_handwritten"))))
    return gating.summary(scored.withColumn("block", F.explode(named)), ("block", *gating.BY))


def confidence_kinds(scored: DataFrame, kinds: dict[str, Column], by: tuple[str, ...], targets: tuple[float, ...] = TARGETS) -> DataFrame:
    """Greatest coverage at each accuracy target per kind of confidence: by, kind, target, coverage (0 where never reached)."""
    each = scored.withColumn("_kind", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("confidence")) for k, c in kinds.items()])))
    rows = each.withColumn("kind", F.col("_kind.kind")).withColumn("confidence", F.col("_kind.confidence")).drop("_kind")
    points = gating.points(rows, (*by, "kind"))
    reach = [F.struct(F.lit(t).alias("target"), F.coalesce(F.max(F.when(F.col("accuracy") >= t - gating.SLACK, F.col("coverage"))), F.lit(0.0)).alias("coverage")) for t in targets]
    return points.groupBy(*by, "kind").agg(F.array(*reach).alias("_r")).select(*by, "kind", F.explode("_r").alias("_r")).select(*by, "kind", "_r.*")


def frozen_pivot(frozen: DataFrame, fields: list[str]) -> DataFrame:
    """Methods by fields; a cell holds test coverage and accuracy in percent, a dash where there is none."""
    accuracy = F.coalesce(F.format_string("%.1f", 100 * F.col("test_accuracy")), F.lit("-"))
    cell = F.concat(F.format_string("%.1f", 100 * F.col("test_coverage")), F.lit(" / "), F.when(F.col("test_accuracy").isNull(), "-").otherwise(accuracy))
    wide = frozen.withColumn("cell", cell).groupBy("method_label").pivot("field_name", fields).agg(F.first("cell"))
    return wide.select("method_label", *[F.coalesce(F.col(f), F.lit("-")).alias(f) for f in fields])


def corner_statistics(records: DataFrame, by: list[str]) -> DataFrame:
    """Counts and shares of matched checks: corner errors below each cutoff, partial or missing corners, orientation and axis.

    records: corner_error (null without usable corners), corners_used, orientation_correct (null if unknown), axis_correct, clockwise.
    """
    usable = F.col("corner_error").isNotNull()
    share = lambda c, of: F.try_divide(F.count_if(of & c), F.count_if(of))
    known = usable & F.col("orientation_correct").isNotNull()
    return records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("matched_checks"), F.avg("corner_error").alias("corner_error_mean"), *[share(F.col("corner_error") < c, usable).alias(f"below_{c}px") for c in CORNER_CUTOFFS],
        F.count_if(usable & (F.col("corners_used") < 4)).alias("partial_corners"), F.count_if(~usable).alias("without_corners"), F.count_if(known).alias("orientation_known"),
        share(F.col("orientation_correct"), known).alias("orientation_accuracy"), share(F.col("axis_correct"), usable).alias("axis_accuracy"), F.count_if(~F.col("clockwise")).alias("counter_clockwise"),
    )


def snap_shares(snapped: DataFrame, by: list[str]) -> DataFrame:
    """Filled, identified and precision in percent over all, handwritten and printed rows: by, rows, n.

    snapped: name (null where nothing snapped), canonical, handwritten.
    """
    filled = F.coalesce(F.col("name") != "", F.lit(False))
    right = F.coalesce(F.col("name") == F.col("canonical"), F.lit(False))
    groups = F.array(F.lit("all"), F.when(F.coalesce("handwritten", F.lit(False)), F.lit("handwritten")).otherwise(F.lit("printed")))
    percent = lambda hits, of: F.round(F.try_divide(100.0 * hits, of), 1)
    n, f = F.count(F.lit(1)), F.count_if("_filled")
    rows = snapped.withColumns({"_filled": filled, "_right": right}).withColumn("rows", F.explode(groups))
    return rows.groupBy(*by, "rows").agg(n.alias("n"), percent(f, n).alias("filled"), percent(F.count_if("_right"), n).alias("identified"), percent(F.count_if(F.col("_filled") & F.col("_right")), f).alias("precision"))
