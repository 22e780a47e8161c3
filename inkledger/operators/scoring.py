"""Truth rows against predictions: one scored row per truth row and method."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkledger.functions import text as t
from inkledger.operators.ranks import percentiles

#: Statuses of rows that count for accuracy, and of those that have a box.
OK, TOO_SMALL = "ok", "too_small"
HEIGHT_EDGES = (14, 18, 24, 32)


def with_method(predictions: DataFrame) -> DataFrame:
    """method_label of a method and, where there is one, its localization; null text is blank."""
    label = F.when(F.col("localization").isNull(), F.col("method")).otherwise(F.concat("method", F.lit("__loc="), F.col("localization")))
    return predictions.withColumn("method_label", label).withColumn("pred_text", F.coalesce("pred_text", F.lit("")))


def repeated_keys(predictions: DataFrame) -> DataFrame:
    """Keys that stand more than once; a valid prediction table has none."""
    return predictions.groupBy("method_label", "row_key").count().filter("count > 1")


def unmatched_predictions(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    return predictions.join(truth.select("row_key"), "row_key", "left_anti").groupBy("method_label").agg(F.count(F.lit(1)).alias("n"))


def only_predicted(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    return truth.join(predictions.select("row_key"), "row_key", "left_semi")


def with_canonical(rows: DataFrame, canonical: DataFrame) -> DataFrame:
    """Field rows with the canonical values of their check; a check that stands twice in canonical is an error."""
    return rows.join(one_row_each(canonical, ["scene_id", "check_index"]), ["scene_id", "check_index"], "left")


def one_row_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows as they are; reading a key that stands more than once fails the query."""
    others = [c for c in rows.columns if c not in keys]
    held = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*others)).alias("_r"))
    told = F.raise_error(F.concat(F.lit("repeated key: "), F.to_json(F.struct(*keys))))
    return held.withColumn("_r", F.when(F.col("_n") == 1, F.col("_r")).otherwise(told)).select(*keys, "_r.*")


def with_hard_sets(truth: DataFrame, flags: DataFrame, names: tuple[str, ...] = ("small_text", "low_contrast", "degraded", "handwritten_degraded", "printed_degraded", "in_hard_set")) -> DataFrame:
    """Truth rows with their hard-set flags by row_key, false where a row has none; a key may stand once in flags."""
    known = one_row_each(flags.select("row_key", *names), ["row_key"])
    return truth.join(known, "row_key", "left").withColumns({n: F.coalesce(n, F.lit(False)) for n in names})


def check_rows(rows: DataFrame) -> DataFrame:
    """One row per check: its first field row by key."""
    others = [c for c in rows.columns if c not in ("scene_id", "check_index")]
    return rows.groupBy("scene_id", "check_index").agg(F.min_by(F.struct(*others), F.col("row_key")).alias("r")).select("scene_id", "check_index", "r.*")


def score_rows(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """A row for every truth row and every method, blank where the method has none.

    truth: row_key, field_name, text, canonical_* and any other columns.
    predictions: method_label, row_key, pred_text, confidence. Those without a method are left out; a method that has a row twice is an error.
    A row's reads meet it once, as a map by method, so truth is shuffled once and not once a method.
    """
    named = predictions.filter("method_label is not null")
    reads = named.groupBy("row_key").agg(F.map_from_entries(F.collect_list(F.struct("method_label", F.struct("pred_text", "confidence").alias("r")))).alias("_reads"))
    methods = named.agg(F.sort_array(F.collect_set("method_label")).alias("_methods"))  # one row
    each = truth.join(reads, "row_key", "left").crossJoin(methods).withColumn("method_label", F.explode("_methods")).withColumn("_read", F.try_element_at("_reads", "method_label"))
    joined = each.withColumn("pred_text", F.coalesce("_read.pred_text", F.lit(""))).withColumn("confidence", F.col("_read.confidence")).drop("_reads", "_methods", "_read")
    field = F.col("field_name")
    canonical = t.canonical_value(field, F.col("canonical_amount_cents"), F.col("canonical_date_iso"), F.col("canonical_check_number"))
    valued = joined.select("*", t.field_value(field, F.col("pred_text")).alias("pred_value"), F.coalesce(t.field_value(field, F.col("text")), canonical).alias("gt_value"), t.normalize_free_text(F.col("pred_text")).alias("pred_plain"), t.normalize_free_text(F.col("text")).alias("gt_plain"))
    return valued.select(
        *[c for c in joined.columns], "pred_value", "gt_value",
        (F.col("pred_text") != "").alias("covered"),
        F.coalesce(F.col("pred_value") == F.col("gt_value"), F.lit(False)).alias("field_correct"),
        (F.col("pred_text") == F.col("text")).alias("exact_raw"),
        (F.col("pred_plain") == F.col("gt_plain")).alias("text_correct"),
        t.character_error_rate(F.col("pred_plain"), F.col("gt_plain")).alias("cer"),
        t.word_error_rate(F.col("pred_plain"), F.col("gt_plain")).alias("wer"),
    )


def field_status(micr: Column, has_box: Column, in_frame: Column, visible: Column, height: Column) -> Column:
    """Why a field row does or does not count; the first reason holds."""
    return (
        F.when(micr, "micr_blurred_in_app").when(~has_box, "not_in_frame").when(in_frame < 0.999, "partially_out_of_frame")
        .when(visible < 0.99, "occluded").when(height < 14, TOO_SMALL).otherwise(OK)
    )


def height_bin(height: Column) -> Column:
    """Left-closed bins of text height."""
    a, b, c, d = HEIGHT_EDGES
    return F.when(height < a, f"<{a}").when(height < b, f"{a}-{b}").when(height < c, f"{b}-{c}").when(height < d, f"{c}-{d}").otherwise(f">={d}")


def hard_set_flags(rows: DataFrame) -> DataFrame:
    """Small text, low contrast (below the field's first quartile among ok rows), and the slices made of them.

    rows: field_name, status, contrast, text_height, handwritten, money_order. The quartile is ranked in two levels and joined back, so a field's rows never meet in one task.
    """
    ok = F.col("status") == OK
    first = percentiles(rows, ["field_name"], F.when(ok, F.col("contrast")), {"q1": 0.25}).withColumnRenamed("field_name", "of")
    known = rows.join(first, F.col("field_name").eqNullSafe(F.col("of")), "left").drop("of")
    small = F.col("text_height").between(14, 18) & (F.col("text_height") < 18)
    low = F.coalesce(ok & (F.col("contrast") < F.col("q1")), F.lit(False))
    flagged = known.withColumn("small_text", small).withColumn("low_contrast", low).withColumn("degraded", F.col("small_text") | F.col("low_contrast"))
    flagged = flagged.withColumn("handwritten_degraded", ok & F.col("handwritten") & F.col("degraded"))
    flagged = flagged.withColumn("printed_degraded", ok & ~F.col("handwritten") & (F.col("degraded") | F.col("money_order")))
    return flagged.withColumn("in_hard_set", F.col("handwritten_degraded") | F.col("printed_degraded")).drop("q1")


def with_subsets(rows: DataFrame) -> DataFrame:
    """A row for each headline subset it belongs to, in column subset."""
    ok = F.col("status") == OK
    named = {"all": ok, "hard": ok & F.col("in_hard_set"), "handwritten": ok & F.col("handwritten"), "handwritten_degraded": F.col("handwritten_degraded"), "printed_degraded": F.col("printed_degraded"), "too_small": F.col("status") == TOO_SMALL}
    return rows.withColumn("subset", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named.items()]))))
