"""Summaries of scored rows: per field with a total, breakdown tables, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkledger.operators import ranks

TOTAL = "ALL"


def share(flag: str) -> Column:
    return F.avg(F.col(flag).cast("int"))


def measures() -> list[Column]:
    filled = F.sum(F.col("covered").cast("int"))
    return [
        F.count(F.lit(1)).alias("n"),
        share("covered").alias("coverage"),
        share("field_correct").alias("accuracy"),
        F.try_divide(F.sum((F.col("covered") & F.col("field_correct")).cast("int")), filled).alias("accuracy_on_filled"),
        share("exact_raw").alias("exact_raw"),
        share("text_correct").alias("text_accuracy"),
        F.avg("cer").alias("mean_cer"),
        F.avg("wer").alias("mean_wer"),
    ]


def summarize(scored: DataFrame, by: list[str]) -> DataFrame:
    """Measures by columns; a null is a group."""
    return scored.groupBy(*by).agg(*measures())


def summary_by_field(scored: DataFrame) -> DataFrame:
    """Per method and field, and a total per method, in one pass."""
    keys = [F.col("method_label"), F.col("field_name")]
    both = scored.groupingSets([keys, keys[:1]], *keys).agg(*measures(), F.grouping("field_name").alias("g"))
    return both.withColumn("field_name", F.when(F.col("g") == 1, F.lit(TOTAL)).otherwise(F.col("field_name"))).drop("g")


def breakdown_sets(scored: DataFrame, dims: list[str]) -> DataFrame:
    """Every dimension pooled and per field, as dimension, value, field_name, in one pass of grouping sets."""
    m, f = F.col("method_label"), F.col("field_name")
    sets = [s for d in dims for s in ([m, F.col(d)], [m, F.col(d), f])]
    many = scored.groupingSets(sets, m, f, *map(F.col, dims)).agg(*measures(), F.grouping("field_name").alias("g"), *[F.grouping(d).alias(f"g_{d}") for d in dims])
    of = F.coalesce(*[F.when(F.col(f"g_{d}") == 0, F.lit(d)) for d in dims])
    value = F.coalesce(*[F.when(F.col(f"g_{d}") == 0, F.coalesce(F.col(d).cast("string"), F.lit("null"))) for d in dims])
    named = many.withColumn("dimension", of).withColumn("value", value).withColumn("field_name", F.when(F.col("g") == 1, F.lit(TOTAL)).otherwise(F.col("field_name")))
    return named.drop("g", *dims, *[f"g_{d}" for d in dims])


def pivot_fields(summary: DataFrame, fields: list[str], cell: Column) -> DataFrame:
    """Methods by fields, total last."""
    return summary.withColumn("cell", cell).groupBy("method_label").pivot("field_name", [*fields, TOTAL]).agg(F.first("cell"))


def accuracy_cell() -> Column:
    return F.format_string("%.1f / %.3f", 100 * F.col("accuracy"), F.col("mean_cer"))


def markdown(table: DataFrame, columns: list[str]) -> DataFrame:
    """Lines of a report table, with their order."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]), F.lit(" |"))
    return table.select(F.row_number().over(W.orderBy(*columns)).alias("line"), line.alias("text"))


def percentiles(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, mean, median, p90, p95 by linear interpolation; exact, and no task holds a group's values."""
    plain = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    cut = ranks.percentiles(rows, by, F.col(value), {"median": 0.5, "p90": 0.9, "p95": 0.95}).withColumnsRenamed({b: f"of_{b}" for b in by})
    on = [F.col(b).eqNullSafe(F.col(f"of_{b}")) for b in by]
    return plain.join(cut, on if on else F.lit(True), "left").drop(*[f"of_{b}" for b in by])


def macro_mean(summary: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean of per-field means."""
    return summary.groupBy(*by).agg(F.avg(value).alias(f"macro_{value}"))


def natural_order(label: Column) -> list[Column]:
    """Labels by a leading number, then as text."""
    number = F.regexp_extract(label, r"\A(\d+)", 1).try_cast("bigint")
    return [number.asc_nulls_last(), label.asc()]


def status_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "too_small").alias("too_small"))
