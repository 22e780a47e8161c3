"""Choosing among methods, configurations and backgrounds from scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Sources whose photos are lit, soft surfaces by category, and soft words in the ids of generated photos.
LIT_SOURCES = ("openverse", "commons")
SOFT_CATEGORIES = ("bedding", "fabric", "rug_carpet", "leather")
SOFT_WORDS = ("bedsheet", "duvet", "comforter", "blanket", "throw", "couch", "cushion", "carpet", "rug", "tablecloth", "linen")


def grid(options: dict[str, list]) -> list[dict]:
    """Every combination of option values, the first option slowest."""
    rows: list[dict] = [{}]
    for name, values in options.items():
        rows = [r | {name: v} for r in rows for v in values]
    return rows


def best_config(scored: DataFrame, by: list[str], config: str) -> DataFrame:
    """Per group the configuration of greatest accuracy, then least error, then first by name."""
    means = scored.groupBy(*by, config).agg(F.avg(F.col("field_correct").cast("int")).alias("accuracy"), F.avg("cer").alias("cer"), F.count(F.lit(1)).alias("n"))
    order = F.struct((-F.col("accuracy")).alias("a"), F.col("cer").alias("c"), F.col(config).alias("k"))
    return means.groupBy(*by).agg(F.min_by(F.struct(config, "accuracy", "cer", "n"), order).alias("b")).select(*by, "b.*")


def method_table(scored: DataFrame, columns: list[str], by: str = "field_name") -> DataFrame:
    """Accuracy in percent, methods by columns."""
    return scored.groupBy("method_label").pivot(by, columns).agg(F.round(100 * F.avg(F.col("field_correct").cast("int")), 3))


def router_table(wide: DataFrame, choices: dict[str, Column], by: list[str]) -> DataFrame:
    """How often each choice of a read is right: choices are boolean columns of `wide`, true where what the choice picks is right."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("choice"), c.alias("right")) for n, c in choices.items()]))
    return wide.select(*by, each.alias("x")).groupBy(*by, "x.choice").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("x.right").cast("int")).alias("accuracy"))


def tuning_objective(rates: DataFrame, by: list[str]) -> DataFrame:
    """Mean of F1 at 0.5 and at 0.9, for choosing parameters."""
    at = lambda t: F.max(F.when(F.col("threshold") == t, F.col("f1")))
    return rates.groupBy(*by).agg(((at(0.5) + at(0.9)) / 2).alias("objective"))


def strictly_better(objective: float, best: float | None) -> bool:
    return best is None or objective > best


def coordinate_descent(start: dict, options: dict[str, list], measure) -> tuple[dict, float]:
    """One option at a time, adopting a value only if strictly better. `measure` runs a query and returns a number."""
    best, score = dict(start), measure(start)
    for name, values in options.items():
        for v in values:
            if v != best[name] and strictly_better(found := measure(best | {name: v}), score):
                best, score = best | {name: v}, found
    return best, score


def background_traits(backgrounds: DataFrame, web: DataFrame) -> DataFrame:
    """lit and soft of background ids; those from the web take them from their source rows (file, source, category)."""
    rows = backgrounds.join(web.select(F.concat(F.lit("web/"), "file").alias("background_id"), "source", "category"), "background_id", "left")
    folder = F.split_part("background_id", F.lit("/"), F.lit(1))
    known = F.col("source").isNotNull()
    words = F.lit(False)
    for w in SOFT_WORDS:
        words = words | F.contains("background_id", F.lit(w))
    lit = F.when((folder == "web") & known, F.col("source").isin(*LIT_SOURCES)).otherwise(folder.isin("flux", "photos"))
    soft = F.when((folder == "web") & known, F.col("category").isin(*SOFT_CATEGORIES)).when(folder == "flux", words).otherwise(True)
    return rows.select("background_id", lit.alias("is_lit"), soft.alias("is_soft"))


def image_rejection(short_side: Column, aspect: Column, grey_std: Column, vivid: Column, least_side: int, most_aspect: float, least_std: float, most_vivid: float) -> Column:
    """The first reason to reject an image by its measures, null if there is none."""
    return F.when(short_side < least_side, "too small").when(aspect > most_aspect, "too long").when(grey_std < least_std, "too flat").when(vivid > most_vivid, "too vivid")


def one_per(rows: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The first row of each group, then the first n of those."""
    first = rows.withColumn("_k", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter("_k = 1").drop("_k")
    return first.orderBy(*order).limit(n)
