"""Detected quadrilaterals against labelled ones: matching, suppression, rates and breakdowns.

A scene's few boxes sit in arrays, so everything inside a scene is one native
expression without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkledger.functions import geometry as g
from inkledger.functions.text import let
from inkledger.operators import ranks

DIAGNOSTIC, REPORTED = 0.1, (0.5, 0.75, 0.9)
SUPPRESS = 0.5
# Keyword of a background id and its surface; the first keyword that the id holds counts.
SURFACES = (
    ("rug", "carpet_rug"), ("carpet", "carpet_rug"), ("towel", "carpet_rug"), ("bedsheet", "bedding"), ("bed", "bedding"), ("duvet", "bedding"), ("comforter", "bedding"),
    ("blanket", "fabric_pattern"), ("crochet", "fabric_pattern"), ("tartan", "fabric_pattern"), ("gingham", "fabric_pattern"), ("jacquard", "fabric_pattern"), ("checkered", "fabric_pattern"), ("diamond", "fabric_pattern"),
    ("fabric", "fabric_plain"), ("cloth", "fabric_plain"), ("chino", "fabric_plain"), ("boucle", "fabric_plain"), ("cardboard", "cardboard"),
    ("marble", "stone_tile"), ("granite", "stone_tile"), ("terrazzo", "stone_tile"), ("slate", "stone_tile"), ("tile", "stone_tile"), ("stone", "stone_tile"), ("speckled", "stone_tile"), ("brick", "stone_tile"), ("linoleum", "stone_tile"),
    ("wood", "wood"), ("veneer", "wood"), ("plank", "wood"), ("laminate", "wood"), ("chipboard", "wood"), ("strand", "wood"), ("pine", "wood"), ("oak", "wood"), ("cork", "wood"),
)


def surface(background_id: Column) -> Column:
    chain, low = None, F.lower(background_id)
    for word, name in SURFACES:
        chain = F.when(low.contains(word), name) if chain is None else chain.when(low.contains(word), name)
    return chain.otherwise("other")


def pairs(preds: Column, truths: Column, least: float, iou=g.box_iou) -> Column:
    """struct(iou, p, t) of overlapping pairs, best first, then by indexes."""
    each = F.flatten(F.transform(preds, lambda a, i: F.transform(truths, lambda b, j: F.struct((-iou(a, b)).alias("o"), i.alias("p"), j.alias("t")))))
    good = F.filter(each, lambda x: x["o"] <= -least)
    return F.transform(F.array_sort(good), lambda x: F.struct((-x["o"]).alias("iou"), x["p"].alias("p"), x["t"].alias("t")))


def greedy_match(preds: Column, truths: Column, least: float = DIAGNOSTIC, iou=g.box_iou) -> Column:
    """One-to-one pairs by overlap, best first."""

    def pick(ordered: Column) -> Column:
        free = lambda acc, x: ~F.exists(acc, lambda y: (y["p"] == x["p"]) | (y["t"] == x["t"]))
        return F.aggregate(ordered, F.slice(ordered, 1, 0), lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))

    return let(pairs(preds, truths, least, iou), pick)


def suppress(dets: Column, least: float = SUPPRESS, iou=g.box_iou) -> Column:
    """Detections (struct with score and box) that overlap no better one kept before; ties keep their order."""
    keyed = F.array_sort(F.transform(dets, lambda d, i: F.struct((-d["score"]).alias("s"), i.alias("i"), d.alias("d"))))

    def pick(ordered: Column) -> Column:
        return F.aggregate(ordered, F.slice(ordered, 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: iou(x["box"], y["box"]) >= least), acc).otherwise(F.concat(acc, F.array(x))))

    return let(F.transform(keyed, lambda k: k["d"]), pick)


def reaching(least: float):
    return lambda m: m["iou"] >= least


def score_scenes(scenes: DataFrame, iou=g.box_iou) -> DataFrame:
    """Scenes with arrays preds and truths, null preds where the file has no entry: counts per threshold.

    A match at a higher threshold is a match at the lowest, so one matching serves all; each threshold matches anew only on what it accepts.
    """
    have = scenes.withColumn("had_entry", F.col("preds").isNotNull()).withColumn("preds", F.coalesce("preds", F.filter("truths", lambda x: F.lit(False))))
    done = have.withColumn("matches", greedy_match(F.col("preds"), F.col("truths"), DIAGNOSTIC, iou))
    for at in REPORTED:
        k = f"{round(100 * at)}"
        done = done.withColumn(f"tp_{k}", F.size(F.filter("matches", reaching(at))))
        done = done.withColumn(f"fp_{k}", F.size("preds") - F.col(f"tp_{k}"))
    done = done.withColumn("n_truth", F.size("truths")).withColumn("n_pred", F.size("preds"))
    return done.withColumn("perfect", (F.col("tp_50") == F.col("n_truth")) & (F.col("fp_50") == 0))


def rates(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Micro precision, recall and F1 at each threshold; no denominator gives null, F1 is 0 where both are 0."""
    ats = F.explode(F.array(*[F.struct(F.lit(at).alias("threshold"), F.col(f"tp_{round(100 * at)}").alias("tp"), F.col(f"fp_{round(100 * at)}").alias("fp")) for at in REPORTED]))
    long = scores.select(*(by or []), "n_truth", ats.alias("x")).select(*(by or []), "n_truth", "x.*")
    sums = long.groupBy(*(by or []), "threshold").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("n_truth").alias("truth"))
    both = sums.withColumn("precision", F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", "truth"))
    p, r = F.col("precision"), F.col("recall")
    return both.withColumn("f1", F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)))


def scene_summary(scores: DataFrame) -> DataFrame:
    """Count accuracy, mean count error, share of perfect scenes, scenes without an entry."""
    return scores.agg(
        F.count(F.lit(1)).alias("scenes"), F.avg((F.col("n_pred") == F.col("n_truth")).cast("int")).alias("count_accuracy"), F.avg(F.abs(F.col("n_pred") - F.col("n_truth"))).alias("count_error"),
        F.avg(F.col("perfect").cast("int")).alias("perfect_share"), F.count_if(~F.col("had_entry")).alias("missing"),
    )


def count_bucket(n: Column) -> Column:
    return F.when(n == 0, "0").when(n <= 3, "1-3").when(n <= 6, "4-6").when(n <= 9, "7-9").when(n <= 12, "10-12").otherwise("13+")


def deformation_groups(kinds: Column) -> Column:
    """none; waves only; else a label for each of fold, curl and corner_lift."""
    named = F.filter(F.array(*map(F.lit, ("fold", "curl", "corner_lift"))), lambda k: F.array_contains(kinds, k))
    return F.when(F.size(kinds) == 0, F.array(F.lit("none"))).when((F.size(kinds) == 1) & F.array_contains(kinds, "waves"), F.array(F.lit("waves only"))).otherwise(named)


def attribute_breakdown(rows: DataFrame, groups: dict[str, Column], measures: list[Column]) -> DataFrame:
    """attribute, label and measures, from array-valued groupings that may overlap."""
    named = lambda name: lambda x: F.struct(F.lit(name).alias("attribute"), x.alias("label"))
    pairs_ = F.flatten(F.array(*[F.transform(labels, named(name)) for name, labels in groups.items()]))
    return rows.withColumn("g", F.explode(pairs_)).select("*", "g.attribute", "g.label").groupBy("attribute", "label").agg(*measures)


def top_quartile(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Rows at or above the 75th percentile of their group."""
    cut = ranks.percentiles(rows, by, F.col(value), {"cut": 0.75}).withColumnsRenamed({b: f"of_{b}" for b in by})
    on = [F.col(b).eqNullSafe(F.col(f"of_{b}")) for b in by]
    return rows.join(cut, on if on else None).filter(F.col(value) >= F.col("cut")).drop(*[f"of_{b}" for b in by])


def reading_order(boxes: Column) -> Column:
    """Indexes of boxes by rows: a row takes boxes within half a median height of its first centre; inside it goes left to right."""
    info = F.array_sort(F.transform(boxes, lambda b, i: F.struct(((b[1] + b[3]) / 2).alias("y"), i.alias("i"), ((b[0] + b[2]) / 2).alias("x"), (b[3] - b[1]).alias("h"))))

    def tall(hs: Column) -> Column:
        at = lambda k: F.get(hs, k.cast("int"))
        return (at(F.floor((F.size(hs) - 1) / 2)) + at(F.floor(F.size(hs) / 2))) / 2

    def rows(s: Column) -> Column:
        none = F.slice(F.transform(s["info"], lambda e: F.struct(F.lit(0).alias("row"), e["x"].alias("x"), e["i"].alias("i"))), 1, 0)
        start = F.struct(F.lit(float("-inf")).alias("first"), F.lit(0).alias("row"), none.alias("out"))

        def step(acc: Column, e: Column) -> Column:
            new = e["y"] - acc["first"] > 0.5 * s["tall"]
            row = acc["row"] + F.when(new, 1).otherwise(0)
            return F.struct(F.when(new, e["y"]).otherwise(acc["first"]).alias("first"), row.alias("row"), F.concat(acc["out"], F.array(F.struct(row.alias("row"), e["x"].alias("x"), e["i"].alias("i")))).alias("out"))

        return F.aggregate(s["info"], start, step, lambda acc: F.transform(F.array_sort(acc["out"]), lambda o: o["i"]))

    return let(let(info, lambda es: F.struct(es.alias("info"), let(F.array_sort(F.transform(es, lambda e: e["h"])), tall).alias("tall"))), rows)


def corner_records(matched: DataFrame) -> DataFrame:
    """Corner errors of matched quadrilaterals pred and truth in a frame width, height: mean, max, axis and orientation."""
    mask = g.in_frame(F.col("truth"), F.col("width"), F.col("height"))
    best = matched.withColumn("best", g.best_shift(F.col("pred"), F.col("truth"), mask))
    shift = F.col("best.shift")
    return best.withColumn("corner_mean", F.col("best.mean")).withColumn("corner_max", F.col("best.max")).withColumn("axis_correct", shift.isin(0, 2)).withColumn("orientation_correct", F.when(F.col("orientation_known"), shift == 0)).drop("best")


def replace_by_candidates(dets: DataFrame, candidates: DataFrame, least: float) -> DataFrame:
    """Each detection (scene_id, det, box) takes the box of the candidate (scene_id, place, cand_box) that overlaps it most, at least by `least`; the last of equal ones."""
    near = dets.join(candidates, "scene_id").withColumn("iou", g.box_iou(F.col("box"), F.col("cand_box"))).filter(F.col("iou") >= least)
    best = near.groupBy("scene_id", "det").agg(F.max(F.struct("iou", "place", "cand_box")).alias("b"))
    return dets.join(best, ["scene_id", "det"], "left").withColumn("box", F.coalesce("b.cand_box", "box")).drop("b")


def confident(quads: Column, supports: Column) -> Column:
    """Of each quadrilateral: aspect in 1.9 to 2.8, every side supported by 0.7, and overlap with any other at most 1% of the smaller."""

    def one(q: Column, i: Column) -> Column:
        aspect = g.long_side(q) / F.greatest(g.short_side(q), F.lit(1.0))
        apart = F.forall(quads, lambda o: F.struct(o).eqNullSafe(F.struct(q)) | (g.quad_intersection(q, o) <= 0.01 * F.least(g.polygon_area(q), g.polygon_area(o))))
        sides = F.get(supports, i)
        return aspect.between(1.9, 2.8) & F.coalesce(F.forall(sides, lambda s: s >= 0.7), F.lit(False)) & apart

    return F.transform(quads, one)


def readable(quads: Column) -> Column:
    """Whether the upper median of long sides reaches 300."""
    longs = F.array_sort(F.transform(quads, g.long_side))
    return F.try_element_at(longs, (F.floor(F.size(longs) / 2) + 1).cast("int")) >= 300
