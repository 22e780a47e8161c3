"""Labelled scenes to training formats: COCO documents, segmentation and box lines, flat label rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkledger.functions import geometry as g
from inkledger.functions.text import let
from inkledger.operators.ranks import running

#: Labels hold pixel centres; exports hold pixel edges.
EDGE = 0.5
LEAST_AREA = 16.0
FIELDS = ("payer_name", "payer_address", "date", "payee", "amount_numeric", "amount_words", "memo", "check_number", "bank_name", "routing_number", "account_number", "signature")


def to_edges(points: Column) -> Column:
    return F.transform(points, lambda p: g.point(p["x"] + EDGE, p["y"] + EDGE))


def instance(points: Column, wide: Column, high: Column) -> Column:
    """struct(segmentation, area, bbox) of the part of a polygon inside the photo; null if hardly any is."""

    def made(inside: Column) -> Column:
        flat = F.flatten(F.transform(inside, lambda p: F.array(F.round(p["x"], 2), F.round(p["y"], 2))))
        box = let(g.bounds(inside), lambda b: F.array(F.round(b[0], 2), F.round(b[1], 2), F.round(b[2] - b[0], 2), F.round(b[3] - b[1], 2)))
        one = lambda area: F.when(F.coalesce(area, F.lit(0.0)) >= LEAST_AREA, F.struct(flat.alias("segmentation"), F.round(area, 2).alias("area"), box.alias("bbox")))
        return let(g.polygon_area(inside), one)

    return let(g.clip_to_frame(to_edges(points), wide.cast("double"), high.cast("double")), made)


def numbered(rows: DataFrame, order: list[str], bucket: Column, name: str = "id") -> DataFrame:
    """Consecutive numbers from 1 in order, without sorting all rows in one task: inside buckets (numbers that follow the order), after the sizes of earlier buckets, which are summed in two levels themselves."""
    keyed = rows.withColumn("_b", bucket)
    sizes = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = running(sizes, [], F.floor(F.col("_b") / 4096), ["_b"], {"_upto": F.col("_n")})
    ahead = upto.select(F.col("_b").alias("_of"), (F.col("_upto") - F.col("_n")).alias("_ahead"))
    inside = F.row_number().over(W.partitionBy("_b").orderBy(*order))
    return keyed.join(ahead, F.col("_b") == F.col("_of")).withColumn(name, (F.col("_ahead") + inside).cast("bigint")).drop("_b", "_of", "_ahead")


def coco_annotations(items: DataFrame, bucket: Column) -> DataFrame:
    """Running annotation ids: each check, then its fields; fields carry their check's id.

    items: scene_id, check_index, field_pos (0 for the check itself), category_id.
    """
    ids = numbered(items, ["scene_id", "check_index", "field_pos"], bucket)
    own = W.partitionBy("scene_id", "check_index")
    return ids.withColumn("check_annotation_id", F.when(F.col("field_pos") > 0, F.min("id").over(own)))


def coco_document(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """One JSON document of a split. It is one value by nature; large splits are written as the three tables instead."""
    listed = lambda df, n: df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(n))
    whole = listed(images, "images").join(listed(annotations, "annotations")).join(listed(categories, "categories"))
    return whole.select(F.to_json(F.struct("images", "annotations", "categories")).alias("document"))


def unit_line(points: Column, wide: Column, high: Column) -> Column:
    """A label line of class 0: points by image size, six decimals."""
    held = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    return F.concat(F.lit("0 "), F.array_join(F.transform(points, lambda p: F.format_string("%.6f %.6f", held(p["x"] / wide), held(p["y"] / high))), " "))


def segmentation_line(outline: Column, wide: Column, high: Column) -> Column:
    """The line of a check's part in frame; null if hardly any is."""
    inside = g.clip_to_frame(to_edges(outline), wide.cast("double"), high.cast("double"))
    return let(inside, lambda ps: F.when(g.polygon_area(ps) >= LEAST_AREA, unit_line(ps, wide, high)))


def visible_rectangle(quad: Column, wide: Column, high: Column) -> Column:
    """The rectangle along a check's top side around its part in frame."""

    def axes(q: Column) -> Column:
        ax, ay = (q[1]["x"] - q[0]["x"]) + (q[2]["x"] - q[3]["x"]), (q[1]["y"] - q[0]["y"]) + (q[2]["y"] - q[3]["y"])
        long = F.sqrt(ax * ax + ay * ay)
        flip = F.when(-ay * (q[3]["x"] - q[0]["x"]) + ax * (q[3]["y"] - q[0]["y"]) < 0, -1.0).otherwise(1.0)
        return F.struct((ax / long).alias("ux"), (ay / long).alias("uy"), (-ay / long * flip).alias("vx"), (ax / long * flip).alias("vy"), g.clip_to_frame(q, wide.cast("double"), high.cast("double")).alias("inside"))

    def spans(a: Column) -> Column:
        along, down = F.transform(a["inside"], lambda p: p["x"] * a["ux"] + p["y"] * a["uy"]), F.transform(a["inside"], lambda p: p["x"] * a["vx"] + p["y"] * a["vy"])
        return F.struct(a.alias("a"), F.array_min(along).alias("a0"), F.array_max(along).alias("a1"), F.array_min(down).alias("d0"), F.array_max(down).alias("d1"))

    def corners(s: Column) -> Column:
        a = s["a"]
        corner = lambda k, m: g.point(s[k] * a["ux"] + s[m] * a["vx"], s[k] * a["uy"] + s[m] * a["vy"])
        return F.array(corner("a0", "d0"), corner("a1", "d0"), corner("a1", "d1"), corner("a0", "d1"))

    return let(let(let(quad, axes), spans), corners)


def box_line(corners: Column, wide: Column, high: Column) -> Column:
    """The oriented-box line: the corners where all are in frame, else the rectangle of what is; held to the image only where it stands out too far."""

    def chosen(quad: Column) -> Column:
        inside = F.forall(g.in_frame(quad, wide, high), lambda x: x)
        return F.when(inside, quad).otherwise(visible_rectangle(quad, wide, high))

    def line(used: Column) -> Column:
        fits = lambda a, b, size: ((a + b) / 2 / size).between(-0.01, 1.01) & ((b - a) / size).between(-0.01, 1.01)
        ok = let(g.bounds(used), lambda b: fits(b[0], b[2], wide) & fits(b[1], b[3], high))
        plain = F.concat(F.lit("0 "), F.array_join(F.transform(used, lambda p: F.format_string("%.6f %.6f", p["x"] / wide, p["y"] / high)), " "))
        return F.when(ok, plain).otherwise(unit_line(used, wide, high))

    return let(let(to_edges(corners), chosen), line)


def label_rows(fields: DataFrame, key: str = "serial") -> DataFrame:
    """One row per serial with a text__ column per field, empty where there is none."""
    wide = fields.groupBy(key).pivot("field_name", list(FIELDS)).agg(F.first("text"))
    return wide.select(key, *[F.coalesce(F.col(f), F.lit("")).alias(f"text__{f}") for f in FIELDS])


def check_records(fields: DataFrame) -> DataFrame:
    """One row per check with a map of its fields to (box, status, handwritten)."""
    entry = F.struct("field_name", F.struct("box", "status", "handwritten").alias("value"))
    return fields.groupBy("scene_id", "check_index").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("fields"))
