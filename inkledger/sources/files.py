"""Readers and writers of the entities, over any path that Spark can open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkledger.functions import text as t
from inkledger.sources import schemas

TARGET_FIELDS = ("payer_name", "payee", "amount_numeric", "amount_words", "date", "memo", "check_number")


def ocr_rows(spark: SparkSession, path: str, target_only: bool = True) -> DataFrame:
    """Field rows with their key; only target fields unless all are asked for."""
    rows = spark.read.schema(schemas.OCR_ROW).json(path)
    rows = rows.filter(F.col("field_name").isin(*TARGET_FIELDS)) if target_only else rows
    return rows.withColumn("row_key", t.row_key(F.col("scene_id"), F.col("check_index"), F.col("field_name")))


def scenes(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Scene annotations by id, optionally the first ones; an empty folder is an error."""
    found = spark.read.schema(schemas.SCENE).option("multiLine", True).json(path)
    if found.isEmpty():
        raise ValueError(f"no scenes in {path}")
    return found.orderBy("scene_id").limit(limit) if limit else found


def checks_of(scene_rows: DataFrame) -> DataFrame:
    """One row per check."""
    return scene_rows.select("scene_id", "image_width", "image_height", "background_id", F.explode("checks").alias("c")).select("scene_id", "image_width", "image_height", "background_id", "c.*")


def canonical_of(scene_rows: DataFrame) -> DataFrame:
    """Canonical values per check, with the names of its fields."""
    c = checks_of(scene_rows)
    return c.select("scene_id", "check_index", "canonical.*", F.transform("fields", lambda f: f["field_name"]).alias("field_names_present")).withColumnsRenamed({"amount_cents": "canonical_amount_cents", "date_iso": "canonical_date_iso", "check_number": "canonical_check_number"})


def fields_of(scene_rows: DataFrame) -> DataFrame:
    c = checks_of(scene_rows)
    return c.select("scene_id", "check_index", F.posexplode("fields").alias("field_pos", "f")).select("scene_id", "check_index", "field_pos", "f.*")


def predictions(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Reading predictions with a method label; keys must be there and stand once, confidences within 0 and 1."""
    rows = spark.read.schema(schemas.PREDICTION).json(paths)
    label = F.when(F.col("localization").isNull(), F.col("method")).otherwise(F.concat("method", F.lit("__loc="), F.col("localization")))
    rows = rows.withColumn("method_label", label).withColumn("pred_text", F.coalesce("pred_text", F.lit("")))
    bad = rows.filter("row_key is null or method is null or confidence < 0 or confidence > 1")
    again = rows.groupBy("method_label", "row_key").count().filter("count > 1")
    if not bad.isEmpty() or not again.isEmpty():
        raise ValueError("predictions lack keys, repeat keys, or have confidences outside 0 to 1")
    return rows


def box_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.BOX_PREDICTION).json(path)


def detections(spark: SparkSession, path: str) -> DataFrame:
    """One row per detection, by scene and place; a missing score is 1."""
    whole = spark.read.schema(schemas.DETECTIONS).option("multiLine", True).json(path)
    each = whole.select("detector_name", "split", F.explode("scenes").alias("scene_id", "dets")).select("detector_name", "split", "scene_id", F.posexplode("dets").alias("pred_idx", "d"))
    return each.select("detector_name", "split", "scene_id", "pred_idx", "d.corners", F.coalesce("d.score", F.lit(1.0)).alias("score"), F.coalesce("d.orientation_known", F.lit(False)).alias("orientation_known"))


def write_predictions(rows: DataFrame, path: str) -> None:
    """In contract order, by method and localization, so that readers prune."""
    names = [part.split(" ")[0] for part in schemas.PREDICTION.split(", ")]
    rows.select(*names, F.col("method").alias("part_method"), F.col("localization").alias("part_localization")).write.partitionBy("part_method", "part_localization").json(path)


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("sep", "\t").schema(schema).csv(path)


def listing(spark: SparkSession, root: str, suffixes: str = "*.{jpg,jpeg,png}") -> DataFrame:
    """Files under a root by path, without reading their bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", suffixes).load(root).select("path", "length", "modificationTime")


def unhandled(candidates: DataFrame, logs: list[DataFrame], key: str = "name") -> DataFrame:
    """Candidates that no log has: what a resumed run still has to do."""
    for log in logs:
        candidates = candidates.join(log.select(key), key, "left_anti")
    return candidates


def stored(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Values of a key-value table of JSON texts; a corrupt or missing value is null."""
    rows = spark.read.schema("key string, json string").json(path).filter(F.col("key") == key)
    return rows.select(F.from_json("json", schema).alias("value"))


# Sources and the licence codes that are accepted, with what they mean.
LICENSES = (
    ("polyhaven", "cc0", "CC0-1.0"), ("ambientcg", "cc0", "CC0-1.0"), ("openverse", "cc0", "CC0-1.0"), ("openverse", "pdm", "PDM-1.0"), ("commons", "cc0", "CC0-1.0"), ("commons", "pd", "public-domain"),
)


def accepted_license(source: Column, code: Column) -> Column:
    """The normalized licence, null where it is not accepted."""
    table = F.create_map(*[F.lit(x) for s, c, name in LICENSES for x in (f"{s}|{c}", name)])
    return F.element_at(table, F.concat_ws("|", source, F.lower(F.trim(code))))
