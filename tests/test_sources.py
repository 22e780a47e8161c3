import json

import pytest
from pyspark.sql import functions as F

from inkledger.sources import files

ROWS = [("s1|0|payee", "s1", 0, "payee", "crnn", None, "Acme", 0.5), ("s1|0|payee", "s1", 0, "payee", "crnn", "boxes", None, None), ("s2|1|memo", "s2", 1, "memo", "ocr", None, "rent", 1.0)]


def reads(spark, rows):
    plain = spark.createDataFrame(rows, "row_key string, scene_id string, check_index int, field_name string, method string, localization string, pred_text string, confidence double")
    return plain.withColumn("pred_box", F.array(F.lit(0.0), F.lit(1.0))).withColumn("latency_ms", F.lit(2.0))


def test_predictions_round_trip(spark, tmp_path):
    files.write_predictions(reads(spark, ROWS), str(tmp_path / "p"))
    back = files.predictions(spark, str(tmp_path / "p"))
    assert {(r.row_key, r.method_label, r.pred_text, r.confidence) for r in back.collect()} == {("s1|0|payee", "crnn", "Acme", 0.5), ("s1|0|payee", "crnn__loc=boxes", "", None), ("s2|1|memo", "ocr", "rent", 1.0)}


@pytest.mark.parametrize("bad", [(*ROWS[0][:7], 1.5), (None, *ROWS[0][1:]), ROWS[2]])
def test_bad_predictions_are_refused(spark, tmp_path, bad):
    files.write_predictions(reads(spark, [*ROWS, bad]), str(tmp_path / "p"))
    with pytest.raises(ValueError):
        files.predictions(spark, str(tmp_path / "p"))


def test_scenes_and_their_parts(spark, tmp_path):
    field = {"field_name": "memo", "text": "rent", "handwritten": True, "bbox_clipped": [0, 0, 5, 5], "visible_fraction": 1.0}
    check = {"check_index": 0, "template_id": "t", "fields": [field, {**field, "field_name": "payee"}], "canonical": {"amount_cents": 125, "date_iso": "2024-01-02", "check_number": "7"}}
    for name, checks in (("b", [check]), ("a", [check, {**check, "check_index": 1, "fields": []}])):
        (tmp_path / f"{name}.json").write_text(json.dumps({"scene_id": name, "image_width": 10, "image_height": 20, "background_id": "rug", "checks": checks}, indent=1))
    scenes = files.scenes(spark, str(tmp_path))
    assert [r.scene_id for r in files.scenes(spark, str(tmp_path), 1).collect()] == ["a"]
    assert files.checks_of(scenes).count() == 3 and {(r.scene_id, r.field_pos, r.field_name) for r in files.fields_of(scenes).collect()} == {(s, i, f) for s in "ab" for i, f in enumerate(("memo", "payee"))}
    one = files.canonical_of(scenes).filter("scene_id = 'b'").first()
    assert (one.canonical_amount_cents, one.canonical_date_iso, one.canonical_check_number, one.field_names_present) == (125, "2024-01-02", "7", ["memo", "payee"])
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no scenes"):
        files.scenes(spark, str(tmp_path / "none"))


def test_detections_by_place(spark, tmp_path):
    corner = [{"x": 0.0, "y": 0.0}]
    (tmp_path / "d.json").write_text(json.dumps({"detector_name": "d", "split": "val", "scenes": {"s": [{"corners": corner, "score": 0.5, "orientation_known": True}, {"corners": corner}], "empty": []}}))
    assert [(r.scene_id, r.pred_idx, r.score, r.orientation_known) for r in files.detections(spark, str(tmp_path)).orderBy("pred_idx").collect()] == [("s", 0, 0.5, True), ("s", 1, 1.0, False)]


def test_ocr_rows_listing_store_and_logs(spark, tmp_path):
    (tmp_path / "rows.jsonl").write_text("\n".join(json.dumps({"scene_id": "s", "check_index": 0, "field_name": f, "text": "x"}) for f in ("memo", "signature")))
    assert files.ocr_rows(spark, str(tmp_path / "rows.jsonl")).count() == 1 and files.ocr_rows(spark, str(tmp_path / "rows.jsonl"), False).count() == 2
    (tmp_path / "img" / "deep").mkdir(parents=True)
    for name in ("img/a.jpg", "img/deep/b.png", "img/c.txt"):
        (tmp_path / name).write_bytes(b"123")
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.listing(spark, str(tmp_path / "img")).collect()) == ["a.jpg", "b.png"]
    (tmp_path / "kv.jsonl").write_text("\n".join(json.dumps(r) for r in ({"key": "k", "json": '{"n": 3}'}, {"key": "k", "json": "{broken"}, {"key": "other", "json": "{}"})))
    assert sorted((r.value.n if r.value else None) or 0 for r in files.stored(spark, str(tmp_path / "kv.jsonl"), "n int", "k").collect()) == [0, 3]
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    assert [r.name for r in files.unhandled(names, [names.filter("name = 'a'"), names.filter("name = 'c'")]).collect()] == ["b"]


def test_licences(spark):
    rows = spark.createDataFrame([("openverse", " PDM "), ("openverse", "by-sa"), ("commons", "pd"), (None, "cc0")], "s string, c string")
    assert [r.l for r in rows.select(files.accepted_license(F.col("s"), F.col("c")).alias("l")).collect()] == ["PDM-1.0", None, "public-domain", None]
