import math

import pytest
from pyspark.sql import functions as F

from inkledger.functions import geometry as g
from inkledger.operators import detection, exports, field_gate, gating, near_duplicates, splits


def test_clip_and_overlap(spark):
    square = lambda x, y, s: F.array(g.point(F.lit(x), F.lit(y)), g.point(F.lit(x + s), F.lit(y)), g.point(F.lit(x + s), F.lit(y + s)), g.point(F.lit(x), F.lit(y + s)))
    diamond = F.array(*[g.point(F.lit(5 + 5 * math.cos(a)), F.lit(5 + 5 * math.sin(a))) for a in (0, math.pi / 2, math.pi, 3 * math.pi / 2)])
    row = spark.range(1).select(
        g.polygon_area(g.clip_to_frame(square(-5.0, -5.0, 10.0), F.lit(100.0), F.lit(100.0))).alias("clip"), g.quad_iou(square(0.0, 0.0, 10.0), square(5.0, 0.0, 10.0)).alias("iou"),
        g.quad_intersection(square(0.0, 0.0, 10.0), diamond).alias("diamond"), g.is_convex(diamond).alias("convex"), g.short_side(square(0.0, 0.0, 4.0)).alias("short"),
        g.best_shift(F.array(*[square(0.0, 0.0, 4.0)[(i + 1) % 4] for i in range(4)]), square(0.0, 0.0, 4.0), F.array(*[F.lit(True)] * 4))["shift"].alias("shift"),
    ).first()
    assert row.clip == pytest.approx(25) and row.iou == pytest.approx(1 / 3) and row.diamond == pytest.approx(50) and row.convex and row.short == 4 and row.shift == 3


def boxes(spark, preds, truths):
    return spark.createDataFrame([(preds, truths)], "preds array<array<double>>, truths array<array<double>>")


def test_greedy_match_and_suppression(spark):
    a, b, c = [0.0, 0.0, 10.0, 10.0], [1.0, 0.0, 11.0, 10.0], [50.0, 50.0, 60.0, 60.0]
    got = boxes(spark, [b, a, c], [a, c]).select(detection.greedy_match(F.col("preds"), F.col("truths"), 0.1).alias("m")).first().m
    assert {(m.p, m.t) for m in got} == {(1, 0), (2, 1)}
    dets = F.transform("preds", lambda x, i: F.struct((1 - i / 10).alias("score"), x.alias("box")))
    assert boxes(spark, [a, b, c], []).select(F.size(detection.suppress(dets)).alias("n")).first().n == 2


def test_truth_as_predictions_is_perfect(spark):
    scenes = spark.createDataFrame([("s", [[0.0, 0.0, 9.0, 9.0], [20.0, 0.0, 29.0, 9.0]])], "s string, truths array<array<double>>").withColumn("preds", F.col("truths"))
    scores = detection.score_scenes(scenes)
    assert scores.first().perfect and all(r.f1 == 1 for r in detection.rates(scores).collect())


def test_reading_order(spark):
    rows = [[[100.0, 0.0, 150.0, 20.0], [0.0, 4.0, 50.0, 24.0], [0.0, 60.0, 50.0, 80.0]]]
    got = spark.createDataFrame([(r,) for r in rows], "b array<array<double>>").select(detection.reading_order(F.col("b")).alias("o")).first().o
    assert got == [1, 0, 2]


def brute_points(rows):
    n, filled = len(rows), [(c if c is not None else -math.inf, k) for c, k, v in rows if v]
    return {t: (sum(c >= t for c, _ in filled) / n, sum(k for c, k in filled if c >= t) / sum(c >= t for c, _ in filled)) for t, _ in filled}


def test_gating(spark):
    rows = [((i * 7 % 10) / 10 if i % 4 else None, i % 3 > 0, i % 5 > 0) for i in range(60)]
    df = spark.createDataFrame([("m", "f", *r) for r in rows], "method_label string, field_name string, confidence double, field_correct boolean, covered boolean")
    want = brute_points(rows)
    got = {(-math.inf if r.threshold is None else r.threshold): (r.coverage, r.accuracy) for r in gating.points(df).collect()}
    assert got.keys() == want.keys() and all(got[t] == pytest.approx(want[t]) for t in want)
    s = gating.summary(df).first()
    assert s.accuracy_at_100 is None and s.coverage_at_99 in [0.0, *[c for c, a in want.values() if a >= 0.99]]
    assert gating.curve(df).count() <= 21


def test_field_gate_amount(spark):
    df = spark.createDataFrame([(("$5.00", 0.9, 0.1, "crnn", None), ("five and no/100", 0.9, 0.1, "crnn", None)), (("$5.00", 0.9, 0.1, "crnn", None), ("six", 0.9, 0.9, "crnn", None)), (None, None)], "n struct<text:string,confidence:double,handwritten_probability:double,reader:string,box:array<double>>, w struct<text:string,confidence:double,handwritten_probability:double,reader:string,box:array<double>>")
    got = [r.a for r in df.select(field_gate.gate_amount(F.col("n"), F.col("w")).alias("a")).collect()]
    assert [(a.state, a.value, a.note) for a in got] == [("confident", "5.00", None), ("unsure", "5.00", None), ("blank", "", None)]


def test_splits(spark):
    ids = spark.range(40).select("id", (F.col("id") % 13 == 0).alias("held_first"), F.lit("s").alias("stratum"))
    got = {r["split"]: r["count"] for r in splits.deal(ids, splits.default_score("bank", 1, F.col("id")), []).groupBy("split").count().collect()}
    assert got == {"eval": 6, "val": 6, "train": 28}
    assert splits.block_counts() == {"wide": 8, "close": 9, "single": 3}
    with pytest.raises(ValueError):
        splits.block_counts((("a", 0.7),))


def test_numbered_without_one_task(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    assert exports.numbered(df, ["k"], F.floor(F.col("k") / 64)).filter("id <> k + 1").count() == 0


def test_near_pairs(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.99, 0.01], 0), (3, [0.0, 1.0], 0), (4, [1.0, 0.0], 1)], "vec_id bigint, embedding array<double>, label int")
    assert [(r.a, r.b) for r in near_duplicates.near_pairs(df, "label", 0.9).collect()] == [(1, 2)]
