import random
import statistics

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from inkledger.functions.fuzzy import weighted_ratio
from inkledger.operators import combination, exports, ranks, scoring


def test_running_sums(spark):
    draw = random.Random(1)
    rows = [(draw.choice("ab"), draw.choice([None, -0.5, 0.25, 1.5, round(draw.random(), 2)]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, x double, id int")
    got = ranks.running(df, ["g"], F.coalesce(ranks.unit_bucket(F.col("x")), F.lit(-1)), ["x", "id"], {"seen": F.lit(1), "ids": F.col("id")}).collect()
    assert len(got) == len(rows)
    for g in "ab":
        ahead = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0.0, r[2]))
        mine = {r.id: r for r in got if r.g == g}
        for k, r in enumerate(ahead):
            assert (mine[r[2]].seen, mine[r[2]].ids, mine[r[2]].all_seen) == (k + 1, sum(a[2] for a in ahead[: k + 1]), len(ahead))


def test_percentiles_of_any_group(spark):
    draw = random.Random(2)
    values = {"many": [draw.gauss(0, 9) for _ in range(500)], "ties": [draw.choice([1.0, 2.0, 5.0]) for _ in range(99)], "one": [3.0], None: [7.0, 8.0]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [("many", None), ("none", None)], "g string, v double")
    wanted = {"low": 0.0, "q1": 0.25, "mid": 0.5, "p95": 0.95, "top": 1.0}
    got = {r.g: r for r in ranks.percentiles(df, ["g"], F.col("v"), wanted).collect()}
    want = {r.g: r for r in df.groupBy("g").agg(*[F.percentile("v", F.lit(q)).alias(n) for n, q in wanted.items()]).collect() if r.low is not None}
    assert got.keys() == want.keys() == values.keys()
    assert all(got[g][n] == pytest.approx(want[g][n]) for g in want for n in wanted)
    whole = ranks.percentiles(df, [], F.col("v"), {"mid": 0.5}).first().mid
    assert whole == pytest.approx(statistics.median(v for vs in values.values() for v in vs))
    assert ranks.percentiles(df.limit(0), ["g"], F.col("v"), wanted).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        ahead, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            ahead, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, ahead + (x != y))
    return row[-1]


def damaged(draw, word):
    for _ in range(draw.randrange(5)):
        k = draw.randrange(len(word) + 1)
        word = draw.choice([word[:k] + word[k + 1 :], word[:k] + draw.choice("abx") + word[k:], word[:k] + "x" + word[k + 1 :]])
    return word


def test_payer_snap_loses_no_name(spark):
    draw = random.Random(3)
    names = ["a", "ab", "", *["".join(draw.choice("ab") for _ in range(draw.randrange(1, 34))) for _ in range(40)]]
    reads = sorted({damaged(draw, draw.choice(names)) for _ in range(150)} | {"", "a", "b"})
    got = combination.payer_snap(spark.createDataFrame([(r,) for r in reads], "read string"), spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, place int"))
    found = {r.read: (r.name, r.distance) for r in got.collect()}
    for r in reads:
        budget = min(3, max(1, len(r) // 8))
        near = [(edits(r, n), i, n) for i, n in enumerate(names) if edits(r, n) <= budget] if r else []
        assert found[r] == ((min(near)[2], min(near)[0]) if near else (None, None)), r


def test_payee_snap_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(combination, "NAME_BLOCK", 2)
    names = ["Green Valley Farm", "Valley Green Farms", "North Bank", "north bank", "Harbour Foods Inc"]
    reads = ["green valley", "nort bank", "harbor food", "zzz", None]
    got = combination.payee_snap(spark.createDataFrame([(r,) for r in reads], "read string"), spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, place int")).collect()
    for r in got:
        score, place = max((weighted_ratio(r.read, n), -i) for i, n in enumerate(names)) if r.read else (None, None)
        assert (r.score is None or r.score == pytest.approx(score)) and r.name == (names[-place] if r.read and score >= 60 else None)


def test_autocomplete_of_long_and_spaced_texts(spark):
    names = spark.createDataFrame([("Harbour Foods", 0), ("Old Harbour", 1), ("Harbour Foods West", 2), ("A Bee", 3)], "name string, place int")
    typed = spark.createDataFrame([("harbour foods w",), ("harb",), ("a b",), ("h",), ("old harbour",)], "typed string")
    got = [(r.typed, r["rank"], r.name) for r in combination.autocomplete(typed, names).orderBy("typed", "rank").collect()]
    assert got == [("a b", 1, "A Bee"), ("harb", 1, "Harbour Foods"), ("harb", 2, "Harbour Foods West"), ("harb", 3, "Old Harbour"), ("harbour foods w", 1, "Harbour Foods West")]


def test_autocomplete_of_repeated_names_without_broadcast(spark, tmp_path):
    names = [(n, 3 * i + k) for i in range(20) for k, n in enumerate(("Old Mill", "old  mill", f"Oldest {i}"))]
    spark.createDataFrame(names[::-1], "name string, place int").write.parquet(str(tmp_path / "names"))
    got = combination.autocomplete(spark.createDataFrame([("old",), ("mill",)], "typed string"), spark.read.parquet(str(tmp_path / "names")))
    assert [(r.typed, r["rank"], r.name) for r in got.orderBy("typed", "rank").collect()] == [("mill", k + 1, ("Old Mill", "old  mill")[k % 2]) for k in range(6)] + [("old", k + 1, names[k][0]) for k in range(6)]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_keys_that_repeat_are_errors(spark):
    rows = spark.createDataFrame([("s", 0, "k")], "scene_id string, check_index int, row_key string")
    twice = spark.createDataFrame([("s", 0, 5), ("s", 0, 6)], "scene_id string, check_index int, cents int")
    assert scoring.with_canonical(rows, twice.limit(1)).first().cents in (5, 6)
    with pytest.raises(PySparkException, match="repeated key"):
        scoring.with_canonical(rows, twice).collect()
    flags = spark.createDataFrame([("other", True)], "row_key string, degraded boolean")
    assert scoring.with_hard_sets(rows, flags, ("degraded",)).first().degraded is False


def test_numbers_over_many_buckets(spark):
    df = spark.range(9000).select((F.col("id") * 7 % 9000).alias("k"))
    assert exports.numbered(df, ["k"], F.col("k")).filter("id <> k + 1").count() == 0
