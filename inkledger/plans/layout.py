"""Queries of geometry, detection, localization, splits, exports, similarity, text and windows.

Coordinates are made of whole numbers by key, so areas and overlaps are exact
on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkledger.functions import geometry as g
from inkledger.functions import text as t
from inkledger.functions.hashing import blake_score, split_score
from inkledger.operators import breakdowns, detection, exports, field_gate, localization, near_duplicates, splits
from inkledger.plans.reading import read
from inkledger.streaming import reads as streams


def numbers(*columns: Column) -> Column:
    return F.array(*[c.cast("double") for c in columns])


def line_boxes(spark, sf_dir) -> DataFrame:
    """Boxes a and b of each line item, by its numbers; duplicates of a line keep equal boxes."""
    p, s, q, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("bigint"), F.col("l_linenumber")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity", (p % 100).alias("x"), (s % 60).alias("y"), (q + 10).alias("w"), (n + 12).alias("h"))
    x, y, w, h = (F.col(c) for c in "xywh")
    return rows.withColumn("a", numbers(x, y, x + w, y + h)).withColumn("b", numbers(x + n, y + 2, x + w, y + h + n))


BOXES = """
WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity, (l_partkey % 100)::double AS x, (l_suppkey % 60)::double AS y, l_quantity::bigint + 10.0::double AS w, l_linenumber + 12.0::double AS h, l_linenumber::double AS n FROM lineitem)
"""


def box_iou_stats(spark, sf_dir):
    rows = line_boxes(spark, sf_dir)
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(g.box_iou(F.col("a"), F.col("b"))), 6).alias("mean_iou"), F.round(F.avg(g.box_cover(F.col("b"), F.col("a"))), 6).alias("mean_cover"), F.sum(g.box_area(F.col("a"))).alias("area"))


BOX_IOU_STATS = BOXES + """, o AS (SELECT *, greatest(w - n, 0) * (h - 2) AS ov, w * h AS aa, greatest(w - n, 0) * (h + n - 2) AS ab FROM i)
SELECT l_returnflag, count(*) AS n, round(avg(ov / (aa + ab - ov)), 6) AS mean_iou, round(avg(ov / aa), 6) AS mean_cover, sum(aa) AS area FROM o GROUP BY l_returnflag
"""


def layout_priors(spark, sf_dir):
    a = F.col("a")
    rows = line_boxes(spark, sf_dir).select("l_returnflag", F.format_string("field%d", F.col("l_linenumber") % 3).alias("field_name"), F.col("l_orderkey").alias("check_id"), *[(a[k] / 200).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))])
    got = localization.layout_priors(rows, "l_returnflag")
    return got.withColumns({c: F.round(c, 9) for c in got.columns if c not in ("l_returnflag", "field_name", "boxes", "checks")})


LAYOUT_PRIORS = BOXES + """, b AS (SELECT l_returnflag, 'field' || (l_linenumber % 3) AS field_name, l_orderkey, x / 200 AS x0, y / 200 AS y0, (x + w) / 200 AS x1, (y + h) / 200 AS y1 FROM i),
c AS (SELECT l_returnflag, count(DISTINCT l_orderkey) AS checks FROM i GROUP BY ALL)
SELECT l_returnflag, field_name, round(median(x0), 9) AS median_x0, round(median(y0), 9) AS median_y0, round(median(x1), 9) AS median_x1, round(median(y1), 9) AS median_y1, round(quantile_cont(x0, 0.005), 9) AS search_x0, round(quantile_cont(y0, 0.005), 9) AS search_y0,
  round(quantile_cont(x1, 0.995), 9) AS search_x1, round(quantile_cont(y1, 0.995), 9) AS search_y1, round(median(y1 - y0), 9) AS median_height, count(*) AS boxes, any_value(checks) AS checks, round(count(*)::double / any_value(checks), 9) AS presence
FROM b JOIN c USING (l_returnflag) GROUP BY l_returnflag, field_name
"""

LOCALIZED = ["field0", "field1", "field2"]


def localization_summary(spark, sf_dir):
    """Checks are orders; field k has truth and prediction by the order's key."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("check_id"))
    k = F.col("check_id")
    each = o.withColumn("f", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    w = k % 40 + 20
    truth = each.filter((k + F.col("f")) % 5 != 0).select("check_id", F.format_string("field%d", "f").alias("field_name"), F.when(k % 9 == 0, "occluded").otherwise("ok").alias("status"), numbers(F.lit(0), F.lit(0), w, F.lit(10)).alias("box"))
    pred = each.filter((k + 2 * F.col("f")) % 7 != 0).select("check_id", F.format_string("field%d", "f").alias("field_name"), numbers(F.lit(0), F.lit(0), w + k % 30, F.lit(10)).alias("pred_box"))
    got = localization.summarize(localization.score_boxes(o, LOCALIZED, truth, pred), ["field_name"])
    return got.withColumns({c: F.round(c, 9) for c in got.columns if c not in ("field_name", "scored_count", "absent_count")})


LOCALIZATION_SUMMARY = """
WITH e AS (SELECT o_orderkey AS k, unnest([0, 1, 2]) AS f FROM orders),
s AS (SELECT 'field' || f AS field_name, CASE WHEN (k + f) % 5 = 0 THEN 'absent' WHEN k % 9 = 0 THEN 'excluded' ELSE 'scored' END AS kind, (k + 2 * f) % 7 <> 0 AS has, (k % 40 + 20)::double AS w, (k % 30)::double AS d FROM e),
r AS (SELECT *, CASE WHEN kind = 'scored' THEN CASE WHEN has THEN w / (w + d) ELSE 0 END END AS iou, CASE WHEN kind = 'scored' AND has THEN (w + d) / w END AS ratio FROM s)
SELECT field_name, count(*) FILTER (kind = 'scored') AS scored_count, round(avg(iou), 9) AS mean_iou, round(avg((iou >= 0.5)::int), 9) AS hit_rate, round(avg(CASE WHEN kind = 'scored' THEN has::int END), 9) AS coverage_rate, round(median(ratio), 9) AS median_area_ratio, round(avg(ratio), 9) AS mean_area_ratio,
  round(avg(CASE WHEN kind = 'scored' THEN (NOT has)::int END), 9) AS no_box_rate, count(*) FILTER (kind = 'absent') AS absent_count, round(avg(CASE WHEN kind = 'absent' THEN has::int END), 9) AS false_box_rate FROM r GROUP BY field_name
"""


def polygon_area_clip(spark, sf_dir):
    """Areas of slanted quadrilaterals, and of axis-aligned ones clipped to a frame."""
    x, y, w, h = (F.col(c) for c in "xywh")
    rows = line_boxes(spark, sf_dir)
    slanted = F.array(g.point(x, y), g.point(x + w, y + 3), g.point(x + w + 2, y + h), g.point(x - 1, y + h + 4))
    inside = g.clip_to_frame(g.box_polygon(F.col("a")), F.lit(80.0), F.lit(50.0))
    per = rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", g.polygon_area(slanted).alias("area"), F.round(g.polygon_area(inside), 6).alias("inside"))
    return per.groupBy("l_orderkey").agg(F.sum("area").alias("area"), F.sum("inside").alias("inside"))


POLYGON_AREA_CLIP = BOXES + """, q AS (SELECT l_orderkey, abs((x * (y + 3) - (x + w) * y) + ((x + w) * (y + h) - (x + w + 2) * (y + 3)) + ((x + w + 2) * (y + h + 4) - (x - 1) * (y + h)) + ((x - 1) * y - x * (y + h + 4))) / 2 AS area,
  greatest(least(x + w, 80) - x, 0) * greatest(least(y + h, 50) - y, 0) AS inside FROM i)
SELECT l_orderkey, sum(area) AS area, sum(inside) AS inside FROM q GROUP BY l_orderkey
"""


def scene_boxes(spark, sf_dir) -> DataFrame:
    """Scenes are orders, their items' boxes the truth; predictions are moved boxes, one more for each fourth order."""
    rows = line_boxes(spark, sf_dir).withColumn("s", F.col("l_orderkey"))
    n = F.col("l_linenumber")
    far = F.transform(F.col("a"), lambda v: v + 200 * n)
    moved = F.transform(F.col("b"), lambda v: v + 200 * n)
    one = F.struct(n.alias("n"), F.col("l_partkey").alias("k1"), F.col("l_suppkey").alias("k2"), F.col("l_quantity").alias("k3"), far.alias("t"), moved.alias("p"))
    scenes = rows.groupBy("s").agg(F.sort_array(F.collect_list(one)).alias("x"))
    return scenes.select("s", F.transform("x", lambda e: e["t"]).alias("truths"), F.transform("x", lambda e: e["p"]).alias("preds"))


def greedy_match(spark, sf_dir):
    m = scene_boxes(spark, sf_dir).withColumn("m", F.explode(detection.greedy_match(F.col("preds"), F.col("truths"), 0.1)))
    return m.select("s", F.col("m.p").alias("p"), F.col("m.t").alias("t"), F.round("m.iou", 9).alias("iou"))


def nms(spark, sf_dir):
    dets = F.transform("preds", lambda b, i: F.struct((F.lit(1.0) - i / 100).alias("score"), b.alias("box")))
    return scene_boxes(spark, sf_dir).select("s", F.size("preds").alias("n"), F.size(detection.suppress(dets)).alias("kept"))


def known_scenes(spark, sf_dir) -> DataFrame:
    """Scenes whose overlaps are known: box k of an order is matched at 10 / (10 + k * 3), order % 6 is how many there are, one extra prediction for each fifth order, and none at all for each seventh."""
    o = F.col("o_orderkey")
    ks = F.sequence(F.lit(1), (o % 6).cast("int"))
    ks = F.when(o % 6 > 0, ks).otherwise(F.slice(F.array(F.lit(0)), 1, 0))
    truths = F.transform(ks, lambda k: numbers(100 * k, F.lit(0), 100 * k + 10, F.lit(10)))
    preds = F.transform(ks, lambda k: numbers(100 * k, F.lit(0), 100 * k + 10 + 3 * k, F.lit(10)))
    extra = F.when(o % 5 == 0, F.array(numbers(F.lit(9000), F.lit(0), F.lit(9010), F.lit(10)))).otherwise(F.slice(preds, 1, 0))
    return read(spark, sf_dir, "orders").select("o_orderkey", truths.alias("truths"), F.when(o % 7 > 0, F.concat(preds, extra)).alias("preds"))


def detection_rates(spark, sf_dir):
    got = detection.rates(detection.score_scenes(known_scenes(spark, sf_dir)))
    return got.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


DETECTION_RATES = """
WITH o AS (SELECT o_orderkey AS o, o_orderkey % 6 AS n, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 6 ELSE 0 END AS p, CASE WHEN o_orderkey % 7 > 0 AND o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS x FROM orders),
h AS (SELECT unnest([0.5, 0.75, 0.9]) AS threshold),
s AS (SELECT threshold::double AS threshold, sum(CASE WHEN p > 0 THEN len(list_filter(range(1, n + 1), lambda k: 10.0 / (10 + 3 * k) >= threshold)) ELSE 0 END)::bigint AS tp, sum(p + x)::bigint AS pn, sum(n)::bigint AS truth FROM o, h GROUP BY threshold),
r AS (SELECT *, tp::double / nullif(pn, 0) AS p, tp::double / nullif(truth, 0) AS r FROM s)
SELECT threshold, tp, pn - tp AS fp, truth, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 9) AS f1 FROM r
"""


def scene_summary(spark, sf_dir):
    got = detection.scene_summary(detection.score_scenes(known_scenes(spark, sf_dir)))
    return got.withColumns({c: F.round(c, 9) for c in ("count_accuracy", "count_error", "perfect_share")})


SCENE_SUMMARY = """
WITH o AS (SELECT o_orderkey % 6 AS n, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 6 + (o_orderkey % 5 = 0)::int ELSE 0 END AS p, o_orderkey % 7 = 0 AS missing FROM orders)
SELECT count(*) AS scenes, round(avg((n = p)::int), 9) AS count_accuracy, round(avg(abs(n - p)), 9) AS count_error, round(avg((n = p AND (n = 0 OR (n <= 3 AND NOT missing)))::int), 9) AS perfect_share, count(*) FILTER (missing) AS missing FROM o
"""


def error_percentiles(spark, sf_dir):
    got = breakdowns.percentiles(read(spark, sf_dir, "events"), ["event_type"], "value")
    return got.withColumns({c: F.round(c, 6) for c in ("mean", "median", "p90", "p95")})


ERROR_PERCENTILES = "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type"


def attr_breakdown(spark, sf_dir):
    e = F.col("event_id")
    kinds = F.array_compact(F.array(F.when(e % 2 == 1, F.lit("fold")), F.when(e % 3 == 1, F.lit("curl")), F.when(e % 5 == 1, F.lit("corner_lift")), F.when(e % 7 < 3, F.lit("waves"))))
    rows = read(spark, sf_dir, "events").withColumn("kinds", kinds)
    groups = {"deformation": detection.deformation_groups(F.col("kinds")), "event_type": F.array("event_type"), "count": F.array(detection.count_bucket(e % 15))}
    return detection.attribute_breakdown(rows, groups, [F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean")])


ATTR_BREAKDOWN = """
WITH e AS (SELECT *, event_id % 2 = 1 AS f, event_id % 3 = 1 AS c, event_id % 5 = 1 AS l, event_id % 7 < 3 AS w, event_id % 15 AS k FROM events),
x AS (
  SELECT 'deformation' AS attribute, 'none' AS label, value FROM e WHERE NOT (f OR c OR l OR w) UNION ALL SELECT 'deformation', 'waves only', value FROM e WHERE w AND NOT (f OR c OR l)
  UNION ALL SELECT 'deformation', 'fold', value FROM e WHERE f UNION ALL SELECT 'deformation', 'curl', value FROM e WHERE c UNION ALL SELECT 'deformation', 'corner_lift', value FROM e WHERE l
  UNION ALL SELECT 'event_type', event_type, value FROM e UNION ALL SELECT 'count', CASE WHEN k = 0 THEN '0' WHEN k <= 3 THEN '1-3' WHEN k <= 6 THEN '4-6' WHEN k <= 9 THEN '7-9' WHEN k <= 12 THEN '10-12' ELSE '13+' END, value FROM e)
SELECT attribute, label, count(*) AS n, round(avg(value), 6) AS mean FROM x GROUP BY ALL
"""


def closeup_subsets(spark, sf_dir):
    rows = detection.top_quartile(read(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"])
    return rows.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("least"))


CLOSEUP_SUBSETS = "WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.75) AS c FROM orders GROUP BY ALL) SELECT o_orderpriority, count(*) AS n, min(o_totalprice) AS least FROM orders JOIN q USING (o_orderpriority) WHERE o_totalprice >= c GROUP BY o_orderpriority"


def reading_order(spark, sf_dir):
    rows = line_boxes(spark, sf_dir)
    one = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "a")
    scenes = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(one)).alias("x"))
    return scenes.select("l_orderkey", detection.reading_order(F.transform("x", lambda e: e["a"])).alias("o")).select("l_orderkey", F.array_join(F.transform("o", lambda i: i.cast("string")), ",").alias("order"))


def part_ids(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("stratum"), (F.col("p_partkey") % 50 == 0).alias("held_first"))


def split_rank(spark, sf_dir):
    return splits.deal(part_ids(spark, sf_dir), split_score(7, 11, F.col("id")), []).select("id", "split")


SCORE = "('0x' || substr(md5('7|11|' || p_partkey), 1, 15))::bigint"
IDS = f"WITH i AS (SELECT p_partkey AS id, p_type AS stratum, p_partkey % 50 = 0 AS held, {SCORE} AS score FROM part)"
DEAL = "greatest(1, round_even(n * 0.15, 0)::int)"


def deal_sql(pool: str) -> str:
    return f"""{IDS}, p AS (SELECT *, {pool} AS pool FROM i),
r AS (SELECT *, count(*) OVER (PARTITION BY pool) AS n, sum(held::int) OVER (PARTITION BY pool) AS hn, row_number() OVER (PARTITION BY pool ORDER BY NOT held, score, id) AS rank FROM p),
e AS (SELECT *, CASE WHEN 2 * {DEAL} >= n THEN 1 ELSE {DEAL} END AS e FROM r)
SELECT id, CASE WHEN n < 3 AND pool = '' THEN CASE WHEN held THEN 'eval' ELSE 'train' END WHEN rank <= e THEN 'eval' WHEN rank <= e + greatest(e, hn - e) THEN 'val' ELSE 'train' END AS split FROM e
"""


SPLIT_RANK = deal_sql("'all'")


def split_threshold(spark, sf_dir):
    return splits.by_threshold(part_ids(spark, sf_dir), split_score(7, 11, F.col("id"))).select("id", "split")


SPLIT_THRESHOLD = IDS + " SELECT id, CASE WHEN score / 1152921504606846976.0::double < 0.15 THEN 'eval' WHEN score / 1152921504606846976.0::double < 0.3 THEN 'val' ELSE 'train' END AS split FROM i"


def split_stratified(spark, sf_dir):
    return splits.stratified(part_ids(spark, sf_dir), split_score(7, 11, F.col("id")), "stratum").select("id", "split")


SPLIT_STRATIFIED = deal_sql("CASE WHEN count(*) OVER (PARTITION BY stratum) < 3 THEN '' ELSE '=' || stratum END")


def split_blake(spark, sf_dir):
    ids = part_ids(spark, sf_dir)
    return splits.by_threshold(ids, blake_score(7, 11)(F.col("id").cast("string"))).select("id", "split", F.round("score", 9).alias("score"))


def regime_mix(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.format_string("s%d", F.col("event_id") % 2).alias("split"), F.floor(F.col("event_id") / 2).cast("bigint").alias("idx"))
    return splits.regime_mix(rows, seed=3).select("split", "idx", "regime")


REGIME_MIX = """
WITH s AS (SELECT 's' || (event_id % 2) AS split, event_id // 2 AS idx FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY split, idx // 20 ORDER BY ('0x' || substr(md5('3|' || split || '|' || (idx // 20) || '|' || (idx % 20)), 1, 15))::bigint, idx) AS rank FROM s)
SELECT split, idx, CASE WHEN rank <= 8 THEN 'wide' WHEN rank <= 17 THEN 'close' ELSE 'single' END AS regime FROM r
"""


def coco_annotations(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scene_id"), F.col("o_orderkey").alias("check_index"))
    items = o.withColumn("field_pos", F.explode(F.sequence(F.lit(0), (F.col("check_index") % 4).cast("int")))).withColumn("category_id", F.col("field_pos") + 1)
    return exports.coco_annotations(items, F.floor(F.col("scene_id") / 256)).select("id", "scene_id", "check_index", "field_pos", "check_annotation_id")


COCO_ANNOTATIONS = """
WITH i AS (SELECT o_custkey AS scene_id, o_orderkey AS check_index, unnest(range(0, o_orderkey % 4 + 1)) AS field_pos FROM orders),
n AS (SELECT *, row_number() OVER (ORDER BY scene_id, check_index, field_pos) AS id FROM i)
SELECT id, scene_id, check_index, field_pos::int AS field_pos, CASE WHEN field_pos > 0 THEN min(id) OVER (PARTITION BY scene_id, check_index) END AS check_annotation_id FROM n
"""


def label_lines(spark, sf_dir):
    """Segmentation lines of boxes in a photo of 128 by 64."""
    rows = line_boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", exports.segmentation_line(g.box_polygon(F.col("a")), F.lit(128), F.lit(64)).alias("line"))
    return rows.groupBy("l_orderkey").agg(F.count("line").alias("lines"), F.concat_ws("|", F.array_sort(F.collect_list(F.substring_index("line", " ", 3)))).alias("first_points"))


def near_duplicate_pairs(spark, sf_dir):
    got = near_duplicates.near_pairs(read(spark, sf_dir, "embeddings"), "label", 0.4)
    return got.select("a", "b", F.round("score", 5).alias("score"))


NEAR_DUPLICATE_PAIRS = """
WITH v AS (SELECT vec_id, label, embedding::double[] AS e FROM embeddings),
p AS (SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.e, y.e) AS s FROM v x JOIN v y ON x.label IS NOT DISTINCT FROM y.label AND x.vec_id < y.vec_id)
SELECT a, b, round(s, 5) AS score FROM p WHERE s >= 0.4
"""


def stratified_sample(spark, sf_dir):
    return splits.stratified_sample(read(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], F.col("doc_id"), 25)


STRATIFIED_SAMPLE = "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY ('0x' || substr(md5(doc_id::varchar), 1, 15))::bigint, doc_id) AS k FROM documents) WHERE k <= 25"


def strip_html(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.md5(t.strip_html(F.col("html")).cast("binary")).alias("plain_md5"))


STRIP_HTML = r"SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g'), '^ | $', '', 'g')) AS plain_md5 FROM pages"


def slugify(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", t.slugify(F.concat_ws(" -- ", "p_name", "p_type", "p_brand")).alias("slug"))


SLUGIFY = r"""
WITH w AS (SELECT p_partkey, regexp_extract_all(lower(p_name || ' -- ' || p_type || ' -- ' || p_brand), '[0-9a-z]+') AS ws FROM part),
c AS (SELECT p_partkey, ws, list_transform(range(1, len(ws) + 1), lambda k: list_sum(list_transform(ws[1:k], lambda x: length(x) + 1))) AS ends FROM w)
SELECT p_partkey, coalesce(nullif(array_to_string(ws[1:len(list_filter(ends, lambda e: e <= 40))], '-'), ''), 'untitled') AS slug FROM c
"""


def semi_anti_audit(spark, sf_dir):
    d, lab = read(spark, sf_dir, "documents").select("doc_id", "lang"), read(spark, sf_dir, "labels").select("doc_id")
    both = d.join(lab, "doc_id", "left_semi").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("labelled"))
    none = d.join(lab, "doc_id", "left_anti").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("unlabelled"))
    return both.unionByName(none)


SEMI_ANTI_AUDIT = "SELECT lang, count(*) AS n, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'labelled' ELSE 'unlabelled' END AS kind FROM documents GROUP BY ALL"


def plan_diff(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    plan = c.filter("c_custkey % 11 <> 0").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_mktsegment").alias("value"))
    old = c.filter("c_custkey % 13 <> 0").select(F.col("c_custkey").cast("string").alias("key"), F.when(F.col("c_custkey") % 3 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("value"))
    return splits.plan_differences(plan, old)


PLAN_DIFF = """
WITH p AS (SELECT c_custkey::varchar AS key, c_mktsegment AS planned FROM customer WHERE c_custkey % 11 <> 0), r AS (SELECT c_custkey::varchar AS key, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS recorded FROM customer WHERE c_custkey % 13 <> 0)
SELECT key, planned, recorded FROM p FULL JOIN r USING (key) WHERE planned IS DISTINCT FROM recorded
"""


def surfaces(spark, sf_dir):
    return read(spark, sf_dir, "part").groupBy(detection.surface(F.concat_ws("/", F.lit("web"), F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, "Oak Tile"))).alias("surface")).agg(F.count(F.lit(1)).alias("n"))


SURFACES = "WITH s AS (SELECT CASE " + " ".join(f"WHEN contains(x, '{w}') THEN '{n}'" for w, n in detection.SURFACES) + " ELSE 'other' END AS surface FROM (SELECT lower('web/' || p_name || CASE WHEN p_partkey % 3 = 0 THEN '/Oak Tile' ELSE '' END) AS x FROM part)) SELECT surface, count(*) AS n FROM s GROUP BY surface"


def review_counters(spark, sf_dir):
    states = F.element_at(F.array(*map(F.lit, ("confident", "unsure", "blank", "unread", "confirmed"))), (F.col("event_id") % 5 + 1).cast("int"))
    return field_gate.review_counters(read(spark, sf_dir, "events").withColumn("review_state", states), ["user_id"])


REVIEW_COUNTERS = "SELECT user_id, count(*) FILTER (event_id % 5 = 3) AS unread, count(*) FILTER (event_id % 5 IN (1, 2)) AS flagged, count(*) FILTER (event_id % 5 IN (1, 2, 3)) AS unfinished FROM events GROUP BY user_id"


def label_table(spark, sf_dir):
    e = F.col("event_id")
    rows = read(spark, sf_dir, "events").select(F.floor(e / 12).cast("bigint").alias("serial"), F.element_at(F.array(*map(F.lit, exports.FIELDS)), (e % 12 + 1).cast("int")).alias("field_name"), F.when(e % 5 > 0, F.col("event_type")).alias("text"))
    return exports.label_rows(rows)


LABEL_TABLE = "SELECT event_id // 12 AS serial, " + ", ".join(f"coalesce(max(event_type) FILTER (event_id % 12 = {k} AND event_id % 5 > 0), '') AS text__{f}" for k, f in enumerate(exports.FIELDS)) + " FROM events GROUP BY event_id // 12"


def events_tumbling(spark, sf_dir):
    return streams.tumbling(read(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


EVENTS_TUMBLING = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


def events_sliding(spark, sf_dir):
    return streams.sliding(read(spark, sf_dir, "events"))


EVENTS_SLIDING = "SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL (k) HOUR AS start, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL"


def events_sessions(spark, sf_dir):
    return streams.sessions(read(spark, sf_dir, "events")).select("user_id", "start", "n")


EVENTS_SESSIONS = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s.s
"""


def latest_reads(spark, sf_dir):
    e = F.col("event_id")
    rows = read(spark, sf_dir, "events").select((e % 500).alias("check_id"), F.col("event_type").alias("field_name"), (e % 3).alias("generation"), e.alias("pass_rank"), F.col("props").alias("text"), F.col("value").alias("confidence"))
    return streams.latest_reads(rows)


LATEST_READS = "SELECT event_id % 500 AS check_id, event_type AS field_name, arg_max(props, (event_id % 3) * 1000000000 + event_id) AS text, arg_max(value, (event_id % 3) * 1000000000 + event_id) AS confidence, max(event_id % 3) AS generation, arg_max(event_id, (event_id % 3) * 1000000000 + event_id) AS pass_rank FROM events GROUP BY ALL"

PAIRS = {
    "box_iou_stats": (box_iou_stats, BOX_IOU_STATS),
    "layout_priors": (layout_priors, LAYOUT_PRIORS),
    "localization_summary": (localization_summary, LOCALIZATION_SUMMARY),
    "polygon_area_clip": (polygon_area_clip, POLYGON_AREA_CLIP),
    "greedy_match": (greedy_match, None),
    "nms": (nms, None),
    "detection_rates": (detection_rates, DETECTION_RATES),
    "scene_summary": (scene_summary, SCENE_SUMMARY),
    "error_percentiles": (error_percentiles, ERROR_PERCENTILES),
    "attr_breakdown": (attr_breakdown, ATTR_BREAKDOWN),
    "closeup_subsets": (closeup_subsets, CLOSEUP_SUBSETS),
    "reading_order": (reading_order, None),
    "split_rank": (split_rank, SPLIT_RANK),
    "split_threshold": (split_threshold, SPLIT_THRESHOLD),
    "split_stratified": (split_stratified, SPLIT_STRATIFIED),
    "split_blake": (split_blake, None),
    "regime_mix": (regime_mix, REGIME_MIX),
    "coco_annotations": (coco_annotations, COCO_ANNOTATIONS),
    "label_lines": (label_lines, None),
    "near_duplicate_pairs": (near_duplicate_pairs, NEAR_DUPLICATE_PAIRS),
    "stratified_sample": (stratified_sample, STRATIFIED_SAMPLE),
    "strip_html": (strip_html, STRIP_HTML),
    "slugify": (slugify, SLUGIFY),
    "semi_anti_audit": (semi_anti_audit, SEMI_ANTI_AUDIT),
    "plan_diff": (plan_diff, PLAN_DIFF),
    "surfaces": (surfaces, SURFACES),
    "review_counters": (review_counters, REVIEW_COUNTERS),
    "label_table": (label_table, LABEL_TABLE),
    "events_tumbling": (events_tumbling, EVENTS_TUMBLING),
    "events_sliding": (events_sliding, EVENTS_SLIDING),
    "events_sessions": (events_sessions, EVENTS_SESSIONS),
    "latest_reads": (latest_reads, LATEST_READS),
}
