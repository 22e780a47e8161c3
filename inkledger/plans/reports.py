"""Queries of reports, gating rules, truth checks and gate states, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.operators import breakdowns, combination, field_gate, gating, reports, scoring, splits
from inkledger.plans.reading import EVENTS, MEASURES, POINTS, event_rows, read, rounded

FIELDS = ["signup", "error", "click", "view", "purchase"]


def report_rows(spark, sf_dir) -> DataFrame:
    """Scored events with a status, hard-set flags and two dimensions."""
    e = F.col("event_id")
    rows = event_rows(spark, sf_dir).withColumn("status", F.when(e % 6 == 0, "too_small").when(e % 13 == 0, "occluded").otherwise("ok"))
    rows = rows.withColumn("handwritten_degraded", (e % 4 == 1) & F.col("handwritten")).withColumn("printed_degraded", (e % 4 == 1) & ~F.col("handwritten"))
    return rows.withColumn("in_hard_set", F.col("handwritten_degraded") | F.col("printed_degraded")).withColumn("layout_family", F.when(e % 5 > 0, F.format_string("f%d", e % 5)))


REPORT_ROWS = EVENTS + """, s AS (
  SELECT *, CASE WHEN event_id % 6 = 0 THEN 'too_small' WHEN event_id % 13 = 0 THEN 'occluded' ELSE 'ok' END AS status, event_id % 4 = 1 AND handwritten AS handwritten_degraded,
         event_id % 4 = 1 AND NOT handwritten AS printed_degraded, event_id % 4 = 1 AS in_hard_set, CASE WHEN event_id % 5 > 0 THEN 'f' || (event_id % 5) END AS layout_family FROM e)
"""


def report_blocks(spark, sf_dir):
    return rounded(reports.blocks(report_rows(spark, sf_dir), F.col("status") == "ok", ("handwritten", "layout_family")))


REPORT_BLOCKS = REPORT_ROWS + f""", b AS (
  SELECT *, 'headline' AS block, '' AS v FROM s WHERE status = 'ok' UNION ALL SELECT *, 'hard_set', '' FROM s WHERE status = 'ok' AND in_hard_set UNION ALL SELECT *, 'too_small', '' FROM s WHERE status = 'too_small'
  UNION ALL SELECT *, 'status', status FROM s UNION ALL SELECT *, 'hard_slice', 'handwritten' FROM s WHERE status = 'ok' AND handwritten UNION ALL SELECT *, 'hard_slice', 'handwritten_degraded' FROM s WHERE status = 'ok' AND handwritten_degraded
  UNION ALL SELECT *, 'hard_slice', 'printed_degraded' FROM s WHERE status = 'ok' AND printed_degraded UNION ALL SELECT *, 'hard_slice', 'easy_printed' FROM s WHERE status = 'ok' AND NOT handwritten AND NOT printed_degraded
  UNION ALL SELECT *, 'by_handwritten', handwritten::varchar FROM s WHERE status = 'ok' UNION ALL SELECT *, 'by_layout_family', coalesce(layout_family, 'null') FROM s WHERE status = 'ok')
SELECT method_label, block, v AS value, CASE WHEN grouping(field_name) = 1 THEN 'ALL' ELSE field_name END AS field_name, {MEASURES} FROM b GROUP BY GROUPING SETS ((method_label, block, v, field_name), (method_label, block, v))
"""


def gating_blocks(spark, sf_dir):
    got = reports.gating_blocks(report_rows(spark, sf_dir), F.col("status") == "ok").select("block", "method_label", "field_name", "n", "fill_coverage", "fill_accuracy", "coverage_at_95")
    return rounded(got, ("fill_coverage", "fill_accuracy", "coverage_at_95"), 9)


GATING_BLOCKS = REPORT_ROWS + """, b AS (SELECT *, 'gating' AS block FROM s WHERE status = 'ok' UNION ALL SELECT *, 'gating_handwritten' FROM s WHERE status = 'ok' AND handwritten),
n AS (SELECT block, method_label, field_name, count(*) AS n, avg(covered::int) AS fc, avg(field_correct::int) FILTER (covered) AS fa FROM b GROUP BY ALL),
w AS (SELECT block, method_label, field_name, count(*) OVER d AS filled, sum(field_correct::int) OVER d AS k FROM b WHERE covered WINDOW d AS (PARTITION BY block, method_label, field_name ORDER BY coalesce(confidence, -1) DESC RANGE UNBOUNDED PRECEDING)),
g AS (SELECT block, method_label, field_name, max(filled) FILTER (k::double / filled >= 0.95 - 1e-12) AS best FROM w GROUP BY ALL)
SELECT block, method_label, field_name, n, round(fc, 9) AS fill_coverage, round(fa, 9) AS fill_accuracy, round(coalesce(best, 0)::double / n, 9) AS coverage_at_95 FROM n LEFT JOIN g USING (block, method_label, field_name)
"""


def confidence_kinds(spark, sf_dir):
    e = F.col("event_id")
    kinds = {"mean": F.col("confidence"), "least": (e * 11 % 64) / F.lit(64.0)}
    return reports.confidence_kinds(event_rows(spark, sf_dir), kinds, ("field_name", "handwritten"), (0.7, 0.9)).withColumn("coverage", F.round("coverage", 9))


CONFIDENCE_KINDS = EVENTS + """, k AS (SELECT *, 'mean' AS kind, confidence AS c FROM e UNION ALL SELECT *, 'least', (event_id * 11 % 64) / 64.0::double FROM e),
n AS (SELECT field_name, handwritten, kind, count(*) AS n FROM k GROUP BY ALL),
w AS (SELECT field_name, handwritten, kind, count(*) OVER d AS filled, sum(field_correct::int) OVER d AS right_ FROM k WHERE covered WINDOW d AS (PARTITION BY field_name, handwritten, kind ORDER BY coalesce(c, -1) DESC RANGE UNBOUNDED PRECEDING)),
t AS (SELECT unnest([0.7, 0.9])::double AS target)
SELECT field_name, handwritten, kind, target, round(coalesce(max(filled) FILTER (right_::double / filled >= target - 1e-12), 0)::double / any_value(n), 9) AS coverage FROM w JOIN n USING (field_name, handwritten, kind), t GROUP BY field_name, handwritten, kind, target
"""


def gating_curve(spark, sf_dir):
    return rounded(gating.curve(event_rows(spark, sf_dir)), ("coverage", "accuracy"), 9)


GATING_CURVE = POINTS + """, r AS (SELECT *, row_number() OVER (PARTITION BY method_label, field_name ORDER BY threshold DESC NULLS LAST) - 1 AS i, count(*) OVER (PARTITION BY method_label, field_name) - 1 AS last FROM p)
SELECT method_label, field_name, threshold, filled, k AS "right", n, round(coverage, 9) AS coverage, round(accuracy, 9) AS accuracy FROM r WHERE list_contains(list_transform(range(0, 21), lambda x: round_even(x * last / 20.0, 0)::bigint), i)
"""


def agreement_rule(spark, sf_dir):
    return rounded(gating.agreement_rule(event_rows(spark, sf_dir)), ("coverage", "accuracy"), 9)


AGREEMENT_RULE = EVENTS + "SELECT method_label, count(*) AS n, round(avg(coalesce(confidence >= 0.9, false)::int), 9) AS coverage, round(avg(field_correct::int) FILTER (confidence >= 0.9), 9) AS accuracy FROM e GROUP BY method_label"


def top_half_accuracy(spark, sf_dir):
    return rounded(gating.top_half_accuracy(event_rows(spark, sf_dir), ("field_name", "height_bin"), [F.col("event_id")]), ("accuracy",), 9)


TOP_HALF_ACCURACY = EVENTS + """, r AS (SELECT *, row_number() OVER (PARTITION BY field_name, height_bin ORDER BY confidence DESC NULLS LAST, event_id) AS i, count(*) OVER (PARTITION BY field_name, height_bin) AS c FROM e)
SELECT field_name, height_bin, round(avg(field_correct::int), 9) AS accuracy, count(*) AS n FROM r WHERE i <= greatest(1, c // 2) GROUP BY ALL
"""


def most_coverage(spark, sf_dir):
    return rounded(gating.most_coverage(event_rows(spark, sf_dir), 0.67), ("coverage",), 9)


MOST_COVERAGE = POINTS + "SELECT method_label, field_name, round(coalesce(max(coverage) FILTER (accuracy >= 0.67), 0), 9) AS coverage FROM p GROUP BY ALL"


def frozen_pivot(spark, sf_dir):
    rows = event_rows(spark, sf_dir)
    got = gating.frozen(rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1"), 0.0)
    return reports.frozen_pivot(got.withColumn("test_coverage", F.round("test_coverage", 6)).withColumn("test_accuracy", F.round("test_accuracy", 6)), FIELDS)


FROZEN_PIVOT = EVENTS + """, b AS (SELECT method_label, field_name, min(coalesce(confidence, '-inf'::double)) AS t FROM e WHERE event_id % 2 = 0 AND covered GROUP BY ALL),
x AS (SELECT method_label, field_name, covered AND confidence >= t AS f, field_correct FROM e JOIN b USING (method_label, field_name) WHERE event_id % 2 = 1),
c AS (SELECT method_label, field_name, printf('%.1f / %.1f', 100 * round(avg(coalesce(f, false)::int), 6), 100 * round(avg(field_correct::int) FILTER (f), 6)) AS c FROM x GROUP BY ALL)
SELECT method_label, """ + ", ".join(f"coalesce(max(c) FILTER (field_name = '{f}'), '-') AS {f}" for f in FIELDS) + " FROM c GROUP BY method_label"


def headline_subsets(spark, sf_dir):
    return scoring.with_subsets(report_rows(spark, sf_dir)).groupBy("subset", "field_name").agg(F.count(F.lit(1)).alias("n"))


HEADLINE_SUBSETS = REPORT_ROWS + """, u AS (SELECT field_name, unnest([CASE WHEN status = 'ok' THEN 'all' END, CASE WHEN status = 'ok' AND in_hard_set THEN 'hard' END, CASE WHEN status = 'ok' AND handwritten THEN 'handwritten' END,
  CASE WHEN handwritten_degraded THEN 'handwritten_degraded' END, CASE WHEN printed_degraded THEN 'printed_degraded' END, CASE WHEN status = 'too_small' THEN 'too_small' END]) AS subset FROM s)
SELECT subset, field_name, count(*) AS n FROM u WHERE subset IS NOT NULL GROUP BY ALL
"""


def status_counts(spark, sf_dir):
    return breakdowns.status_counts(report_rows(spark, sf_dir), ["field_name", "height_bin"])


STATUS_COUNTS = REPORT_ROWS + "SELECT field_name, height_bin, count(*) AS n, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'too_small') AS too_small FROM s GROUP BY ALL"


def macro_mean(spark, sf_dir):
    per_field = breakdowns.summarize(event_rows(spark, sf_dir), ["method_label", "field_name"])
    return rounded(breakdowns.macro_mean(per_field, ["method_label"], "accuracy"), ("macro_accuracy",), 9)


MACRO_MEAN = EVENTS + "SELECT method_label, round(avg(a), 9) AS macro_accuracy FROM (SELECT method_label, field_name, avg(field_correct::int) AS a FROM e GROUP BY ALL) GROUP BY method_label"


def field_status(spark, sf_dir):
    q = F.col("l_quantity")
    status = scoring.field_status(F.col("l_linenumber") == 7, F.col("l_partkey") % 9 > 0, 1 - F.col("l_discount") / 50, 1 - F.col("l_tax") / 6, q)
    return read(spark, sf_dir, "lineitem").select(status.alias("status"), scoring.height_bin(q).alias("height_bin")).groupBy("status", "height_bin").agg(F.count(F.lit(1)).alias("n"))


FIELD_STATUS = """
SELECT CASE WHEN l_linenumber = 7 THEN 'micr_blurred_in_app' WHEN l_partkey % 9 = 0 THEN 'not_in_frame' WHEN 1 - l_discount::double / 50 < 0.999 THEN 'partially_out_of_frame' WHEN 1 - l_tax::double / 6 < 0.99 THEN 'occluded' WHEN l_quantity < 14 THEN 'too_small' ELSE 'ok' END AS status,
       CASE WHEN l_quantity < 14 THEN '<14' WHEN l_quantity < 18 THEN '14-18' WHEN l_quantity < 24 THEN '18-24' WHEN l_quantity < 32 THEN '24-32' ELSE '>=32' END AS height_bin, count(*) AS n FROM lineitem GROUP BY ALL
"""


def truth_with_flags(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("row_key"), "o_orderkey")
    flags = orders.filter("o_orderkey % 3 = 0").select("row_key", (F.col("o_orderkey") % 2 == 0).alias("small_text"), (F.col("o_orderkey") % 5 == 0).alias("degraded"))
    return scoring.with_hard_sets(orders, flags, ("small_text", "degraded")).select("o_orderkey", "small_text", "degraded")


TRUTH_WITH_FLAGS = "SELECT o_orderkey, o_orderkey % 6 = 0 AS small_text, o_orderkey % 15 = 0 AS degraded FROM orders"


def canonical_join(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scene_id"), F.lit(0).alias("check_index"), "l_linenumber")
    canonical = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scene_id"), F.lit(0).alias("check_index"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_iso"))
    return scoring.with_canonical(rows, canonical).groupBy("date_iso").agg(F.count(F.lit(1)).alias("n"))


CANONICAL_JOIN = "SELECT strftime(o_orderdate, '%Y-%m-%d') AS date_iso, count(*) AS n FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL"


def first_field_rows(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("scene_id"), F.lit(0).alias("check_index"), F.format_string("%010d_%d_%04d", "l_partkey", "l_linenumber", "l_suppkey").alias("row_key"))
    return scoring.check_rows(rows).select("scene_id", "row_key")


FIRST_FIELD_ROWS = "SELECT l_orderkey AS scene_id, min(printf('%010d_%d_%04d', l_partkey, l_linenumber, l_suppkey)) AS row_key FROM lineitem GROUP BY l_orderkey"


def prediction_audit(spark, sf_dir):
    """Repeated keys, and predictions without truth."""
    reads = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("method_label"), F.col("l_orderkey").cast("string").alias("row_key"))
    truth = read(spark, sf_dir, "orders").filter("o_orderkey % 4 > 0").select(F.col("o_orderkey").cast("string").alias("row_key"))
    again = scoring.repeated_keys(reads).groupBy("method_label").agg(F.count(F.lit(1)).alias("repeated"))
    return again.join(scoring.unmatched_predictions(truth, reads), "method_label", "full").select("method_label", "repeated", F.col("n").alias("unmatched"))


PREDICTION_AUDIT = """
WITH r AS (SELECT l_returnflag AS m, count(*) AS repeated FROM (SELECT l_returnflag, l_orderkey FROM lineitem GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL), u AS (SELECT l_returnflag AS m, count(*) AS unmatched FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 > 0) GROUP BY ALL)
SELECT m AS method_label, repeated, unmatched FROM r FULL JOIN u USING (m)
"""


def corner_statistics(spark, sf_dir):
    k = F.col("l_orderkey") + F.col("l_linenumber")
    rows = read(spark, sf_dir, "lineitem").select(
        "l_returnflag", F.when(k % 7 > 0, F.col("l_quantity").cast("double")).alias("corner_error"), (k % 5).alias("corners_used"), F.when(k % 3 > 0, k % 2 == 0).alias("orientation_correct"), (k % 4 > 0).alias("axis_correct"), (k % 11 > 0).alias("clockwise")
    )
    got = reports.corner_statistics(rows, ["l_returnflag"])
    return rounded(got, ("corner_error_mean", "below_4px", "below_8px", "below_16px", "orientation_accuracy", "axis_accuracy"), 9)


CORNER_STATISTICS = """
WITH r AS (SELECT l_returnflag, l_quantity::double AS q, l_orderkey + l_linenumber AS k FROM lineitem)
SELECT l_returnflag, count(*) AS matched_checks, round(avg(q) FILTER (k % 7 > 0), 9) AS corner_error_mean, round(avg((q < 4)::int) FILTER (k % 7 > 0), 9) AS below_4px, round(avg((q < 8)::int) FILTER (k % 7 > 0), 9) AS below_8px, round(avg((q < 16)::int) FILTER (k % 7 > 0), 9) AS below_16px,
       count(*) FILTER (k % 7 > 0 AND k % 5 < 4) AS partial_corners, count(*) FILTER (k % 7 = 0) AS without_corners, count(*) FILTER (k % 7 > 0 AND k % 3 > 0) AS orientation_known, round(avg((k % 2 = 0)::int) FILTER (k % 7 > 0 AND k % 3 > 0), 9) AS orientation_accuracy,
       round(avg((k % 4 > 0)::int) FILTER (k % 7 > 0), 9) AS axis_accuracy, count(*) FILTER (k % 11 = 0) AS counter_clockwise FROM r GROUP BY l_returnflag
"""


def snap_shares(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select("o_orderpriority", F.when(k % 4 > 0, F.concat(F.lit("n"), k % 3)).alias("name"), F.concat(F.lit("n"), k % 5).alias("canonical"), F.when(k % 9 > 0, k % 2 == 0).alias("handwritten"))
    return reports.snap_shares(rows, ["o_orderpriority"])


SNAP_SHARES = """
WITH o AS (SELECT o_orderpriority, o_orderkey % 4 > 0 AS f, o_orderkey % 4 > 0 AND o_orderkey % 3 = o_orderkey % 5 AS r, o_orderkey % 9 > 0 AND o_orderkey % 2 = 0 AS h FROM orders),
u AS (SELECT *, unnest(['all', CASE WHEN h THEN 'handwritten' ELSE 'printed' END]) AS rows FROM o)
SELECT o_orderpriority, rows, count(*) AS n, round(100.0::double * sum(f::int) / count(*), 1) AS filled, round(100.0::double * sum(r::int) / count(*), 1) AS identified, round(100.0::double * sum(r::int) / nullif(sum(f::int), 0), 1) AS precision FROM u GROUP BY ALL
"""


def names_kept(spark, sf_dir):
    """A list of names that grows: the last ones stay, first spelling kept."""
    known = read(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").cast("bigint").alias("seq"))
    new = read(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.format_string("supplier#%09d", F.floor(F.col("c_custkey") / 4).cast("bigint"))).otherwise(F.col("c_name")).alias("name"), (F.col("c_custkey") + 1000000).cast("bigint").alias("seq"))
    return combination.add_names(known, new, 300)


NAMES_KEPT = """
WITH b AS (SELECT s_name AS name, s_suppkey::bigint AS seq FROM supplier UNION ALL SELECT CASE WHEN c_custkey % 2 = 0 THEN printf('supplier#%09d', c_custkey // 4) ELSE c_name END, c_custkey + 1000000 FROM customer)
SELECT min(seq) AS seq, arg_min(name, seq) AS name FROM b GROUP BY lower(name) ORDER BY seq DESC LIMIT 300
"""


def scene_counts(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", splits.scene_counts(F.col("p_partkey") % 97).alias("c")).select("p_partkey", "c.train", "c.val", "c.eval")


SCENE_COUNTS = """
WITH p AS (SELECT p_partkey, p_partkey % 97 AS t, greatest(CASE WHEN p_partkey % 97 >= 3 THEN 1 ELSE 0 END, floor((p_partkey % 97) * 0.15::double)::int) AS k FROM part)
SELECT p_partkey, t - 2 * k AS train, k AS val, k AS eval FROM p
"""


def gate_names(spark, sf_dir):
    """States of payer and payee reads of events: snapped, own, or left blank for handwriting that nothing read."""
    e = F.col("event_id")
    one = F.struct(F.when(e % 9 > 0, F.concat(F.lit(" Acme "), e % 5)).otherwise("").alias("text"), F.lit(1.0).alias("confidence"), F.lit(0.0).alias("handwritten_probability"), F.lit("crnn").alias("reader"), F.lit(None).cast("array<double>").alias("box"))
    snap, distance = F.when(e % 3 == 0, F.lit("Acme")), F.when(e % 3 == 0, (e % 2).cast("int"))
    rows = read(spark, sf_dir, "events").select("event_id", field_gate.gate_payer(one, snap, distance).alias("p"), field_gate.gate_payee(one, snap).alias("q"))
    return rows.select("event_id", F.col("p.state").alias("payer_state"), F.col("p.snapped_from").alias("payer_from"), F.col("q.state").alias("payee_state"), F.col("q.value").alias("payee_value"))


GATE_NAMES = """
SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'blank' WHEN event_id % 3 = 0 AND event_id % 2 = 1 THEN 'unsure' ELSE 'confident' END AS payer_state,
       CASE WHEN event_id % 9 > 0 AND event_id % 3 = 0 AND event_id % 2 = 1 THEN 'Acme ' || (event_id % 5) END AS payer_from,
       CASE WHEN event_id % 9 = 0 THEN 'blank' ELSE 'unsure' END AS payee_state, CASE WHEN event_id % 9 = 0 THEN '' WHEN event_id % 3 = 0 THEN 'Acme' ELSE 'Acme ' || (event_id % 5) END AS payee_value FROM events
"""


def review_edits(spark, sf_dir):
    """Records of events after an edit and a confirmation."""
    e = F.col("event_id")
    states = F.element_at(F.array(*map(F.lit, ("confident", "unsure", "blank"))), (e % 3 + 1).cast("int"))
    none = F.lit(None).cast("string")
    before = field_gate.record(F.when(e % 4 > 0, "read").otherwise(""), states, states, F.lit(None).cast("array<double>"), none, F.when(e % 5 == 0, "Old Name"), F.lit(False))
    typed = F.when(e % 10 == 0, "Old Name").when(e % 7 == 0, " ").otherwise("typed")
    rows = read(spark, sf_dir, "events").select("event_id", before.alias("r"), typed.alias("typed"))
    after = rows.select("event_id", field_gate.edit(F.col("r"), F.col("typed")).alias("x"), field_gate.confirm(F.col("r")).alias("y"))
    return after.select("event_id", F.col("x.review_state").alias("edited"), F.col("y.review_state").alias("confirmed"), F.col("y.touched").alias("touched"))


REVIEW_EDITS = """
WITH s AS (SELECT event_id AS e, ['confident', 'unsure', 'blank'][event_id % 3 + 1] AS st FROM events)
SELECT e AS event_id, CASE WHEN e % 10 = 0 THEN 'unsure' WHEN e % 7 = 0 THEN CASE WHEN st = 'confident' THEN 'confirmed' ELSE 'blank' END ELSE 'confirmed' END AS edited,
       CASE WHEN st <> 'confident' AND e % 4 > 0 THEN 'confirmed' ELSE st END AS confirmed, st <> 'confident' AND e % 4 > 0 AS touched FROM s
"""


#: name: (query, SQL)
PAIRS = {
    "report_blocks": (report_blocks, REPORT_BLOCKS),
    "gating_blocks": (gating_blocks, GATING_BLOCKS),
    "confidence_kinds": (confidence_kinds, CONFIDENCE_KINDS),
    "gating_curve": (gating_curve, GATING_CURVE),
    "agreement_rule": (agreement_rule, AGREEMENT_RULE),
    "top_half_accuracy": (top_half_accuracy, TOP_HALF_ACCURACY),
    "most_coverage": (most_coverage, MOST_COVERAGE),
    "frozen_pivot": (frozen_pivot, FROZEN_PIVOT),
    "headline_subsets": (headline_subsets, HEADLINE_SUBSETS),
    "status_counts": (status_counts, STATUS_COUNTS),
    "macro_mean": (macro_mean, MACRO_MEAN),
    "field_status": (field_status, FIELD_STATUS),
    "truth_with_flags": (truth_with_flags, TRUTH_WITH_FLAGS),
    "canonical_join": (canonical_join, CANONICAL_JOIN),
    "first_field_rows": (first_field_rows, FIRST_FIELD_ROWS),
    "prediction_audit": (prediction_audit, PREDICTION_AUDIT),
    "corner_statistics": (corner_statistics, CORNER_STATISTICS),
    "snap_shares": (snap_shares, SNAP_SHARES),
    "names_kept": (names_kept, NAMES_KEPT),
    "scene_counts": (scene_counts, SCENE_COUNTS),
    "gate_names": (gate_names, GATE_NAMES),
    "review_edits": (review_edits, REVIEW_EDITS),
}
