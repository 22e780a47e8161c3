"""Queries of parsing, scoring, gating and combination over the star-schema tables.

Each query has its SQL beside it. Inputs are projections of whole tables:
texts are rendered in several styles by key, so the right answer is known by
construction and the SQL need not parse anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkledger.functions import text as t
from inkledger.operators import breakdowns, combination, field_gate, gating, scoring, selection


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_style(key: Column, *styles: Column) -> Column:
    """The style of a key's remainder."""
    return F.element_at(F.array(*styles), (key % len(styles) + 1).cast("int"))


def cents_of(price: Column) -> Column:
    return F.round(price * 100).cast("bigint")


def parse_amount_numeric(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("c", cents_of(F.col("o_totalprice")))
    d, c = F.floor(F.col("c") / 100).cast("bigint"), (F.col("c") % 100).cast("bigint")
    f = F.format_string
    text = by_style(F.col("o_orderkey"), f("$***%,d.%02d", d, c), f("%,d %02d/100", d, c), f("%d =", d), f("%,d.xx", d), f("%d.%d", d, c % 10), f("%,d.%02d", d, c), f("%d no/100", d), f("%dO.%02d", d, c))
    return o.select("o_orderkey", t.parse_amount_numeric(text).alias("cents"))


PARSE_AMOUNT_NUMERIC = """
WITH o AS (SELECT o_orderkey, round(o_totalprice * 100)::bigint AS c FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 8 IN (4, 7) THEN NULL WHEN o_orderkey % 8 IN (2, 3, 6) THEN (c // 100) * 100 ELSE c END AS cents FROM o
"""


def parse_amount_words(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("c", cents_of(F.col("p_retailprice")))
    d, c = F.floor(F.col("c") / 100).cast("int"), (F.col("c") % 100).cast("int")
    p = p.withColumn("words", t.spell_dollars(d))
    words = F.col("words")
    text = by_style(
        F.col("p_partkey"), F.concat(F.lit("***"), F.upper(words), F.format_string(" AND %02d/100***", c)), F.concat(F.initcap(words), F.format_string(" & %02d/100", c)), F.concat(words, F.lit(" dollars and no/100")),
        F.concat(F.upper(words), F.format_string(" DOLLARS AND %02d CENTS", c)), F.concat(words, F.lit(" and xx/100")), words, F.concat(F.lit("five twenty "), words),
    )
    return p.withColumn("text", text).select("p_partkey", t.parse_amount_words(F.col("text")).alias("cents"))


PARSE_AMOUNT_WORDS = """
WITH p AS (SELECT p_partkey, round(p_retailprice * 100)::bigint AS c FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 7 = 6 THEN NULL WHEN p_partkey % 7 IN (2, 4, 5) THEN (c // 100) * 100 ELSE c END AS cents FROM p
"""


def spell_amount(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", t.spell_dollars(F.floor("p_retailprice").cast("int")).alias("words"))


SPELL_AMOUNT = """
WITH w AS (SELECT ['', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'eleven', 'twelve', 'thirteen', 'fourteen', 'fifteen', 'sixteen', 'seventeen', 'eighteen', 'nineteen'] AS o,
  ['', '', 'twenty', 'thirty', 'forty', 'fifty', 'sixty', 'seventy', 'eighty', 'ninety'] AS t),
n AS (SELECT p_partkey, floor(p_retailprice)::int AS d FROM part),
h AS (SELECT p_partkey, d, unnest([d // 1000, d % 1000]) AS g, unnest([' thousand', '']) AS s, unnest([1, 2]) AS k FROM n),
x AS (SELECT p_partkey, d, k, trim(concat_ws(' ', CASE WHEN g >= 100 THEN o[g // 100 + 1] || ' hundred' END,
   CASE WHEN g % 100 >= 20 THEN t[g % 100 // 10 + 1] || CASE WHEN g % 10 > 0 THEN '-' || o[g % 10 + 1] ELSE '' END ELSE o[g % 100 + 1] END)) || s AS part, g FROM h, w)
SELECT p_partkey, CASE WHEN d = 0 THEN 'zero' ELSE string_agg(CASE WHEN g > 0 THEN part END, ' ' ORDER BY k) END AS words FROM x GROUP BY p_partkey, d
"""


def parse_date(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    day = F.col("o_orderdate")
    f = lambda p: F.date_format(day, p)
    text = by_style(F.col("o_orderkey"), f("MM/dd/yyyy"), f("M-d-yy"), f("yyyy-MM-dd"), F.concat(f("MMM"), F.lit(". "), t.ordinal(F.dayofmonth(day)), F.lit(", "), f("yyyy")), F.concat(f("d"), F.lit(" "), F.upper(f("MMMM")), F.lit(" "), f("yyyy")), f("M.d.yy"), F.concat(F.lit("2/30/"), f("yyyy")))
    return o.select("o_orderkey", t.parse_date(text).alias("iso"))


PARSE_DATE = """
SELECT o_orderkey, CASE o_orderkey % 7 WHEN 6 THEN NULL WHEN 1 THEN '20' || strftime(o_orderdate, '%y-%m-%d') WHEN 5 THEN '20' || strftime(o_orderdate, '%y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso
FROM orders
"""


def parse_check_number(spark, sf_dir):
    k = F.col("o_orderkey")
    text = by_style(k, F.concat(F.lit("No. "), k.cast("string")), F.concat(F.lit("# "), F.lpad(k.cast("string"), 9, "0")), F.concat(F.lit("00"), k.cast("string")), F.concat(k.cast("string"), F.lit("A")), F.concat(F.lit(" "), F.substring(k.cast("string"), 1, 1), F.lit(" "), F.substring(k.cast("string"), 2, 20)))
    return read(spark, sf_dir, "orders").select("o_orderkey", t.parse_check_number(text).alias("number"))


PARSE_CHECK_NUMBER = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 3 THEN NULL ELSE o_orderkey::varchar END AS number FROM orders"


def normalize_free_text(spark, sf_dir):
    noisy = lambda c: F.concat(F.lit("  **("), F.upper(F.replace(c, F.lit(" "), F.lit(" \t "))), F.lit(" .)! "))
    names = read(spark, sf_dir, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    names = names.unionAll(read(spark, sf_dir, "part").select(F.lit("p"), "p_partkey", "p_name"))
    return names.select("kind", "id", t.normalize_free_text(noisy(F.col("name"))).alias("plain"))


NORMALIZE_FREE_TEXT = "SELECT 'c' AS kind, c_custkey AS id, lower(c_name) AS plain FROM customer UNION ALL SELECT 'p', p_partkey, lower(p_name) FROM part"


def cer_wer(spark, sf_dir):
    name = F.concat(F.col("p_brand"), F.lit(" "), F.col("p_name"), F.lit(" "), F.col("p_type"))
    pred = by_style(F.col("p_partkey"), F.substring(name, 2, 1000), F.regexp_replace(name, r"^\S+\s", ""), name, F.lit(""))
    rows = read(spark, sf_dir, "part").select("p_partkey", name.alias("truth"), pred.alias("pred"))
    return rows.select("p_partkey", F.round(t.character_error_rate(F.col("pred"), F.col("truth")), 9).alias("cer"), F.round(t.word_error_rate(F.col("pred"), F.col("truth")), 9).alias("wer"))


CER_WER = """
WITH r AS (SELECT p_partkey, p_brand || ' ' || p_name || ' ' || p_type AS truth FROM part),
x AS (SELECT *, CASE p_partkey % 4 WHEN 0 THEN substr(truth, 2) WHEN 1 THEN regexp_replace(truth, '^\\S+\\s', '') WHEN 2 THEN truth ELSE '' END AS pred, len(regexp_split_to_array(truth, '\\s+')) AS n FROM r)
SELECT p_partkey, round(levenshtein(pred, truth)::double / length(truth), 9) AS cer, round(CASE p_partkey % 4 WHEN 0 THEN 1.0::double / n WHEN 1 THEN 1.0::double / n WHEN 2 THEN 0 ELSE 1 END, 9) AS wer FROM x
"""


def clean_ocr_token(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("c", cents_of(F.col("o_totalprice")))
    money = F.format_string("%d.%02d", F.floor(F.col("c") / 100).cast("bigint"), (F.col("c") % 100).cast("bigint"))
    noisy = by_style(F.col("o_orderkey"), F.concat(F.lit("[#%+ "), money, F.lit("|")), F.concat(F.lit("|7| "), money), F.concat(F.lit("'("), money, F.lit(")'")), F.lit("[ total ]"))
    return o.select("o_orderkey", t.clean_field(F.lit("amount_numeric"), noisy).alias("token"))


CLEAN_OCR_TOKEN = "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 'total' ELSE printf('%d.%02d', round(o_totalprice * 100)::bigint // 100, round(o_totalprice * 100)::bigint % 100) END AS token FROM orders"


def reading_truth(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("c", cents_of(F.col("o_totalprice")))
    return o.select(
        F.format_string("s%d__check=0__field=amount_numeric", "o_orderkey").alias("row_key"), "o_orderkey", by_style(F.col("o_orderkey"), F.lit("amount_numeric"), F.lit("memo"), F.lit("check_number")).alias("field_name"),
        F.concat(F.lit("$"), t.format_cents(F.col("c"))).alias("money"), F.col("c").alias("canonical_amount_cents"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("canonical_date_iso"), F.col("o_orderkey").cast("string").alias("canonical_check_number"),
    ).select("row_key", "o_orderkey", "field_name", F.when(F.col("field_name") == "check_number", F.concat(F.lit("No. "), F.col("canonical_check_number"))).otherwise(F.col("money")).alias("text"), "canonical_amount_cents", "canonical_date_iso", "canonical_check_number")


def reading_predictions(spark, sf_dir):
    """Method a: no row for each fifth key, blank for the next, else the bare value; method b: one character changed for each third key."""
    truth = reading_truth(spark, sf_dir)
    k, text = F.col("o_orderkey"), F.col("text")
    bare = F.regexp_replace(text, r"^(\$|No\. )", "")
    confidence = F.when(k % 11 > 0, (k * 7 % 100) / F.lit(100.0))
    a = truth.filter("o_orderkey % 5 <> 0").select("row_key", F.lit("a").alias("method_label"), F.when(k % 5 == 1, F.lit(None).cast("string")).otherwise(bare).alias("pred_text"), confidence.alias("confidence"))
    b = truth.select("row_key", F.lit("b").alias("method_label"), F.when(k % 3 == 0, F.concat(text, F.lit("7"))).otherwise(text).alias("pred_text"), confidence.alias("confidence"))
    return a.unionAll(b)


READING = """
WITH t AS (
  SELECT o_orderkey AS k, ['amount_numeric', 'memo', 'check_number'][o_orderkey % 3 + 1] AS field_name, round(o_totalprice * 100)::bigint AS c,
         CASE WHEN o_orderkey % 3 = 2 THEN 'No. ' || o_orderkey ELSE '$' || printf('%d.%02d', round(o_totalprice * 100)::bigint // 100, round(o_totalprice * 100)::bigint % 100) END AS text FROM orders),
p AS (
  SELECT *, 'a' AS method_label, CASE WHEN k % 5 IN (0, 1) THEN '' ELSE replace(replace(text, '$', ''), 'No. ', '') END AS pred_text FROM t
  UNION ALL SELECT *, 'b', CASE WHEN k % 3 = 0 THEN text || '7' ELSE text END FROM t),
s AS (
  SELECT *, pred_text <> '' AS covered, pred_text = text AS exact_raw, CASE WHEN pred_text = '' THEN false WHEN method_label = 'a' THEN true ELSE k % 3 <> 0 END AS field_correct,
         ltrim(lower(text), '$') AS gp, ltrim(lower(pred_text), '$') AS pp, CASE WHEN k % 11 > 0 THEN CASE WHEN method_label = 'a' AND k % 5 = 0 THEN NULL ELSE (k * 7 % 100) / 100.0::double END END AS confidence FROM p),
r AS (
  SELECT *, gp = pp AS text_correct, levenshtein(pp, gp)::double / length(gp) AS cer,
         CASE WHEN pp = gp THEN 0.0 WHEN field_name = 'check_number' THEN CASE WHEN pp = '' THEN 1.0 WHEN method_label = 'a' THEN 0.5 ELSE 0.0 END ELSE 1.0 END::double AS wer FROM s)
"""


def scored(spark, sf_dir):
    return scoring.score_rows(reading_truth(spark, sf_dir), reading_predictions(spark, sf_dir))


def score_rows(spark, sf_dir):
    return scored(spark, sf_dir).select(F.col("o_orderkey").alias("k"), "method_label", "covered", "field_correct", "exact_raw", "text_correct", F.round("cer", 9).alias("cer"), F.round("wer", 9).alias("wer"))


SCORE_ROWS = READING + "SELECT k, method_label, covered, field_correct, exact_raw, text_correct, round(cer, 9) AS cer, round(wer, 9) AS wer FROM r"

ROUNDED = ("coverage", "accuracy", "accuracy_on_filled", "exact_raw", "text_accuracy", "mean_cer", "mean_wer")


def rounded(df: DataFrame, columns=ROUNDED, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


MEASURES = """count(*) AS n, round(avg(covered::int), 6) AS coverage, round(avg(field_correct::int), 6) AS accuracy, round(sum((covered AND field_correct)::int)::double / nullif(sum(covered::int), 0), 6) AS accuracy_on_filled,
  round(avg(exact_raw::int), 6) AS exact_raw, round(avg(text_correct::int), 6) AS text_accuracy, round(avg(cer), 6) AS mean_cer, round(avg(wer), 6) AS mean_wer"""


def reading_accuracy(spark, sf_dir):
    """Flagship: accuracy of each reading method per field, with a total."""
    return rounded(breakdowns.summary_by_field(scored(spark, sf_dir)))


READING_ACCURACY = READING + f"""
SELECT method_label, CASE WHEN grouping(field_name) = 1 THEN 'ALL' ELSE field_name END AS field_name, {MEASURES} FROM r GROUP BY GROUPING SETS ((method_label, field_name), (method_label))
"""


def event_rows(spark, sf_dir):
    e = F.col("event_id")
    return read(spark, sf_dir, "events").select(
        "event_id", F.format_string("m%d", F.col("user_id") % 2).alias("method_label"), F.col("event_type").alias("field_name"), (e % 7 != 0).alias("covered"), ((e % 3 > 0) & (e % 7 != 0)).alias("field_correct"),
        (e % 5 == 0).alias("exact_raw"), (e % 4 > 0).alias("text_correct"), (e % 10 / F.lit(10.0)).alias("cer"), (e % 8 / F.lit(8.0)).alias("wer"), F.when(e % 11 > 0, (e * 7 % 100) / F.lit(100.0)).alias("confidence"),
        (F.col("user_id") % 3 == 0).alias("handwritten"), scoring.height_bin(F.col("value") / 10).alias("height_bin"), F.col("value"), F.col("user_id"),
    )


EVENTS = """
WITH e AS (
  SELECT event_id, 'm' || (user_id % 2) AS method_label, event_type AS field_name, event_id % 7 <> 0 AS covered, event_id % 3 > 0 AND event_id % 7 <> 0 AS field_correct, event_id % 5 = 0 AS exact_raw, event_id % 4 > 0 AS text_correct,
         (event_id % 10) / 10.0::double AS cer, (event_id % 8) / 8.0::double AS wer, CASE WHEN event_id % 11 > 0 THEN (event_id * 7 % 100) / 100.0::double END AS confidence, user_id % 3 = 0 AS handwritten, value, user_id,
         CASE WHEN value / 10 < 14 THEN '<14' WHEN value / 10 < 18 THEN '14-18' WHEN value / 10 < 24 THEN '18-24' WHEN value / 10 < 32 THEN '24-32' ELSE '>=32' END AS height_bin
  FROM events)
"""


def summary_by_field(spark, sf_dir):
    return rounded(breakdowns.summary_by_field(event_rows(spark, sf_dir)))


SUMMARY_BY_FIELD = EVENTS + f"SELECT method_label, CASE WHEN grouping(field_name) = 1 THEN 'ALL' ELSE field_name END AS field_name, {MEASURES} FROM e GROUP BY GROUPING SETS ((method_label, field_name), (method_label))"


def breakdown_sets(spark, sf_dir):
    return rounded(breakdowns.breakdown_sets(event_rows(spark, sf_dir), ["handwritten", "height_bin"]))


BREAKDOWN_SETS = EVENTS + ", d AS (SELECT *, 'handwritten' AS dimension, handwritten::varchar AS v FROM e UNION ALL SELECT *, 'height_bin', height_bin FROM e)" + f"""
SELECT method_label, CASE WHEN grouping(field_name) = 1 THEN 'ALL' ELSE field_name END AS field_name, dimension, v AS value, {MEASURES} FROM d GROUP BY GROUPING SETS ((method_label, dimension, v), (method_label, dimension, v, field_name))
"""


def pivot_methods_fields(spark, sf_dir):
    cell = F.format_string("%.1f / %.3f", F.round(100 * F.col("accuracy"), 1), F.round("mean_cer", 3))
    return breakdowns.pivot_fields(breakdowns.summary_by_field(event_rows(spark, sf_dir)), ["signup", "error", "click", "view", "purchase"], cell)


PIVOT_METHODS_FIELDS = EVENTS + """, s AS (SELECT method_label, CASE WHEN grouping(field_name) = 1 THEN 'ALL' ELSE field_name END AS f, printf('%.1f / %.3f', round(100 * avg(field_correct::int), 1), round(avg(cer), 3)) AS c FROM e GROUP BY GROUPING SETS ((method_label, field_name), (method_label)))
SELECT method_label, max(c) FILTER (f = 'signup') AS signup, max(c) FILTER (f = 'error') AS error, max(c) FILTER (f = 'click') AS click, max(c) FILTER (f = 'view') AS view, max(c) FILTER (f = 'purchase') AS purchase, max(c) FILTER (f = 'ALL') AS "ALL" FROM s GROUP BY method_label
"""


def hard_set_flags(spark, sf_dir):
    e = F.col("event_id")
    rows = event_rows(spark, sf_dir).select("event_id", "field_name", F.when(e % 6 == 0, "too_small").otherwise("ok").alias("status"), F.col("value").alias("contrast"), (e % 40).alias("text_height"), "handwritten", (e % 9 == 0).alias("money_order"))
    return scoring.hard_set_flags(rows).select("event_id", "small_text", "low_contrast", "degraded", "handwritten_degraded", "printed_degraded", "in_hard_set")


HARD_SET_FLAGS = EVENTS + """, q AS (SELECT field_name, quantile_cont(CASE WHEN event_id % 6 <> 0 THEN value END, 0.25) AS q1 FROM e GROUP BY field_name),
f AS (SELECT event_id, event_id % 40 >= 14 AND event_id % 40 < 18 AS small_text, event_id % 6 <> 0 AND value < q1 AS low_contrast, event_id % 6 <> 0 AS ok, handwritten AS hw, event_id % 9 = 0 AS mo FROM e JOIN q USING (field_name)),
g AS (SELECT *, small_text OR low_contrast AS degraded FROM f),
h AS (SELECT *, ok AND hw AND degraded AS handwritten_degraded, ok AND NOT hw AND (degraded OR mo) AS printed_degraded FROM g)
SELECT event_id, small_text, low_contrast, degraded, handwritten_degraded, printed_degraded, handwritten_degraded OR printed_degraded AS in_hard_set FROM h
"""


def gating_points(spark, sf_dir):
    return rounded(gating.points(event_rows(spark, sf_dir)), ("coverage", "accuracy"), 9)


POINTS = EVENTS + """, n AS (SELECT method_label, field_name, count(*) AS n FROM e GROUP BY ALL),
w AS (SELECT method_label, field_name, confidence, count(*) OVER d AS filled, sum(field_correct::int) OVER d AS k FROM e WHERE covered WINDOW d AS (PARTITION BY method_label, field_name ORDER BY coalesce(confidence, -1) DESC RANGE UNBOUNDED PRECEDING)),
p AS (SELECT method_label, field_name, confidence AS threshold, max(filled)::bigint AS filled, max(k)::bigint AS k, max(n.n) AS n, max(filled)::double / max(n.n) AS coverage, max(k)::double / max(filled) AS accuracy FROM w JOIN n USING (method_label, field_name) GROUP BY method_label, field_name, confidence)
"""
GATING_POINTS = POINTS + 'SELECT method_label, field_name, threshold, filled, k AS "right", n, round(coverage, 9) AS coverage, round(accuracy, 9) AS accuracy FROM p'


def gating_summary(spark, sf_dir):
    s = gating.summary(event_rows(spark, sf_dir))
    return s.withColumns({c: F.round(c, 9) for c in s.columns if c not in ("method_label", "field_name", "n", "has_confidence")})


GATING_SUMMARY = POINTS + """SELECT method_label, field_name, any_value(n) AS n, round(max(coverage), 9) AS fill_coverage, round(arg_max(accuracy, coverage), 9) AS fill_accuracy, true AS has_confidence,
""" + ", ".join(f"round(arg_max(accuracy, coalesce(threshold, -1)) FILTER (coverage >= {c} - 1e-12), 9) AS accuracy_at_{round(100 * c)}" for c in gating.COVERAGES) + ", " + ", ".join(
    f"round(coalesce(max(coverage) FILTER (accuracy >= {a} - 1e-12), 0), 9) AS coverage_at_{round(100 * a)}, round(arg_max(threshold, coverage) FILTER (accuracy >= {a} - 1e-12), 9) AS threshold_at_{round(100 * a)}" for a in gating.ACCURACIES
) + " FROM p GROUP BY method_label, field_name"


def frozen_threshold(spark, sf_dir):
    rows = event_rows(spark, sf_dir).withColumn("method_label", F.lit("m"))
    got = gating.frozen(rows.filter("user_id % 2 = 0"), rows.filter("user_id % 2 = 1"), 0.66)
    return rounded(got, ("test_coverage", "test_accuracy"), 9)


FROZEN_THRESHOLD = EVENTS + """, v AS (SELECT * FROM e WHERE user_id % 2 = 0), t AS (SELECT * FROM e WHERE user_id % 2 = 1), n AS (SELECT field_name, count(*) AS n FROM v GROUP BY ALL),
w AS (SELECT field_name, coalesce(confidence, '-inf'::double) AS c, count(*) OVER d AS filled, sum(field_correct::int) OVER d AS k FROM v WHERE covered WINDOW d AS (PARTITION BY field_name ORDER BY coalesce(confidence, '-inf'::double) DESC RANGE UNBOUNDED PRECEDING)),
b AS (SELECT field_name, arg_max(c, filled) FILTER (k::double / filled >= 0.66 - 1e-12) AS t FROM w GROUP BY field_name)
SELECT 'm' AS method_label, n.field_name, nullif(any_value(b.t), '-inf'::double) AS threshold, count(t.covered) AS n_test, round(coalesce(count(*) FILTER (t.covered AND t.confidence >= b.t), 0)::double / count(t.covered), 9) AS test_coverage,
       round(count(*) FILTER (t.covered AND t.confidence >= b.t AND t.field_correct)::double / nullif(count(*) FILTER (t.covered AND t.confidence >= b.t), 0), 9) AS test_accuracy
FROM n LEFT JOIN b USING (field_name) LEFT JOIN t USING (field_name) GROUP BY n.field_name
"""


def confidence_percentile(spark, sf_dir):
    rows = event_rows(spark, sf_dir).filter("confidence is not null").select("event_id", "field_name", "confidence", "user_id")
    got = gating.confidence_percentile(rows, rows.filter("user_id % 2 = 0"), ["field_name"])
    return got.select("event_id", F.round("percentile", 9).alias("percentile"))


CONFIDENCE_PERCENTILE = EVENTS + """, r AS (SELECT field_name, confidence, count(*) AS c FROM e WHERE user_id % 2 = 0 AND confidence IS NOT NULL GROUP BY ALL)
SELECT event_id, round((SELECT coalesce(sum(c), 0) FROM r WHERE r.field_name = e.field_name AND r.confidence <= e.confidence)::double / (SELECT sum(c) FROM r WHERE r.field_name = e.field_name), 9) AS percentile FROM e WHERE confidence IS NOT NULL
"""


def crosscheck_reads(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("c", F.round("o_totalprice").cast("bigint"))
    k = F.col("o_orderkey")
    base = o.select(F.format_string("s%d", k).alias("scene_id"), F.lit(0).alias("check_index"), F.lit("crnn").alias("method_label"), k.alias("k"), "c", F.when(k % 4 > 0, (k % 50) / F.lit(100.0)).alias("confidence"))
    kk = F.col("k")
    numeric = base.withColumn("field_name", F.lit("amount_numeric")).withColumn("pred_text", F.when(kk % 5 == 0, "smudge").otherwise(F.format_string("$%d.00", "c")))
    words = base.withColumn("field_name", F.lit("amount_words")).withColumn("pred_text", F.when(kk % 7 == 0, "??").otherwise(F.concat(t.spell_dollars(F.when(kk % 3 == 0, F.col("c") + 1).otherwise(F.col("c"))), F.lit(" and no/100"))))
    return numeric.unionAll(words).drop("c")


def amount_crosscheck(spark, sf_dir):
    got = combination.cross_check(crosscheck_reads(spark, sf_dir)).filter("field_name = 'amount_numeric'")
    return got.select("k", "method_label", "pred_text", F.round("confidence", 9).alias("confidence"))


AMOUNT_CROSSCHECK = """
WITH o AS (SELECT o_orderkey AS k, round(o_totalprice)::bigint AS c, CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 50) / 100.0::double ELSE 0 END AS c0 FROM orders)
SELECT k, 'crnn+xcheck' AS method_label, CASE WHEN k % 5 = 0 THEN CASE WHEN k % 7 = 0 THEN 'smudge' ELSE printf('%d.00', c + (k % 3 = 0)::int) END ELSE printf('$%d.00', c) END AS pred_text,
       round(CASE WHEN k % 5 <> 0 AND k % 7 <> 0 AND k % 3 <> 0 THEN 0.9 + 0.1 * c0 ELSE 0.5 * c0 END, 9) AS confidence FROM o
"""


def wide_reads(spark, sf_dir):
    e = F.col("event_id")
    rows = read(spark, sf_dir, "events").select(e.cast("string").alias("row_key"), e)
    a = rows.select("row_key", F.lit("a").alias("method_label"), F.concat(F.lit("a"), e).alias("pred_text"), F.when(e % 4 > 0, (e * 7 % 100) / F.lit(100.0)).alias("confidence"), (e % 5).cast("double").alias("latency_ms"))
    b = rows.select("row_key", F.lit("b").alias("method_label"), F.concat(F.lit("b"), e).alias("pred_text"), ((e * 3 % 100) / F.lit(100.0)).alias("confidence"), F.when(e % 3 > 0, 2.0).alias("latency_ms"))
    return combination.aligned(a.unionAll(b), ["a", "b"])


WIDE = """
WITH e AS (SELECT event_id::varchar AS row_key, event_id AS k, CASE WHEN event_id % 4 > 0 THEN (event_id * 7 % 100) / 100.0::double END AS ca, (event_id * 3 % 100) / 100.0::double AS cb, (event_id % 5)::double AS la, CASE WHEN event_id % 3 > 0 THEN 2.0::double END AS lb FROM events),
x AS (SELECT *, coalesce(ca, 0) AS a0, coalesce(lb, 0) AS b0 FROM e)
"""


def combine_maxconf(spark, sf_dir):
    return combination.max_confidence(wide_reads(spark, sf_dir), ["a", "b"])


COMBINE_MAXCONF = WIDE + "SELECT row_key, CASE WHEN a0 >= cb THEN 'a' ELSE 'b' END AS source, CASE WHEN a0 >= cb THEN 'a' ELSE 'b' END || k AS pred_text, CASE WHEN a0 >= cb THEN ca ELSE cb END AS confidence, la + b0 AS latency_ms FROM x"


def combine_cascade(spark, sf_dir):
    return combination.cascade(wide_reads(spark, sf_dir), "a", "b")


COMBINE_CASCADE = WIDE + "SELECT row_key, CASE WHEN a0 < 0.9 THEN 'b' ELSE 'a' END AS source, CASE WHEN a0 < 0.9 THEN 'b' ELSE 'a' END || k AS pred_text, CASE WHEN a0 < 0.9 THEN cb ELSE ca END AS confidence, la + CASE WHEN a0 < 0.9 THEN b0 ELSE 0 END AS latency_ms FROM x"


def combine_route(spark, sf_dir):
    return combination.route(wide_reads(spark, sf_dir), F.col("row_key").try_cast("bigint") % 6 < 2, "b", "a")


COMBINE_ROUTE = WIDE + "SELECT row_key, CASE WHEN k % 6 < 2 THEN 'b' ELSE 'a' END AS source, CASE WHEN k % 6 < 2 THEN 'b' ELSE 'a' END || k AS pred_text, CASE WHEN k % 6 < 2 THEN cb ELSE ca END AS confidence, CASE WHEN k % 6 < 2 THEN b0 ELSE la END AS latency_ms FROM x"


def known_names(spark, sf_dir):
    """A list of names such as an operator keeps: the suppliers' nations."""
    return read(spark, sf_dir, "nation").select(F.concat(F.lit("Cooperative "), F.initcap("n_name")).alias("name"), F.col("n_nationkey").alias("place"))


def payer_snap(spark, sf_dir):
    c = read(spark, sf_dir, "customer").join(known_names(spark, sf_dir), F.col("c_nationkey") == F.col("place"))
    k = F.col("c_custkey")
    reads = c.select("c_custkey", by_style(k, F.col("name"), F.concat(F.lit("x"), F.substring("name", 2, 100)), F.upper("name"), F.concat(F.lit("someone else "), k.cast("string")), F.concat("name", F.lit("abcdef"))).alias("read"))
    return combination.payer_snap(reads, known_names(spark, sf_dir)).select("c_custkey", "name", "distance")


PAYER_SNAP = """
WITH n AS (SELECT 'Cooperative ' || upper(left(n_name, 1)) || lower(substr(n_name, 2)) AS name, n_nationkey AS place FROM nation),
r AS (SELECT c_custkey, lower(CASE c_custkey % 5 WHEN 0 THEN name WHEN 1 THEN 'x' || substr(name, 2) WHEN 2 THEN upper(name) WHEN 3 THEN 'someone else ' || c_custkey ELSE name || 'abcdef' END) AS rd FROM customer JOIN n ON c_nationkey = place),
d AS (SELECT c_custkey, name, place, levenshtein(rd, lower(name)) AS d, least(3, greatest(1, length(rd) // 8)) AS b FROM r, n),
x AS (SELECT c_custkey, arg_min(struct_pack(name := name, d := d), d * 1000 + place) AS m FROM d WHERE d <= b GROUP BY c_custkey)
SELECT c.c_custkey, m.name AS name, m.d::int AS distance FROM customer c LEFT JOIN x USING (c_custkey)
"""


def payee_snap_wratio(spark, sf_dir):
    names = known_names(spark, sf_dir)
    reads = read(spark, sf_dir, "supplier").join(names, F.col("s_nationkey") == F.col("place")).select("s_suppkey", by_style(F.col("s_suppkey"), F.lower("name"), F.concat(F.substring("name", 13, 50), F.lit(" Cooperative")), F.col("s_name")).alias("read"))
    return combination.payee_snap(reads, names).select("s_suppkey", "read", "name", F.round("score", 6).alias("score"))


def duplicate_lookup(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    number = F.concat(F.lit("No. 00"), (F.col("o_orderkey") % 97 + 1).cast("string"))
    payer = F.concat(F.lit(" Payer "), (F.col("o_custkey") % 50).cast("string"), F.lit("."))
    history = o.select(number.alias("check_number"), payer.alias("payer"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("batch_date"))
    checks = o.select("o_orderkey", F.when(F.col("o_orderkey") % 10 > 0, number).alias("check_number"), F.upper(payer).alias("payer"))
    return combination.last_seen(checks, history).select("o_orderkey", "last_batch_date")


DUPLICATE_LOOKUP = """
WITH h AS (SELECT o_orderkey % 97 AS n, o_custkey % 50 AS p, max(strftime(o_orderdate, '%Y-%m-%d')) AS last_batch_date FROM orders GROUP BY ALL)
SELECT o_orderkey, CASE WHEN o_orderkey % 10 > 0 THEN last_batch_date END AS last_batch_date FROM orders JOIN h ON o_orderkey % 97 = n AND o_custkey % 50 = p
"""


def autocomplete(spark, sf_dir):
    names = read(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("place"))
    typed = read(spark, sf_dir, "part").select(F.substring(F.split("p_name", " ")[0], 1, 4).alias("typed")).distinct()
    return combination.autocomplete(typed, names)


AUTOCOMPLETE = """
WITH n AS (SELECT p_name AS name, p_partkey AS place, trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS n FROM part), t AS (SELECT DISTINCT left(split_part(p_name, ' ', 1), 4) AS typed FROM part),
m AS (SELECT typed, name, place, CASE WHEN starts_with(n, lower(typed)) THEN 0 WHEN contains(' ' || n, ' ' || lower(typed)) THEN 1 END AS kind FROM t, n WHERE n <> lower(typed) AND length(typed) >= 2),
r AS (SELECT typed, name, row_number() OVER (PARTITION BY typed ORDER BY kind, place) AS rank FROM m WHERE kind IS NOT NULL)
SELECT typed, rank, name FROM r WHERE rank <= 6
"""


def read_struct(text: Column, confidence: Column, hand: Column, reader: Column) -> Column:
    return F.struct(text.alias("text"), confidence.alias("confidence"), hand.alias("handwritten_probability"), reader.alias("reader"), F.array(F.lit(0.0), F.lit(0.0), F.lit(9.0), F.lit(9.0)).alias("box"))


def field_gate_query(spark, sf_dir):
    e = F.col("event_id")
    conf, hand, reader = (e * 7 % 1000) / F.lit(1000.0), (e % 4) / F.lit(4.0), F.when(e % 5 == 0, "trocr").otherwise("crnn")
    rows = read(spark, sf_dir, "events").select(
        "event_id", read_struct(F.when(e % 3 > 0, F.concat(F.lit("No. "), e)).otherwise("none"), conf, hand, reader).alias("check_number"),
        read_struct(F.date_format("ts", "M/d/yyyy"), 0.9 + conf / 10, hand, reader).alias("date"), read_struct(F.lit("rent"), 0.9 + conf / 10, hand, reader).alias("memo"),
        read_struct(F.concat(F.lit("$"), e, F.lit(".00")), conf, F.lit(0.0), F.lit("crnn")).alias("amount_numeric"), read_struct(F.when(e % 6 == 0, "one and no/100").otherwise("smudge"), conf, hand, F.lit("crnn")).alias("amount_words"),
    )
    states = {
        "check_number": field_gate.gate_check_number(F.col("check_number")), "date": field_gate.gate_date(F.col("date"), F.lit("2024-12-31").cast("date")),
        "memo": field_gate.gate_memo(F.col("memo")), "amount": field_gate.gate_amount(F.col("amount_numeric"), F.col("amount_words")),
    }
    return rows.select("event_id", *[c for n, s in states.items() for c in (s["state"].alias(f"{n}_state"), s["value"].alias(f"{n}_value"))], states["amount"]["note"].alias("amount_note"))


FIELD_GATE = """
WITH e AS (SELECT event_id AS e, ts, (event_id * 7 % 1000) / 1000.0::double AS c, event_id % 4 = 3 AND event_id % 5 <> 0 AS unread, event_id % 5 = 0 AS hand FROM events),
s AS (SELECT *,
  CASE WHEN e % 3 = 0 OR unread THEN 'blank' WHEN hand THEN CASE WHEN c >= 0.6 THEN 'unsure' ELSE 'blank' END WHEN c >= 0.5392 THEN 'confident' ELSE 'blank' END AS check_number_state,
  CASE WHEN unread OR abs(datediff('day', ts::date, DATE '2024-12-31')) > 366 THEN 'blank' WHEN hand THEN 'unsure' WHEN 0.9 + c / 10 >= 0.9821 THEN 'confident' WHEN 0.9 + c / 10 >= 0.9548 THEN 'unsure' ELSE 'blank' END AS date_state,
  CASE WHEN unread THEN 'blank' WHEN hand THEN 'unsure' WHEN 0.9 + c / 10 >= 0.9603 THEN 'unsure' ELSE 'blank' END AS memo_state,
  e % 6 = 0 AND e % 4 <> 3 AS words FROM e)
SELECT e AS event_id, check_number_state, CASE WHEN check_number_state = 'blank' THEN '' ELSE e::varchar END AS check_number_value, date_state, CASE WHEN date_state = 'blank' THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS date_value,
       memo_state, CASE WHEN memo_state = 'blank' THEN '' ELSE 'rent' END AS memo_value, CASE WHEN words AND e = 1 THEN 'confident' ELSE 'unsure' END AS amount_state, e || '.00' AS amount_value,
       CASE WHEN words AND e <> 1 THEN 'the written amount reads differently' END AS amount_note FROM s
"""


def tsv_rows(spark, sf_dir):
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.withColumn("note", F.concat(F.lit(" a\t"), "o_orderstatus", F.lit("\r\nb "))).withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return field_gate.tsv_rows(o, ["o_orderkey", "c_name", "day", "note"]).select("o_orderkey", "line")


TSV_ROWS = "SELECT o_orderkey, concat_ws(chr(9), o_orderkey::varchar, c_name, strftime(o_orderdate, '%Y-%m-%d'), 'a ' || o_orderstatus || ' b') AS line FROM orders JOIN customer ON o_custkey = c_custkey"


def ctc_decode(spark, sf_dir):
    labels = F.transform(F.split(F.col("o_orderkey").cast("string"), ""), lambda d: d.cast("int"))
    doubled = F.flatten(F.transform(labels, lambda d: F.array(d, d)))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(t.greedy_ctc(doubled), "").alias("decoded"))


CTC_DECODE = r"SELECT o_orderkey, replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(o_orderkey::varchar, '1+', '1', 'g'), '2+', '2', 'g'), '3+', '3', 'g'), '4+', '4', 'g'), '5+', '5', 'g'), '6+', '6', 'g'), '7+', '7', 'g'), '8+', '8', 'g'), '9+', '9', 'g'), '0', '') AS decoded FROM orders"

def config_grid(spark, sf_dir):
    rows = event_rows(spark, sf_dir).withColumn("config", F.format_string("psm%d", F.col("event_id") % 13))
    got = selection.best_config(rows, ["field_name"], "config")
    return rounded(got, ("accuracy", "cer"), 9)


CONFIG_GRID = EVENTS + """, g AS (SELECT field_name, 'psm' || (event_id % 13) AS config, avg(field_correct::int) AS accuracy, avg(cer) AS cer, count(*) AS n FROM e GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY field_name ORDER BY accuracy DESC, cer, config) AS k FROM g)
SELECT field_name, config, round(accuracy, 9) AS accuracy, round(cer, 9) AS cer, n FROM r WHERE k = 1
"""


def router_table(spark, sf_dir):
    e = F.col("event_id")
    rows = read(spark, sf_dir, "events").select("event_type", (e % 3 > 0).alias("a"), (e % 4 > 0).alias("b"), (e % 7 / F.lit(7.0)).alias("ca"), (e % 5 / F.lit(5.0)).alias("cb"), (F.col("user_id") % 2 == 0).alias("hand"))
    a, b = F.col("a"), F.col("b")
    choices = {"a": a, "b": b, "most_confident": F.when(F.col("ca") >= F.col("cb"), a).otherwise(b), "by_style": F.when(F.col("hand"), b).otherwise(a), "either": a | b}
    return rounded(selection.router_table(rows, choices, ["event_type"]), ("accuracy",), 9)


ROUTER_TABLE = """
WITH r AS (SELECT event_type, event_id % 3 > 0 AS a, event_id % 4 > 0 AS b, event_id % 7 / 7.0::double AS ca, event_id % 5 / 5.0::double AS cb, user_id % 2 = 0 AS hand FROM events),
x AS (SELECT event_type, unnest(['a', 'b', 'most_confident', 'by_style', 'either']) AS choice, unnest([a, b, CASE WHEN ca >= cb THEN a ELSE b END, CASE WHEN hand THEN b ELSE a END, a OR b]) AS ok FROM r)
SELECT event_type, choice, count(*) AS n, round(avg(ok::int), 9) AS accuracy FROM x GROUP BY ALL
"""


def method_table(spark, sf_dir):
    return selection.method_table(event_rows(spark, sf_dir), ["signup", "error", "click", "view", "purchase"])


METHOD_TABLE = EVENTS + "SELECT method_label, " + ", ".join(f"round(100 * avg(field_correct::int) FILTER (field_name = '{f}'), 3) AS {f}" for f in ("signup", "error", "click", "view", "purchase")) + " FROM e GROUP BY method_label"


#: name: (query, SQL or none)
PAIRS = {
    "reading_accuracy": (reading_accuracy, READING_ACCURACY),
    "parse_amount_numeric": (parse_amount_numeric, PARSE_AMOUNT_NUMERIC),
    "parse_amount_words": (parse_amount_words, PARSE_AMOUNT_WORDS),
    "spell_amount": (spell_amount, SPELL_AMOUNT),
    "parse_date": (parse_date, PARSE_DATE),
    "parse_check_number": (parse_check_number, PARSE_CHECK_NUMBER),
    "normalize_free_text": (normalize_free_text, NORMALIZE_FREE_TEXT),
    "cer_wer": (cer_wer, CER_WER),
    "clean_ocr_token": (clean_ocr_token, CLEAN_OCR_TOKEN),
    "score_rows": (score_rows, SCORE_ROWS),
    "summary_by_field": (summary_by_field, SUMMARY_BY_FIELD),
    "breakdown_sets": (breakdown_sets, BREAKDOWN_SETS),
    "pivot_methods_fields": (pivot_methods_fields, PIVOT_METHODS_FIELDS),
    "hard_set_flags": (hard_set_flags, HARD_SET_FLAGS),
    "gating_points": (gating_points, GATING_POINTS),
    "gating_summary": (gating_summary, GATING_SUMMARY),
    "frozen_threshold": (frozen_threshold, FROZEN_THRESHOLD),
    "confidence_percentile": (confidence_percentile, CONFIDENCE_PERCENTILE),
    "amount_crosscheck": (amount_crosscheck, AMOUNT_CROSSCHECK),
    "combine_maxconf": (combine_maxconf, COMBINE_MAXCONF),
    "combine_cascade": (combine_cascade, COMBINE_CASCADE),
    "combine_route": (combine_route, COMBINE_ROUTE),
    "payer_snap": (payer_snap, PAYER_SNAP),
    "payee_snap_wratio": (payee_snap_wratio, None),
    "duplicate_lookup": (duplicate_lookup, DUPLICATE_LOOKUP),
    "autocomplete": (autocomplete, AUTOCOMPLETE),
    "field_gate": (field_gate_query, FIELD_GATE),
    "tsv_rows": (tsv_rows, TSV_ROWS),
    "ctc_decode": (ctc_decode, CTC_DECODE),
    "config_grid": (config_grid, CONFIG_GRID),
    "router_table": (router_table, ROUTER_TABLE),
    "method_table": (method_table, METHOD_TABLE),
}
