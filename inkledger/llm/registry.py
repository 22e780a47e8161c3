"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkledger.llm import exact_dedup, jaccard, language, lm, mixing, pieces, quality, substrings, toxicity, warc
from inkledger.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), width=3, percent=90)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    judged = quality.judge(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"), "posterior")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(table(spark, sf_dir, "pages")))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.positions(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "position")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_lm_scoring, op3_ngram_jaccard, op4_substring_dedup, op5_quality_rules, op6_warc, op7_sentencepiece, op8_toxicity, op9_exact_dedup, op10_mixing)}


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i+2], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = d.doc_id
GROUP BY d.doc_id, n.n
"""

OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i+49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM s),
c AS (SELECT doc_id, list(i) AS starts FROM m WHERE first < doc_id GROUP BY doc_id),
g AS (SELECT DISTINCT doc_id, unnest(flatten(list_transform(starts, lambda i: range(i, i + 50)))) AS p FROM c),
r AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id),
k AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed,
         CASE WHEN gone IS NULL THEN ws ELSE list_transform(list_sort(list_where(range(1, len(ws) + 1), list_transform(range(1, len(ws) + 1), lambda x: NOT list_contains(gone, x)))), lambda x: ws[x]) END AS kept
  FROM w LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words::bigint AS n_words, n_removed::bigint AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""

OP9_SQL = r"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint AS size,
         ('0x' || substr(md5(doc_id::varchar), 1, 12))::bigint AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::bigint AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place
  FROM d GROUP BY source),
w AS (
  SELECT *, [5.0, 2.0, 1.0][place + 1]::double AS weight, [-0.6, 0.0, 0.6][place + 1]::double AS slope, source_size::double * 3 AS cap FROM s),
f AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS rank,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))::double
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT *, coalesce(least(cap, (SELECT arg_min(level, rank) FROM f WHERE level * weight <= cap) * weight), cap) AS target FROM f),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.slope,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::bigint AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE
           (ahead + size / 2 <= target)::int + (source_size + ahead + size / 2 <= target)::int + (2 * source_size + ahead + size / 2 <= target)::int END AS copies,
         CASE WHEN target > 0 THEN least(ahead / target, 1.0) ELSE 1.0 END AS share
  FROM r)
SELECT doc_id, size, source_size, target, (size * copies)::bigint AS taken, copies,
       CASE WHEN slope = 0 THEN share ELSE 2 * share / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * share)) END AS position
FROM c
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_jaccard": OP3_SQL, "op4_substring_dedup": OP4_SQL, "op9_exact_dedup": OP9_SQL, "op10_mixing": OP10_SQL}
