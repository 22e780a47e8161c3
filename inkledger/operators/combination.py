"""Combining the reads of several methods, amount cross-checks, and snaps to known names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkledger.functions import text as t
from inkledger.functions.fuzzy import SNAP_SCORE, best_weighted, edit_budget

CASCADE = 0.9
#: Names that a read is scored against at once, and the longest beginning that is a key of autocompletion.
NAME_BLOCK, BEGINNING = 1000, 8


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def aligned(reads: DataFrame, methods: list[str]) -> DataFrame:
    """One row per row_key that all methods have, a struct column per method. One shuffle for any number of methods."""
    fields = [c for c in reads.columns if c not in ("row_key", "method_label")]
    wide = reads.filter(F.col("method_label").isin(*methods)).groupBy("row_key").pivot("method_label", methods).agg(F.first(F.struct(*fields)))
    return wide.dropna(subset=methods)


def max_confidence(wide: DataFrame, methods: list[str]) -> DataFrame:
    """The most confident read, the first method of equal ones; latencies add up."""
    top = F.greatest(*[zero(F.col(m)["confidence"]) for m in methods])
    chosen = F.coalesce(*[F.when(zero(F.col(m)["confidence"]) == top, F.struct(F.lit(m).alias("source"), F.col(m).alias("r"))) for m in methods])
    spent = sum((zero(F.col(m)["latency_ms"]) for m in methods[1:]), zero(F.col(methods[0])["latency_ms"]))
    return wide.select("row_key", chosen.alias("chosen"), spent.alias("latency_ms")).select("row_key", F.col("chosen.source").alias("source"), F.col("chosen.r.pred_text").alias("pred_text"), F.col("chosen.r.confidence").alias("confidence"), "latency_ms")


def cascade(wide: DataFrame, first: str, other: str, floor: float = CASCADE) -> DataFrame:
    """The first read unless its confidence is under the floor; the other's latency counts only when used."""
    falls = zero(F.col(first)["confidence"]) < floor
    pick = lambda k: F.when(falls, F.col(other)[k]).otherwise(F.col(first)[k])
    spent = zero(F.col(first)["latency_ms"]) + F.when(falls, zero(F.col(other)["latency_ms"])).otherwise(0.0)
    return wide.select("row_key", F.when(falls, other).otherwise(first).alias("source"), pick("pred_text").alias("pred_text"), pick("confidence").alias("confidence"), spent.alias("latency_ms"))


def route(wide: DataFrame, rule: Column, yes: str, no: str) -> DataFrame:
    """One method where the rule holds, another where not or unknown."""
    rule = F.coalesce(rule, F.lit(False))
    pick = lambda k: F.when(rule, F.col(yes)[k]).otherwise(F.col(no)[k])
    return wide.select("row_key", F.when(rule, yes).otherwise(no).alias("source"), pick("pred_text").alias("pred_text"), pick("confidence").alias("confidence"), zero(pick("latency_ms")).alias("latency_ms"))


def cross_check(reads: DataFrame) -> DataFrame:
    """Numeric amounts against the words of the same check: agreement lifts confidence, anything else halves it, and words stand in for digits that do not parse.

    reads: scene_id, check_index, field_name, pred_text, confidence, method_label.
    """
    words = reads.filter(F.col("field_name") == "amount_words").select("scene_id", "check_index", "method_label", t.parse_amount_words(F.col("pred_text")).alias("words_cents"))
    numeric = reads.filter(F.col("field_name") == "amount_numeric").withColumn("cents", t.parse_amount_numeric(F.col("pred_text")))
    both = numeric.join(words, ["scene_id", "check_index", "method_label"], "left")
    agree, c0 = F.coalesce(F.col("cents") == F.col("words_cents"), F.lit(False)), zero(F.col("confidence"))
    recovered = F.col("cents").isNull() & F.col("words_cents").isNotNull()
    checked = both.withColumn("pred_text", F.when(recovered, t.format_cents(F.col("words_cents"))).otherwise(F.col("pred_text"))).withColumn("confidence", F.when(agree, 0.9 + 0.1 * c0).otherwise(0.5 * c0)).drop("cents", "words_cents")
    rest = reads.filter(F.coalesce(F.col("field_name") != "amount_numeric", F.lit(True)))
    return rest.unionByName(checked).withColumn("method_label", F.concat("method_label", F.lit("+xcheck")))


def piece_keys(known: Column) -> Column:
    """For each budget, the pieces of a name: budget + 1 of them, so that edits within the budget leave one whole."""
    size = F.length(known)

    def of(budget: int) -> list[Column]:
        cuts = [F.floor(size * i / (budget + 1)).cast("int") for i in range(budget + 2)]
        return [F.struct(F.lit(budget).alias("budget"), size.alias("size"), F.lit(i).alias("i"), F.substr(known, cuts[i] + 1, cuts[i + 1] - cuts[i]).alias("piece")) for i in range(budget + 1)]

    return F.array(*[k for budget in (1, 2, 3) for k in of(budget)])


def probe_keys(read: Column, budget: Column) -> Column:
    """The pieces that a name within the budget could share with a read: every size, piece and shift that the edits allow."""
    length = F.length(read)

    def shifted(size: Column, i: Column, low: Column, high: Column) -> Column:
        starts = F.filter(F.transform(F.sequence(-budget, budget), lambda d: low + d), lambda s: (s >= 0) & (s + high - low <= length))
        return F.transform(starts, lambda s: F.struct(budget.alias("budget"), size.alias("size"), i.alias("i"), F.substr(read, s + 1, high - low).alias("piece")))

    def pieces(size: Column) -> Column:
        cut = lambda i: F.floor(size * i / (budget + 1)).cast("int")
        return F.flatten(F.transform(F.sequence(F.lit(0), budget), lambda i: shifted(size, i, cut(i), cut(i + 1))))

    sizes = F.sequence(F.greatest(F.lit(0), length - budget), length + budget)
    return F.array_distinct(F.flatten(F.transform(sizes, pieces)))


def payer_snap(reads: DataFrame, names: DataFrame) -> DataFrame:
    """The nearest known name within the edit budget, earliest of equal ones.

    reads: read; names: name, place. Distinct reads meet only names that share a piece at a place the budget allows; distances are exact.
    """
    plain = reads.select("read").distinct().withColumn("plain", t.normalize_free_text(F.col("read"))).filter("plain <> ''")
    known = names.select("name", "place", t.normalize_free_text(F.col("name")).alias("known"))
    keyed = known.withColumn("key", F.explode(piece_keys(F.col("known"))))
    near = plain.withColumn("key", F.explode(probe_keys(F.col("plain"), edit_budget(F.col("plain"))))).join(keyed, "key").drop("key")
    apart = near.withColumn("distance", F.levenshtein("plain", "known", 3)).filter((F.col("distance") >= 0) & (F.col("distance") <= edit_budget(F.col("plain"))))
    best = apart.groupBy("read").agg(F.min(F.struct("distance", "place", "name")).alias("b")).select("read", F.col("b.name").alias("name"), F.col("b.distance").alias("distance"))
    return reads.join(best, "read", "left")


def payee_snap(reads: DataFrame, names: DataFrame, least: float = SNAP_SCORE) -> DataFrame:
    """The name of best weighted ratio if it reaches `least`, earliest of equal ones.

    The ratio has no key that all its pairs share, so each distinct read is scored against the whole list, a block of names at a time: a row per read and block, not per pair.
    """
    dealt = names.select("name", "place", F.floor(F.col("place") / NAME_BLOCK).alias("block"))
    blocks = dealt.groupBy("block").agg(F.collect_list(F.struct("name", F.col("place").cast("bigint").alias("place"))).alias("names")).select("names")
    scored = reads.select("read").distinct().join(blocks).select("read", best_weighted("read", "names").alias("x"))
    best = scored.groupBy("read").agg(F.min(F.struct((-F.col("x.score")).alias("s"), F.col("x.place").alias("place"), F.col("x.name").alias("name"))).alias("b"))
    return reads.join(best.select("read", F.when(-F.col("b.s") >= least, F.col("b.name")).alias("name"), (-F.col("b.s")).alias("score")), "read", "left")


def last_seen(checks: DataFrame, history: DataFrame) -> DataFrame:
    """The latest batch date among history entries of the same number and payer, both normalized and present."""
    key = lambda number, payer: [t.parse_check_number(F.col(number)).alias("k_number"), F.nullif(t.normalize_free_text(F.col(payer)), F.lit("")).alias("k_payer")]
    past = history.select(*key("check_number", "payer"), "batch_date").dropna().groupBy("k_number", "k_payer").agg(F.max("batch_date").alias("last_batch_date"))
    return checks.select("*", *key("check_number", "payer")).join(past, ["k_number", "k_payer"], "left").drop("k_number", "k_payer")


def autocomplete(typed: DataFrame, names: DataFrame, most: int = 6) -> DataFrame:
    """Up to `most` names for each typed text: those that begin with it, then those with a word that does, each in list order.

    Texts meet only names with a beginning in common, of the text's own length up to BEGINNING characters. Of names that are equal when normalized only the first `most` can be wanted. The list with its beginnings is many times its estimated size, so it is never broadcast.
    """
    t_plain, n_plain = t.normalize_free_text(F.col("typed")), t.normalize_free_text(F.col("name"))
    asked = typed.select("typed", t_plain.alias("t")).distinct().filter(F.length("t") >= 2)
    asked = asked.withColumn("key", F.left("t", F.lit(BEGINNING)))
    starts = F.concat(F.array(F.col("n")), F.split("n", " "))
    beginnings = F.flatten(F.transform(starts, lambda s: F.transform(F.sequence(F.lit(2), F.lit(BEGINNING)), lambda k: F.left(s, k))))
    equal = F.row_number().over(W.partitionBy("n").orderBy("place"))
    known = names.select("name", "place", n_plain.alias("n")).withColumn("equal", equal).filter(F.col("equal") <= most).drop("equal")
    known = known.withColumn("key", F.explode(F.array_distinct(beginnings))).hint("merge")
    rank = F.when(F.col("n").startswith(F.col("t")), 0).when(F.exists(F.split("n", " "), lambda w: w.startswith(F.col("t"))), 1)
    met = asked.join(known, "key").drop("key").filter("n <> t").withColumn("kind", rank).filter("kind is not null")
    return met.withColumn("rank", F.row_number().over(W.partitionBy("typed").orderBy("kind", "place"))).filter(F.col("rank") <= most).select("typed", "rank", "name")


def add_names(known: DataFrame, new: DataFrame, most: int = 1000) -> DataFrame:
    """The list with names not yet in it, compared normalized, first spelling kept; the last `most` stay. Columns name, seq."""
    both = known.select("name", "seq").unionByName(new.select("name", "seq")).withColumn("key", t.normalize_free_text(F.col("name"))).filter("key <> ''")
    first = both.groupBy("key").agg(F.min(F.struct("seq", "name")).alias("f")).select(F.col("f.seq").alias("seq"), t.collapse(F.col("f.name")).alias("name"))
    return first.orderBy(F.desc("seq")).limit(most)
