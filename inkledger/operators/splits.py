"""Deterministic splits of ids, scene counts, regime mixes and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkledger.functions.hashing import md5_number, split_score
from inkledger.operators.ranks import BUCKETS, running, unit_bucket

TRAIN, VAL, TEST = "train", "val", "eval"
SHARE, OPEN_POOL = 0.15, 50
SALTS = {"template": 11, "background": 23, "handwriting": 37, "signature": 41, "payee": 43, "bank": 47}
BLOCK = 20
MIX = (("wide", 0.40), ("close", 0.45), ("single", 0.15))


def held_out_count(n: Column) -> Column:
    """15%, half to even, at least one."""
    return F.greatest(F.lit(1), F.bround(n * SHARE).cast("int"))


def dealt(ids: DataFrame, score: Column, by: list[str]) -> DataFrame:
    """`deal` with the size of each group in `group_size`."""
    later = (~F.col("held_first")).cast("int")
    bucket = later * BUCKETS + F.coalesce(unit_bucket(F.col("score")), F.lit(0))
    rows = running(ids.withColumn("score", score), by, bucket, [later, "score", "id"], {"rank": F.lit(1), "held": F.col("held_first").cast("int")})
    rows = rows.withColumnRenamed("all_rank", "group_size").withColumn("e", held_out_count(F.col("group_size")))
    rows = rows.withColumn("e", F.when(2 * F.col("e") >= F.col("group_size"), 1).otherwise(F.col("e"))).withColumn("v", F.greatest(F.col("e"), F.col("all_held") - F.col("e")))
    return rows.withColumn("split", F.when(F.col("rank") <= F.col("e"), TEST).when(F.col("rank") <= F.col("e") + F.col("v"), VAL).otherwise(TRAIN)).drop("held", "all_held", "rank", "e", "v")


def deal(ids: DataFrame, score: Column, by: list[str]) -> DataFrame:
    """Rank each group by (held first, score, id): the first go to eval, the next to val, the rest to train. Groups of one stay whole in train.

    ids: id, held_first and the group columns. Groups of any size: ranks are made in two levels, by buckets of the score.
    """
    return dealt(ids, score, by).drop("group_size")


def by_threshold(ids: DataFrame, score: Column) -> DataFrame:
    """Open pools of many ids: by score alone, so an id never moves when others come."""
    s = F.col("score")
    return ids.withColumn("score", score).withColumn("split", F.when(s < SHARE, TEST).when(s < 2 * SHARE, VAL).otherwise(TRAIN))


def stratified(ids: DataFrame, score: Column, stratum: str, least: int = 3) -> DataFrame:
    """Deal each stratum on its own; strata under `least` ids are pooled, and a pool still under it gives its held-first ids to eval."""
    size = ids.groupBy(F.col(stratum).alias("of")).agg(F.count(F.lit(1)).alias("size"))
    rows = ids.join(size, F.col(stratum).eqNullSafe(F.col("of"))).drop("of")
    pooled = rows.withColumn("pool", F.when(F.col("size") < least, F.lit("")).otherwise(F.concat(F.lit("="), F.col(stratum).cast("string"))))
    small = F.col("group_size") < least
    return dealt(pooled, score, ["pool"]).withColumn("split", F.when(small & F.col("held_first"), TEST).when(small, TRAIN).otherwise(F.col("split"))).drop("size", "pool", "group_size")


def scene_counts(total: Column) -> Column:
    """struct(train, val, eval) of a number of scenes."""
    part = F.greatest(F.when(total >= 3, 1).otherwise(0), F.floor(total * SHARE)).cast("int")
    return F.struct((total - 2 * part).alias("train"), part.alias("val"), part.alias("eval"))


def block_counts(mix: tuple[tuple[str, float], ...] = MIX, block: int = BLOCK) -> dict[str, int]:
    """Scenes of each regime in a block, by largest remainder."""
    if any(s < 0 for _, s in mix) or abs(sum(s for _, s in mix) - 1) > 1e-6:
        raise ValueError("shares must be at least 0 and sum to 1")
    counts = {name: int(share * block + 1e-9) for name, share in mix}
    rest = sorted(range(len(mix)), key=lambda k: (-(mix[k][1] * block - counts[mix[k][0]]), k))
    for k in rest[: block - sum(counts.values())]:
        counts[mix[k][0]] += 1
    return counts


def regime_mix(scenes: DataFrame, seed: int = 0, mix: tuple[tuple[str, float], ...] = MIX, block: int = BLOCK) -> DataFrame:
    """Scenes (split, idx) with a regime: exact counts in each whole block, in hash order of seed, split, block and place."""
    name = F.concat_ws("|", F.lit(seed), "split", F.floor(F.col("idx") / block).cast("string"), (F.col("idx") % block).cast("string"))
    rows = scenes.withColumn("block", F.floor(F.col("idx") / block).cast("bigint"))
    rank = F.row_number().over(W.partitionBy("split", "block").orderBy(md5_number(name), "idx"))
    chain, low = None, 0
    for regime, n in block_counts(mix, block).items():
        low += n
        chain = F.when(F.col("rank") <= low, regime) if chain is None else chain.when(F.col("rank") <= low, regime)
    return rows.withColumn("rank", rank).withColumn("regime", chain).drop("rank")


def stratified_sample(rows: DataFrame, by: list[str], key: Column, cap: int) -> DataFrame:
    """At most `cap` rows a stratum, by hash of the key: reproducible, and an operator that samples by design."""
    return rows.withColumn("h", md5_number(key.cast("string"))).withColumn("k", F.row_number().over(W.partitionBy(*by).orderBy("h", key))).filter(F.col("k") <= cap).drop("h", "k")


def weighted_choice(score: Column, weights: dict[str, float]) -> Column:
    """A name by a score in [0, 1) and weights."""
    total, low, chain = sum(weights.values()), 0.0, None
    for name, w in weights.items():
        low += w / total
        chain = F.when(score < low, name) if chain is None else chain.when(score < low, name)
    return chain.otherwise(list(weights)[-1])


def plan_differences(plan: DataFrame, recorded: DataFrame) -> DataFrame:
    """Keys whose values differ, or that one side lacks. Both: key, value."""
    both = plan.withColumnRenamed("value", "planned").join(recorded.withColumnRenamed("value", "recorded"), "key", "full")
    return both.filter(~F.col("planned").eqNullSafe(F.col("recorded")))


def default_score(kind: str, seed: int, key: Column) -> Column:
    return split_score(seed, SALTS[kind], key)
