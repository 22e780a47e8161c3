"""Pairs of vectors that correlate, and admission of new ones in order.

Vectors are compared inside their group in blocks: a pair of blocks is one
matrix product in a task of its own, and only pairs over the threshold leave it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1024


def unit(vectors: pd.Series, centred: bool = False) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x - x.mean(axis=1, keepdims=True) if centred else x
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def pairs_in(least: float, centred: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def near(group: pd.DataFrame) -> pd.DataFrame:
        i, j = group["i"].iloc[0], group["j"].iloc[0]
        left, right = group[group["block"] == i], group[group["block"] == j]
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": [], "score": []})
        score = unit(left["embedding"], centred) @ unit(right["embedding"], centred).T
        x, y = np.nonzero(score >= least)
        a, b = left["vec_id"].to_numpy()[x], right["vec_id"].to_numpy()[y]
        keep = a < b if i == j else np.ones(len(a), bool)
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "score": score[x, y][keep]})

    return near


def near_pairs(vectors: DataFrame, by: str, least: float, centred: bool = False) -> DataFrame:
    """a, b, score of pairs with a cosine of at least `least` inside a group. vectors: vec_id, embedding and the group."""
    sizes = vectors.groupBy(F.col(by).alias("of")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = vectors.join(sizes, F.col(by).eqNullSafe(F.col("of"))).drop("of").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    other = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = other.select("vec_id", "embedding", F.col(by).alias("g"), "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return spread.groupBy("g", "i", "j").applyInPandas(pairs_in(least, centred), "a bigint, b bigint, score double")


def admitted(vectors: DataFrame, pairs: DataFrame, spark_rounds: int = 50) -> DataFrame:
    """Vectors admitted in id order: one stays unless it pairs with a smaller one that stays.

    Each round settles the vectors whose smaller partners are all settled.
    """
    state = vectors.select("vec_id").withColumn("kept", F.lit(None).cast("boolean"))
    edges = pairs.select("a", "b")
    for _ in range(spark_rounds):
        known = edges.join(state.withColumnRenamed("vec_id", "a"), "a").groupBy(F.col("b").alias("vec_id")).agg(F.coalesce(F.bool_or("kept"), F.lit(False)).alias("beaten"), F.bool_or(F.col("kept").isNull()).alias("open"))
        settled = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("beaten", F.lit(False)), False).when(F.coalesce("open", F.lit(False)), F.lit(None)).otherwise(True)
        state = state.join(known, "vec_id", "left").select("vec_id", settled.cast("boolean").alias("kept")).checkpoint()
        if state.filter("kept is null").isEmpty():
            return state
    raise RuntimeError("admission did not settle")
