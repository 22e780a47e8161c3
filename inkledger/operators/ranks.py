"""Running totals, ranks and percentiles of groups of any size, in two levels.

A group is cut into buckets that follow its order, each a window of its own;
what lies ahead of a bucket comes from one row per bucket. No task holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS = 1024


def unit_bucket(value: Column) -> Column:
    """A bucket of a value that is mostly in [0, 1); it never falls as the value grows. Null stays null."""
    return F.least(F.greatest(F.floor(value * BUCKETS), F.lit(0)), F.lit(BUCKETS - 1)).cast("int")


def running(rows: DataFrame, by: list[str], bucket: Column, order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """Each name of `sums` as the sum of its column up to this row in order, and all_<name> as the group's.

    `bucket` may not fall along the order and is never null; rows that are equal in order come in any order.
    """
    keyed = rows.withColumns({"_bucket": bucket, **{f"_v_{n}": c for n, c in sums.items()}})
    sizes = keyed.groupBy(*by, "_bucket").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums])
    group = [F.col(b) for b in by] or [F.lit(1)]
    before, whole = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*group)
    ahead = sizes.select(
        *[F.col(b).alias(f"_of_{b}") for b in by], F.col("_bucket").alias("_of"),
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_a_{n}") for n in sums], *[F.sum(f"_s_{n}").over(whole).alias(f"all_{n}") for n in sums],
    )
    inside = W.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    on = [F.col(b).eqNullSafe(F.col(f"_of_{b}")) for b in by] + [F.col("_bucket") == F.col("_of")]
    both = keyed.withColumns({f"_r_{n}": F.sum(f"_v_{n}").over(inside) for n in sums}).join(ahead, on)
    found = both.withColumns({n: F.col(f"_a_{n}") + F.col(f"_r_{n}") for n in sums})
    return found.drop("_bucket", "_of", *[f"_of_{b}" for b in by], *[f"{p}{n}" for n in sums for p in ("_v_", "_r_", "_a_")])


def percentiles(rows: DataFrame, by: list[str], value: Column, wanted: dict[str, float], cuts: int = 64) -> DataFrame:
    """Per group the exact percentiles of a number by linear interpolation, nulls left out; a group without values has no row.

    Distinct values are counted first; a sketch only says where buckets end, the result does not depend on it.
    """
    counted = rows.select(*by, value.cast("double").alias("_x")).filter("_x is not null").groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_c"))
    ends = counted.groupBy(*[F.col(b).alias(f"_e_{b}") for b in by]).agg(F.percentile_approx("_x", [k / cuts for k in range(1, cuts)], 1000).alias("_ends"))
    on = [F.col(b).eqNullSafe(F.col(f"_e_{b}")) for b in by]
    cut = counted.join(ends, on) if on else counted.crossJoin(ends)  # without groups `ends` is one row
    run = running(cut, by, F.size(F.filter("_ends", lambda e: e < F.col("_x"))), ["_x"], {"_n": F.col("_c")})
    upto, n = F.col("_n"), F.col("all__n")
    at = lambda place: F.max(F.when((place < upto) & (place >= upto - F.col("_c")), F.col("_x")))
    named = list(wanted.items())
    found = run.groupBy(*by).agg(
        F.max(n).alias("_all"), *[at(F.floor((n - 1) * q)).alias(f"_lo{i}") for i, (_, q) in enumerate(named)], *[at(F.ceil((n - 1) * q)).alias(f"_hi{i}") for i, (_, q) in enumerate(named)]
    )

    def between(i: int, q: float) -> Column:
        place, low, high = (F.col("_all") - 1) * q, F.col(f"_lo{i}"), F.col(f"_hi{i}")
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return found.select(*by, *[between(i, q).alias(name) for i, (name, q) in enumerate(named)])
