"""Weighted string similarity (0 to 100) as an Arrow UDF, and the native bounded-edit snap.

The score is a maximum of scaled part scores built on Indel similarity: whole
strings, best window, sorted words, and word sets. Apply the UDF to distinct
pairs.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Scales of the part scores, the length ratios between which windows count, and the least score of a snap.
WORDS_SCALE, NEAR, FAR, PART, LONG_PART = 0.95, 1.5, 8.0, 0.9, 0.6
SNAP_SCORE = 60

BEST = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("place", T.LongType()), T.StructField("name", T.StringType())])


def common_length(a: str, b: str) -> int:
    """Longest common subsequence, bit-parallel: a zero bit of `row` is a place of `a` that is used."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def similarity(a: str, b: str) -> float:
    both = len(a) + len(b)
    return 1 - (both - 2 * common_length(a, b)) / both if both else 1.0


def best_window(short: str, long: str) -> float:
    """Best similarity of `short` to a beginning, a run of its own length, or an ending of `long` that closes or opens on a shared character."""
    n, m, own = len(short), len(long), set(short)
    spans = [(0, k) for k in range(1, n) if long[k - 1] in own]
    spans += [(k, k + n) for k in range(m - n) if long[k + n - 1] in own]
    spans += [(k, m) for k in range(max(0, m - n), m) if long[k] in own]
    return max((similarity(short, long[a:b]) for a, b in spans), default=0.0)


def partial_ratio(a: str, b: str) -> float:
    if not a and not b:
        return 100.0
    if len(a) == len(b):
        return 100 * max(best_window(a, b), best_window(b, a))
    return 100 * (best_window(a, b) if len(a) < len(b) else best_window(b, a))


def word_ratio(a: str, b: str) -> float:
    """The better of sorted words and word sets."""
    x, y = a.split(), b.split()
    in_order = 100 * similarity(" ".join(sorted(x)), " ".join(sorted(y)))
    x, y = set(x), set(y)
    if not x or not y:
        return in_order
    shared, only_x, only_y = x & y, x - y, y - x
    if shared and not (only_x and only_y):
        return 100.0
    left, right, base = " ".join(sorted(only_x)), " ".join(sorted(only_y)), len(" ".join(shared))
    gap = bool(base)
    with_x, with_y = base + gap + len(left), base + gap + len(right)
    score = lambda away, size: 100 - 100 * away / size if size else 100.0
    best = score(len(left) + len(right) - 2 * common_length(left, right), with_x + with_y)
    if base:
        best = max(best, score(gap + len(left), base + with_x), score(gap + len(right), base + with_y))
    return max(in_order, best)


def partial_word_ratio(a: str, b: str) -> float:
    x, y = a.split(), b.split()
    if set(x) & set(y):
        return 100.0
    best = partial_ratio(" ".join(sorted(x)), " ".join(sorted(y)))
    if len(set(x)) < len(x) or len(set(y)) < len(y):
        best = max(best, partial_ratio(" ".join(sorted(set(x))), " ".join(sorted(set(y)))))
    return best


def weighted_ratio(a: str | None, b: str | None) -> float:
    if not a or not b:
        return 0.0
    ratio = max(len(a), len(b)) / min(len(a), len(b))
    plain = 100 * similarity(a, b)
    if ratio < NEAR:
        return max(plain, WORDS_SCALE * word_ratio(a, b))
    scale = PART if ratio <= FAR else LONG_PART
    return max(plain, scale * partial_ratio(a, b), WORDS_SCALE * scale * partial_word_ratio(a, b))


@F.pandas_udf(BEST)
def best_weighted(reads: pd.Series, lists: pd.Series) -> pd.DataFrame:
    """The best name of each read's list of (name, place): greatest weighted ratio, then least place."""
    rows = []
    for read, names in zip(reads, lists, strict=True):
        scored = [(weighted_ratio(read, n["name"]), -n["place"], n["name"]) for n in names]
        rows.append(max(scored, default=(0.0, 0, None)))
    best = pd.DataFrame(rows, columns=["score", "place", "name"])
    return best.assign(place=-best["place"])


def edit_budget(name: Column) -> Column:
    """Edits within which a read snaps to a name: one in 8 characters, 1 to 3."""
    return F.least(F.lit(3), F.greatest(F.lit(1), F.floor(F.length(name) / 8))).cast("int")
