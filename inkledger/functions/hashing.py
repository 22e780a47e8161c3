"""Stable scores in [0, 1) of ids."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def md5_number(text: Column) -> Column:
    """The first 60 bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def split_score(seed: int, salt: int, key: Column) -> Column:
    """Native score by MD5 of seed|salt|id."""
    return md5_number(F.concat(F.lit(f"{seed}|{salt}|"), key.cast("string"))) / F.lit(float(16**15))


def blake_score(seed: int, salt: int):
    """The exact score by an 8-byte BLAKE2b of seed|salt|id. Spark has no BLAKE2b, so apply this to distinct ids."""

    @F.pandas_udf(T.DoubleType())
    def score(ids: pd.Series) -> pd.Series:
        return ids.map(lambda i: None if i is None else int.from_bytes(hashlib.blake2b(f"{seed}|{salt}|{i}".encode(), digest_size=8).digest(), "big") / 2**64)

    return score
