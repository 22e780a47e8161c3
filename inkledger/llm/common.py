"""What the training-data operators share: scratch tables, word splitting, hashing.

Words are maximal runs outside the bytes 20 and 09-0D; upper case is folded
for A-Z only. Both are byte operations, so they hold for any UTF-8 text.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python step works on at once.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master gets one of its own if none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="inkledger-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends here and lost executors cost nothing.

    Spark keeps shuffle files until the driver has collected the plan that made them, so it is asked to do so now.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def unused(name: str, df: DataFrame) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def one_of_each(docs: DataFrame, keep: DataFrame, keys: list[Column], text: str) -> DataFrame:
    """The rows of docs whose keys (never null) are rows of `keep` (distinct, as many columns); of rows with the same keys the first by text and then by the other columns."""
    names = [unused(f"key{i}", docs) for i in range(len(keys))]
    rank = unused("rank", docs)
    keyed = docs.withColumns(dict(zip(names, keys, strict=True)))
    wanted = keep.toDF(*[f"{n}_of" for n in names])
    on = [F.col(n) == F.col(f"{n}_of") for n in names]
    ordered = [f.name for f in docs.schema if f.name != text and "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    order = [F.col(f"`{c}`").asc_nulls_first() for c in (text, *ordered)]
    kept = keyed.join(wanted, on, "left_semi").withColumn(rank, F.row_number().over(W.partitionBy(*names).orderBy(*order)))
    return kept.filter(F.col(rank) == 1).drop(*names, rank)


def drop_stash(df: DataFrame) -> None:
    """Remove a stashed table that no later plan reads."""
    jvm = df.sparkSession._jvm
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `most` bytes of text; a longer row is a run of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The words of some texts: `ids` in order into `values` (bytes), text i owning ids[starts[i]:starts[i + 1]]."""

    def __init__(self, texts: list[str | None], lower: bool = False):
        encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        parts = [(t.lower() if lower else t).split() for t in encoded]
        self.starts = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=self.starts[1:])
        flat = pa.array([w for p in parts for w in p], pa.binary()).dictionary_encode()
        self.ids = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.values = flat.dictionary.to_pylist()

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, in order."""
        each = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.values), np.uint64, len(self.values))
        return each[self.ids] if len(each) else np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit words."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of `width` words, by joining runs of halved widths."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    have, run, done, total = words, 1, None, 0
    n, bits = len(words), width
    while bits:
        if bits & 1:
            if done is None:
                done, total = have, run
            else:
                keep = n - total - run + 1
                done, total = mix(done[:keep] * np.uint64(0x2545F4914F6CDD1D) + have[total : total + keep]), total + run
        bits >>= 1
        if bits:
            keep = n - 2 * run + 1
            have, run = mix(have[:keep] * np.uint64(0x9E6C63D0876A9A47) + have[run : run + keep]), 2 * run
    return done
