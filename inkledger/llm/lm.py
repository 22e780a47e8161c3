"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation, and a count baseline.

Tokens are the words of a text, A-Z lower-cased, and one end. All training
documents are counted; the model predicts one of WORDS frequent words, the
end, or one of BUCKETS classes of other words (by how they begin), from the two tokens before:

    s(w | a, b) = r_w . (c1_a + c2_b) + bias_w

and a word of a class has its count's share of the class, smoothed as in the
baseline. NCE trains against the classes' own frequencies: first on a bounded
sample to leave the symmetric start, then one pass over all training
documents, every task moving the vectors on its share and the results averaged
by tokens. Batched matrix products of the trained vectors give the scores of
all pairs and the exact normaliser of every context, so a token's
probability is normalised and costs three look-ups.

Counts of frequent words (LOCAL of them) travel with the code; what a text
holds of other words meets the count table in a join, merged by text first.

Cases: null is the empty text, whose only token is the end; without training
documents all counts are 0 and the model is uniform over its classes; null
doc_ids are trained on; repeated rows count and score each on its own; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkledger.llm.common import Words, slices, stash

WORDS, BUCKETS, WIDTH = 1920, 127, 24
#: Frequent words whose counts are looked up without a join.
LOCAL = 40_000
NOISE, BATCH, RATE = 32, 4096, 0.1
WARM_DOCS, WARM_PASSES = 400, 4
#: Training tokens of a shard; shards are averaged in so many groups first.
SHARD_TOKENS, GROUPS = 250_000, 16
TASKS_MOST = 10_000
#: Before a text's first token stand two of these.
SEED = 7
FLUSH = 400_000
TRAIN_CHARS = 4 << 20
SMOOTH = 0.1


def head_bucket(head: bytes) -> int:
    return zlib.crc32(head.decode("utf-8", "surrogatepass")[:2].encode("utf-8", "surrogatepass")) % BUCKETS


ascii_bucket = lru_cache(maxsize=1 << 15)(head_bucket)


def bucket(word: bytes) -> int:
    """The class of a word outside the frequent ones: by its first two characters, which are its first two bytes if those are ASCII."""
    head = word[:2]
    return ascii_bucket(head) if head.isascii() else head_bucket(word)


def bucket_column(word: Column) -> Column:
    return (F.crc32(F.encode(F.substring(F.decode(word, "UTF-8"), 1, 2), "UTF-8")) % BUCKETS).cast("int")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


class Counts(NamedTuple):
    total: int
    distinct: int
    #: Frequent words by count, with counts; the first ones have classes of their own. The end is the empty word.
    local: tuple[tuple[bytes, int], ...]
    rare: tuple[tuple[int, int], ...]  # tokens and distinct words of each class

    @property
    def frequent(self) -> dict[bytes, int]:
        own = [w for w, _ in self.local if w][:WORDS]
        return {b"": 0} | {w: k + 1 for k, w in enumerate(own)}

    def class_counts(self) -> np.ndarray:
        by, n = dict(self.local), np.zeros(1 + WORDS + BUCKETS)
        for w, k in self.frequent.items():
            n[k] = by.get(w, 0)
        n[1 + WORDS :] = [t for t, _ in self.rare]
        return n


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, int] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for whole in batches:
        for batch in slices(whole):
            words = Words(batch.column("text").to_pylist(), lower=True)
            for w, n in zip(words.values, np.bincount(words.ids, minlength=len(words.values)).tolist(), strict=True):
                held[w] = held.get(w, 0) + n
            held[b""] = held.get(b"", 0) + batch.num_rows
            if len(held) >= FLUSH:
                yield out()
                held.clear()
    if held:
        yield out()


def count(rows: DataFrame) -> tuple[DataFrame, Counts]:
    """The table of all words and counts, and the bounded part of it that tasks carry."""
    table = stash(rows.mapInArrow(count_batches, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    whole = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    local = tuple((bytes(r["word"]), r["n"]) for r in table.orderBy(F.desc("n"), "word").limit(LOCAL).collect())
    counts = Counts(whole[0], whole[1], local, ())
    own = table.sparkSession.createDataFrame([(bytearray(w),) for w in counts.frequent], "own binary")  # WORDS + 1 rows
    others = table.join(F.broadcast(own), F.col("word") == F.col("own"), "left_anti")
    rare = {r["b"]: (r["t"], r["d"]) for r in others.groupBy(bucket_column(F.col("word")).alias("b")).agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("d")).collect()}
    return table, counts._replace(rare=tuple(rare.get(b, (0, 0)) for b in range(BUCKETS)))


class Vectors(NamedTuple):
    target: np.ndarray
    first: np.ndarray
    second: np.ndarray
    bias: np.ndarray

    def pack(self) -> bytes:
        return np.concatenate([x.astype(np.float32).ravel() for x in self]).tobytes()


CLASSES = 1 + WORDS + BUCKETS
START = CLASSES  # a context, never predicted


def unpack(raw: bytes) -> Vectors:
    x = np.frombuffer(raw, np.float32).copy()
    shapes = ((CLASSES, WIDTH), (CLASSES + 1, WIDTH), (CLASSES + 1, WIDTH), (CLASSES,))
    ends = np.cumsum([int(np.prod(s)) for s in shapes])
    return Vectors(*(p.reshape(s) for p, s in zip(np.split(x, ends[:-1]), shapes, strict=True)))


def noise_of(counts: np.ndarray) -> np.ndarray:
    p = counts + 0.5
    return p / p.sum()


def initial(noise: np.ndarray) -> Vectors:
    random = np.random.default_rng(SEED)
    draw = lambda n: random.normal(0, 0.1, (n, WIDTH)).astype(np.float32)
    return Vectors(draw(CLASSES), draw(CLASSES + 1), draw(CLASSES + 1), np.log(noise).astype(np.float32))


def runs_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A stable order of class ids (they fit 16 bits, so digits sort them), the distinct ones, where each begins, and the roots of their counts."""
    order = np.argsort(ids.astype(np.uint16), kind="stable")
    sorted_ids = ids[order]
    starts = np.flatnonzero(np.diff(sorted_ids, prepend=-1))
    return order, sorted_ids[starts], starts, np.sqrt(np.diff(starts, append=len(ids)))


class Trainer:
    """NCE by Adagrad over batches of (class, token before, token before that)."""

    def __init__(self, vectors: Vectors, noise: np.ndarray, rate: float = RATE, seen: list[np.ndarray] | None = None):
        self.v, self.noise, self.rate = vectors, noise, rate
        self.log_kq = np.log(NOISE * noise).astype(np.float32)
        self.cumulative = np.cumsum(noise)
        self.seen = [x.copy() for x in seen] if seen else [np.full(x.shape[0], 1e-2, np.float32) for x in vectors]
        self.random = np.random.default_rng(SEED)

    def move(self, which: int, runs: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], grads: np.ndarray) -> None:
        order, own, starts, roots = runs
        g = np.add.reduceat(grads[order], starts, axis=0)
        g /= roots[:, None] if g.ndim == 2 else roots
        self.seen[which][own] += (g * g).mean(axis=1) if g.ndim == 2 else g * g
        scale = self.rate / np.sqrt(self.seen[which][own])
        self.v[which][own] += g * (scale[:, None] if g.ndim == 2 else scale)

    def step(self, w: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        v = self.v
        q = v.first[a] + v.second[b]
        n = np.minimum(np.searchsorted(self.cumulative, self.random.random(NOISE)), CLASSES - 1)
        r = v.target[w]
        good = 1 / (1 + np.exp(np.einsum("ij,ij->i", q, r) + v.bias[w] - self.log_kq[w]))
        bad = -1 / (1 + np.exp(-(q @ v.target[n].T + v.bias[n] - self.log_kq[n])))
        back = good[:, None] * r + bad @ v.target[n]
        rows = np.concatenate([good[:, None] * q, bad.T @ q])
        both = runs_of(np.concatenate([w, n]))
        self.move(0, both, rows)
        self.move(3, both, np.concatenate([good, bad.sum(axis=0)]))
        self.move(1, runs_of(a), back)
        self.move(2, runs_of(b), back)

    def fit(self, ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        for at in range(0, len(ids), BATCH):
            self.step(ids[at : at + BATCH], a[at : at + BATCH], b[at : at + BATCH])


@lru_cache(maxsize=2)
def local_tables(counts: Counts) -> tuple[dict[bytes, int], dict[bytes, int]]:
    return counts.frequent, dict(counts.local)


def classes(words: Words, frequent: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens in order, ends included: class, the class before and the one before that; and each text's number of tokens."""
    each = np.fromiter((frequent.get(w) or 1 + WORDS + bucket(w) for w in words.values), np.int64, len(words.values))
    sizes = np.diff(words.starts)
    tokens = np.zeros(len(words.ids) + len(sizes), np.int64)
    ends = np.cumsum(sizes + 1) - 1
    inner = np.ones(len(tokens), bool)
    inner[ends] = False
    tokens[inner] = each[words.ids] if len(each) else 0
    a = np.concatenate([[START], tokens[:-1]])
    b = np.concatenate([[START, START], tokens[:-2]])[: len(tokens)]
    starts = ends - sizes
    a[starts] = START
    b[starts] = START
    b[np.minimum(starts + 1, ends)] = START
    return tokens, a, b, sizes + 1


def train(rows: DataFrame, counts: Counts) -> Vectors:
    """Vectors after a warm start on a bounded sample and one averaged pass over all rows."""
    noise = noise_of(counts.class_counts())
    warm = Trainer(initial(noise), noise)
    mark = F.xxhash64("doc_id", "text")
    some = [r["text"] for r in rows.select(mark.alias("h"), "text").orderBy("h", "text").limit(WARM_DOCS).collect()]
    for _ in range(WARM_PASSES if some else 0):
        warm.fit(*classes(Words(some, lower=True), counts.frequent)[:3])
    start = warm.v.pack()
    shared = rows.sparkSession.sparkContext.broadcast((counts, start, warm.seen))

    def train_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, start, steps = shared.value
        frequent, _ = local_tables(counts)
        shard, own, seen = None, None, 0
        held: list[str] = []

        def learn() -> None:
            nonlocal seen
            tokens, a, b, _ = classes(Words(held, lower=True), frequent)
            own.fit(tokens, a, b)
            seen += len(tokens)
            held.clear()

        def done() -> pa.RecordBatch:
            if held:
                learn()
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([own.v.pack()], pa.binary()), pa.array([seen], pa.int64())], ["shard", "vectors", "tokens"])

        size = 0
        for batch in batches:
            for of, text in zip(batch.column("shard").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if of != shard:
                    if shard is not None:
                        yield done()
                    shard, own, seen, size = of, Trainer(unpack(start), noise, RATE / 10, steps), 0, 0
                held.append(text)
                size += len(text)
                if size >= TRAIN_CHARS:
                    learn()
                    size = 0
        if shard is not None:
            yield done()

    def average_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, total, seen = None, None, 0
        names = ["shard", "vectors", "tokens"]
        done = lambda: pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([(total / seen).astype(np.float32).tobytes()], pa.binary()), pa.array([seen], pa.int64())], names)
        for batch in batches:
            for of, raw, n in zip(batch.column("group").to_pylist(), batch.column("vectors"), batch.column("tokens").to_pylist(), strict=True):
                x = np.frombuffer(raw.as_py(), np.float32).astype(np.float64) * n
                if of != group:
                    if group is not None:
                        yield done()
                    group, total, seen = of, x, n
                else:
                    total, seen = total + x, seen + n
        if group is not None:
            yield done()

    kinds = "shard long, vectors binary, tokens long"
    shards = max(1, -(-counts.total // SHARD_TOKENS))
    dealt = rows.select(F.pmod(mark, F.lit(shards)).alias("shard"), mark.alias("h"), "text").repartition(min(shards, TASKS_MOST), "shard").sortWithinPartitions("shard", "h", "text")
    parts = dealt.mapInArrow(train_batches, kinds).withColumn("group", F.col("shard") % GROUPS)
    means = parts.repartition("group").sortWithinPartitions("group", "shard").mapInArrow(average_batches, kinds).collect()  # GROUPS rows at most
    seen = sum(m["tokens"] for m in means)
    if not seen:
        return unpack(start)
    whole = sum(np.frombuffer(m["vectors"], np.float32).astype(np.float64) * (m["tokens"] / seen) for m in sorted(means, key=lambda m: m["shard"]))
    return unpack(whole.astype(np.float32).tobytes())


class Scorer:
    """log10 probabilities of classes from tables of all pairs and all contexts' normalisers."""

    def __init__(self, vectors: Vectors):
        v = vectors
        self.first = (v.first @ v.target.T + v.bias).astype(np.float32)
        self.second = (v.second @ v.target.T).astype(np.float32)
        top_a, top_b = self.first.max(axis=1), self.second.max(axis=1)
        # sum over w of exp(first[a, w]) * exp(second[b, w]): one product gives all contexts
        inside = np.exp((self.first - top_a[:, None]).astype(np.float64)) @ np.exp((self.second - top_b[:, None]).astype(np.float64)).T
        self.normal = (np.log(inside) + top_a[:, None] + top_b[None, :]).astype(np.float32)

    def log10(self, w: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.first[a, w].astype(np.float64) + self.second[b, w] - self.normal[a, b]) / np.log(10)


@lru_cache(maxsize=2)
def scorer(raw: bytes) -> Scorer:
    return Scorer(unpack(raw))


def score(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of whole texts."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    table, counts = count(rows.filter(~F.col("held_out")))
    vectors = train(rows.filter(~F.col("held_out")), counts).pack()
    shared = spark.sparkContext.broadcast((counts, vectors))
    base_of = counts.total + SMOOTH * (counts.distinct + 1)

    def score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, raw = shared.value
        (frequent, local), model = local_tables(counts), scorer(raw)
        share = np.zeros(CLASSES)
        share[1 + WORDS :] = [np.log10(t + SMOOTH * (d + 1)) for t, d in counts.rare]
        for whole in batches:
            for batch in slices(whole, most=4 << 20):
                words = Words(batch.column("text").to_pylist(), lower=True)
                tokens, a, b, sizes = classes(words, frequent)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                n = np.fromiter((local.get(w, -1) for w in words.values), np.int64, len(words.values))
                own = np.fromiter((w in frequent for w in words.values), bool, len(words.values))
                # of a word in a class: log10 of its share of the class, known here or after the join
                word = np.full(len(tokens), -1)
                inner = np.ones(len(tokens), bool)
                inner[np.cumsum(sizes) - 1] = False
                word[inner] = words.ids
                end = local.get(b"", 0)
                count = np.where(word < 0, end, n[word] if len(n) else 0)
                here = count >= 0
                base = np.where(here, np.log10(np.maximum(count, 0) + SMOOTH), 0.0)
                in_class = (word >= 0) & ~(own[word] if len(own) else True)
                extra = np.where(in_class, np.where(here, base, 0.0) - share[tokens], 0.0)
                total = lambda x: np.bincount(owner, x, len(sizes))
                apart = np.flatnonzero(~here)
                key = owner[apart] * len(n) + word[apart]
                pairs, times = np.unique(key, return_counts=True)
                offsets = np.searchsorted(pairs // max(len(n), 1), np.arange(len(sizes) + 1)).astype(np.int32)
                dictionary = pa.array(words.values, pa.binary())
                lists = pa.StructArray.from_arrays([dictionary.take(pa.array(pairs % max(len(n), 1))), pa.array(times, pa.int64())], ["w", "k"])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), batch.column("held_out"), pa.array(sizes, pa.int64()), pa.array(total(here & (count > 0)).astype(np.int64)),
                        pa.array(total(base)), pa.array(total(model.log10(tokens, a, b) + extra)), pa.ListArray.from_arrays(pa.array(offsets), lists),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base", "model", "apart"],
                )

    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, apart array<struct<w:binary,k:long>>"
    scored = rows.mapInArrow(score_batches, kinds).withColumn("row", F.monotonically_increasing_id())
    scored = stash(scored, "scored")
    apart = scored.select("row", F.explode("apart").alias("x")).select("row", F.col("x.w").alias("w"), F.col("x.k").alias("k"))
    met = apart.join(table.select(F.col("word"), F.col("n")), F.col("w") == F.col("word"), "left")
    sums = met.groupBy("row").agg(
        F.sum(F.col("k") * F.log10(F.coalesce(F.col("n"), F.lit(0)) + SMOOTH)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("more_known")
    )
    whole = scored.drop("apart").join(sums, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(counts.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.log10(F.lit(float(base_of)))).alias("base_score"), (F.col("model") + more).alias("score"),
    )
