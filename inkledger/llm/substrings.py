"""Substring dedup by compressed FM-indexes per shard.

A window is WINDOW consecutive words. Every window has an anchor: the 16-word run in
it whose hash is least, so equal windows have equal anchors. Anchors that only
one text has settle their windows at once. The rest send the stretch of words
around them (all windows of that anchor) to the anchor's shard. A shard builds an FM-index of
its stretches: suffix order by prefix doubling, the BWT in a wavelet matrix of
packed bits with counted ranks. Each stretch is then streamed through it by
backward search from its last word; where the match has reached WINDOW
words, the suffix interval of that window is reported if a document with a
smaller doc_id stands in it. All stretches of a shard step together.

Text that repeats itself takes one anchor for many windows. Texts that are equal as a whole are settled by their hash: all but the
smallest doc_id lose every word if they hold a window. Stretches equal to one of a smaller document in
the same task are settled before they move. Stretches of an anchor beyond
PART are cut into parts by order, and each pair of parts has an index of its own, so
no task holds an unbounded group.

Cases: a null text has no words; texts under WINDOW words keep all; a window
repeated within one document, or in a row of the same doc_id, is no repeat; null doc_ids neither remove
nor lose words; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.llm.common import Words, slices, stash, window_hashes

WINDOW, GRAM = 50, 16
#: Words of stretches that a shard holds on average, and stretches of one anchor in one part.
SHARD_WORDS, PART = 150_000, 4000
KNOWN = 300_000


def name_of(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def anchors(hashes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of anchors: every window holds one whose hash is the least in it.

    Where a least run stands more than once, as in text that repeats itself, as few places as cover the windows are taken: the key is the same at each.
    """
    if len(hashes) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = window_hashes(hashes, GRAM)
    span = window - GRAM + 1
    first = np.arange(len(grams) - span + 1) + np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1)
    least = grams[first]
    edges = np.flatnonzero(least[1:] != least[:-1]) + 1
    begins, ends = np.append(0, edges), np.append(edges, len(least))
    several = np.flatnonzero(first[begins] != first[ends - 1])
    at = [np.delete(first[begins], several)]
    for k in several.tolist():
        w, end = int(begins[k]), int(ends[k])
        places = w + np.flatnonzero(grams[w : end + span - 1] == least[w])
        taken = []
        while w < end:
            taken.append(int(places[np.searchsorted(places, w + span, side="left") - 1]))
            w = taken[-1] + 1
        at.append(np.array(taken, np.int64))
    at = np.unique(np.concatenate(at))
    return at, grams[at]


def survey_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of two kinds: a row's (doc_id, n, node), and a text's (node, key, at) for its anchors."""
    known: set[bytes] = set()
    names = ["doc_id", "n", "node", "key", "at"]
    for whole in batches:
        for batch in slices(whole):
            words = Words(batch.column("text").to_pylist())
            hashes = words.hashes()
            ids, nodes, found = batch.column("doc_id").to_pylist(), [], []
            for doc_id, a, b in zip(ids, words.starts[:-1].tolist(), words.starts[1:].tolist(), strict=True):
                node = name_of([words.values[k] for k in words.ids[a:b]])
                nodes.append(node)
                if doc_id is not None and node not in known and b - a >= WINDOW:
                    known.add(node)
                    found.append((node, *anchors(hashes[a:b])))
            if len(known) > KNOWN:
                known.clear()
            n, k = len(ids), sum(len(f[1]) for f in found)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(words.starts)), pa.array(nodes, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())], names)
            if k:
                spread = pa.array(np.repeat(np.arange(len(found)), [len(f[1]) for f in found]))
                keys, at = np.concatenate([f[2] for f in found]).view(np.int64), np.concatenate([f[1] for f in found]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array([f[0] for f in found], pa.binary()).take(spread), pa.array(keys), pa.array(at)], names)


def shared_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a table sorted by key and node: the rows whose key has two nodes or more, with their part of the key."""
    names = ["node", "key", "at", "part"]
    key = first = before = None
    waiting: list[tuple[bytes, int]] = []
    rank = 0  # rows of the open key that are out; 0: it has had one node so far
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.int32(), pa.int32()))], names)
        out.clear()
        return done

    for batch in batches:
        keys = batch.column("key").to_numpy()
        # rows whose neighbours have other keys are alone, unless they continue the open key
        same = np.zeros(len(keys), bool)
        same[1:] |= keys[1:] == keys[:-1]
        same[:-1] |= keys[1:] == keys[:-1]
        if len(keys):
            same[0] = same[-1] = True
        some = np.flatnonzero(same)
        part = batch.take(pa.array(some))
        for row in zip(keys[some].tolist(), part.column("node").to_pylist(), part.column("at").to_pylist(), strict=True):
            if row == before:
                continue
            before = row
            k, node, at = row
            if k != key:
                key, first, rank = k, node, 0
                waiting.clear()
            if rank == 0 and node == first:
                waiting.append((node, at))
                continue
            if rank == 0:
                out.extend((n, k, a, r // PART) for r, (n, a) in enumerate(waiting))
                rank = len(waiting)
            out.append((node, k, at, rank // PART))
            rank += 1
            if len(out) >= 20_000:
                yield flush()
    if out:
        yield flush()


def stretch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches around shared anchors: (doc_id, node, key, part, start, words), or with null words where a smaller document has the same."""
    known: dict[tuple[int, bytes], int] = {}
    names = ["doc_id", "node", "key", "part", "start", "size", "words"]
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    for whole in batches:
        for batch in slices(whole):
            rows: list[tuple] = []
            for doc_id, node, text, shared in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "node", "text", "shared")), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                if name_of(words) != node:
                    continue  # another row of the same doc_id
                for s in shared:
                    a, b = max(0, s["at"] - (WINDOW - GRAM)), min(len(words), s["at"] + WINDOW)
                    held = b" ".join(words[a:b])
                    mark = (s["key"], hashlib.blake2b(held, digest_size=12).digest())
                    least = known.get(mark)
                    if least is not None and least < doc_id:
                        rows.append((doc_id, node, s["key"], s["part"], a, b - a, None))
                        continue
                    known[mark] = doc_id
                    rows.append((doc_id, node, s["key"], s["part"], a, b - a, held))
            if len(known) > KNOWN:
                known.clear()
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


class Wavelet:
    """Ranks over a sequence of symbols: one packed bit vector a level."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = []
        self.bits = max(1, int(top).bit_length())
        now = symbols
        for k in range(self.bits - 1, -1, -1):
            bit = (now >> k) & 1
            padded = np.zeros(-(-(len(bit) + 1) // 64) * 64, np.uint8)
            padded[: len(bit)] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=counts[1:])
            self.levels.append((packed, counts, int(len(bit) - bit.sum())))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def follow(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where positions `at` come to rest among their symbols; differences are ranks."""
        for k, (packed, counts, zeros) in enumerate(self.levels):
            block = at >> 6
            below = packed[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = counts[block] + np.bitwise_count(below)
            at = np.where((symbol >> (self.bits - 1 - k)) & 1, zeros + ones, at - ones)
        return at


class Index:
    """FM-index of stretches of symbols over 1; 0 parts them. `docs` names each stretch's document."""

    def __init__(self, stretches: list[np.ndarray], docs: np.ndarray, window: int = WINDOW):
        sizes = np.array([len(s) for s in stretches], np.int64)
        n = int(sizes.sum() + len(sizes))
        text = np.zeros(n, np.int64)
        inner = np.ones(n, bool)
        inner[np.cumsum(sizes + 1) - 1] = False
        text[inner] = np.concatenate(stretches) if len(stretches) else 0
        owner = np.repeat(docs, sizes + 1)
        # prefix doubling until runs longer than a window are in order; the ranks of each width also give common lengths
        ranks, width = [np.unique(text, return_inverse=True)[1].astype(np.int64)], 1
        while width <= window:
            r = ranks[-1]
            after = np.concatenate([r[width:] + 1, np.zeros(min(width, n), np.int64)])[:n]
            ranks.append(np.unique(r * (n + 2) + after, return_inverse=True)[1].astype(np.int64))
            width *= 2
        order = np.argsort(ranks[-1], kind="stable")
        common, i, j = np.zeros(n, np.int64), order[:-1].copy(), order[1:].copy()
        for k in range(len(ranks) - 1, -1, -1):
            inside = (i < n) & (j < n)
            equal = np.zeros(n - 1 if n else 0, bool)
            equal[inside] = ranks[k][i[inside]] == ranks[k][j[inside]]
            common[1:] += equal * (1 << k)
            i, j = i + equal * (1 << k), j + equal * (1 << k)
        # suffixes that share `window` symbols stand together
        self.block = np.cumsum(common < window) - 1
        starts = np.flatnonzero(common < window)
        self.block_start, self.block_end = starts, np.append(starts[1:], n)
        self.block_least = np.minimum.reduceat(owner[order], starts) if n else np.zeros(0, np.int64)
        before = text[order - 1]
        top = int(text.max()) if n else 0
        self.wavelet = Wavelet(before, top)
        first = np.zeros(top + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=top + 1), out=first[1:])
        symbols = np.arange(top + 1)
        self.offset = first[:-1] - self.wavelet.follow(symbols, np.zeros(top + 1, np.int64))
        self.size, self.window = n, window

    def repeats(self, stretches: list[np.ndarray], docs: np.ndarray) -> list[np.ndarray]:
        """Starts of the windows of each stretch that also stand in a smaller document of the index."""
        sizes = np.array([len(s) for s in stretches], np.int64)
        longest = int(sizes.max()) if len(sizes) else 0
        grid = np.zeros((longest, len(sizes)), np.int64)
        for k, s in enumerate(stretches):
            grid[longest - len(s) :, k] = s  # all end together
        low, high, length = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.size, np.int64), np.zeros(len(sizes), np.int64)
        hit = np.zeros((longest, len(sizes)), bool)
        for p in range(longest - 1, -1, -1):
            live = np.flatnonzero(sizes > longest - 1 - p)
            c = grid[p, live]
            new_low, new_high = self.offset[c] + self.wavelet.follow(c, low[live]), self.offset[c] + self.wavelet.follow(c, high[live])
            found = new_low < new_high
            low[live], high[live] = np.where(found, new_low, 0), np.where(found, new_high, self.size)
            length[live] = np.where(found, length[live] + 1, 0)
            full = live[length[live] >= self.window]
            if len(full):
                block = self.block[low[full]]
                hit[p, full] = self.block_least[block] < docs[full]
                low[full], high[full] = self.block_start[block], self.block_end[block]
        return [np.flatnonzero(hit[longest - s :, k]) for k, s in enumerate(sizes)]


def shard_intervals(group):
    """Covered intervals (node, start, end) of the stretches of a shard."""
    import pandas as pd

    texts: dict[bytes, int] = {}
    which = np.array([texts.setdefault(w, len(texts)) for w in map(bytes, group["words"])], np.int64)
    docs = group["doc_id"].to_numpy()
    least = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(least, which, docs)
    known: dict[bytes, int] = {}
    stretches = [np.array([known.setdefault(w, len(known) + 1) for w in t.split()], np.int64) for t in texts]
    starts = Index(stretches, least).repeats(stretches, least)
    nodes, begins = group["node"].tolist(), group["start"].tolist()
    out: list[tuple[bytes, int, int]] = []
    for k, t in enumerate(which.tolist()):
        if docs[k] > least[t]:
            out.append((nodes[k], begins[k], begins[k] + len(stretches[t])))
            continue
        s = starts[t]
        if len(s):
            cut = np.flatnonzero(np.diff(s) > 1) + 1
            for run in np.split(s, cut):
                out.append((nodes[k], begins[k] + int(run[0]), begins[k] + int(run[-1]) + WINDOW))
    return pd.DataFrame({"node": pd.Series([o[0] for o in out], dtype=object), "start": np.array([o[1] for o in out], np.int32), "end": np.array([o[2] for o in out], np.int32)})


def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            rows = []
            for doc_id, text, node, again, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "node", "again", "spans")), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                if node is not None and name_of(words) != node:
                    continue  # another row of the same doc_id
                gone = np.zeros(len(words) + 1, np.int64)
                if again and len(words) >= WINDOW:
                    gone[0] = 1
                for s in spans or ():
                    gone[s["start"]] += 1
                    gone[s["end"]] -= 1
                keep = np.cumsum(gone)[:-1] <= 0
                kept = b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k)
                rows.append((doc_id, len(words), int(len(words) - keep.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text: one row per row of docs."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text"))
    seen = stash(rows.mapInArrow(survey_batches, "doc_id long, n long, node binary, key long, at int"), "anchors")
    classes = seen.filter("key is null").select("doc_id", "n", "node")
    firsts = classes.filter(F.col("doc_id").isNotNull() & (F.col("n") >= WINDOW)).groupBy("node").agg(F.min("doc_id").alias("first"))

    keyed = seen.filter("key is not null").select("node", "key", "at").repartition("key").sortWithinPartitions("key", "node", "at")
    shared = keyed.mapInArrow(shared_batches, "node binary, key long, at int, part int").groupBy("node").agg(F.collect_list(F.struct("key", "at", "part")).alias("shared"))
    held = shared.join(firsts.withColumnRenamed("node", "of"), F.col("node") == F.col("of")).select("node", "first", "shared")
    texts = rows.join(held, F.col("doc_id") == F.col("first")).select("doc_id", "node", "text", "shared")
    kinds = "doc_id long, node binary, key long, part int, start int, size int, words binary"
    stretches = stash(texts.mapInArrow(stretch_batches, kinds), "stretches")

    whole = stretches.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shards = max(1, -(-whole // SHARD_WORDS))
    moved = stretches.filter("words is not null")
    last = moved.groupBy(F.col("key").alias("of")).agg(F.max("part").alias("last")).filter("last > 0")
    split = moved.join(last, F.col("key") == F.col("of"), "left").withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("last", F.lit(0)))))
    placed = split.select(
        "doc_id", "node", "start", "words", F.when(F.col("last").isNull(), F.pmod(F.xxhash64("key"), F.lit(shards))).otherwise(F.col("key")).alias("shard"),
        F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), F.col("last").isNull().alias("mixed"),
    )
    found = placed.groupBy("mixed", "shard", "i", "j").applyInPandas(shard_intervals, "node binary, start int, end int")
    same = stretches.filter("words is null").select("node", "start", (F.col("start") + F.col("size")).alias("end"))
    spans = found.unionAll(same).filter(F.col("end") - F.col("start") >= WINDOW).groupBy("node").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    known = classes.select("doc_id", "node").distinct().join(firsts.withColumnRenamed("node", "of"), F.col("node") == F.col("of"))
    fate = known.join(spans.withColumnRenamed("node", "cut"), F.col("node") == F.col("cut"), "left")
    again = F.col("doc_id") > F.col("first")
    fate = fate.select(F.col("doc_id").alias("of_doc"), "node", again.alias("again"), F.when(~again, F.col("spans")).alias("spans")).filter("again or spans is not null")
    joined = rows.join(fate, F.col("doc_id") == F.col("of_doc"), "left").select("doc_id", "text", "node", "again", "spans")
    return joined.mapInArrow(cut_batches, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
