"""N-gram Jaccard join by token-combination prefixes.

A document's set holds the hashes of its distinct word shingles. Documents of equal
sets form one class; a class is a node, named by a 128-bit hash of its set.
Shingles stand in one global order: those not known to be frequent first, then
frequent ones by count. Two sets that are similar enough share a token among
the first n - o + 1 (o: the least overlap that a set of n tokens can link
with), and their second shared token is among the first n - o + 2. So rare
tokens of the prefix are index keys of their own, and of frequent tokens pairs
from the prefix extended by one are keys; sets too long for pairs (over
Limits.pair_size) use single frequent tokens. Positions and sizes bound the overlap
of two sets under a key, which settles most candidates; the rest are verified on
whole sets. The sets of a larger group (Limits.group) meet a few pivots in
each turn instead of one another; components are contracted after each, and
only what stands in different components is compared further. Links give
components by alternating stars. How many links a document has is not returned:
that would need all pairs of a large group.

Frequent are shingles counted at least Limits.frequent times by tasks that saw them
twice or more, at most FREQUENT_MOST of them; this only shapes the
order, and any order gives the same links.

Cases: null, empty or blank texts have an empty set and link with nothing; texts
of fewer words than a shingle have one token, the whole sequence; repeated
rows and equal texts are one class; ties do not arise, the component is the
smallest doc_id (nulls aside); an empty table gives no rows; other columns, of
any name, are ignored by `join` and pass through `dedup`, which keeps one row
of each component: of its smallest doc_id (null last), and of rows with that doc_id
one by hash of the text, and of rows with that text too the first by other columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.llm.common import Words, mix, one_of_each, slices, stash, window_hashes
from inkledger.llm.components import components

FREQUENT_MOST = 500_000


class Limits(NamedTuple):
    """What decides the way in which a pair is found, never whether it is."""

    frequent: int = 8
    #: Sets of more tokens have single frequent tokens as keys, others pairs.
    pair_size: int = 300
    #: Groups of more sets go by blocks, of so many sets.
    group: int = 64
    block: int = 512
    #: Before that, while a set would meet more than so many others there, come turns with so many pivots.
    meet: int = 256
    pivots: int = 4
    turns: int = 2


LIMITS = Limits()
#: Stands for a null doc_id in keys.
NO_ID = -(1 << 62)
COUNT_AT_ONCE = 3_000_000
#: Pairs that a task remembers, so that it seldom repeats those which meet under many keys.
KNOWN_PAIRS = 200_000
COLUMNS_AT_ONCE = 8192
#: Bytes of text whose sets a task makes at once, and nodes that it remembers.
TEXT_AT_ONCE = 2 << 20
KNOWN_NODES = 200_000
SKETCH = ("s0", "s1", "s2", "s3")
#: Sets of more tokens have a wide sketch besides, of a bit or two a token.
WIDE = 256


def least_overlap(n, percent: int):
    return (percent * n + 99) // 100


def pair_overlap(n, m, percent: int):
    """The overlap from which sets of n and m tokens link."""
    return -(-percent * (n + m) // (100 + percent))


def sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words(texts, lower=True)
    hashes = words.hashes()
    out = []
    for a, b in zip(words.starts[:-1].tolist(), words.starts[1:].tolist(), strict=True):
        grams = window_hashes(hashes[a:b], min(width, b - a)) if b > a else np.zeros(0, np.uint64)
        if 0 < b - a < width:
            grams = mix(grams + np.uint64(b - a))
        out.append(np.unique(grams))
    return out


def name_of(tokens: np.ndarray) -> bytes | None:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None


def sketch(tokens: np.ndarray) -> np.ndarray:
    """256 bits: of which bits the set has an odd number of tokens. Sketches differ in no more bits than the sets do in tokens."""
    odd = np.bincount((tokens >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_sketch(tokens: np.ndarray) -> bytes | None:
    """The same over as many bits as the next power of two from the set's size, by the low bits of tokens."""
    if len(tokens) <= WIDE:
        return None
    bits = 1 << (len(tokens) - 1).bit_length()
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def bits_apart(x: bytes, y: bytes) -> int:
    """In how many bits wide sketches differ; the longer one is folded to the length of the other."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def survey(width: int):
    """Rows of two kinds: a document's (doc_id, n, node, sketches), and a token's (token, seen) in a stretch of documents."""
    names = ["doc_id", "mark", "n", "node", *SKETCH, "wide", "token", "seen"]

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        tokens, seen = np.unique(np.concatenate(held), return_counts=True)
        tokens, seen = tokens[seen > 1], seen[seen > 1]
        nulls = lambda kind: pa.nulls(len(tokens), kind)
        return pa.RecordBatch.from_arrays([nulls(pa.int64()), nulls(pa.int64()), nulls(pa.int64()), nulls(pa.binary()), *[nulls(pa.int64()) for _ in SKETCH], nulls(pa.binary()), pa.array(tokens.view(np.int64)), pa.array(seen.astype(np.int64))], names)

    def survey_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        known: set[bytes | None] = set()
        for whole in batches:
            for batch in slices(whole, most=TEXT_AT_ONCE):
                found = sets(batch.column("text").to_pylist(), width)
                nodes = [name_of(s) for s in found]
                nulls = lambda kind, n=len(found): pa.nulls(n, kind)
                bits = np.stack([sketch(s) for s in found])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array([len(s) for s in found], pa.int64()), pa.array(nodes, pa.binary()), *[pa.array(np.ascontiguousarray(bits[:, k])) for k in range(len(SKETCH))], pa.array([wide_sketch(s) for s in found], pa.binary()), nulls(pa.int64()), nulls(pa.int64())], names)
                for s, node in zip(found, nodes, strict=True):
                    if node not in known:
                        known.add(node)
                        held.append(s)
                        size += len(s)
                if size >= COUNT_AT_ONCE:
                    yield flush(held)
                    held, size = [], 0
                    known.clear()
        if held:
            yield flush(held)

    return survey_batches


class Order:
    """The global order of tokens: by 0 or a frequent token's count, then by hash."""

    def __init__(self, tokens: np.ndarray, seen: np.ndarray):
        order = np.argsort(tokens)
        self.tokens, self.seen = tokens[order], seen[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.tokens >> np.uint64(42)).astype(np.int64)] = True

    def weights(self, tokens: np.ndarray) -> np.ndarray:
        out = np.zeros(len(tokens), np.int64)
        if len(self.tokens):
            likely = np.flatnonzero(self.maybe[(tokens >> np.uint64(42)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.tokens, tokens[likely]), len(self.tokens) - 1)
            out[likely] = np.where(self.tokens[at] == tokens[likely], self.seen[at], 0)
        return out


def keys_of(tokens: np.ndarray, weights: np.ndarray, percent: int, pair_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Index keys of a set: key, how many shared tokens it stands for, position of the last of them, and a token before (0: none).

    Sets that share the key and the token before also share a key that comes earlier in the order, so they meet there.
    """
    n = len(tokens)
    if n < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    short = n - least_overlap(n, percent) + 1
    order = np.argsort(weights, kind="stable")[: min(n, short + 1)]
    prefix, heavy = tokens[order], weights[order] > 0
    before = lambda at: np.where(at > 0, prefix[at - 1], np.uint64(0))
    rare = np.flatnonzero(~heavy[:short])
    keys, stands, places, earlier = [prefix[rare]], [np.ones(len(rare), np.int64)], [rare], [before(rare)]
    often = np.flatnonzero(heavy)
    if len(often) and percent * n <= 100 * pair_size:
        first, second = np.triu_indices(len(often), 1)
        first, second = often[first], often[second]
        fits = first < short
        first, second = first[fits], second[fits]
        keys.append(mix(prefix[first] * np.uint64(0x9E6C63D0876A9A47) + prefix[second]))
        stands.append(np.full(len(first), 2, np.int64))
        places.append(second)
        # a pair that begins with the first frequent token has, with it, the pair of that one and the token before its second
        earlier.append(np.where((first == often[0]) & (second > first + 1), prefix[second - 1], before(first)))
    if len(often) and 100 * n > percent * pair_size:
        single = often[often < short]
        keys.append(mix(prefix[single]))
        stands.append(np.ones(len(single), np.int64))
        places.append(single)
        earlier.append(before(single))
    return np.concatenate(keys), np.concatenate(stands), np.concatenate(places), np.concatenate(earlier)


def index(width: int, percent: int, shared, pair_size: int):
    def index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(*shared.value)
        known: set[bytes] = set()
        for whole in batches:
            for batch in slices(whole, most=TEXT_AT_ONCE):
                found = sets(batch.column("text").to_pylist(), width)
                nodes = [name_of(s) for s in found]
                fresh = []
                for s, node in zip(found, nodes, strict=True):
                    if node is not None and node not in known:
                        known.add(node)
                        fresh.append((s, node))
                if len(known) > KNOWN_NODES:
                    known.clear()
                if not fresh:
                    continue
                weights = order.weights(np.concatenate([s for s, _ in fresh]))
                ends = np.cumsum([len(s) for s, _ in fresh])
                rows = [keys_of(s, weights[e - len(s) : e], percent, pair_size) for (s, _), e in zip(fresh, ends, strict=True)]
                counts = [len(r[0]) for r in rows]
                sizes = np.repeat([len(s) for s, _ in fresh], counts)
                spread = pa.array(np.repeat(np.arange(len(fresh)), counts))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([r[0] for r in rows]).view(np.int64)), pa.array([x for _, x in fresh], pa.binary()).take(spread), pa.array(sizes.astype(np.int32)),
                        pa.array(np.concatenate([r[1] for r in rows]).astype(np.int32)), pa.array(np.concatenate([r[2] for r in rows]).astype(np.int32)), pa.array(np.concatenate([r[3] for r in rows]).view(np.int64)),
                    ],
                    ["key", "node", "n", "stands", "at", "before"],
                )

    return index_batches


class Fits:
    """Of a large group's members, in order of size, those that can link with another one by sizes and places of the key.

    What waits for a larger partner is at most one member of each size, as two of one size that may have larger ones fit each other.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.seen: dict[int, int] = {}  # of sizes in reach, the largest partner that a member may have
        self.waiting: dict[int, tuple[bytes, int, int]] = {}
        self.low = 0

    def add(self, node: bytes, n: int, most: int) -> list[tuple[bytes, int, int]]:
        """(node, n, most) of the members that are now known to fit: this one and those that waited for it."""
        low = -(-self.percent * n // 100)
        if low > self.low:
            self.low = low
            for sizes in (self.seen, self.waiting):
                for m in [m for m in sizes if m < low]:
                    del sizes[m]
        own = (node, n, most)
        if n <= most and self.seen.get(n, 0) >= n:
            found = [own]
        elif most >= low and any(m <= most and up >= n for m, up in self.seen.items()):
            found = [own]
        else:
            found = []
        if found and self.waiting:
            met = [m for m, w in self.waiting.items() if m <= most and w[2] >= n]
            found += [self.waiting.pop(m) for m in met]
        if most >= n:
            self.seen[n] = max(self.seen.get(n, 0), most)
            if not found:
                self.waiting[n] = own
        return found


def pair_up(percent: int, most: int):
    """Candidates of a table sorted by key, size and node: pairs of small groups; of groups with more than `most` sets, the members that can link there, and pairs of each with the first one of its size, and of that with the first of the size before.

    A pair whose sets name the same token before the key shares an earlier key and is left to that one, so it comes out of few tasks, not of all that its keys are dealt to.
    As nodes are hashes, groups of the same sets have the same first ones, and what their pairs link is contracted before anything else is compared.
    """
    names = ["a", "b", "key", "n", "most"]

    def partner(n: int, stands: int, at: int) -> int:
        """The size up to which a set can link under a key, as only what follows the key can be shared besides it."""
        return (100 + percent) * (stands + n - at - 1) // percent - n

    def near(x: tuple[int, bytes, int, int, int], y: tuple[int, bytes, int, int, int]) -> bool:
        (n, _, stands, p, before), (m, _, _, q, other) = x, y
        return (before != other or not before) and percent * m <= 100 * n and stands + min(n - p, m - q) - 1 >= pair_overlap(n, m, percent)

    def pair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple[int, bytes, int, int, int]] = []
        state = {"key": None, "large": None, "last": None, "first": None}
        pairs: list[tuple[bytes, bytes]] = []
        known: set[tuple[bytes, bytes]] = set()  # pairs that this task has put out
        large: list[tuple[bytes, int, int, int]] = []

        def close() -> None:
            if state["large"]:
                return
            for i, x in enumerate(group):
                for y in group[i + 1 :]:
                    if percent * y[0] > 100 * x[0]:
                        break
                    if near(x, y):
                        pairs.append((x[1], y[1]) if x[1] < y[1] else (y[1], x[1]))

        def more(member: tuple[int, bytes, int, int, int]) -> None:
            n, node, stands, at, _ = member
            large.extend((x, state["key"], m, up) for x, m, up in state["large"].add(node, n, partner(n, stands, at)))
            first = state["first"]
            if first is not None and near(first, member):
                pairs.append((first[1], node) if first[1] < node else (node, first[1]))
            if first is None or first[0] != n:
                state["first"] = member

        def out() -> pa.RecordBatch:
            if len(known) > KNOWN_PAIRS:
                known.clear()
            own = list(set(pairs) - known)
            known.update(own)
            blank = [None] * len(own)
            done = pa.RecordBatch.from_arrays(
                [
                    pa.array([p[0] for p in own] + [r[0] for r in large], pa.binary()), pa.array([p[1] for p in own] + [None] * len(large), pa.binary()),
                    *[pa.array(blank + [r[i] for r in large], kind) for i, kind in ((1, pa.int64()), (2, pa.int32()), (3, pa.int32()))],
                ],
                names,
            )
            pairs.clear()
            large.clear()
            return done

        for batch in batches:
            keys = batch.column("key").to_numpy()
            # rows whose neighbours have other keys are alone, unless they continue the open group
            same = np.zeros(len(keys), bool)
            same[1:] |= keys[1:] == keys[:-1]
            same[:-1] |= keys[1:] == keys[:-1]
            if len(keys):
                same[0] = same[-1] = True
            some = np.flatnonzero(same)
            part = batch.take(pa.array(some))
            before = part.column("before").to_pylist() if "before" in part.schema.names else [0] * len(some)
            for key, *member in zip(keys[some].tolist(), *(part.column(c).to_pylist() for c in ("n", "node", "stands", "at")), before, strict=True):
                if key != state["key"]:
                    close()
                    group.clear()
                    state.update(key=key, large=None, last=None, first=None)
                if member[1] == state["last"]:
                    continue
                state["last"] = member[1]
                if state["large"]:
                    more(member)
                else:
                    group.append(member)
                    if len(group) > most:
                        state["large"] = Fits(percent)
                        for held in group:
                            more(held)
                if len(large) + len(pairs) > 20_000:
                    yield out()
        close()
        yield out()

    return pair_batches


def packed(width: int):
    """Sets by node; rows may share a doc_id, so a text counts only under its own name."""

    def pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=TEXT_AT_ONCE):
                found = sets(part.column("text").to_pylist(), width)
                good = pa.array([name_of(s) == node for s, node in zip(found, part.column("node").to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "tokens"]).filter(good)

    return pack_batches


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def still_near(percent: int):
    """Of pairs with wide sketches x and y, those that may link."""

    def near_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(batch.column("a_n").to_pylist(), batch.column("b_n").to_pylist(), strict=True)
            most = (n + m - 2 * pair_overlap(n, m, percent) for n, m in sizes)
            good = [bits_apart(x.as_buffer(), y.as_buffer()) <= k for x, y, k in zip(batch.column("x"), batch.column("y"), most, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return near_batches


def verify(percent: int):
    def verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unpack = lambda c: (np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(c))  # noqa: E731, B023
            good = [linked(x, y, percent) for x, y in zip(unpack("x"), unpack("y"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return verify_batches


def forest(nodes: list[bytes], tokens: list[np.ndarray], percent: int) -> list[tuple[bytes, bytes]]:
    """Links that connect what all links among these sets connect."""
    n = len(nodes)
    flat = np.concatenate(tokens) if n else np.zeros(0, np.uint64)
    _, column = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(n), [len(t) for t in tokens])
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((n, n), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS_AT_ONCE):
        a, b = np.searchsorted(column, [low, low + COLUMNS_AT_ONCE])
        grid = np.zeros((n, COLUMNS_AT_ONCE), np.float32)
        grid[owner[a:b], column[a:b] - low] = 1
        both += grid @ grid.T
    size = np.array([len(t) for t in tokens], np.float64)
    near = 100 * both.astype(np.float64) >= percent * (size[:, None] + size[None, :] - both)
    left, out = np.ones(n, bool), []
    for start in range(n):
        if not left[start]:
            continue
        left[start] = False
        todo = [start]
        while todo:
            k = todo.pop()
            for other in np.flatnonzero(near[k] & left).tolist():
                left[other] = False
                todo.append(other)
                out.append((nodes[k], nodes[other]))
    return out


def links_of_blocks(percent: int):
    import pandas as pd

    def block_links(group: pd.DataFrame) -> pd.DataFrame:
        found = forest(list(map(bytes, group["node"])), [np.frombuffer(t, np.uint64) for t in group["tokens"]], percent)
        return pd.DataFrame({"a": [min(p) for p in found], "b": [max(p) for p in found]}, dtype=object)

    return block_links


class Sets:
    """The sets of a table's nodes: sketches settle most pairs, whole sets move only for those that are left."""

    def __init__(self, rows: DataFrame, nodes: DataFrame, width: int, percent: int):
        self.rows, self.nodes, self.width, self.percent = rows, nodes, width, percent

    def near(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those that sketches leave: the short ones first, as only wide ones tell long sets apart."""
        percent = self.percent
        side = lambda x: self.nodes.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), *[F.col(k).alias(f"{x}_{k}") for k in SKETCH])
        apart = sum((F.bit_count(F.col(f"a_{k}").bitwiseXOR(F.col(f"b_{k}"))) for k in SKETCH[1:]), F.bit_count(F.col("a_s0").bitwiseXOR(F.col("b_s0"))))
        both = F.col("a_n") + F.col("b_n")
        # dealt by `b`, as a pivot is `a` in many pairs; distinct and the first join need no shuffle of their own
        near = pairs.select("a", "b").repartition("b").distinct().join(side("b"), "b").join(side("a"), "a").filter(apart <= both - 2 * F.ceil(percent * both / (100 + percent)))
        near = stash(near.select("a", "b", "a_n", "b_n"), "near")
        wide = self.nodes.filter("wide is not null")
        wide_a, wide_b = wide.select(F.col("node").alias("a"), F.col("wide").alias("x")), wide.select(F.col("node").alias("b"), F.col("wide").alias("y"))
        both_wide = F.least("a_n", "b_n") > WIDE
        nearer = near.filter(both_wide).join(wide_a, "a").join(wide_b, "b").select("a", "b", "a_n", "b_n", "x", "y").mapInArrow(still_near(percent), "a binary, b binary")
        return stash(nearer.unionAll(near.filter(~both_wide).select("a", "b")), "pairs")

    def of(self, wanted: DataFrame) -> DataFrame:
        """(node, tokens) of the nodes in `want`; a class stands for all its documents."""
        chosen = self.nodes.select("node", "first").join(wanted.distinct(), F.col("node") == F.col("want"), "left_semi")
        held = self.rows.join(chosen, F.coalesce("doc_id", F.lit(NO_ID)) == F.col("first")).select("node", "text")
        return stash(held.mapInArrow(packed(self.width), "node binary, tokens binary"), "sets")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Of pairs, those that link."""
        left = self.near(pairs)
        own = self.of(left.select(F.explode(F.array("a", "b")).alias("want")))
        x, y = own.select(F.col("node").alias("a"), F.col("tokens").alias("x")), own.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
        return stash(left.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(verify(self.percent), "a binary, b binary"), "verified")


def still_apart(members: DataFrame) -> DataFrame:
    """Of (key, node, root), the groups that stand in two components or more."""
    open_keys = members.groupBy(F.col("key").alias("of")).agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("of")
    return stash(members.join(open_keys, F.col("key") == F.col("of"), "left_semi"), "members")


def in_blocks(members: DataFrame, block: int) -> DataFrame:
    """of, main, outers, inners: of each group its largest component, in how many blocks the members outside it fall, and those inside."""
    sizes = members.groupBy("key", "root").count()
    groups = sizes.groupBy(F.col("key").alias("of")).agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.sum("count").alias("all"), F.max("count").alias("held"))
    blocks = lambda n: F.greatest(F.ceil(n / block), F.lit(1)).cast("int")
    return groups.withColumn("outers", blocks(F.col("all") - F.col("held"))).withColumn("inners", blocks(F.col("held")))


def pivot_pairs(members: DataFrame, turn: int, pivots: int) -> DataFrame:
    """Pairs of each group's members with its pivots of this turn, where they stand in different components.

    Pivots are the first members of up to `pivots` buckets in a hash order that all groups share, so that groups of the same sets have the same ones and their pairs fall together.
    """
    mark = F.xxhash64("node", F.lit(turn))
    chosen = members.groupBy(F.col("key").alias("of"), F.pmod(mark, F.lit(pivots)).alias("bucket")).agg(F.min(F.struct(mark.alias("mark"), "node", "root")).alias("p"))
    chosen = chosen.select("of", F.col("p.node").alias("pivot"), F.col("p.root").alias("pivot_root"))
    met = members.join(chosen, F.col("key") == F.col("of")).filter("root <> pivot_root")
    return met.select(F.col("pivot").alias("a"), F.col("node").alias("b"))


def contracted(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members with the roots that new links between them give, as far as their groups still stand apart."""
    roots = members.select("node", "root").distinct()
    of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
    moved = components(links.join(of("a"), "a").join(of("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))
    moved = moved.select(F.col("node").alias("of"), F.col("root").alias("new"))
    return still_apart(members.join(moved, F.col("root") == F.col("of"), "left").select("key", "node", "n", "most", F.coalesce("new", "root").alias("root")))


def large_links(members: DataFrame, links: DataFrame, sets_of: Sets, limits: Limits) -> DataFrame:
    """`links` and more, which connect what all links inside large groups connect.

    Groups are compared in blocks: the members outside a group's largest component against all members. While a member would meet more than Limits.meet others there on average, groups meet a few pivots instead, whatever their size, and components are contracted; pairs inside a component need no comparison.
    """
    stars = stash(components(links).select(F.col("root").alias("a"), F.col("node").alias("b")), "stars")
    links = stars.select("a", "b")
    members = still_apart(members.join(stars, F.col("node") == F.col("b"), "left").select("key", "node", "n", "most", F.coalesce("a", "node").alias("root")))
    for turn in range(limits.turns):
        compared = (F.col("all") - F.col("held")).cast("double") * F.col("all")
        meet, had = in_blocks(members, limits.block).agg(F.coalesce(F.sum(compared), F.lit(0.0)), F.coalesce(F.sum("all"), F.lit(0))).first()
        if meet <= limits.meet * had:
            break
        new = sets_of.links(pivot_pairs(members, turn, limits.pivots))
        links, members = links.unionAll(new), contracted(members, new)
    placed = members.join(in_blocks(members, limits.block), F.col("key") == F.col("of")).withColumn("outer", F.col("root") != F.col("main"))
    at = F.when(F.col("outer"), F.pmod(F.xxhash64("node"), F.col("outers"))).otherwise(F.col("outers") + F.pmod(F.xxhash64("node"), F.col("inners"))).cast("int")
    # an outer block meets every block, an inner one the outer ones only
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("outer"), F.col("outers") + F.col("inners") - 1).otherwise(F.col("outers") - 1)))
    spread = placed.select("node", "key", at.alias("at"), other.alias("other")).select("node", "key", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"))
    own = sets_of.of(members.select(F.col("node").alias("want")))
    filled = spread.join(own.withColumnRenamed("node", "own"), F.col("node") == F.col("own")).select("node", "key", "i", "j", "tokens")
    return links.unionAll(filled.groupBy("key", "i", "j").applyInPandas(links_of_blocks(sets_of.percent), "a binary, b binary"))


def classes_and_links(docs: DataFrame, text: str, width: int, percent: int, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, node) of each row, and links (a, b) between nodes that connect what all links connect."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"))
    bits = ", ".join(f"{b} long" for b in SKETCH)
    seen = stash(rows.mapInArrow(survey(width), f"doc_id long, mark long, n long, node binary, {bits}, wide binary, token long, seen long"), "shingles")
    classes = seen.filter("token is null").select("doc_id", "mark", "n", "node", *SKETCH, "wide")
    often = seen.filter("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")).filter(F.col("seen") >= limits.frequent)
    top = often.orderBy(F.desc("seen"), "token").limit(FREQUENT_MOST).toArrow()
    shared = spark.sparkContext.broadcast((top.column("token").to_numpy().view(np.uint64), top.column("seen").to_numpy()))  # FREQUENT_MOST at most
    keys = rows.select("text").mapInArrow(index(width, percent, shared, limits.pair_size), "key long, node binary, n int, stands int, at int, before long")
    grouped = keys.repartition("key").sortWithinPartitions("key", "n", "node")
    found = stash(grouped.mapInArrow(pair_up(percent, limits.group), "a binary, b binary, key long, n int, most int"), "candidates")
    nodes = classes.filter("node is not null").groupBy("node").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("first"), F.first("n").alias("n"), *[F.first(b).alias(b) for b in (*SKETCH, "wide")])
    sets_of = Sets(rows, stash(nodes, "nodes"), width, percent)
    links = sets_of.links(found.filter("b is not null"))
    members = found.filter("b is null").select("key", F.col("a").alias("node"), "n", "most")
    return classes, links if members.isEmpty() else large_links(members, links, sets_of, limits)


def placed(docs: DataFrame, text: str, width: int, percent: int, limits: Limits) -> DataFrame:
    """doc_id, mark (a hash of the text), n, and least: (no id, doc_id, mark) of the first document in its component."""
    classes, links = classes_and_links(docs, text, width, percent, limits)
    roots = components(links)
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    firsts = classes.filter("node is not null").groupBy("node").agg(F.min(own).alias("first"))
    named = firsts.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = named.groupBy(F.col("root").alias("of")).agg(F.min("first").alias("least"))
    named = named.join(least, F.col("root") == F.col("of")).select(F.col("node").alias("of_node"), "least")
    return classes.join(named, F.col("node") == F.col("of_node"), "left").select("doc_id", "mark", "n", F.coalesce("least", own).alias("least"))


def join(docs: DataFrame, text: str = "text", width: int = 3, percent: int = 90, limits: Limits = LIMITS) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of docs."""
    return placed(docs, text, width, percent, limits).select("doc_id", F.col("n").alias("n_shingles"), F.col("least.doc_id").alias("component_id"))


def dedup(docs: DataFrame, text: str = "text", width: int = 5, percent: int = 80, limits: Limits = LIMITS) -> DataFrame:
    """One row of each component, with all its columns."""
    found = placed(docs, text, width, percent, limits)
    keep = found.filter(F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("mark") == F.col("least.mark"))).select(F.coalesce("doc_id", F.lit(NO_ID)), "mark").distinct()
    return one_of_each(docs, keep, [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64(text)], text)
