"""Language identification by cross-parsing entropy.

For each language a suffix automaton of its labelled sample holds all
substrings of that sample. A text is parsed greedily into the longest phrases
that the automaton reads; a text in the automaton's own language needs few
of them. To point at a phrase in a sample of n symbols takes log2 n bits, so phrases
are normalised by that length, and the language with the fewest bits wins.

Letters are lower-cased and everything else counts as one space. Every letter of
the samples is a symbol; letters that no sample has are one more. An automaton's
transitions are a hash table of (state, symbol), so an alphabet of thousands costs
nothing. A text's blocks of BLOCK symbols advance together, each from the automaton's
start; a phrase that a block's end cuts is counted as two.

Rows to learn from are bounded: about SAMPLE_DOCS whole documents of each language, chosen
by hash among those of up to LONGEST characters, and only those rows move. Every prediction
reads the whole text.

Cases: a null text or one without a letter is `und` with score 0; without
labelled rows every text is `und`; ties go to the first language by code
point; repeated rows are predicted alike; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkledger.llm.common import slices

#: Documents to learn a language from, and characters of the longest of them; a language with longer ones only is learnt from its shortest.
SAMPLE_DOCS, LONGEST = 40, 50_000
BLOCK = 512
TEXT_BYTES = 4 << 20
#: Symbols 0 and 1: anything but a letter; a letter that no sample has.
GAP, OTHER = 0, 1
LETTER = re.compile(r"[^\W\d_]")
CODES = 0x110000
#: No key of a transition; keys of states that go nowhere are small negative numbers.
FREE = -(1 << 62)


def automaton(text: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of `text`, a dict by symbol for each state."""
    go: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for c in text.tolist():
        new = len(go)
        go.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if longest[p] + 1 == longest[q]:
                link[new] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                longest.append(longest[p] + 1)
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return go


class Steps:
    """The transitions of an automaton as one open hash table of (state, symbol)."""

    def __init__(self, go: list[dict[int, int]], symbols: int):
        self.symbols = symbols
        keys = np.fromiter((s * symbols + c for s, d in enumerate(go) for c in d), np.int64)
        to = np.fromiter((t for d in go for t in d.values()), np.int32, len(keys))
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.to = np.full(1 << self.bits, FREE, np.int64), np.zeros(1 << self.bits, np.int32)
        left, at, self.probes = np.arange(len(keys)), self.place(keys), 0
        while len(left):
            free = self.keys[at[left]] == FREE
            self.keys[at[left[free]]] = keys[left[free]]  # of several at one place the last stays
            done = self.keys[at[left]] == keys[left]
            self.to[at[left[done]]] = to[left[done]]
            left = left[~done]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def next(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The next states, -1 where the automaton does not go on."""
        keys = states.astype(np.int64) * self.symbols + symbols
        at = self.place(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.to[at], -1)
        left = np.flatnonzero((found != keys) & (found != FREE))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[left]]
            same = found == keys[left]
            out[left[same]] = self.to[at[left[same]]]
            left = left[~same & (found != FREE)]
        return out


class Parser:
    """The automata of all languages."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.languages = [lang for lang, _ in samples]
        letters = sorted({c for _, s in samples for c in s.lower() if c.isalpha()})
        self.symbol = np.full(CODES, -1, np.int32)  # -1: not seen yet
        self.symbol[list(map(ord, letters))] = np.arange(len(letters), dtype=np.int32) + 2
        parts = [self.symbols(sample) for _, sample in samples]
        self.bits = np.log2([max(len(p), 2) for p in parts])
        self.steps = [Steps(automaton(p), len(letters) + 2) for p in parts]

    def symbols(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        s = self.symbol[codes]
        if (s < 0).any():
            for code in np.unique(codes[s < 0]).tolist():
                self.symbol[code] = OTHER if chr(code).isalpha() else GAP
            s = self.symbol[codes]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != GAP) | (s[:-1] != GAP)
        return s[keep]

    def phrases(self, parts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each part in each language."""
        counts = np.zeros((len(parts), len(self.languages)), np.int64)
        lengths = np.array([len(p) for p in parts], np.int64)
        blocks = -(-lengths // BLOCK)
        owner = np.repeat(np.arange(len(parts)), blocks)
        if not len(owner):
            return counts
        size = np.full(len(owner), BLOCK, np.int64)
        last = np.cumsum(blocks) - 1
        full = np.concatenate([np.concatenate([p, np.zeros(-len(p) % BLOCK, np.int32)]) for p in parts])
        grid = full.reshape(-1, BLOCK)
        size[last[blocks > 0]] = lengths[blocks > 0] - (blocks[blocks > 0] - 1) * BLOCK
        order = np.argsort(-size, kind="stable")
        columns = np.ascontiguousarray(grid[order].T)
        live = np.searchsorted(-size[order], -np.arange(BLOCK), side="left")  # blocks longer than k
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        for lang, steps in enumerate(self.steps):
            start = steps.next(np.zeros(steps.symbols, np.int64), np.arange(steps.symbols))
            # a symbol that the sample does not have leads to -1, which goes nowhere: it is a phrase of its own
            state, found = start[columns[0]], np.ones(len(owner), np.int64)  # the phrase that is open at the end
            for k in range(1, BLOCK):
                m = live[k]
                if not m:
                    break
                to = steps.next(state[:m], columns[k, :m])
                ends = to < 0
                found[:m] += ends
                state[:m] = np.where(ends, start[columns[k, :m]], to)
            np.add.at(counts[:, lang], owner, found[back])
        return counts

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        parts = [self.symbols(t) if t else np.zeros(0, np.int32) for t in texts]
        needed = self.phrases(parts) * self.bits
        langs, scores = [], []
        for text, part, c in zip(texts, parts, needed, strict=True):
            if not self.languages or not ((part > GAP).any() or (text and LETTER.search(text))):
                langs.append("und")
                scores.append(0.0)
                continue
            best = int(c.argmin())
            langs.append(self.languages[best])
            scores.append(float(1 / np.exp2(np.maximum(c.min() - c, -1000)).sum()))
        return langs, scores


@lru_cache(maxsize=2)
def parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(samples)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = SAMPLE_DOCS) -> tuple[tuple[str, str], ...]:
    """(language, sample) by code point, from about `most` labelled documents of each language outside the held-out fold, by hash."""
    known = docs.filter(~held_out(F.col("doc_id")) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    known = known.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64("doc_id", text).alias("h"), F.length(text).alias("size"))
    short = F.col("size") <= LONGEST
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count_if(short).alias("n")).collect()}  # a row per language
    if not sizes:
        return ()
    # each row decides by its own hash whether it is in its language's share, before anything moves
    shares = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, most / n) if n else 0.0)])
    share = F.pmod("h", F.lit(1 << 40)) / float(1 << 40)
    some = known.filter(short & (share < F.element_at(shares, F.col("lang")))).select("lang", "h", "text")
    # rows that repeat share a hash; of them too only so many move
    some = some.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h", "text"))).filter(F.col("k") <= 2 * most).drop("k")
    if long := [k for k, n in sizes.items() if not n]:
        least = known.filter(F.col("lang").isin(long)).groupBy("lang").agg(F.min(F.struct("size", "h", "text")).alias("m"))
        some = some.unionByName(least.select("lang", "m.h", "m.text"))
    by: dict[str, list] = {}
    for r in some.collect():
        by.setdefault(r["lang"], []).append((r["h"], r["text"]))
    return tuple((k, "\n".join(t for _, t in sorted(by[k]))) for k in sorted(by))


def predict(docs: DataFrame, samples: tuple[tuple[str, str], ...], text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of whole texts."""

    def predict_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(samples)
        for whole in batches:
            for batch in slices(whole, most=TEXT_BYTES):
                langs, scores = p.predict(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    docs = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col(text).alias("text"))
    return docs.mapInArrow(predict_batches, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    return predict(docs, learn(docs, text, lang), text)
