"""Toxicity by a learned lexicon, matched through Levenshtein automata, with context scores.

The lexicon holds words and word beginnings that labelled toxic documents share
and clean ones do not. A term counts by how many texts it is in, near copies taken
for one, so that the words of one text that was copied many times do not enter;
and of all words that are in toxic texts only, a test at a fixed false discovery rate
leaves out those that so many words would show by chance. Each distinct
token is looked up once: as a term, as a term's inflection, as a disguised
term (digits, signs or doubled letters in its place), or as a misspelt term,
found by walking the lexicon's trie with the rows of a Levenshtein automaton that allows
one edit or swap. Around each hit a window is searched for signs that it is
quoted. What a hit of each kind, quoted or not, says about a document is
estimated from the labelled sample; a document's score joins its hits.

Labels are learnt from a bounded sample by hash order: TOXIC_ROWS and
CLEAN_ROWS labelled documents outside the held-out fold. Every score reads the
whole text.

Cases: null and empty texts score as texts without hits; a document labelled
both ways counts as toxic; null labels are no labels; without labels no text
has hits and all score 0.01; repeated rows score alike; an empty table gives no
rows; other columns are ignored by `score` and pass through `drop_toxic`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkledger.llm.common import Words, slices, stash

TOXIC_ROWS, CLEAN_ROWS = 4000, 8000
#: A term is in at least so many of the sampled toxic texts, and this share of its texts is toxic; near copies are one text.
TERM_TEXTS, TERM_PURITY = 4, 0.93
#: A text of fewer distinct words has near copies only in texts of the same words.
SHORT = 20
#: The share of terms that may be there by chance.
FALSE_TERMS = 0.02
STEM_LENGTHS = range(4, 8)
#: Shorter terms are not matched with an edit.
EDIT_LENGTH = 5
WINDOW = 6
THRESHOLD = 0.3
NONE, EXACT, STEM, DISGUISED, MISSPELT = range(5)
KINDS = ("none", "exact", "stem", "disguised", "misspelt")
#: Before any label is seen: chance that a document with such a hit is toxic, plain and quoted; and how many documents that is worth.
PRIOR = {EXACT: (0.9, 0.4), STEM: (0.9, 0.4), DISGUISED: (0.8, 0.35), MISSPELT: (0.45, 0.2)}
PRIOR_DOCS, NO_HIT = 2.0, 0.01
# Signs that stand for letters, and marks and words of quotation.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "+": "t"})
QUOTES = "\"'“”„«»‘’‹›"
CUES = frozenset("quote quoted quotes quoting said says wrote writes called word words term terms zitat zitiert sagte wort cité citation dit mot cita dijo palabra".split())
EDGES = QUOTES + ".,;:?()[]{}|#*%&<>-"
DOUBLED = re.compile(r"(.)\1+")
LETTERS = re.compile(r"[^\W\d_]+")
CACHE = 300_000


class Lexicon(NamedTuple):
    words: tuple[str, ...]
    stems: tuple[str, ...]


class Trie:
    """Lexicon words as nested dicts; the empty string marks an end."""

    def __init__(self, words: tuple[str, ...]):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    @staticmethod
    def exact(node: dict | None, word: str, at: int) -> str | None:
        """The term that the rest of the word ends at, without further edits."""
        for c in word[at:]:
            if node is None:
                return None
            node = node.get(c)
        return node.get("") if node else None

    def within_one(self, word: str) -> str | None:
        """A term one edit or swap of neighbours away.

        The automaton has states without an edit, which follow the trie as far as the word does, and states with one, which must match to the end.
        """
        node, n = self.root, len(word)
        for at in range(n + 1):
            c = word[at] if at < n else ""
            tries = [self.exact(node, word, at + 1)] if c else []
            if at + 1 < n and word[at + 1] != c:
                tries.append(self.exact(node.get(word[at + 1], {}).get(c), word, at + 2))
            for other, child in node.items():
                if other:
                    tries.append(self.exact(child, word, at))
                    if c and other != c:
                        tries.append(self.exact(child, word, at + 1))
            if found := next((t for t in tries if t and t != word), None):
                return found
            node = node.get(c) if c else None
            if node is None:
                return None
        return None


class Matcher:
    def __init__(self, lexicon: Lexicon):
        self.words = frozenset(lexicon.words)
        self.stems = frozenset(lexicon.stems)
        self.stem_lengths = sorted({len(s) for s in lexicon.stems})
        long = tuple(w for w in lexicon.words if len(w) >= EDIT_LENGTH)
        self.trie = Trie(long)
        # by the length of the word looked up: one edit leaves a term's first or second half as it is; swaps of neighbours are few enough to list
        self.heads: dict[int, dict[int, set[str]]] = {}
        self.tails: dict[int, dict[int, set[str]]] = {}
        for w in long:
            half = len(w) // 2
            for size in (len(w) - 1, len(w), len(w) + 1):
                self.heads.setdefault(size, {}).setdefault(half, set()).add(w[:half])
                self.tails.setdefault(size, {}).setdefault(len(w) - half, set()).add(w[half:])
        self.swaps = {w[:k] + w[k + 1] + w[k] + w[k + 2 :] for w in long for k in range(len(w) - 1)} - set(lexicon.words)
        self.firsts = {w[0] for w in lexicon.words}
        self.known: dict[bytes, int] = {}

    def of_word(self, w: str) -> int:
        if w in self.words:
            return EXACT
        for n in self.stem_lengths:
            if w[:n] in self.stems:
                return STEM
        return NONE

    def misspelt(self, w: str) -> bool:
        if w in self.swaps:
            return True
        size = len(w)
        if size not in self.heads:
            return False
        for n, heads in self.heads[size].items():
            if w[:n] in heads:
                break
        else:
            for n, tails in self.tails[size].items():
                if w[size - n :] in tails:
                    break
            else:
                return False
        return self.trie.within_one(w) is not None

    def kind(self, token: bytes) -> int:
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            found = self.known[token] = self.classify(token.decode("utf-8", "surrogatepass").lower())
        return found

    def classify(self, token: str) -> int:
        core = token.strip(EDGES)
        if core.isalpha():
            return self.of_word(core) or self.near(core)
        parts = LETTERS.findall(token)
        kinds = [k for p in parts if (k := self.of_word(p))]
        if kinds:
            return min(kinds)
        if len(core) >= 4 and parts:
            plain, joined = "".join(LETTERS.findall(core.translate(LEET))), "".join(parts)
            if plain != joined and self.of_word(plain) == EXACT or len(parts) > 1 and self.of_word(joined) == EXACT:
                return DISGUISED
            if len(core) in self.heads and self.trie.within_one(core):
                return DISGUISED
        return min((k for p in parts if (k := self.near(p))), default=NONE)

    def near(self, w: str) -> int:
        """Kind of a word that is no term: one with doubled letters, or with an edit."""
        if len(w) < 4:
            return NONE
        if w[0] in self.firsts and DOUBLED.search(w):
            single = DOUBLED.sub(r"\1", w)
            if single in self.words:
                return DISGUISED
        return MISSPELT if self.misspelt(w) else NONE


@lru_cache(maxsize=2)
def matcher(lexicon: Lexicon) -> Matcher:
    return Matcher(lexicon)


def quoted(tokens: list[str], at: int) -> bool:
    """Whether a token stands in quotation marks, or next to a word that announces a quotation."""
    token = tokens[at]
    opened = any(t[:1] in QUOTES for t in tokens[max(0, at - WINDOW) : at + 1] if t)
    closed = any(t.rstrip(".,;:!?")[-1:] in QUOTES for t in tokens[at : at + WINDOW + 1] if t.rstrip(".,;:!?"))
    near = tokens[max(0, at - 3) : at] + tokens[at + 1 : at + 3]
    return bool(token) and (opened and closed or any(t.strip(QUOTES + ".,;:!?").lower() in CUES for t in near))


def hits(m: Matcher, texts: list[str | None]) -> list[list[tuple[int, bool]]]:
    """(kind, quoted) of each hit of each text."""
    words = Words(texts)
    kinds = np.fromiter((m.kind(v) for v in words.values), np.int8, len(words.values))
    found: list[list[tuple[int, bool]]] = [[] for _ in texts]
    if not len(kinds):
        return found
    each = kinds[words.ids]
    at = np.flatnonzero(each)
    owner = np.searchsorted(words.starts, at, side="right") - 1
    for k, i in zip(at.tolist(), owner.tolist(), strict=True):
        low, high = max(int(words.starts[i]), k - WINDOW - 1), min(int(words.starts[i + 1]), k + WINDOW + 2)
        near = [words.values[j].decode("utf-8", "surrogatepass") for j in words.ids[low:high]]
        found[i].append((int(each[k]), quoted(near, k - low)))
    return found


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """toxic, text of the labelled sample."""
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    rows = known.filter("toxic = 1").orderBy(*order).limit(TOXIC_ROWS).unionByName(known.filter("toxic = 0").orderBy(*order).limit(CLEAN_ROWS))
    rows = rows.groupBy(F.col("doc_id").alias("of")).agg(F.max("toxic").alias("toxic"))  # 12,000 rows at most
    return docs.join(F.broadcast(rows), F.col("doc_id") == F.col("of")).select("toxic", F.coalesce(F.col(text), F.lit("")).alias("text"))


def terms_of(text: str) -> Iterator[tuple[str, str]]:
    """(term, word) for the words of a text and their beginnings, which end in * and cover the word that is nothing more."""
    for w in LETTERS.findall(text.lower()):
        if len(w) >= 4:
            yield w, w
            for n in STEM_LENGTHS:
                if n <= len(w):
                    yield w[:n] + "*", w


def sketch_of(text: str) -> int:
    """A mark that near copies mostly share and other texts hardly ever do: the least of each of two hashes over the words; of a few words, they themselves."""
    words = set(text.lower().encode("utf-8", "surrogatepass").split())
    if len(words) < SHORT:
        return xxhash.xxh3_64_intdigest(b" ".join(sorted(words))) >> 1
    both = b"".join(min(xxhash.xxh3_64_digest(w, seed) for w in words) for seed in (1, 2))
    return xxhash.xxh3_64_intdigest(both) >> 1


def term_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, word, of, toxic): the terms of each text, the words they cover, and a mark that near copies share."""
    for whole in batches:
        for batch in slices(whole, most=1 << 20):
            out: list[tuple[str, str, int, int]] = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                of = sketch_of(text)
                out.extend((term, word, of, toxic) for term, word in set(terms_of(text)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64(), pa.int32()))], ["term", "word", "of", "toxic"])


def chance(toxic: int, clean: int, share: float) -> float:
    """How likely a term without meaning is in so many toxic texts or more, of so many in all, where a share of all texts is toxic."""
    n = toxic + clean
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share) for k in range(toxic, n + 1)]
    return min(1.0, sum(map(math.exp, logs)))


def told_apart(found: list[tuple[int, int, int]], share: float) -> set[tuple[int, int]]:
    """Of (toxic, clean, number of such terms), the pairs that pass at a false discovery rate of FALSE_TERMS (Benjamini and Hochberg)."""
    ranked, seen, last = sorted((chance(a, c, share), a, c, n) for a, c, n in found), 0, -1
    total = sum(n for _, _, n in found)
    for k, (p, _, _, n) in enumerate(ranked):
        seen += n
        if p * total <= FALSE_TERMS * seen:
            last = k
    return {(a, c) for _, a, c, _ in ranked[: last + 1]}


def learn_lexicon(rows: DataFrame) -> Lexicon:
    seen = rows.mapInArrow(term_batches, "term string, word string, of long, toxic int")
    # near copies count once
    texts = seen.groupBy("term", "of").agg(F.max("toxic").alias("toxic"))
    counts = stash(texts.groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("c")), "terms")
    # a row for each pair of numbers of texts, both bounded by the sample
    found = [(r["a"], r["c"], r["count"]) for r in counts.filter(F.col("a") + F.col("c") >= TERM_TEXTS).groupBy("a", "c").count().collect()]
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not sizes.get(1):
        return Lexicon((), ())
    # where labels are mostly toxic they say little about a rare term; it then has the benefit of the share that a full sample has
    share = min(sizes[1] / (sizes[1] + sizes.get(0, 0) + 1), TOXIC_ROWS / (TOXIC_ROWS + CLEAN_ROWS))
    good = [(a, c) for a, c in told_apart(found, share) if a >= TERM_TEXTS and a >= TERM_PURITY * (a + c)]
    if not good:
        return Lexicon((), ())
    chosen = rows.sparkSession.createDataFrame(good, "good_a long, good_c long")
    kept = counts.join(chosen, (F.col("a") == F.col("good_a")) & (F.col("c") == F.col("good_c"))).select("term")
    forms = seen.filter(F.col("term").endswith("*") & (F.col("toxic") == 1)).groupBy(F.col("term").alias("of_term")).agg(F.countDistinct("word").alias("words"))
    kept = kept.join(forms, F.col("term") == F.col("of_term"), "left").filter(~F.col("term").endswith("*") | (F.col("words") >= 3))
    terms = sorted(r["term"] for r in kept.select("term").collect())
    stems = [t[:-1] for t in terms if t.endswith("*")]
    stems = tuple(s for s in stems if not any(s != o and s.startswith(o) for o in stems))
    return Lexicon(tuple(t for t in terms if not t.endswith("*")), stems)


def evidence(found: list[tuple[int, bool]]) -> tuple[int, bool]:
    """The strongest hit of a document."""
    return min(found, key=lambda x: (x[1], x[0])) if found else (NONE, False)


def learn_rates(rows: DataFrame, lexicon: Lexicon) -> tuple[tuple[tuple[int, bool], float], ...]:
    """Chance of toxic for documents whose strongest hit is of a kind."""

    def evidence_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher(lexicon)
        for batch in batches:
            best = [evidence(f) for f in hits(m, batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in best], pa.int32()), pa.array([b[1] for b in best], pa.bool_()), batch.column("toxic")], ["kind", "quoted", "toxic"])

    counted = rows.mapInArrow(evidence_batches, "kind int, quoted boolean, toxic int").groupBy("kind", "quoted").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n")).collect()
    by = {(r["kind"], r["quoted"]): (r["a"], r["n"]) for r in counted}
    rates = {(NONE, False): NO_HIT}
    for kind, priors in PRIOR.items():
        for is_quoted, prior in ((False, priors[0]), (True, priors[1])):
            a, n = by.get((kind, is_quoted), (0, 0))
            rates[kind, is_quoted] = (a + PRIOR_DOCS * prior) / (n + PRIOR_DOCS)
    a, n = by.get((NONE, False), (0, 0))
    rates[NONE, False] = min((a + 10 * NO_HIT) / (n + 10), THRESHOLD / 2)
    return tuple(sorted(rates.items()))


class Model(NamedTuple):
    lexicon: Lexicon
    rates: tuple[tuple[tuple[int, bool], float], ...]


def learn(docs: DataFrame, labels: DataFrame, text: str = "text") -> Model:
    rows = stash(sample(docs, labels, text), "labelled")
    lexicon = learn_lexicon(rows)
    return Model(lexicon, learn_rates(rows, lexicon))


def joined(found: list[tuple[int, bool]], rates: dict[tuple[int, bool], float]) -> float:
    """The strongest hit's chance; each further hit of an own kind closes a part of what is missing to 1."""
    if not found:
        return rates[NONE, False]
    chances = sorted((rates[f] for f in found), reverse=True)
    missing = 1 - chances[0]
    for c in chances[1:]:
        missing *= 1 - c / 2 if c >= THRESHOLD else 1
    return 1 - missing


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits, n_quoted of whole texts."""

    def score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, rates = matcher(model.lexicon), dict(model.rates)
        for whole in batches:
            for batch in slices(whole):
                found = hits(m, batch.column("text").to_pylist())
                scores = np.array([joined(f, rates) for f in found])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32)), pa.array([len(f) for f in found], pa.int64()), pa.array([sum(q for _, q in f) for f in found], pa.int64())],
                    ["doc_id", "held_out", "score", "predicted", "n_hits", "n_quoted"],
                )

    docs = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col(text).alias("text"))
    return docs.mapInArrow(score_batches, "doc_id long, held_out boolean, score double, predicted int, n_hits long, n_quoted long")


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns, in one pass over the table."""

    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])  # names of any kind
    at = f"c{names.index(text)}"

    def keep_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, rates = matcher(model.lexicon), dict(model.rates)
        for whole in batches:
            for batch in slices(whole, column=at):
                found = hits(m, batch.column(at).to_pylist())
                yield batch.filter(pa.array([joined(f, rates) < THRESHOLD for f in found], pa.bool_()))

    return plain.mapInArrow(keep_batches, plain.schema).toDF(*names)
