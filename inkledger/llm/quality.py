"""Quality rules by weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on whole-text measures. Most
rules know a fault and abstain where they see none, as the lack of one fault says little
about the others. How often each rule votes what on good and on bad documents is
not known: expectation-maximisation over all documents estimates it, and the
share of good ones, taking the true quality as hidden and rules as independent
given it. The posterior probability of good quality then decides, instead of
a filter that every rule must pass. EM only needs how many documents have each
pattern of votes, at most 3^rules numbers however many documents there are.
It reads no labels.

Cases: a null text has no words; a text without words gets a bad vote from the
length rule only; repeated rows are scored alike; an empty table gives no rows;
other columns, of any name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkledger.llm.common import Words, slices, stash, window_hashes

SYMBOLS = set("#*$%&|<>")
REPEAT_WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_bare", "n_distinct")
#: A posterior under this drops the document.
KEEP_AT = 0.5
#: EM starts from rules that vote bad on so many bad and good documents, good votes the other way round, and this share of good documents.
START_HIT, START_FALSE, START_GOOD, ROUNDS = 0.3, 0.03, 0.8, 100
#: A rule is taken to vote bad on no more than this share of good documents; else a fault of its own kind would pass as a habit of good ones.
FALSE_MOST = 0.01
#: The start counts as so many documents in each round, so that good stays what good votes go with.
PSEUDO = 2.0


def word_traits(word: bytes) -> tuple[int, int, int, int, int, int]:
    """Of a word: code points, symbols, upper-case letters, letters, exclamation and question marks, and whether it has no letter."""
    w = word.decode("utf-8", "surrogatepass")
    letters = sum(c.isalpha() for c in w)
    return len(w), sum(c in SYMBOLS for c in w), sum(c.isupper() for c in w), letters, w.count("!") + w.count("?"), int(not letters)


def dup_lines(text: str | None) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    seen: set[str] = set()
    lines = again = 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\r\x0b\x0c"):
            lines += 1
            again += line in seen
            seen.add(line)
    return lines, again


def repeated(hashes: np.ndarray, width: int = REPEAT_WINDOW) -> int:
    """Words inside windows whose content stands twice or more in the text."""
    grams = window_hashes(hashes, width)
    if not len(grams):
        return 0
    _, back, count = np.unique(grams, return_inverse=True, return_counts=True)
    steps = np.zeros(len(hashes) + 1, np.int64)
    hit = np.flatnonzero(count[back] > 1)
    np.add.at(steps, hit, 1)
    np.add.at(steps, hit + width, -1)
    return int((np.cumsum(steps)[:-1] > 0).sum())


def measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            texts = batch.column("text").to_pylist()
            words = Words(texts)
            n = np.diff(words.starts)
            owner = np.repeat(np.arange(len(texts)), n)
            traits = np.array([word_traits(w) for w in words.values], np.int64).reshape(-1, 6)
            sums = [np.bincount(owner, traits[words.ids, k], len(texts)).astype(np.int64) for k in range(6)]
            hashes = words.hashes()
            spans = list(zip(words.starts[:-1], words.starts[1:], strict=True))
            lines = np.array([dup_lines(t) for t in texts], np.int64).reshape(-1, 2)
            out = [n, sums[0], sums[1], lines[:, 1], np.array([repeated(hashes[a:b]) for a, b in spans], np.int64), lines[:, 0], *sums[2:], np.array([len(np.unique(words.ids[a:b])) for a, b in spans], np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in out)], ["doc_id", *COUNTS])


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and COUNTS of whole texts."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text"))
    return docs.mapInArrow(measure_batches, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def vote(bad: Column, good: Column | None = None) -> Column:
    return F.when(bad, -1).when(F.lit(False) if good is None else good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes by name. Shares are of words, lines or letters."""
    share = lambda part, of: F.col(part) / F.greatest(F.col(of), F.lit(1)).cast("double")
    mean = share("word_chars", "n_words")
    return {
        "length": vote(F.col("n_words") < 5, F.col("n_words") >= 20),
        "word_length": vote((F.col("n_words") > 0) & ((mean > 12) | (mean < 2.5)), mean.between(3.5, 7)),
        "symbols": vote(share("n_symbols", "n_words") > 0.1),
        "duplicate_lines": vote((F.col("n_lines") >= 4) & (share("n_dup_lines", "n_lines") > 0.3)),
        "repetition": vote(share("n_repeat_words", "n_words") > 0.3),
        "capitals": vote((F.col("n_letters") >= 20) & (share("n_upper", "n_letters") > 0.4)),
        "letters": vote((F.col("n_words") >= 20) & (share("n_letters", "word_chars") < 0.7)),
        "bare_words": vote((F.col("n_words") >= 5) & (share("n_bare", "n_words") > 0.2)),
        "marks": vote(share("n_marks", "n_words") > 0.5),
        "variety": vote((F.col("n_words") >= 30) & (F.col("n_distinct") / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)).cast("double")) < 2.5)),
    }


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS, false_most: float = FALSE_MOST) -> tuple[np.ndarray, float, np.ndarray]:
    """EM over vote patterns: P(vote | quality) as [quality, rule, vote + 1], P(good), posterior of each pattern."""
    n_rules = patterns.shape[1] if patterns.ndim == 2 else 0
    start = np.empty((2, n_rules, 3))
    start[0], start[1] = [START_HIT, 1 - START_HIT - START_FALSE, START_FALSE], [START_FALSE, 1 - START_HIT - START_FALSE, START_HIT]
    like, good, post = start.copy(), START_GOOD, np.zeros(len(counts))
    at = np.arange(n_rules)
    for _ in range(rounds if len(counts) else 0):
        logs = [np.log(like[q][at, patterns + 1]).sum(axis=1) + np.log(good if q else 1 - good) for q in (0, 1)]
        post = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        for q, weight in ((0, (1 - post) * counts), (1, post * counts)):
            for v in (-1, 0, 1):
                like[q][:, v + 1] = ((patterns == v) * weight[:, None]).sum(axis=0) + PSEUDO * start[q][:, v + 1]
            like[q] /= like[q].sum(axis=1, keepdims=True)
        wrong = np.minimum(like[1][:, 0], false_most)
        like[1][:, 1:] *= ((1 - wrong) / (1 - like[1][:, 0]))[:, None]
        like[1][:, 0] = wrong
        good = float((post @ counts + PSEUDO * START_GOOD) / (counts.sum() + PSEUDO))
    return like, good, post


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, COUNTS, votes, posterior (of good quality) and kept, by EM over all documents."""
    spark = docs.sparkSession
    names = list(rules())
    voted = stash(measures(docs, text).withColumns(rules()), "votes")
    pattern = F.array(*names)
    found = voted.groupBy(pattern.alias("votes")).count().collect()  # 3^10 rows at most
    votes, counts = np.array([r["votes"] for r in found], np.int64).reshape(-1, len(names)), np.array([r["count"] for r in found], np.float64)
    _, _, post = estimate(votes, counts)
    known = spark.createDataFrame([(list(map(int, v)), float(p)) for v, p in zip(votes, post, strict=True)], "votes array<int>, posterior double")
    return voted.withColumn("votes", pattern).drop(*names).join(F.broadcast(known), "votes").withColumn("kept", F.col("posterior") >= KEEP_AT)
