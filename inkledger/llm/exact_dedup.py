"""Exact dedup by content-defined chunk recipes, in DataFrame operations only.

Each text, folded to lower case for A-Z, is cut where its own content says so:
after a token (up to a white space or punctuation mark) if the low bits of a hash of it and the
one before are 0 (once in SPACING), so that an insertion moves cuts only next to itself, in
any script. A chunk's identifier is its SHA-256
and length, verified by comparing the bytes of all chunks that carry it. Two
texts are equal if and only if their ordered identifier lists are, so what moves between
tasks to compare documents is a short list, not the text. A document moves
chunk by chunk once, for the verification, after equal chunks of a task have
been merged.

Cases: a null text counts as empty; an empty text has the empty recipe and is
equal to other empty ones; a text without a cut is one chunk; among equal texts the largest doc_id stays; a null
doc_id stays only where no row of the text has another; of rows that repeat the
doc_id that stays, `groups` keeps all and `dedup` one, the first by text and then by other columns; an empty table gives an empty result;
other columns, of any name, pass through `dedup` and are ignored by `groups`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkledger.llm.common import lower_ascii, one_of_each, stash

#: Tokens a chunk on average, a power of two.
SPACING = 64
TOKEN = r"[^\s\p{P}]{1,64}+[\s\p{P}]?|[\s\p{P}]"
#: Stands for a null doc_id in keys.
NO_ID = -(1 << 62)


def let(value: Column, use) -> Column:
    """use(value) with value evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def chunks(text: Column, spacing: int = SPACING) -> Column:
    """Content-defined pieces that join to the text again."""

    def ends(tokens: Column) -> Column:
        # a run of one token is no place to cut
        here, before = lambda i: F.get(tokens, i - 1), lambda i: F.get(tokens, i - 2)
        cut = lambda i: (i == F.size(tokens)) | ((F.xxhash64(before(i), here(i)).bitwiseAND(F.lit(spacing - 1)) == 0) & (here(i) != before(i)))
        return F.filter(F.sequence(F.lit(1), F.size(tokens)), cut)

    def joined(tokens: Column, at: Column) -> Column:
        start = lambda k: F.coalesce(F.get(at, k - 1), F.lit(0))
        return F.transform(at, lambda end, k: F.array_join(F.slice(tokens, start(k) + 1, end - start(k)), ""))

    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(let(tokens, lambda t: let(ends(t), lambda at: joined(t, at))))


def recipes(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text_sha256, pieces, recipe (ordered identifiers)."""
    folded = docs.select("doc_id", lower_ascii(F.coalesce(F.col(text), F.lit(""))).alias("folded"))
    cut = folded.select("doc_id", F.sha2("folded", 256).alias("text_sha256"), chunks(F.col("folded")).alias("pieces"))
    return cut.withColumn("recipe", F.transform("pieces", lambda p: F.concat(F.unhex(F.sha2(p, 256)), F.unhex(F.lpad(F.hex(F.length(p)), 8, "0")))))


def clashes(cut: DataFrame) -> DataFrame:
    """Identifiers that stand for two different chunks."""
    each = cut.select(F.explode(F.arrays_zip("recipe", "pieces")).alias("x")).select(F.col("x.recipe").alias("id"), F.col("x.pieces").alias("piece"))
    return each.groupBy("id").agg(F.min("piece").alias("a"), F.max("piece").alias("b")).filter("a <> b").select("id")


def groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs."""
    cut = stash(recipes(docs, text), "recipes")  # cut and hashed once, read for the verification and for the comparison
    lists = cut.select("doc_id", "recipe", "text_sha256")
    if not clashes(cut).isEmpty():
        # an identifier that failed verification: these texts are compared as a whole
        lists = cut.select("doc_id", F.transform("pieces", lambda p: F.encode(p, "UTF-8")).alias("recipe"), "text_sha256")
    of = lists.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    joined = lists.join(of.withColumnRenamed("recipe", "of_recipe"), F.col("recipe") == F.col("of_recipe"))
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that stay, one of each group, with all their columns."""
    keep = groups(docs, text).filter("kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text_sha256").distinct()
    return one_of_each(docs, keep, [F.coalesce("doc_id", F.lit(NO_ID)), F.sha2(lower_ascii(F.coalesce(F.col(text), F.lit(""))), 256)], text)
