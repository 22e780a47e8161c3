"""Reads as streams: later passes replace earlier ones, stale generations drop, edits stay.

The event-time windows are an extension of this library.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


def latest_reads(reads: DataFrame) -> DataFrame:
    """Per check and field the read of the newest generation and its last pass, whatever order they arrive in. Works on batches and streams (update or complete mode)."""
    rank = F.struct("generation", "pass_rank")
    best = F.max_by(F.struct("text", "confidence", "generation", "pass_rank"), rank).alias("r")
    return reads.groupBy("check_id", "field_name").agg(best).select("check_id", "field_name", "r.*")


STATE = "text string, state string, touched boolean"


def review_step(key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A field's record under gate results and edits: a touched record keeps the operator's text."""
    text, mark, touched = state.get if state.exists else ("", "unread", False)
    for piece in pieces:
        for e in piece.sort_values("seq").itertuples():
            if e.kind == "edit":
                flagged = mark in ("unsure", "blank")
                text, touched = e.text, True
                mark = "confirmed" if e.text.strip() else "blank" if flagged else mark if mark == "unread" else "confirmed"
            elif not touched:
                text, mark = e.text, e.state
    state.update((text, mark, touched))
    yield pd.DataFrame({"check_id": [key[0]], "field_name": [key[1]], "text": [text], "state": [mark], "touched": [touched]})


def review_records(events: DataFrame) -> DataFrame:
    """A stream of gate results and edits (check_id, field_name, seq, kind, text, state) to current records."""
    return events.groupBy("check_id", "field_name").applyInPandasWithState(review_step, "check_id bigint, field_name string, " + STATE, STATE, "update", "NoTimeout")


def seen_before(checks: DataFrame, history: DataFrame) -> DataFrame:
    """A stream of checks against a table of past ones."""
    past = history.groupBy("check_number", "payer").agg(F.max("batch_date").alias("last_batch_date"))
    return checks.join(past, ["check_number", "payer"], "left")


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    events = events.withWatermark("ts", late) if late else events
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str | None = None) -> DataFrame:
    events = events.withWatermark("ts", late) if late else events
    return events.groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    events = events.withWatermark("ts", late) if late else events
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
