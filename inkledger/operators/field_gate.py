"""What a read shows on review: confident, unsure or blank; and how review records change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkledger.functions import text as t

CONFIDENT, UNSURE, BLANK, UNREAD, CONFIRMED = "confident", "unsure", "blank", "unread", "confirmed"
# Confidences from which a read is confident, and unsure. Memo is never confident.
THRESHOLDS = {"check_number": (0.5392, 0.5392), "payer_name": (0.9895, 0.9691), "date": (0.9821, 0.9548), "memo": (float("inf"), 0.9603)}
HANDWRITTEN, HAND_READER, HAND_UNSURE = 0.5, "trocr", 0.6
NOTE = "the written amount reads differently"


def has_text(read: Column) -> Column:
    return F.coalesce(F.trim(read["text"]) != "", F.lit(False))


def by_hand(read: Column) -> Column:
    return F.coalesce(read["reader"] == HAND_READER, F.lit(False))


def unread_hand(read: Column) -> Column:
    """Handwriting that no handwriting reader has read."""
    return F.coalesce(read["handwritten_probability"] > HANDWRITTEN, F.lit(False)) & ~by_hand(read)


def state_of(read: Column, field: str) -> Column:
    sure, maybe = THRESHOLDS[field]
    c = F.coalesce(read["confidence"], F.lit(-1.0))
    return F.when(~has_text(read), BLANK).when(by_hand(read), F.when(c >= HAND_UNSURE, UNSURE).otherwise(BLANK)).when(c >= sure, CONFIDENT).when(c >= maybe, UNSURE).otherwise(BLANK)


def gated(state: Column, value: Column, read: Column, note: Column | None = None, snapped_from: Column | None = None) -> Column:
    blank = F.lit(None).cast("string")
    return F.struct(state.alias("state"), F.when(state == BLANK, "").otherwise(value).alias("value"), read["box"].alias("box"), (blank if note is None else note).alias("note"), (blank if snapped_from is None else F.when(state != BLANK, snapped_from)).alias("snapped_from"))


def gate_check_number(read: Column) -> Column:
    digits = F.when(has_text(read), t.check_number_digits(read["text"]))
    return gated(F.when(digits.isNull() | unread_hand(read), BLANK).otherwise(state_of(read, "check_number")), digits, read)


def gate_date(read: Column, today: Column) -> Column:
    iso = F.when(has_text(read), t.parse_date(read["text"]))
    fits = F.coalesce(t.plausible_date(iso, today), F.lit(False))
    return gated(F.when(unread_hand(read) | ~fits, BLANK).otherwise(state_of(read, "date")), iso, read)


def gate_memo(read: Column) -> Column:
    return gated(F.when(unread_hand(read), BLANK).otherwise(state_of(read, "memo")), F.trim(read["text"]), read)


def gate_payer(read: Column, snap: Column, distance: Column) -> Column:
    """snap and distance: the known name nearest to the read, null if none is within its budget."""
    own = F.when(unread_hand(read), BLANK).otherwise(state_of(read, "payer_name"))
    moved = (own != BLANK) & (distance > 0)
    state = F.when(F.coalesce(moved, F.lit(False)), UNSURE).otherwise(own)
    return gated(state, F.coalesce(snap, F.trim(read["text"])), read, snapped_from=F.when(distance > 0, F.trim(read["text"])))


def gate_payee(read: Column, snap: Column) -> Column:
    """snap: the known name of best score, null if that is too low."""
    state = F.when(~has_text(read) | unread_hand(read), BLANK).otherwise(UNSURE)
    return gated(state, F.coalesce(snap, F.trim(read["text"])), read, snapped_from=F.when(snap.isNotNull(), F.trim(read["text"])))


def gate_amount(numeric: Column, words: Column) -> Column:
    seen = F.coalesce(~unread_hand(words), F.lit(True))
    digits = F.when(has_text(numeric), t.parse_amount_numeric(numeric["text"]))
    spelt = F.when(seen & has_text(words), t.parse_amount_words(words["text"]))
    hand = by_hand(numeric) | seen & by_hand(words)
    agree = F.coalesce(digits == spelt, F.lit(False))
    state = F.when(agree & ~hand, CONFIDENT).when(digits.isNotNull() | spelt.isNotNull(), UNSURE).otherwise(BLANK)
    note = F.when(digits.isNotNull() & spelt.isNotNull() & ~agree, NOTE)
    return gated(state, t.format_cents(F.coalesce(digits, spelt)), numeric, note=note)


def gate_checks(checks: DataFrame, today: Column) -> DataFrame:
    """Checks with struct columns payer_name, payee, amount_numeric, amount_words, date, memo, check_number of (text, confidence, handwritten_probability, reader, box), and payer_snap, payer_distance, payee_snap."""
    c = F.col
    return checks.select(
        "*", gate_payer(c("payer_name"), c("payer_snap"), c("payer_distance")).alias("gated_payer"), gate_amount(c("amount_numeric"), c("amount_words")).alias("gated_amount"),
        gate_date(c("date"), today).alias("gated_date"), gate_check_number(c("check_number")).alias("gated_check_number"),
        gate_memo(c("memo")).alias("gated_memo"), gate_payee(c("payee"), c("payee_snap")).alias("gated_payee"),
    )


def highlighted(record: Column) -> Column:
    return record["review_state"].isin(UNSURE, BLANK)


def tab_stop(record: Column) -> Column:
    return record["gated_state"] != CONFIDENT


def wants_magnifier(record: Column) -> Column:
    return record["gated_state"].isin(UNSURE, BLANK)


def record(text: Column, gated_state: Column, review_state: Column, box: Column, note: Column, snapped_from: Column, touched: Column) -> Column:
    return F.struct(text.alias("text"), gated_state.alias("gated_state"), review_state.alias("review_state"), box.alias("box"), note.alias("note"), snapped_from.alias("snapped_from"), touched.alias("touched"))


def display_text(field: Column, value: Column) -> Column:
    return F.when(field == "date", F.coalesce(t.display_date(t.parse_date(value)), value)).otherwise(value)


def copy_value(field: Column, text: Column) -> Column:
    plain = t.collapse(text)
    return F.when(field == "date", F.coalesce(t.parse_date(plain), plain)).when(field == "amount", F.when(plain == "", "").otherwise(t.normalize_typed_amount(plain))).otherwise(plain)


def apply_gate(r: Column, g: Column, field: Column) -> Column:
    """A new gate result: a touched record only takes its box."""
    kept = record(r["text"], r["gated_state"], r["review_state"], g["box"], r["note"], r["snapped_from"], r["touched"])
    taken = record(display_text(field, g["value"]), g["state"], g["state"], g["box"], g["note"], g["snapped_from"], F.lit(False))
    return F.when(r["touched"], kept).otherwise(taken)


def edit(r: Column, text: Column) -> Column:
    empty = F.when(wants_magnifier(r), BLANK).when(r["review_state"] == UNREAD, UNREAD).otherwise(CONFIRMED)
    state = F.when(F.coalesce((r["snapped_from"] != "") & (text == r["snapped_from"]), F.lit(False)), UNSURE).when(F.trim(text) == "", empty).otherwise(CONFIRMED)
    return record(text, r["gated_state"], state, r["box"], F.lit(None).cast("string"), r["snapped_from"], F.lit(True))


def confirm(r: Column) -> Column:
    done = record(r["text"], r["gated_state"], F.lit(CONFIRMED), r["box"], r["note"], r["snapped_from"], F.lit(True))
    return F.when(highlighted(r) & (F.trim(r["text"]) != ""), done).otherwise(r)


def review_counters(fields: DataFrame, by: list[str]) -> DataFrame:
    state = F.col("review_state")
    return fields.groupBy(*by).agg(F.count_if(state == UNREAD).alias("unread"), F.count_if(state.isin(UNSURE, BLANK)).alias("flagged"), F.count_if(~state.isin(CONFIDENT, CONFIRMED)).alias("unfinished"))


def finished_values(fields: DataFrame) -> DataFrame:
    """What enters history: confident or confirmed values."""
    return fields.filter(F.col("review_state").isin(CONFIDENT, CONFIRMED) & (F.trim("text") != ""))


def tsv_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One clipboard line per row."""
    return rows.withColumn("line", F.concat_ws("\t", *[F.coalesce(t.clean_cell(F.col(c).cast("string")), F.lit("")) for c in columns]))


def seen_before(last_batch_date: Column) -> Column:
    return F.when(last_batch_date.isNotNull(), F.concat(F.lit("Seen before: batch on "), t.short_date(last_batch_date)))
