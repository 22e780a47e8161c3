"""All queries of the library proper, and their SQL."""

from __future__ import annotations

from inkledger.plans import layout, reading, reports

PAIRS = {**reading.PAIRS, **layout.PAIRS, **reports.PAIRS}


def queries():
    return {name: query for name, (query, _) in PAIRS.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in PAIRS.items() if sql}
