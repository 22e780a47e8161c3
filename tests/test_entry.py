import duckdb
import pytest

import __spark_entry__ as entry
from inkledger.plans import registry

SF = "/root/testdata/sf0.001"
SOME = ["reading_accuracy", "parse_amount_numeric", "gating_points", "gating_summary", "localization_summary", "detection_rates", "split_stratified", "coco_annotations", "attr_breakdown", "label_table"]


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def plain(rows):
    return sorted(repr([round(v, 6) + 0.0 if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    names = sorted(df.columns)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == names
    assert plain(map(tuple, df.select(*names).collect())) == plain(want.select(", ".join(f'"{n}"' for n in names)).fetchall())
