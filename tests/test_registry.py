from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from shelfwave.plans.registry import entries

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
SF = "/root/testdata/sf0.001"
SAMPLE = ["top_rising_by_dimension", "trend_snapshots", "document_mentions", "shelf_by_type", "retail_sample", "catalog_sync", "facet_flags", "json_ld_products", "press_brief"]

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="sample tables not present")


def test_every_query_has_an_oracle():
    """Those of this library; training-data queries without a SQL form have their own tests."""
    own = entries()
    assert own.keys() <= entry.queries().keys() and all(e.sql for e in own.values()) and own.keys() <= entry.oracle_sql().keys() <= entry.queries().keys()


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["dimension", "code", "mentions", "momentum", "status", "tone", "place"] and df.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_oracle(spark, name):
    from check_oracle import TABLES, table
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cursor = duck.execute(entry.oracle_sql()[name])
    assert table(df.columns, df.collect()) == table([d[0] for d in cursor.description], cursor.fetchall())
