"""Queries against DuckDB on the smallest tables; the whole set is compared by the driver."""

import numbers
import os

import pytest

import __spark_entry__ as entry
from lexweave.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
TABLES = ("lineitem", "orders", "documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events")


def plain(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(str([round(float(v), 6) if isinstance(v, numbers.Number) else v for v in row]) for row in frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None))


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert plain(entry.queries()[name](spark, SF).toPandas()) == plain(con.execute(entry.oracle_sql()[name]).fetchdf())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r.sound and r.violations == 0 and bool(r.context) == (r.n_seeds > 0) for r in rows)
    assert any(r.n_conflicts for r in rows) and any("[= " in (r.context or "") for r in rows)
