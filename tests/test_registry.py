"""Every registered query against DuckDB, and what the driver asks of the entry."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from marginalia import registry

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def base(data):
    con = duckdb.connect()
    for name in os.listdir(data):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{data}/{name}')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, data, base, name):
    df = registry.queries()[name](spark, data)
    rows = df.collect()
    if name not in registry.oracle_sql():
        return
    found = base.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(df.columns)
    at = [columns.index(c) for c in order]
    want = sorted(str([plain(r[i]) for i in at]) for r in found.fetchall())
    assert sorted(str([plain(r[c]) for c in order]) for r in rows) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["query_id", "document_id", "best_chunk", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_subpackage():
    code = "import sys; sys.modules['marginalia.llm'] = None; import __spark_entry__ as e; assert 'pipeline' not in e.queries() and len(e.queries()) > 90"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)
