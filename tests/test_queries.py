"""Every query with SQL agrees with DuckDB on the smallest tables, and the library imports without the text operators."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from rallyline import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in queries.TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(value):
    return float(value) if isinstance(value, float) else str(value) if value is not None else None


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    found = duck.sql(queries.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(found.columns)
    mine = sorted([tuple(plain(r[c]) for c in order) for r in df.collect()], key=repr)
    theirs = sorted([tuple(plain(r[found.columns.index(c)]) for c in order) for r in found.fetchall()], key=repr)
    assert mine == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_imports_without_the_text_operators(tmp_path):
    root = Path(entry.__file__).parent
    (tmp_path / "__spark_entry__.py").write_bytes((root / "__spark_entry__.py").read_bytes())
    package = tmp_path / "rallyline"
    package.mkdir()
    for p in (root / "rallyline").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (package / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; assert not any(q.startswith('op') or q == 'pipeline' for q in e.queries()), e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
