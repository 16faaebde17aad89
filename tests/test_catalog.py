"""Each registered query with SQL against DuckDB on the smallest tables, where those are present."""

import os

import pytest

from tidemark import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("orders", "lineitem", "events", "customer")


def _norm(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    got = [tuple(None if v is None or v != v else v for v in (r[i] for i in order)) for r in rows]
    return sorted(got, key=lambda r: repr([round(v, 3) + 0.0 if isinstance(v, float) else v for v in r]))


def _same(a, b):
    close = lambda x, y: abs(x - y) <= 2e-6 * max(1, abs(y)) if isinstance(x, float) and isinstance(y, float) else x == y
    return len(a) == len(b) and all(len(r) == len(s) and all(map(close, r, s)) for r, s in zip(a, b))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.queries()[name](spark, SF)
    want = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert _same(_norm(map(tuple, df.collect()), df.columns), _norm(want.fetchall(), names))


def test_no_session_needed_to_import():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=root, capture_output=True, text=True)
    assert int(out.stdout.split()[-1]) > 50
