"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sitefold.plans import catalogue  # noqa: E402

DATA = "/root/testdata/sf0.001"


def cell(v):
    if v is None or v != v:
        return ""
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.sql(f"create view {t[:-8]} as select * from '{DATA}/{t}'")
    got, want = catalogue.QUERIES[name](spark, DATA).toPandas(), con.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = lambda f: sorted(tuple(map(cell, r)) for r in f[columns].itertuples(index=False))
    assert rows(got) == rows(want)


def test_entry_works_without_the_llm_subpackage():
    import subprocess

    code = (
        "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; "
        "q = e.queries(); assert 'daf_patterns' in q and 'pipeline' not in q and not any(x.startswith('op') and x[2].isdigit() for x in q); assert set(e.oracle_sql()) <= set(q)"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
