import glob
import math
import os
import subprocess
import sys

import duckdb
import pytest

from photolith.plans import catalogue, catalogue_sources, catalogue_sql

SQL = catalogue_sql.ORACLE_SQL | catalogue_sources.ORACLE_SQL


def cells(rows, names):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return float(f"{v:.9g}") if isinstance(v, float) else v

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert cells([tuple(r) for r in df.collect()], df.columns) == cells(want.fetchall(), names)


def test_every_query_has_its_sql(spark, sf_dir):
    assert set(catalogue.QUERIES) == set(SQL) | {"q93_near_spellings"}  # no SQL has longest matching blocks: `test_spellings` compares with all pairs
    verdicts = {r.verdict for r in catalogue.q22_greedy(spark, sf_dir).collect()}
    assert verdicts == {"new", "exact_duplicate", "ambiguous_match", "low_res_twin", "higher_res_arrived"}
    assert "new" not in {r.verdict for r in catalogue.q24_rerun(spark, sf_dir).collect()}


def test_entry_imports_without_a_session():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, timeout=120).returncode == 0
