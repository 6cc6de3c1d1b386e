import glob
import math
import os

import corpus_pipeline
import duckdb
import pytest

import __spark_entry__
from photolith.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, sf_dir)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    at = [df.columns.index(n) for n in names]
    assert sorted(df.columns) == sorted(names)
    got = sorted((tuple(r[i] for i in at) for r in df.collect()), key=str)
    assert got == sorted(want.fetchall(), key=str) and not any(isinstance(x, float) and math.isnan(x) for r in got for x in r)


def test_all_thirteen_and_the_pipeline_are_registered():
    found = __spark_entry__.queries()
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in found) == 1
    assert found["pipeline"] is corpus_pipeline.run and len(corpus_pipeline.STAGES) == 5
