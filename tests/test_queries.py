"""Every query runs on the smallest tables; those with SQL give the same rows as DuckDB."""

import os

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "evidence artefact_row scan_summary walk_stats source_file scan_document raw_record documents eval_item reading_label source_target".split()
CORE = [q for part in entry.PARTS if not part.__name__.startswith("cipherledger.llm") for q in part.QUERIES]

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    got = [r.asDict() for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql:
        result = duck.execute(sql)
        columns = [c[0] for c in result.description]
        assert sorted(df.columns) == sorted(columns)
        want = result.fetchall()
        assert sorted((tuple(plain(r[c]) for c in columns) for r in got), key=repr) == sorted((tuple(map(plain, r)) for r in want), key=repr)
