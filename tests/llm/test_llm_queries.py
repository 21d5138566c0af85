"""The queries of this subpackage on the smallest tables."""

import os

import pytest

from cipherledger.llm import queries as llm

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
FOUND = {
    "p1_found": ["id", "start_char"],
    "p3_found": ["group_id", "field_name", "survivor_id"],
    "p5_found": ["file_id"],
    "p7_found": ["doc_id", "item_id"],
    "p9_found": ["doc_id", "reading_level"],
}


@pytest.mark.parametrize("name", list(llm.QUERIES))
def test_query(spark, name):
    df = llm.QUERIES[name](spark, DIR)
    got = df.collect()
    assert got
    if name in FOUND:
        assert df.columns == FOUND[name] and len(got) == len(set(got))


def test_survivors_equal_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW evidence AS SELECT * FROM '{DIR}/evidence.parquet'")
    assert sorted(map(tuple, llm.QUERIES["p3_found"](spark, DIR).collect())) == sorted(con.execute(llm.ORACLE_SQL["p3_found"]).fetchall())
