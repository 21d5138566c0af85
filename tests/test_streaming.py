import datetime as dt
import glob
import shutil

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cipherledger.functions.scale import cut_lineage, previous_in_series, salted_join, shared_folder, spread
from cipherledger.streaming import evidence
from cipherledger.streaming.evidence import evidence_stream, register_upserts, run_to_table, windowed_counts

T = dt.datetime(2024, 1, 1)


def test_windowed_counts_as_stream_and_table(spark, tmp_path):
    data = [("a", "algorithm", T), ("a", "algorithm", T), ("b", "algorithm", T + dt.timedelta(days=1)), ("c", "key", T + dt.timedelta(days=40)), (None, "key", T), ("d", "key", None)]
    df = spark.createDataFrame(data, "id string, raw_type string, recorded_at timestamp_ntz")
    df.write.parquet(f"{tmp_path}/t.parquet")
    out = run_to_table(windowed_counts(evidence_stream(spark, f"{tmp_path}/t.parquet"), lateness="100 days"))
    assert rows(out, "window_start", "raw_type", "n") == rows(windowed_counts(df), "window_start", "raw_type", "n")
    assert sorted(n for _, _, n in rows(out, "window_start", "raw_type", "n")) == [1, 2]


def test_register_upserts_replace_whole_scans(spark, tmp_path):
    schema = "_id string, scan_id string, delivery_no int, name string"

    def deliver(name, data):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        register_upserts(stream, f"{tmp_path}/register", f"{tmp_path}/state").awaitTermination()
        return rows(spark.read.schema(schema).parquet(f"{tmp_path}/register"), "_id", "scan_id", "delivery_no", "name")

    one = [("s:a", "s", 1, "x"), ("s:b", "s", 1, "x"), ("s:b", "s", 1, "x"), ("t:a", "t", 1, "x"), ("n", None, 1, "x")]
    assert deliver("1", one) == [("s:a", "s", 1, "x"), ("s:b", "s", 1, "x"), ("t:a", "t", 1, "x")]
    assert deliver("2", [("s:a", "s", 2, "y")]) == [("s:a", "s", 2, "y"), ("t:a", "t", 1, "x")]
    assert deliver("3", [("s:c", "s", 1, "late"), ("t:b", "t", 1, "x")]) == [("s:a", "s", 2, "y"), ("t:a", "t", 1, "x"), ("t:b", "t", 1, "x")]


REGISTER = "_id string, scan_id string, delivery_no int"


def deliver(spark, at, data, **how):
    """The register after one more delivery."""
    spark.createDataFrame(data, REGISTER).coalesce(1).write.mode("append").parquet(f"{at}/in")
    register_upserts(spark.readStream.schema(REGISTER).parquet(f"{at}/in"), f"{at}/register", f"{at}/state", **how).awaitTermination()
    return rows(spark.read.schema(REGISTER).parquet(f"{at}/register"), "_id", "scan_id", "delivery_no")


def test_register_of_many_scans_has_few_files(spark, tmp_path):
    scans = ["", "7", "007", *(f"s{i}" for i in range(300))]  # these ids stay texts
    one = [(f"{s}:{i}", s, 1) for s in scans for i in (1, 2)]
    assert deliver(spark, tmp_path, one) == sorted(one, key=repr)
    assert len(glob.glob(f"{tmp_path}/register/**/*.parquet", recursive=True)) <= evidence.BUCKETS
    two = [("007:1", "007", 2), ("007:1", "007", 2), ("new:1", "new", 1)]
    want = sorted([r for r in one if r[1] != "007"] + two[1:], key=repr)
    assert deliver(spark, tmp_path, two) == want
    assert len(glob.glob(f"{tmp_path}/register/**/*.parquet", recursive=True)) <= evidence.BUCKETS
    assert not glob.glob(f"{tmp_path}/state/kept/*")
    assert deliver(spark, tmp_path, [("n:1", None, 1), ("x:1", "x", None)]) == want


def test_register_batch_that_broke_off_begins_again(spark, tmp_path, monkeypatch):
    one = [("s:1", "s", 1), ("t:1", "t", 1)]
    assert deliver(spark, tmp_path, one, buckets=1) == one
    with monkeypatch.context() as m:
        m.setattr(evidence, "_remove", lambda *_: 1 / 0)
        with pytest.raises(Exception, match="ZeroDivisionError"):
            deliver(spark, tmp_path, [("t:1", "t", 2)], buckets=1)
    shutil.rmtree(f"{tmp_path}/register/bucket_of_1=0")  # as if it ended while the bucket was replaced
    assert deliver(spark, tmp_path, [("u:1", "u", 1)], buckets=1) == [("s:1", "s", 1), ("t:1", "t", 2), ("u:1", "u", 1)]
    with pytest.raises(Exception, match="isn't kept in 2 buckets"):
        deliver(spark, tmp_path, one, buckets=2)


def test_salted_join_keeps_every_match_once(spark):
    facts = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    dim = spark.createDataFrame([("hot", 1), ("5", 2), (None, 3)], "k string, v int")
    assert salted_join(facts, dim, ["k"], ["id"]).count() == 334 + 1
    left = salted_join(facts.union(spark.createDataFrame([(None, -1)], "k string, id long")), dim, ["k"], ["id"], "left")
    assert left.count() == 1001 and left.filter("v is not null").count() == 335


def test_previous_in_series_with_null_keys_and_times(spark):
    data = [("x", T, "1"), ("x", None, "0"), ("x", T, "2"), ("x", T + dt.timedelta(days=70), "3"), (None, T, "a"), (None, T + dt.timedelta(days=1), "b")]
    df = spark.createDataFrame(data, "s string, t timestamp_ntz, id string")
    assert dict(rows(previous_in_series(df, ["s"], F.col("t"), "id", ["id"]), "id", "prev_id")) == {"0": None, "1": "0", "2": "1", "3": "2", "a": None, "b": "a"}


def test_lineage_and_spread(spark):
    df = spark.range(10).coalesce(1)
    assert cut_lineage(df).count() == 10 and spread(df).rdd.getNumPartitions() == 4 and spread(spark.range(10, numPartitions=3)).rdd.getNumPartitions() == 3
    assert shared_folder(spark) != shared_folder(spark)
