import datetime as dt

import pytest
from conftest import rows

from cipherledger.operators.snapshot_changes import Compared, consecutive_scans, snapshot_changes

T = dt.datetime(2024, 1, 1)
SCANS = "scan_id string, installation_id string, target_name string, created_at timestamp_ntz"
ROWS = "scan_id string, delivery_no int, delivered_at timestamp_ntz, artefact_id string, name string, location string, due string, size int, x double, later string"
COMPARED = Compared(texts=("name",), paths=("location",), dates=("due",), exact=("size",), numbers=("x",))


def scans(spark, *data):
    return spark.createDataFrame(list(data), SCANS)


def row(scan, key, name="n", delivery=1, at=T, location="a/b", due="2030-01-01", size=1, x=1.0):
    return (scan, delivery, at, key, name, location, due, size, x, "clash")


def changes(spark, scan_rows, data):
    out = snapshot_changes(spark.createDataFrame(data, ROWS), scan_rows, "artefact_id", COMPARED)
    return rows(out, "scan_id", "artefact_id", "change_kind")


def day(n):
    return T + dt.timedelta(days=n)


def test_order_of_scans_across_months_and_null_installations(spark):
    s = scans(spark, ("a", None, "t", day(0)), ("b", None, "t", day(40)), ("c", None, "t", day(41)), ("d", "i", "t", day(1)), ("b", None, "t", day(40)), (None, None, "t", day(2)))
    assert rows(consecutive_scans(s), "scan_id", "prev_scan_id") == [("a", None), ("b", "a"), ("c", "b"), ("d", None)]


def test_added_removed_changed_and_notation(spark):
    s = scans(spark, ("a", "i", "t", day(0)), ("b", "i", "t", day(1)))
    old = [row("a", "K1"), row("a", "k2"), row("a", "k3", name=None), row("a", "k4", x=1.0), row("a", "k5", due="2030-01-01T00:00:00"), row("a", "k6", location="a\\b"), row("a", "k8", x=None), row("a", "k9", x=2.0)]
    new = [row("b", "k1 "), row("b", "k3", name="  "), row("b", "k4", x=1.0 + 1e-7), row("b", "k5"), row("b", "k6"), row("b", "k7"), row("b", "k8", x=1.0), row("b", "k9", x=2.00001)]
    assert changes(spark, s, old + new) == [("b", "k2", "removed"), ("b", "k7", "added"), ("b", "k8", "changed"), ("b", "k9", "changed")]


def test_last_delivery_replaces_whole_and_repeated_rows_count_once(spark):
    s = scans(spark, ("a", "i", "t", day(0)), ("b", "i", "t", day(1)))
    data = [row("a", "k1"), row("a", "k1"), row("a", "k2"), row("b", "k1", delivery=1), row("b", "k2", delivery=1), row("b", "k1", delivery=2), row("b", "k1", delivery=2, at=day(3))]
    assert changes(spark, s, data) == [("b", "k2", "removed")]


def test_a_scan_without_rows_is_an_empty_snapshot(spark):
    s = scans(spark, ("a", "i", "t", day(0)), ("b", "i", "t", day(1)), ("c", "i", "t", day(2)))
    assert changes(spark, s, [row("a", "k"), row("c", "k"), row("zzz", "k"), row("c", None), row("c", " ")]) == [("b", "k", "removed"), ("c", "k", "added")]


@pytest.mark.parametrize("some", [True, False])
def test_empty_tables(spark, some):
    s = scans(spark, *([("a", "i", "t", day(0))] if some else []))
    assert changes(spark, s, []) == []


def test_one_series_with_most_scans_is_ordered(spark):
    s = scans(spark, *[(f"s{i:03}", "i", "t", day(i)) for i in range(120)])
    got = dict(rows(consecutive_scans(s), "scan_id", "prev_scan_id"))
    assert got == {f"s{i:03}": (f"s{i - 1:03}" if i else None) for i in range(120)}
