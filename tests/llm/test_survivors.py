import datetime as dt

from conftest import rows

from cipherledger.llm.survivors import agreement, long_reports, survivors, value_levels

T = dt.datetime(2024, 1, 1)
SCHEMA = "id string, scan_id string, file_path string, line_number int, raw_type string, detected_name string, key_length int, curve_name string, version_or_mode string, metadata struct<detector: string, parameters_resolved: boolean>, recorded_at timestamp_ntz, rank int"


def report(i, name=None, key=None, curve=None, mode=None, day=0, detector=None, resolved=None, path="a/b", line=1, scan="s", kind="algorithm"):
    at = None if day is None else T + dt.timedelta(days=day)
    return (i, scan, path, line, kind, name, key, curve, mode, (detector, resolved), at, 9)


def kept(spark, *reports):
    return rows(survivors(spark.createDataFrame(list(reports), SCHEMA)), "group_id", "field_name", "survivor_id")


def test_provenance_then_time_then_id_field_by_field(spark):
    got = kept(
        spark,
        report("a", name="RSA", key=1024, resolved=False, day=5),
        report("b", name="RSA-2048", key=2048, resolved=True, day=1, path="./a\\b"),
        report("c", name=" N/A ", key=0, curve="P-256", detector="regex+taint", day=9),
        report("d", name="AES", curve="P-384", day=9),
        report("e", name="RSA-2048", resolved=True, day=1),
    )
    assert got == [("a", "curve_name", "c"), ("a", "detected_name", "b"), ("a", "key_length", "b")]


def test_groups_need_two_ids_a_line_and_equal_keys(spark):
    twice = report("a", name="RSA")
    assert kept(spark, twice, twice, report("b", name="RSA", line=None), report("c", name="RSA", line=None), report("d", name="RSA", path="x"), report("e", name="RSA", kind="key")) == []


def test_values_that_are_none(spark):
    assert kept(spark, report("a", name="-", key=-1, curve="", mode="Unknown"), report("b", name="n/A", key=0, curve=None, mode=" ")) == []


def test_missing_timestamps_take_the_topologically_latest_value(spark):
    history = [x for n in range(3) for x in (report(f"h{n}1", name="DES", day=1, line=10 + n), report(f"h{n}2", name="3DES", day=2, line=10 + n), report(f"h{n}3", name="AES", day=3, line=10 + n))]
    odd = [report("o1", name="AES", day=1, line=50), report("o2", name="DES", day=2, line=50)]
    untimed = [report("u1", name="DES", day=None, line=99), report("u2", name="AES", day=None, line=99), report("u3", name="3DES", day=None, line=99)]
    df = spark.createDataFrame(history + odd + untimed, SCHEMA)
    levels = {r.value: r.level for r in value_levels(long_reports(df)).filter("field = 'detected_name'").collect()}
    assert levels["des"] < levels["3des"] < levels["aes"]
    assert ("u1", "detected_name", "u2") in kept(spark, *history, *odd, *untimed)


def test_a_cycle_of_values_ends(spark):
    a = [report(f"{x}{y}", name=v, day=d, line=n) for n, (x, p, q) in enumerate((("a", "X", "Y"), ("b", "Y", "Z"), ("c", "Z", "X"))) for y, v, d in ((1, p, 1), (2, q, 2))]
    assert len(kept(spark, *a)) == 3


def test_levels_of_long_chains_and_of_what_lies_behind_cycles(spark):
    steps = [(f"1.{k}", f"1.{k + 1}") for k in range(12)] + [("1.12", "X"), ("X", "Y"), ("Y", "Z"), ("Z", "X"), ("X", "9"), ("9", "8"), ("8", "P"), ("P", "Q"), ("Q", "R"), ("R", "P")]
    pairs = [report(f"{n:02}{y}", mode=v, day=y, line=n) for n, s in enumerate(steps) for y, v in enumerate(s)]
    level = {r.value: r.level for r in value_levels(long_reports(spark.createDataFrame(pairs, SCHEMA))).collect()}
    assert [level[f"1.{k}"] for k in range(13)] == list(range(13))
    assert level["1.12"] < level["x"] < level["9"] < level["8"] < level["p"]  # 9 and 8 stand between two cycles, not on one


def test_empty(spark):
    assert kept(spark) == []


def test_a_long_chain_decides_where_times_are_missing(spark):
    chain = [report(f"{n:02}{y}", mode=f"v{n + y:02}", day=y, line=n) for n in range(13) for y in (0, 1)]
    untimed = [report("u1", mode="v09", day=None, line=99), report("u2", mode="v13", day=None, line=99)]
    assert ("u1", "version_or_mode", "u2") in kept(spark, *chain, *untimed)
    timed = [report("w1", mode="v13", day=1, line=98), report("w2", mode="v09", day=2, line=98)]  # its own times hold
    assert ("w1", "version_or_mode", "w2") in kept(spark, *chain, *untimed, *timed)


def test_agreement_where_times_are_withheld(spark):
    history = [x for n in range(40) for x in (report(f"{n:03}a", name="DES", day=1, line=n), report(f"{n:03}b", name="AES", day=2, line=n))]
    (got,) = rows(agreement(spark.createDataFrame(history, SCHEMA)), "field_name", "n_groups", "learned", "same_value")
    assert got == ("detected_name", 40, 40, 40)
