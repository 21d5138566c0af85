import datetime as dt
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_register import T, table

from cipherledger.operators import merging
from cipherledger.operators import register as reg
from cipherledger.operators.scan_documents import bill_vulnerabilities

TODAY = "2026-01-01"
SCANS = "scan_id string, installation_id string, created_at timestamp_ntz, mosca_global_z double, band string"
WALKS = "scan_id string, files_seen int, files_scanned int, files_skipped_size int, files_skipped_type int, dirs_pruned int, hit_file_limit boolean, hit_depth_limit boolean, finished_at timestamp_ntz, created_at string, _own string"
LATER = T + dt.timedelta(days=1)


def wide(spark, *data):
    """Register rows with the columns that the merged view reads beside those of the other tests."""
    t = table(spark, *data)
    lines = {f"{d.get('scan_id', 's')}:{d.get('artefact_id')}": (d.get("line"), d.get("use")) for d in data}
    extra = spark.createDataFrame([(k, *v) for k, v in lines.items()], "_id string, line_number int, crypto_usage string")
    return t.join(extra, "_id", "left").withColumn("installation_id", F.lit("clash")).withColumn("horizon", F.lit(1)).withColumn("target_type", F.lit("source_code"))


def test_merging_never_softens(spark):
    t = wide(
        spark, dict(scan_id="s", artefact_id="a", location="src\\a.py ", line=1, shelf_life_x=9.0, business_criticality="Critical", name="old"), dict(scan_id="u", artefact_id="a", location="src/a.py", line=1, migration_time_y=4.0, business_criticality=None, name="new", system_name="other"),
        dict(scan_id="u", artefact_id="b", location="src/a.py", line=None), dict(scan_id="u", artefact_id="c", location=None, key_size_bits=None, shelf_life_x=None, migration_time_y=None, business_criticality="odd"), dict(scan_id="n", artefact_id="d", location="src/a.py", line=5), dict(scan_id="nowhere", artefact_id="e"),
    )
    scans = spark.createDataFrame([("s", "i", T, 9.0, ""), ("u", "i", LATER, None, ""), ("v", "i", T, 6.0, ""), ("v", "i", T, 6.0, ""), ("n", None, None, None, ""), (None, "i", T, 1.0, "")], SCANS)
    got = {(r.installation_id, r.location): r for r in merging.merged_register(t, scans, TODAY).collect()}
    assert set(got) == {("i", "src/a.py"), ("i", ""), (None, "src/a.py")}
    r = got["i", "src/a.py"]
    assert (r.shelf_life_x, r.migration_time_y, r.business_criticality, r.threat_timeline_z) == (9.0, 4.0, "Critical", 6.0)
    assert (r.name, r.occurrences, r.systems) == ("RSA", 2, 2)  # u:b is the newest scan's larger id
    assert got["i", ""].business_criticality is None and got["i", ""].mosca_slack is None
    assert got[None, "src/a.py"].threat_timeline_z == 8.0
    assert merging.merged_register(t.limit(0), scans, TODAY).count() == 0 and merging.merged_register(t, scans.limit(0), TODAY).count() == 0


def test_recalculation_keeps_rows_and_checks_the_horizon(spark):
    t = wide(spark, dict(artefact_id="a", use="key_transport "), dict(artefact_id="b", use=" integrity"), dict(artefact_id="c", use=None, migration_time_y=None))
    got = {r.artefact_id: r for r in merging.recalculated(t, TODAY, 20.0, 30.0).collect()}
    assert {k: r.shelf_life_x for k, r in got.items()} == {"a": 30.0, "b": 3.0, "c": 30.0}
    assert got["a"].mosca_slack == -12.0 and got["b"].mosca_slack == 15.0 and got["c"].mosca_slack is None
    assert rows(merging.recalculated(t, TODAY, 20.0), "artefact_id", "shelf_life_x") == [("a", 3.0), ("b", 3.0), ("c", 3.0)]
    assert {r.threat_timeline_z for r in t.collect()} == {8.0}
    for z in (0.4, 30.1):
        with pytest.raises(ValueError):
            merging.recalculated(t, TODAY, z)
    assert merging.recalculated(t.limit(0), TODAY, 0.5).count() == 0


def test_walks_together(spark):
    scans = spark.createDataFrame([("s", "i", T, None, ""), ("u", "i", LATER, None, ""), ("v", "i", LATER, None, ""), ("n", None, T, None, "")], SCANS)
    walks = spark.createDataFrame([("s", 5, 4, 1, 7, None, None, True, T, "x", "x"), ("s", 5, 4, 1, 7, None, None, True, T, "x", "x"), ("u", 2, 2, None, None, 3, False, False, LATER, "x", "x"), ("w", 9, 9, 9, 9, 9, True, True, T, "x", "x")], WALKS)
    got = {r.installation_id: r[1:] for r in merging.combined_walks(walks, scans).collect()}
    assert got == {"i": (3, 2, 7, 6, 1, 7, 3, False, True, LATER, 7), None: (1, 0, 0, 0, 0, 0, 0, False, False, None, None)}
    assert merging.combined_walks(walks, scans.limit(0)).count() == 0


def test_capped_pages_and_numbered_waves(spark):
    t = table(spark, *[dict(artefact_id=f"k{i}", must_start_by=d) for i, d in enumerate(["2040-01-01", "2026-06-01", None, "2027-06-01", "2026-07-01"])], dict(scan_id="u", artefact_id="x", must_start_by="2020-01-01"))
    got = reg.capped_page(t, 1, 2, "deadline", cap=4).collect()
    assert [(r.artefact_id, r.results_capped) for r in got] == [("k1", True), ("k3", True)]  # k4 is beyond the cap
    assert [(r.artefact_id, r.results_capped) for r in reg.capped_page(t, 3, 2, "deadline", cap=6).collect()] == [("k0", False), ("k2", False)]
    assert reg.capped_page(t.limit(0)).count() == 0
    assert rows(reg.wave_sequence(t, TODAY), "scan_id", "sequence", "wave", "artefact_id") == [("s", 0, 1, "k1"), ("s", 0, 1, "k4"), ("s", 1, 2, "k3"), ("s", 2, 4, "k0"), ("u", 0, 0, "x")]


def shortened(path, most=48):
    """What short_path must give, directory by directory."""
    if not path:
        return "—"
    p = path.replace("\\", "/")
    if len(p) <= most:
        return p
    *directories, last = p.split("/")
    kept = ""
    for d in directories:
        if len(last) >= most - 4 or len(kept) + len(d) + 1 > most - len(last) - 4:
            break
        kept += d + "/"
    return f"{kept}…/{last}"


def test_paths(spark):
    paths = [None, "", "a", "a\\b.c", "a/", "/" * 60, "x" * 60, "d/" * 30 + "f.py", "dir/" + "y" * 50, "/usr/" + "long" * 9 + "/bin/tool.py", "a/b/" + "z" * 44, "a/b/" + "z" * 43, "first/" + "é" * 20 + "/" + "w" * 30 + "/n.ts", "d/" * 30]
    got = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string").select("i", reg.file_name(F.col("p")).alias("f"), reg.short_path(F.col("p")).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [shortened(p) for p in paths]
    assert [r.f for r in got][:5] == ["—", "—", "a", "b.c", "a/"]


def test_groups_of_a_comparison(spark):
    t = spark.createDataFrame([("s", b) for b in ("removed", "unchanged", "added", "added", "odd", None)], "scan_id string, bucket string")
    assert rows(reg.delta_groups(t), "scan_id", "position", "label", "n") == [("s", 1, "New", 2), ("s", 5, "Removed", 1)]


def test_advisories_of_a_bill(spark):
    known = [
        {"id": "A", "severity": "mODERATE", "aliases": ["z", None, "b"], "fixed_version": "1.2"}, {"id": "B", "severity": "CVSS:3.1/AV:N", "aliases": "one", "reference_url": "u", "summary": ""}, {"id": "C", "severity": None}, {"severity": "Low"}, {"id": "A", "severity": "Unknown"},
    ]
    doc = {"artefacts": [{"id": "x", "known_vulnerabilities": known}, {"known_vulnerabilities": [{"id": "lost"}]}, {"id": "y", "known_vulnerabilities": {"id": "D"}}, {"id": "z"}]}
    t = spark.createDataFrame([("s", T, json.dumps(doc)), ("s", LATER, "{cut"), (None, T, "{}"), ("e", T, "{}"), ("f", T, None)], "scan_id string, received_at timestamp_ntz, document string")
    got = rows(bill_vulnerabilities(t), "artefact_id", "pos", "bom_ref", "aliases", "severity", "rating", "url", "recommendation", "description")
    osv = "https://osv.dev"
    assert got == [
        ("x", 0, "x:A", ["z", "b"], "Moderate", "moderate", osv, "Upgrade to 1.2 or later.", None), ("x", 1, "x:B", ["one"], "See CVSS", "see cvss", "u", None, None), ("x", 2, "x:C", [], "Unknown", None, osv, None, None), ("x", 4, "x:A", [], "Unknown", None, osv, None, None),
        ("y", 0, "y:D", [], "Unknown", None, osv, None, None),
    ]
