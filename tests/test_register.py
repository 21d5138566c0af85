import datetime as dt

from conftest import rows

from cipherledger.operators import assessment as ass
from cipherledger.operators import register as reg

T = dt.datetime(2024, 1, 1)
COLUMNS = {
    "_id": "string", "scan_id": "string", "system_name": "string", "artefact_id": "string", "name": "string", "type": "string", "algorithm_family": "string", "algorithm_class": "string", "key_size_bits": "int", "curve": "string",
    "location": "string", "purl": "string", "quantum_vulnerability": "string", "business_criticality": "string", "occurrence_count": "int", "known_vulnerability_count": "int", "risk_category": "string", "shelf_life_x": "double",
    "migration_time_y": "double", "threat_timeline_z": "double", "must_start_by": "string", "must_complete_by": "string", "is_overdue": "boolean", "recommended_standard": "string", "sensitivity_profile": "string", "delivery_no": "int",
    "delivered_at": "timestamp_ntz", "band": "string", "n": "int",
}
DEFAULT = dict(scan_id="s", system_name="sys", name="RSA", type="algorithm", algorithm_family="RSA", algorithm_class="asymmetric_factoring", key_size_bits=2048, location="a", quantum_vulnerability="fully_broken", business_criticality="Medium", occurrence_count=1, known_vulnerability_count=0, risk_category="Low", shelf_life_x=3.0, migration_time_y=2.0, threat_timeline_z=8.0, must_start_by="2030-01-01", must_complete_by="2032-01-01", is_overdue=False, delivery_no=1, delivered_at=T, band="clash", n=7)


def table(spark, *data):
    full = [{**DEFAULT, **d, "_id": f"{d.get('scan_id', 's')}:{d.get('artefact_id')}"} for d in data]
    return spark.createDataFrame([tuple(d.get(c) for c in COLUMNS) for d in full], ", ".join(f"{k} {v}" for k, v in COLUMNS.items()))


def test_current_rows(spark):
    t = table(spark, dict(artefact_id="A"), dict(artefact_id="a"), dict(artefact_id="b"), dict(artefact_id="a", delivery_no=2, name="new"), dict(artefact_id="c", scan_id="u"), dict(artefact_id="c", scan_id=None))
    assert rows(reg.current(t), "scan_id", "artefact_id", "name") == [("s", "a", "new"), ("u", "c", "RSA")]


def test_filters_search_and_pages(spark):
    t = table(spark, *[dict(artefact_id=f"k{i}", name=None if i == 3 else f"n{i}", risk_category=["Low", "High", None][i % 3], is_overdue=i % 2 == 0, must_start_by=None if i == 1 else f"20{30 + i}-01-01", purl="pkg:x" if i == 4 else None) for i in range(7)])
    assert [r[0] for r in rows(reg.matching(t, risk_category="High", overdue_only=True), "artefact_id")] == ["k4"]
    assert [r[0] for r in rows(reg.matching(t, search=" PKG:X K4 "), "artefact_id")] == ["k4"]
    assert reg.matching(t, search="  ", risk_category="").count() == 7
    assert [r.artefact_id for r in reg.page(t, 1, 3, "risk").collect()] == ["k4", "k1", "k0"]
    assert [r.artefact_id for r in reg.page(t, 3, 3, "nonsense").collect()] == ["k5"]
    assert [r.artefact_id for r in reg.page(t, 0, 0, "deadline").collect()] == ["k0"]
    assert reg.page(t, 99, 500, "name").count() == 0
    assert rows(reg.page_counts(t, 3), "total", "total_pages") == [(7, 3)]
    assert rows(reg.capped(t, 5), "kept", "results_capped") == [(5, True)] and rows(reg.capped(t, 7), "kept", "results_capped") == [(7, False)]


def test_rollups(spark):
    t = table(spark, dict(artefact_id="a", risk_category="Critical", system_name=""), dict(artefact_id="b", risk_category=None, is_overdue=None, must_start_by=None, migration_time_y=None))
    assert rows(reg.readiness(t, ["scan_id"]), "readiness", "n") == [(50.0, 2)]
    assert rows(reg.histograms(t, ["scan_id"]), "risk_critical", "risk_high", "status_fully_broken", "status_unknown") == [(1, 0, 2, 0)]
    assert rows(reg.rollup(t, "2026-01-01"), "next_deadline", "overdue", "longest_y", "assets") == [("2030-01-01", 0, 2.0, 2)]
    assert rows(reg.facets(t).filter("facet = 'system_name'"), "value", "n") == [("sys", 1)]
    assert rows(reg.estate(t).filter("is_total = 1"), "assets", "critical") == [(2, 1)]


def test_horizons_against_brute_force(spark):
    data = [dict(artefact_id=str(i), algorithm_class=c, business_criticality=b, shelf_life_x=x, migration_time_y=1.0) for i, (c, b, x) in enumerate((c, b, x) for c in ("hybrid", "legacy_broken", "symmetric") for b in ("High", "Low", None) for x in (0.5, 2.5, 9.0, None))]

    def band(z, c, b, x):
        if c == "hybrid":
            return "Low"
        if c == "legacy_broken":
            return "Critical"
        if x is None:
            return None
        m, heavy = z - x - 1.0, b == "High"
        return ("Critical" if heavy else "High") if m < 1 else ("High" if heavy else "Medium") if m < 3 else "Low"

    want = {}
    for z in (2, 4, 10):
        for k in reg.BANDS:
            want[z, k] = sum(band(z, d["algorithm_class"], d["business_criticality"], d["shelf_life_x"]) == k for d in data)
    assert {(r.z, r.band): r.n for r in reg.horizons(table(spark, *data), [2, 4, 10]).collect()} == want


def test_delta_buckets(spark):
    def one(scan, loc, **k):
        return dict(scan_id=scan, location=loc, artefact_id=f"{loc}{k.pop('i', 0)}", **k)

    t = table(
        spark,
        *[one("old", x) for x in ("gone", "same", "worse", "better", "size", "p\\q", "twice")], one("old", "moved", risk_category=None),
        one("new", "same", occurrence_count=4), one("new", "worse", risk_category="High"), one("new", "better", risk_category=None), one("new", "size", key_size_bits=4096), one("new", "p/q"), one("new", "fresh"), one("new", "moved"), one("new", "twice", i=1, risk_category="High"), one("new", "twice", i=2),
    )
    pairs = spark.createDataFrame([("old", None), ("new", "old"), ("empty", "new")], "scan_id string, prev_scan_id string")
    got = rows(reg.scan_delta(t, pairs).filter("scan_id = 'new'"), "path", "bucket", "occurrence_delta")
    assert got == [("better", "improved", 0), ("fresh", "added", None), ("gone", "removed", None), ("moved", "worsened", 0), ("p/q", "unchanged", 0), ("same", "unchanged", 3), ("size", "parameters_changed", 0), ("twice", "unchanged", 0), ("worse", "worsened", 0)]
    assert rows(reg.delta_counts(reg.scan_delta(t, pairs)).filter("scan_id = 'empty'"), "bucket", "n") == [("removed", 8)]


def test_waves(spark):
    t = table(spark, dict(artefact_id="a", must_start_by="2025-01-01", must_complete_by="2025-06-01", migration_time_y=4.0), dict(artefact_id="b", must_start_by="2027-06-01T00:00:00"), dict(artefact_id="c", must_start_by=None))
    got = rows(reg.waves(t, "2026-01-01"), "wave", "assets", "starts", "deadline", "infeasible", "breached")
    assert got == [(0, 1, "2026-01-01", "2025-06-01", True, True), (2, 1, "2027-06-01", "2032-01-01", False, False)]


def test_verdicts(spark):
    t = table(
        spark,
        dict(artefact_id="safe", algorithm_class="post_quantum", quantum_vulnerability="quantum_safe"), dict(artefact_id="weak", key_size_bits=1024), dict(artefact_id="plain"), dict(artefact_id="tight", shelf_life_x=5.5, business_criticality="High"),
        dict(artefact_id="none", algorithm_class="unknown", quantum_vulnerability="unknown", shelf_life_x=None), dict(artefact_id="law", shelf_life_x=0.0, migration_time_y=0.5, threat_timeline_z=30.0),
    )
    got = {r.artefact_id: r for r in ass.verdicts(t, "2026-01-01").collect()}
    assert (got["safe"].band, got["safe"].binding) == ("Low", None)
    assert (got["weak"].band, got["weak"].binding, got["weak"].overdue) == ("Critical", "regulatory", True)
    assert (got["plain"].band, got["plain"].binding, got["plain"].slack, got["plain"].breach_high) == ("Low", "mosca", 3.0, 0.15)
    assert (got["tight"].band, got["tight"].slack) == ("Critical", 0.5)
    assert (got["none"].band, got["none"].binding) == (None, None)
    assert got["law"].binding == "regulatory"


def test_strength_and_agility(spark):
    t = table(spark, dict(artefact_id="a"), dict(artefact_id="b", algorithm_class="asymmetric_discrete_log", curve="P-521", key_size_bits=521), dict(artefact_id="c", key_size_bits=None), dict(artefact_id="d", algorithm_class="symmetric", key_size_bits=128, sensitivity_profile="national_security"))
    assert rows(ass.strength(t), "artefact_id", "strength_bits", "target_category") == [("a", 112, 3), ("b", 260, 5), ("c", None, 3), ("d", 128, 5)]
    data = [("dataflow", "algorithm", "source_code", "x\\app.yaml", 1, "hash"), ("literal", "hardware_module", "binary", None, 1000, "unknown"), (None, None, None, None, None, None)]
    a = ass.agility(spark.createDataFrame(data, "parameter_source string, type string, target_type string, location string, occurrence_count int, algorithm_class string"))
    assert rows(a, "score", "grade", "weakest", "multiplier") == [(25.0, "Rigid", "configurability", 1.2), (55.0, "Moderate", "substitutability", 1.0), (88.3, "Agile", "indirection", 0.9)]


def test_empty(spark):
    t = table(spark)
    pairs = spark.createDataFrame([], "scan_id string, prev_scan_id string")
    for out in (reg.current(t), reg.page(t), reg.facets(t), reg.readiness(t, ["scan_id"]), reg.rollup(t, "2026-01-01"), reg.scan_delta(t, pairs), reg.waves(t, "2026-01-01"), ass.verdicts(t, "2026-01-01")):
        assert out.count() == 0
    assert rows(reg.page_counts(t), "total", "total_pages") == [(0, 1)]


def test_parameter_changes_between_scans(spark):
    pairs = spark.createDataFrame([("t", "s"), ("s", None)], "scan_id string, prev_scan_id string")
    old = [dict(artefact_id="1", location="a\\b", key_size_bits=2048), dict(artefact_id="2", location="c", key_size_bits=None, curve=" "), dict(artefact_id="3", location="d"), dict(artefact_id="4", location="gone")]
    new = [dict(artefact_id="1", location="a/b", key_size_bits=1024, curve="P-256", occurrence_count=3), dict(artefact_id="2", location="c", key_size_bits=256), dict(artefact_id="3", location="d", name="x"), dict(artefact_id="5", location="new")]
    got = rows(reg.asset_changes(table(spark, *old, *[{**d, "scan_id": "t"} for d in new]), pairs), "path", "parameter", "before", "after", "occurrence_delta")
    assert got == [("a/b", "curve", "", "P-256", 2), ("a/b", "key_size_bits", "2048", "1024", 2), ("c", "key_size_bits", None, "256", 0)]
    assert reg.asset_changes(table(spark), pairs).count() == 0


def test_band_movement_and_long_lead(spark):
    schema = "scan_id string, installation_id string, target_name string, created_at timestamp_ntz, risk_distribution map<string,int>, quantum_readiness_score double"
    day = dt.timedelta(days=1)
    scans = spark.createDataFrame([("a", None, "t", T, {"High": 2, "Low": 1}, 50.0), ("b", None, "t", T + day, {"High": 1, "Critical": 4}, 47.25), ("b", None, "t", T + day, {"High": 1, "Critical": 4}, 47.25), ("c", "i", "t", T, None, None), ("d", "i", "t", T + day, None, 1.0)], schema)
    assert rows(reg.band_movement(scans), "scan_id", "band", "movement", "readiness_delta") == [("b", "Critical", 4, -2.8), ("b", "High", -1, -2.8), ("b", "Low", -1, -2.8)]
    t = table(spark, dict(artefact_id="1", migration_time_y=0.9), dict(artefact_id="2", migration_time_y=1.0), dict(artefact_id="3", migration_time_y=2.5), dict(artefact_id="4", migration_time_y=None))
    assert rows(reg.long_lead(t), "artefact_id", "migration_time_y", "critical_path") == [("2", 1.0, 2.5), ("3", 2.5, 2.5)]
    assert reg.band_movement(scans.limit(0)).count() == reg.long_lead(t.limit(0)).count() == 0
