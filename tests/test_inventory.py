import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cipherledger.operators import inventory as inv

T = dt.datetime(2024, 1, 1)
SCHEMA = "id string, scan_id string, system_name string, target_type string, file_path string, line_number int, snippet string, matched_pattern string, raw_type string, detected_name string, version_or_mode string, key_length int, curve_name string, metadata struct<detector: string, parameters_resolved: boolean>, branch string, mode string"


def evidence(i, detected="RSA", matched="", key=None, curve=None, mode=None, kind="algorithm", line=1, path="a.py", scan="s", target="source_code", detector=None, resolved=None, system="x", snippet="t"):
    return (i, scan, system, target, path, line, snippet, matched, kind, detected, mode, key, curve, (detector, resolved), "clash", "clash")


def table(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


@pytest.mark.parametrize(
    "e,family,status,criticality,size",
    [
        (evidence("1"), "RSA", "fully_broken", "Medium", 2048),
        (evidence("1", key=1024), "RSA", "classically_broken", "Critical", 1024),
        (evidence("1", "x", "ecdsa"), "ECC", "fully_broken", "Medium", 256),
        (evidence("1", "ECC", curve="P-384"), "ECC", "fully_broken", "Medium", 384),
        (evidence("1", "ECC", curve="secp239k1"), "ECC", "fully_broken", "Medium", 239),
        (evidence("1", "AES"), "AES", "unknown", "Medium", None),
        (evidence("1", "AES", key=128), "AES", "degraded", "Medium", 128),
        (evidence("1", "DES", "RSA"), "RSA", "fully_broken", "Medium", 2048),
        (evidence("1", "Legacy-Cipher", key=56), "Legacy Symmetric Cipher (DES/3DES/RC4)", "classically_broken", "Critical", 56),
        (evidence("1", "SHA-2/SHA-3", "hashlib.sha256"), "SHA-2 / SHA-3", "degraded", "Low", None),
        (evidence("1", "TLS", "PROTOCOL_TLSv1", kind="protocol"), inv.OLD_PROTOCOL_FAMILY, "classically_broken", "Critical", None),
        (evidence("1", "HSM", kind="hardware_module"), "HSM", "unknown", "Critical", None),
        (evidence("1", None, None), None, "unknown", "Medium", None),
    ],
)
def test_first_family_counts(spark, e, family, status, criticality, size):
    assert rows(inv.normalise(table(spark, e)), "algorithm_family", "quantum_vulnerability", "business_criticality", "key_size_bits") == [(family, status, criticality, size)]


@pytest.mark.parametrize("spec,want", [("^4.2.0", ("4.2.0", True)), ("==4.2.0", ("4.2.0", False)), ("v1.8.0", ("1.8.0", False)), (">=1.5, <2", ("1.5", True)), ("latest", (None, True)), ("*", (None, True)), (None, (None, False)), ("", (None, False)), ("  ", (None, True)), ("git+https", (None, True)), ("1.2.3", ("1.2.3", False))])
def test_version_specifiers(spark, spec, want):
    version, ranged = inv.version_of(F.col("s"))
    assert rows(spark.createDataFrame([(spec,)], "s string").select(version.alias("v"), ranged.alias("r")), "v", "r") == [want]


def test_purl_of_dependencies(spark):
    data = [evidence("1", "lib", "Node.RSA", mode="^1.2.3", target="dependency", path="x/package.json"), evidence("2", "lib", "Py_Crypto.X", mode="==2.0", target="dependency", path="requirements.txt"), evidence("3", "lib", "org.a:b", mode=None, target="dependency", path="pom.xml"), evidence("4", "lib", "q", target="dependency", path="unknown.lock")]
    assert [r[1] for r in rows(inv.normalise(table(spark, *data)), "id", "purl")] == ["pkg:npm/node.rsa@1.2.3", "pkg:pypi/py-crypto-x@2.0", "pkg:maven/org.a/b", None]


def test_merging_never_softens_and_counts_lines_once(spark):
    data = [
        evidence("3", "AES", key=256, line=9, resolved=False, snippet="late"), evidence("1", "AES", key=256, line=4, resolved=True, snippet="b"), evidence("2", "AES", key=256, line=4, snippet="a"),
        evidence("4", "AES", key=256, line=None, detector="regex+taint"), evidence("1", "AES", key=256, line=4, resolved=True, snippet="b"), evidence("5", "AES", key=256, path="other.py"),
    ]
    got = rows(inv.aggregate(inv.normalise(table(spark, *data)), ["scan_id"]), "location", "occurrence_count", "evidence_count", "line_number", "code_snippet", "parameter_source", "confidence")
    assert got == [("a.py", 3, 4, 4, "a", "dataflow", 0.99), ("other.py", 1, 1, 1, "t", None, 0.9)]


def test_merged_scans(spark):
    data = [evidence("1", system="b"), evidence("2", system="a", scan="t"), evidence("3", system="a", scan="u", line=2)]
    assert rows(inv.merge_scans(inv.normalise(table(spark, *data))), "source_systems", "most_occurrences", "evidence_count") == [(["a", "b"], 2, 3)]


def test_merged_scans_count_the_lines_of_all_systems(spark):
    data = [evidence(f"a{n}", "AES", key=256, line=n, system="a", resolved=False) for n in (1, 2, 3)] + [evidence(f"b{n}", "AES", key=256, line=n, system="b", scan="t", detector="regex+taint", snippet="s") for n in (3, 4, 5)]
    got = rows(inv.merge_scans(inv.normalise(table(spark, *data))), "source_systems", "occurrence_count", "most_occurrences", "evidence_count", "parameter_source", "business_criticality", "confidence", "line_number", "code_snippet")
    assert got == [(["a", "b"], 5, 3, 6, "dataflow", "Medium", 0.99, 1, "t")]


def test_nearest_above(spark):
    data = [
        evidence("t1", line=10), evidence("t2", line=12), evidence("t0", line=12), evidence("bound", line=13, key=128), evidence("f1", line=14, detector="taint"), evidence("f2", line=18, detector="ast+taint", path="./a.py"),
        evidence("f3", line=19, detector="taint"), evidence("f4", line=9, detector="taint"), evidence("f5", line=12, detector="taint"), evidence("f6", line=None, detector="taint"), evidence("f7", line=13, detector="taint", path="b.py"),
    ]
    assert rows(inv.nearest_above(table(spark, *data)), "finding_id", "target_id", "distance") == [("f1", "t0", 2), ("f2", "t0", 6), ("f5", "t0", 0)]


def test_findings_are_bound_whatever_the_key_length(spark):
    data = [
        evidence("r1", line=10, key=128), evidence("r2", line=12, key=256), evidence("r3", line=12, key=256), evidence("f1", line=12, detector="taint"), evidence("f2", line=14, detector="taint"),
        evidence("cert", "X509-Certificate", line=20), evidence("f3", line=20, detector="taint"), evidence("f4", line=18, detector="taint"), evidence("u1", None, line=30), evidence("u2", line=30), evidence("f5", line=36, detector="taint", path="./a.py"),
        evidence("own", line=40, key=64), evidence("f6", line=40, detector="taint"), evidence("f7", line=41, detector="taint"), evidence("f8", line=17, detector="taint", path="b.py"), evidence("f9", line=None, detector="taint"),
    ]
    assert rows(inv.bind_findings(table(spark, *data)), "finding_id", "target_id", "distance", "binding") == [
        ("f1", "r2", 0, "direct"), ("f2", "r3", 2, "nearest-generator"), ("f4", "r3", 6, "nearest-generator"), ("f5", "u2", 6, "nearest-generator"), ("f6", "own", 0, "direct"),
    ]
    assert inv.bind_findings(table(spark)).count() == 0


def test_empty(spark):
    empty = inv.normalise(table(spark))
    assert empty.count() == inv.aggregate(empty, ["scan_id"]).count() == inv.merge_scans(empty).count() == inv.nearest_above(table(spark)).count() == 0


APPLIED = ("id", "detected_name", "version_or_mode", "key_length", "curve_name", "key_binding", "replaced_name", "replaced_key_length", "replaced_curve")


def test_findings_are_applied_in_order(spark):
    data = [
        evidence("a1", "Legacy-Cipher", key=56, line=10), evidence("a2", "RSA", line=10), evidence("f1", "AES-256/GCM", line=10, detector="taint"), evidence("f2", "no family", key=192, line=10, detector="taint"),
        evidence("b1", "Unresolved-Algorithm", curve="P-256", line=20), evidence("f3", "?", curve="secp384r1", line=20, detector="regex+taint"),
        evidence("c1", "RSA", key=1024, line=30), evidence("f4", "RSA", key=4096, line=33, detector="taint"), evidence("f5", "RSA", key=3072, line=32, detector="taint", path=".\\a.py"),
        evidence("d1", "AES", line=50), evidence("f6", None, line=50, detector="taint"), evidence("n1", "AES", line=None), evidence("x1", "X509-Certificate", line=10, path="b.py"), evidence("f7", "AES", line=10, path="b.py", detector="taint"),
    ]
    assert rows(inv.apply_findings(table(spark, *data)), *APPLIED) == [
        ("a1", "AES", "GCM", 192, None, "direct", "Legacy-Cipher", 56, None),
        ("b1", "ECC", None, None, "secp384r1", None, "Unresolved-Algorithm", None, "P-256"),
        ("c1", "RSA", None, 4096, None, "nearest-generator", None, 1024, None),
    ]
    assert inv.apply_findings(table(spark)).count() == inv.added_findings(table(spark)).count() == 0


def test_findings_without_a_record_are_evidence_of_their_own(spark):
    data = [
        evidence("r", "AES", line=10), evidence("f1", "AES-CBC", key=128, line=14, detector="taint"), evidence("f2", "mystery", key=64, curve="P-521", line=40, detector="taint"), evidence("f3", "RSA", key=2048, line=40, detector="taint"),
        evidence("f3", "RSA", key=2048, line=40, detector="taint"), evidence("f4", None, line=90, detector="taint"), evidence("f5", "RSA", line=None, detector="taint"),
    ]
    assert rows(inv.added_findings(table(spark, *data)), "finding_id", "param", "detected_name", "version_or_mode", "key_length", "curve_name") == [
        ("f1", "algorithm", "AES", "CBC", None, None), ("f2", "curve", "ECC", None, None, "P-521"), ("f3", "algorithm", "RSA", None, None, None), ("f3", "key_size", "RSA", None, 2048, None),
    ]


def test_ecosystems(spark):
    urls = spark.createDataFrame([("pkg:npm/a@1",), ("pkg:cargo/b",), ("pkg:deb/c",), ("npm/a",), (" ",), (None,)], "u string")
    assert [r[0] for r in urls.select(inv.ecosystem(F.col("u"))).collect()] == ["npm", "crates.io", None, None, None, None]
