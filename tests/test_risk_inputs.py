import math

from pyspark.sql import functions as F

from cipherledger.operators import assessment as ass

FIELDS = "i int, scan_id string, algorithm_family string, name string, type string, target_type string, algorithm_class string, business_criticality string, parameter_source string, occurrence_count long, location string, sensitivity_profile string, _kept int"
KEY = ["algorithm_family", "name", "type", "algorithm_class"]


def assets(spark, *data):
    names = [f.split()[0] for f in FIELDS.split(", ")]
    return spark.createDataFrame([tuple({"i": i, "scan_id": "s", "sensitivity_profile": "clash", **d}.get(n) for n in names) for i, d in enumerate(data)], FIELDS).drop("_kept")


def scans(spark, *data):
    return spark.createDataFrame(list(data), "scan_id string, sensitivity_profile string, retention_override_years double, location string")


def test_usage(spark):
    cases = [
        ("integrity", "ECDSA", "x", "certificate", "hash"), ("authenticity", "RSA", "RSA-2048", "certificate", "asymmetric_factoring"), ("authenticity", "ECC", "ecdsa p-256", "algorithm", "asymmetric_discrete_log"), ("authenticity", "ML-DSA", None, "algorithm", "post_quantum"),
        ("key_transport", "ECC", "ECDH with signature", "algorithm", "asymmetric_discrete_log"), ("unknown", "ML-KEM", "Dilithium", "library", "post_quantum"), ("confidentiality", "AES", "AES-128", "algorithm", "symmetric"), ("key_transport", "RSA", "RSA-2048", "algorithm", "asymmetric_factoring"),
        ("key_transport", "TLS", "TLS", "protocol", "unknown"), ("unknown", None, None, None, None),
    ]
    got = ass.usage(assets(spark, *[dict(zip(KEY, c[1:])) for c in cases])).orderBy("i").collect()
    assert [r.crypto_usage for r in got] == [c[0] for c in cases]


def test_shelf_life_and_migration_time(spark):
    t = assets(
        spark, dict(algorithm_class="asymmetric_factoring", type="algorithm", target_type="source_code", business_criticality="Critical", parameter_source="literal", occurrence_count=100, location="a"),
        dict(type="hardware_module", target_type="source_code", algorithm_class="hash", business_criticality="Low", parameter_source="dataflow", occurrence_count=None), dict(scan_id="u"), dict(scan_id="nowhere"), dict(scan_id=None),
        dict(scan_id="v", type="hardware_module", algorithm_class="asymmetric_factoring", business_criticality="Critical", parameter_source="literal", occurrence_count=10**12),
    )
    df = scans(spark, ("s", "health", None, "x"), ("s", "health", None, "x"), ("u", "health", 0.0, "x"), ("v", "odd", None, "x"), (None, "session", None, "x"))
    got = ass.risk_inputs(t, df).orderBy("i").collect()
    assert [r.shelf_life_x for r in got] == [25.0, 10.0, 0.0, 7.0, 7.0, 7.0]
    spread = round(1 + 0.3 * math.log10(100), 3)
    assert [r.migration_time_y for r in got] == [round(0.25 * spread * 1.2 * 1.3 * 1.2, 2), 2.25, 0.5, 0.5, 0.5, 6.0]
    assert ass.risk_inputs(t.limit(0), df).count() == 0 and ass.risk_inputs(t, df.limit(0)).filter(F.col("shelf_life_x") == 10).count() == 1
