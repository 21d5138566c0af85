import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cipherledger.operators import context as ctx

T = dt.datetime(2024, 1, 1)


def test_consequence(spark):
    data = [("src/Auth/x.py", "algorithm", "hash", "Low"), ("src\\keystore.json", "key", "unknown", "Medium"), ("a/b.py", "algorithm", "legacy_broken", "Low"), ("authx/b", "algorithm", "hash", "Low"), (None, None, None, None), ("hsm", "hardware_module", None, None), ("a", "key", "x", "High")]
    got = ctx.consequence(spark.createDataFrame(data, "location string, type string, algorithm_class string, business_criticality string"))
    assert [r.placed_criticality for r in got.collect()] == ["High", "Critical", "Medium", "Low", None, "Critical", "Critical"]


@pytest.mark.parametrize("name,family", [("AES/GCM/NoPadding", "AES"), ("aes-256-cbc", "AES"), ("DESede/CBC/PKCS5Padding", "Legacy-Cipher"), ("SHA-1", "MD5/SHA-1"), ("RSA", "RSA"), ("Kyber768", "PQC-FIPS"), ("tlsv1.2", "TLS/SSL Protocol"), ("with ecdsa inside", "ECC"), ("SunJCE", None), ("", None), (None, None)])
def test_families_of_algorithm_strings(spark, name, family):
    assert spark.createDataFrame([(name,)], "n string").select(ctx.family_of(F.col("n"))).first()[0] == family


def test_algorithm_strings(spark):
    data = [("1", 'Cipher.getInstance("AES/GCM/NoPadding"); f(\'rsa-4096\')', "clash"), ("1", 'Cipher.getInstance("AES/GCM/NoPadding"); f(\'rsa-4096\')', "clash"), ("2", None, ""), ("3", "", ""), (None, '"AES"', "")]
    got = ctx.algorithm_strings(spark.createDataFrame(data, "id string, snippet string, mode string"))
    assert rows(got, "id", "stated", "family", "mode", "bits") == [("1", "AES/GCM/NoPadding", "AES", "GCM", None), ("1", "rsa-4096", "RSA", None, 4096)]


def test_notes_horizon_and_trend(spark):
    walks = spark.createDataFrame([("a", 5, 2, 0, True, None), ("a", 5, 2, 0, True, None), ("b", 1, None, None, False, False)], "scan_id string, files_scanned int, files_skipped_size int, dirs_pruned int, hit_file_limit boolean, hit_depth_limit boolean")
    assert rows(ctx.coverage_notes(walks), "scan_id", "notes") == [("a", "stopped after 5 files; 2 files too large"), ("b", "")]
    data = [("1", None, "t", T, 10.0, 8.0, "health"), ("1", None, "t", T, 10.0, 8.0, "health"), ("2", None, "t", T + dt.timedelta(days=45), 12.34, 6.0, None), ("3", "i", "t", T, None, None, "odd")]
    scans = spark.createDataFrame(data, "scan_id string, installation_id string, target_name string, created_at timestamp_ntz, quantum_readiness_score double, mosca_global_z double, sensitivity_profile string")
    assert rows(ctx.readiness_trend(scans), "scan_id", "score", "change") == [("1", 10.0, None), ("2", 12.34, 2.3), ("3", None, None)]
    assert rows(ctx.effective_horizon(scans), "target_name", "horizon", "horizons", "profile", "profiles") == [("t", 6.0, 2, "health", 2)]
    assert ctx.effective_horizon(scans.limit(0)).count() == ctx.readiness_trend(scans.limit(0)).count() == ctx.coverage_notes(walks.limit(0)).count() == 0
