import re

from conftest import rows

from cipherledger.operators import detection as det

LINES = [
    "key = RSA.generate(3072)  # note", "c = AES.new(k, AES.MODE_GCM)", "Cipher.getInstance('DESede/CBC/PKCS5Padding')", "ECGenParameterSpec('secp384r1')", "digest = hashlib.md5(x)", "x = sha256", "MessageDigest.getInstance(\"SHA-512\")",
    "kem = oqs.KeyExchange('ML-KEM-768')", "-----BEGIN RSA PRIVATE KEY-----", "ctx.PROTOCOL_TLSv1", "boto3.client('kms')", "NORSAHERE", "plain text", "lib = pkcs11.lib()", "new DHParameterSpec(p, g, 2048)", "rsa, key_size = 4096", "X25519MLKEM768",
]


def test_rules_against_plain_expressions(spark):
    text = "\r\n".join(LINES[:6]) + "\r" + "\n".join(LINES[6:]) + "\n"
    df = spark.createDataFrame([(1, text, "clash"), (2, None, ""), (3, "", ""), (4, "nothing here", "")], "id long, text string, rule string")
    want = sorted((n + 1, r.name, m.group(1)) for n, line in enumerate(LINES) for r in det.RULES if (m := re.search(r.regex(), line)))
    assert sorted(x[1:] for x in rows(det.detect(df, "id", "text"), "id", "line_number", "rule", "matched")) == want and len(want) >= 14


def test_parameters_and_defaults(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "id long, text string")
    got = {(r.id, r.detected_name): (r.key_length, r.curve_name, r.mode) for r in det.detect(df, "id", "text").collect()}
    assert got[0, "RSA"] == (3072, None, None) and got[1, "AES"] == (256, None, None) and got[2, "Legacy-Cipher"] == (56, None, "CBC")
    assert got[3, "ECC"] == (None, "SECP384R1", None) and got[15, "RSA"] == (4096, None, None) and got[14, "Diffie-Hellman"] == (2048, None, None)


def test_every_rule_names_an_anchor_of_its_own_examples():
    for r in det.RULES:
        for line in LINES:
            if re.search(r.regex(), line):
                assert any(a in line.lower() for a in r.anchors), (r.name, line)


def test_listing(spark):
    data = [
        (1, "s", 10, "src/a.py"), (2, "s", 10, "src\\vendor\\a.py"), (3, "s", 10, "./web/a.min.js"), (4, "s", 9_000_000, "b.java"), (5, "s", 10, "x/package.json"), (6, "s", 10, ".github/a.yml"), (7, "s", 10, ".hidden/a.yml"),
        (8, "s", 10, "Dockerfile"), (9, "s", 10, "poetry.lock"), (10, "s", 10, "scan_1.json"), (11, "s", 10, "/".join("d" * 26) + "/a.py"), (12, "t", None, "noext"), (13, "t", 1, None), (1, "s", 10, "src/a.py"), (14, "t", 1, "p.egg-info/x.py"),
    ]
    got = rows(det.listing(spark.createDataFrame(data, "file_id long, scan_id string, size_bytes long, file_path string")), "file_id", "verdict", "scanners")
    assert got == sorted(
        [
            (1, "scanned", ["source"]), (2, "pruned", []), (3, "skipped_type", []), (4, "skipped_size", []), (5, "scanned", ["source", "dependency"]), (6, "scanned", ["source"]), (7, "pruned", []), (8, "scanned", ["container"]),
            (9, "skipped_type", []), (10, "skipped_type", []), (11, "pruned", []), (12, "scanned", []), (14, "pruned", []),
        ],
        key=repr,
    )
    empty = spark.createDataFrame([], "file_id long, scan_id string, size_bytes long, file_path string")
    assert det.coverage(empty).count() == 0


def test_depth_and_routing(spark):
    deep = lambda n: "/".join(["d"] * n + ["a.py"])
    files = spark.createDataFrame([(1, "s", 5, deep(24)), (2, "s", 5, deep(25)), (3, "s", 5, None)], "file_id long, scan_id string, size_bytes long, file_path string")
    assert [(r.file_id, r.verdict) for r in det.listing(files).orderBy("file_id").collect()] == [(1, "scanned"), (2, "pruned")]
    scans = spark.createDataFrame([("a", ["source_code", "binary"], 1), ("a", ["source_code", "binary"], 1), ("b", ["multi_target", "binary"], 1), ("c", None, 1), ("d", ["else"], 1), (None, ["binary"], 1)], "scan_id string, target_types array<string>, seq int")
    assert sorted((r.scan_id, r.scanner, r.seq) for r in det.routed(scans).collect()) == [("a", "binary", 2), ("a", "certificate", 5), ("a", "source", 1), ("b", "binary", 2), ("b", "certificate", 5), ("b", "container", 4), ("b", "dependency", 3), ("b", "source", 1)]
