"""What surrounds an asset: sensitive places in its path, algorithm strings at its call, the coverage of its scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherledger.functions.scale import previous_in_series
from cipherledger.functions.text import slashed

# Parts of a path that make an asset consequential; families of algorithm names.
SENSITIVE = ["auth", "authentication", "authorization", "payment", "payments", "billing", "banking", "ledger", "identity", "iam", "session", "secrets", "keystore", "keyvault", "kms", "hsm", "vault", "credentials", "signing", "tls", "pki"]
# Years that data of each profile stay confidential.
RETENTION_YEARS = {"session": 0.5, "general_business": 3.0, "financial": 7.0, "personal_data": 10.0, "health": 25.0, "government": 25.0, "national_security": 50.0}
FAMILY_OF = {
    "aes": "AES", "aes-128": "AES", "aes-192": "AES", "aes-256": "AES", "aesgcm": "AES", "rijndael": "AES",
    "chacha20": "ChaCha20-Poly1305", "chacha20-poly1305": "ChaCha20-Poly1305",
    "des": "Legacy-Cipher", "desede": "Legacy-Cipher", "des-ede3": "Legacy-Cipher", "des3": "Legacy-Cipher", "tripledes": "Legacy-Cipher", "3des": "Legacy-Cipher", "rc2": "Legacy-Cipher", "rc4": "Legacy-Cipher", "arc4": "Legacy-Cipher", "blowfish": "Legacy-Cipher", "idea": "Legacy-Cipher", "cast5": "Legacy-Cipher",
    "rsa": "RSA",
    "dsa": "Diffie-Hellman", "dh": "Diffie-Hellman", "diffiehellman": "Diffie-Hellman",
    "ec": "ECC", "ecdsa": "ECC", "ecdh": "ECC", "ed25519": "ECC", "x25519": "ECC",
    "md5": "MD5/SHA-1", "sha1": "MD5/SHA-1", "sha-1": "MD5/SHA-1", "md4": "MD5/SHA-1",
    "sha256": "SHA-2/SHA-3", "sha-256": "SHA-2/SHA-3", "sha384": "SHA-2/SHA-3", "sha-384": "SHA-2/SHA-3", "sha512": "SHA-2/SHA-3", "sha-512": "SHA-2/SHA-3", "sha3-256": "SHA-2/SHA-3", "sha3-512": "SHA-2/SHA-3", "blake2b": "SHA-2/SHA-3",
    "sslv2": "TLS/SSL Protocol", "sslv3": "TLS/SSL Protocol", "ssl": "TLS/SSL Protocol", "tls": "TLS/SSL Protocol", "tlsv1": "TLS/SSL Protocol", "tlsv1.1": "TLS/SSL Protocol", "tlsv1.2": "TLS/SSL Protocol", "tlsv1.3": "TLS/SSL Protocol",
    "kyber": "PQC-FIPS", "ml-kem": "PQC-FIPS", "ml-dsa": "PQC-FIPS", "dilithium": "PQC-FIPS", "sphincs+": "PQC-FIPS", "slh-dsa": "PQC-FIPS", "kyber512": "PQC-FIPS", "kyber768": "PQC-FIPS", "kyber1024": "PQC-FIPS", "dilithium2": "PQC-FIPS", "dilithium3": "PQC-FIPS", "dilithium5": "PQC-FIPS", "falcon512": "PQC-FIPS", "falcon1024": "PQC-FIPS",
}
MODES = ["gcm", "cbc", "ctr", "ecb", "cfb", "ofb", "ccm", "xts", "oaep", "pss"]


def consequence(assets: DataFrame) -> DataFrame:
    """Adds placed_criticality: High where a part of the path, without its ending, is a sensitive place.

    Hardware modules and keys that are High become Critical; broken classes are Medium at least. Null paths
    have no parts; a null criticality stays null unless the path decides.
    """
    parts = F.transform(F.split(F.lower(slashed(F.coalesce("location", F.lit("")))), "/"), lambda p: F.regexp_replace(p, r"\.[^.]*$", ""))
    placed = F.when(F.arrays_overlap(parts, F.array(*map(F.lit, SENSITIVE))), "High").otherwise(F.col("business_criticality"))
    raised = F.when(F.col("type").isin("hardware_module", "key") & (placed == "High"), "Critical").when((F.col("algorithm_class") == "legacy_broken") & (placed == "Low"), "Medium").otherwise(placed)
    return assets.withColumn("placed_criticality", raised)


def family_of(name: Column) -> Column:
    """Family of an algorithm string: the whole text, else its head before / \\ or blank, else its first known token; else null."""
    known = F.create_map(*[F.lit(x) for token, family in FAMILY_OF.items() for x in (token, family)])
    text = F.lower(F.trim(name))
    tokens = F.filter(F.split(text, r"[^a-z0-9.+]+"), lambda t: F.element_at(known, t).isNotNull())
    return F.coalesce(F.element_at(known, text), F.element_at(known, F.regexp_extract(text, r"^([^/\\ ]*)", 1)), F.element_at(known, F.get(tokens, F.lit(0))))


def algorithm_strings(evidence: DataFrame) -> DataFrame:
    """id, stated, family, mode, bits of the quoted algorithm strings in snippets that name a known family.

    mode is the first known one in the string, bits a length of three or four digits in it. Repeated ids count once;
    null snippets have none.
    """
    once = evidence.filter("id is not null and snippet is not null").select("id", "snippet").dropDuplicates(["id"])
    rows = once.select("id", F.explode(F.array_distinct(F.expr(r"""regexp_extract_all(snippet, '["\']([A-Za-z0-9][A-Za-z0-9/+._ -]{1,60})["\']', 1)"""))).alias("stated"))
    mode, bits = mode_and_bits(F.col("stated"))
    return rows.select("id", "stated", family_of(F.col("stated")).alias("family"), mode.alias("mode"), bits.alias("bits")).filter("family is not null")


def mode_and_bits(stated: Column) -> tuple[Column, Column]:
    """The first known mode in an algorithm string, in upper case, and a length of three or four digits in it; null without."""
    low = F.lower(stated)
    mode = reduce(lambda c, m: c.when(F.rlike(low, F.lit(rf"(^|[^a-z0-9]){m}([^a-z0-9]|$)")), m.upper()), MODES, F.when(F.lit(False), ""))
    return mode, F.regexp_extract(stated, r"(?:^|[^0-9])(\d{3,4})(?:[^0-9]|$)", 1).try_cast("int")


def coverage_notes(walks: DataFrame) -> DataFrame:
    """scan_id and what its walk left out, as one text; scans that left out nothing have an empty text. Repeated rows count once."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    notes = [
        F.when(F.col("hit_file_limit"), F.concat(F.lit("stopped after "), F.col("files_scanned").cast("string"), F.lit(" files"))),
        F.when(F.col("hit_depth_limit"), F.lit("directories too deep")),
        F.when(n("files_skipped_size") > 0, F.concat(F.col("files_skipped_size").cast("string"), F.lit(" files too large"))),
        F.when(n("dirs_pruned") > 0, F.concat(F.col("dirs_pruned").cast("string"), F.lit(" directories left out"))),
    ]
    return walks.dropDuplicates(["scan_id"]).select("scan_id", F.concat_ws("; ", *notes).alias("notes"))


def effective_horizon(scans: DataFrame) -> DataFrame:
    """Per system: the smallest horizon of its scans, how many differ, and the profile kept longest. Repeated rows count once."""
    kept = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in RETENTION_YEARS.items() for x in kv]), F.coalesce("sensitivity_profile", F.lit(""))), F.lit(0.0))
    once = scans.dropDuplicates(["scan_id"])
    return once.groupBy("target_name").agg(
        F.coalesce(F.min("mosca_global_z"), F.lit(8.0)).alias("horizon"), F.count_distinct("mosca_global_z").alias("horizons"), F.max(F.struct(kept.alias("y"), F.col("sensitivity_profile").alias("p"))).getField("p").alias("profile"), F.count_distinct("sensitivity_profile").alias("profiles")
    )


def readiness_trend(scans: DataFrame) -> DataFrame:
    """scan_id, score, change: each scan's score and its change since the scan before it in the series, one decimal."""
    once = scans.dropDuplicates(["scan_id"])
    rows = previous_in_series(once, ["installation_id", "target_name"], F.col("created_at"), "scan_id", ["quantum_readiness_score"])
    score = F.col("quantum_readiness_score")
    return rows.select("scan_id", score.alias("score"), F.round((score - F.col("prev_quantum_readiness_score")).cast("decimal(20,6)"), 1).cast("double").alias("change"))
