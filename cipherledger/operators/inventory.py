"""Raw evidence to typed assets, and assets collapsed into an inventory.

Families are recognised by an ordered list of marks: the first family whose mark is contained in the
detected name or the matched pattern counts, so the order of FAMILIES is part of the semantics.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherledger.functions.text import plain_path
from cipherledger.operators.context import family_of, mode_and_bits

# Marks of each family in order, and the family's name and class.
FAMILIES: list[tuple[str, list[str], str, str]] = [
    ("rsa", ["RSA"], "RSA", "asymmetric_factoring"),
    ("ecc", ["ECC", "ECDSA", "ECDH", "SECP256K1", "ED25519", "X25519", "PRIME256V1"], "ECC", "asymmetric_discrete_log"),
    ("dh", ["DIFFIE-HELLMAN", "DH", "DSA"], "Diffie-Hellman / DSA", "asymmetric_discrete_log"),
    ("aes", ["AES"], "AES", "symmetric"),
    ("legacy", ["DES", "3DES", "TRIPLEDES", "RC4", "BLOWFISH", "LEGACY-CIPHER"], "Legacy Symmetric Cipher (DES/3DES/RC4)", "legacy_broken"),
    ("chacha", ["CHACHA20"], "ChaCha20-Poly1305", "symmetric"),
    ("md5", ["MD5", "SHA-1", "SHA1"], "MD5/SHA-1", "legacy_broken"),
    ("sha2", ["SHA-256", "SHA-384", "SHA-512", "SHA-3", "SHA256"], "SHA-2 / SHA-3", "hash"),
    ("pqc", ["ML-KEM", "KYBER", "ML-DSA", "DILITHIUM", "SLH-DSA", "SPHINCS+", "FALCON", "PQC-FIPS", "FIPS 203", "FIPS 204", "FIPS 205"], "NIST Post-Quantum Standard (FIPS 203/204/205)", "post_quantum"),
    ("hybrid", ["HYBRID", "X25519KYBER768", "X25519MLKEM"], "Hybrid PQC + Classical Scheme", "hybrid"),
]
OLD_PROTOCOLS = ["SSLV2", "SSLV3", "TLSV1", "TLSV1.0", "TLSV1.1"]
OLD_PROTOCOL_FAMILY = "Deprecated Protocol (SSL/TLS < 1.2)"
# Field sizes of named curves, in the order in which decorated names are searched.
CURVE_BITS: list[tuple[str, int]] = [
    ("secp160r1", 160), ("secp160k1", 160), ("secp160r2", 160), ("secp192r1", 192), ("secp192k1", 192), ("prime192v1", 192), ("p-192", 192),
    ("secp224r1", 224), ("secp224k1", 224), ("p-224", 224), ("secp256r1", 256), ("secp256k1", 256), ("prime256v1", 256), ("p-256", 256),
    ("nist256p", 256), ("nistp256", 256), ("secp384r1", 384), ("p-384", 384), ("nist384p", 384), ("nistp384", 384), ("secp521r1", 521),
    ("p-521", 521), ("nist521p", 521), ("nistp521", 521), ("ed25519", 255), ("x25519", 255), ("curve25519", 255), ("ed448", 448), ("x448", 448),
    ("curve448", 448), ("brainpoolp160r1", 160), ("brainpoolp192r1", 192), ("brainpoolp224r1", 224), ("brainpoolp256r1", 256),
    ("brainpoolp320r1", 320), ("brainpoolp384r1", 384), ("brainpoolp512r1", 512), ("sect163k1", 163), ("sect233k1", 233), ("sect283k1", 283),
    ("sect409k1", 409), ("sect571k1", 571),
]
CRITICALITY = ["Low", "Medium", "High", "Critical"]  # by rank from 0
PROVENANCE = ["assumed", "literal", "dataflow"]  # by rank from 1
# Manifest names, purl types.
MANIFESTS = {"package.json": "npm", "requirements.txt": "pypi", "Pipfile": "pypi", "pom.xml": "maven", "go.mod": "golang", "Cargo.toml": "cargo"}

# Names whose parameters identify the asset, so that no finding is bound to them.
NON_ALGORITHMS = ["Hardcoded-Private-Key", "Hardcoded-Public-Key", "X509-Certificate", "Cloud KMS Service", "HSM/PKCS#11 Module"]


def _any_in(texts: list[Column], marks: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(t, F.lit(m)) for t in texts for m in marks])


def curve_bits(curve: Column) -> Column:
    """Field size of a curve name: exact, then the first known name contained, then three digits, else null."""
    text = F.lower(F.trim(curve))
    exact = reduce(lambda c, kv: c.when(text == kv[0], F.lit(kv[1])), CURVE_BITS, F.when(text == "", F.lit(None).cast("int")))
    inside = reduce(lambda c, kv: c.when(F.contains(text, F.lit(kv[0])), F.lit(kv[1])), CURVE_BITS, F.when(F.lit(False), F.lit(0)))
    return F.coalesce(exact, inside, F.regexp_extract(text, r"(\d{3})", 1).try_cast("int"))


def version_of(specifier: Column) -> tuple[Column, Column]:
    """(concrete version or null, whether the specifier was a range) of a manifest's version specifier."""
    text = F.trim(specifier)
    marks = ["^", "~", ">", "<", "*", "x", "||", ",", " - "]
    ranged = _any_in([text], marks)
    ranged = F.when(F.startswith(text, F.lit("==")) & ~_any_in([F.substring(text, 3, 1000)], marks), False).otherwise(ranged)
    bare = F.regexp_replace(F.regexp_replace(text, r"^\s*(?:[\^~=<>!]+|v)\s*", ""), r"\s*(?:,|\|\||\s-\s|\s+).*$", "")
    bare = F.regexp_replace(F.trim(bare), r"^[=<>!~^ ]+|[=<>!~^ ]+$", "")
    whole = F.rlike(bare, F.lit(r"^\d[\w.\-+]*$"))
    blank = specifier.isNull() | (specifier == "")
    version = F.when(~blank & (text != "") & ~text.isin("*", "latest") & whole, bare)
    is_range = F.when(blank, False).when((text == "") | text.isin("*", "latest") | ~whole, True).otherwise(ranged)
    return version, is_range


def purl(kind: Column, name: Column, version: Column) -> Column:
    """Package URL; null without a kind or name. pypi and npm names are in lower case, pypi's dots and underscores are dashes."""
    plain = F.when(kind == "pypi", F.regexp_replace(F.lower(F.trim(name)), "[._]+", "-")).when(kind == "npm", F.lower(F.trim(name))).otherwise(F.trim(name))
    pathed = F.when((kind == "maven") & F.contains(plain, F.lit(":")), F.regexp_replace(plain, "^([^:]*):", "$1/")).otherwise(plain)
    return F.concat(F.lit("pkg:"), kind, F.lit("/"), pathed, F.coalesce(F.concat(F.lit("@"), version), F.lit("")))


def normalise(evidence: DataFrame) -> DataFrame:
    """One typed asset for each piece of evidence; repeated rows count once.

    Null names and patterns count as empty text, so they are of no known family. A null key length
    stays unknown except where the family fixes it. Other columns are not read.
    """
    e = evidence.select("id", "scan_id", "system_name", "target_type", "file_path", "line_number", "snippet", "matched_pattern", "raw_type", "detected_name", "version_or_mode", "key_length", "curve_name", "metadata").dropDuplicates(["id"])
    name, matched = F.upper(F.coalesce("detected_name", F.lit(""))), F.upper(F.coalesce("matched_pattern", F.lit("")))
    both = [name, matched]
    branch = reduce(lambda c, f: c.when(_any_in(both, f[1]), f[0]), FAMILIES, F.when(F.lit(False), ""))
    branch = branch.when(_any_in([matched], OLD_PROTOCOLS), "old_tls").otherwise("other")
    kind = F.lower("raw_type")
    types = ["key", "certificate", "protocol", "library", "hardware_module", "cloud_service"]
    detector = F.coalesce(F.col("metadata.detector"), F.lit(""))
    resolved = F.col("metadata.parameters_resolved")
    e = e.withColumns({"branch": branch, "type": F.when(kind.isin(types), kind).otherwise("algorithm"), "mode": F.col("version_or_mode")})
    b, size = F.col("branch"), F.col("key_length")
    stated = F.coalesce(size, F.lit(0)) != 0
    curve = F.when((b == "ecc") & (F.coalesce("curve_name", F.lit("")) == ""), "secp256r1 (P-256)").otherwise(F.col("curve_name"))
    e = e.withColumn("curve", curve)
    key = F.when((b == "rsa") & ~stated | (b == "dh") & ~stated, 2048).when(b == "ecc", curve_bits(F.col("curve"))).when(b == "chacha", 256).otherwise(size)
    e = e.withColumn("key_size_bits", key)
    weak_rsa = stated & (size <= 1024)
    by_type = F.when(F.col("type").isin("key", "certificate", "cloud_service"), "High").when(F.col("type") == "hardware_module", "Critical").otherwise("Medium")
    criticality = (
        F.when(b == "rsa", F.when(weak_rsa, "Critical").when(F.col("key_size_bits") >= 2048, "Medium").otherwise("High"))
        .when(b.isin("ecc", "dh", "aes", "chacha", "md5"), "Medium")
        .when(b.isin("legacy", "old_tls"), "Critical")
        .when(b.isin("sha2", "pqc", "hybrid"), "Low")
        .otherwise(by_type)
    )
    status = (
        F.when(b == "rsa", F.when(weak_rsa, "classically_broken").otherwise("fully_broken"))
        .when(b.isin("ecc", "dh"), "fully_broken")
        .when(b == "aes", F.when(size.isNull(), "unknown").when(size <= 128, "degraded").otherwise("quantum_safe"))
        .when(b.isin("legacy", "md5", "old_tls"), "classically_broken")
        .when(b == "sha2", F.when(_any_in(both, ["256"]), "degraded").otherwise("quantum_safe"))
        .when(b.isin("chacha", "pqc"), "quantum_safe")
        .when(b == "hybrid", "hybrid_protected")
        .otherwise("unknown")
    )
    family = reduce(lambda c, f: c.when(b == f[0], f[2]), FAMILIES, F.when(b == "old_tls", OLD_PROTOCOL_FAMILY)).otherwise(F.col("detected_name"))
    cls = reduce(lambda c, f: c.when(b == f[0], f[3]), FAMILIES, F.when(b == "old_tls", "legacy_broken")).otherwise("unknown")
    source = F.when(F.contains(detector, F.lit("taint")), "dataflow").when(resolved, "literal").when(~resolved, "assumed")
    confidence = F.when(F.contains(detector, F.lit("taint")), 0.99).when(detector == "ast", 0.98).otherwise(0.90)
    manifest = F.substring_index("file_path", "/", -1)
    package = reduce(lambda c, kv: c.when(manifest == kv[0], kv[1]), MANIFESTS.items(), F.when(F.lit(False), ""))
    version, ranged = version_of(F.col("mode"))
    depends = F.col("target_type") == "dependency"
    family_name = F.concat(family, F.when(F.coalesce("key_size_bits", F.lit(0)) != 0, F.concat(F.lit("-"), F.col("key_size_bits").cast("string"))).otherwise(""), F.when(F.coalesce("curve", F.lit("")) != "", F.concat(F.lit(" ("), F.col("curve"), F.lit(")"))).otherwise(""))
    ending = F.when(F.col("type") == "certificate", F.when(F.contains(F.lower(family_name), F.lit("certificate")), "").otherwise(" certificate")).when((F.coalesce("mode", F.lit("")) != "") & (F.col("mode") != "GCM"), F.concat(F.lit("-"), F.col("mode"))).otherwise("")
    return e.select(
        "id", "scan_id", "system_name", "type", family.alias("algorithm_family"), cls.alias("algorithm_class"), status.alias("quantum_vulnerability"), criticality.alias("business_criticality"),
        "key_size_bits", "curve", "mode", F.col("file_path").alias("location"), "line_number", "snippet", "target_type", source.alias("parameter_source"), confidence.alias("confidence"),
        F.when(depends, purl(package, F.col("matched_pattern"), version)).alias("purl"), F.when(depends, ranged).otherwise(False).alias("version_is_range"), F.concat(family_name, ending).alias("name"),
    )


IDENTITY = ["algorithm_family", "key_size_bits", "curve", "mode", "type", "target_type", "location"]


def aggregate(assets: DataFrame, within: list[str]) -> DataFrame:
    """Assets with equal identity collapsed, within the columns `within`; nulls equal nulls.

    An occurrence is a distinct line of the asset's file. Merging never softens: the highest criticality,
    provenance and confidence are kept. The canonical line is the smallest known one, its snippet the
    smallest text on that line; other attributes are those of the asset with the smallest id.
    """
    rank = F.array_position(F.array(*map(F.lit, CRITICALITY)), F.col("business_criticality"))
    known = F.coalesce(F.array_position(F.array(*map(F.lit, PROVENANCE)), F.col("parameter_source")), F.lit(0))
    lines = assets.groupBy(*within, *IDENTITY, "line_number").agg(
        F.max(rank).alias("rank"), F.max(known).alias("known"), F.max("confidence").alias("confidence"), F.min(F.struct("id", "name", "quantum_vulnerability", "algorithm_class", "purl")).alias("first"), F.min("snippet").alias("snippet"), F.count("*").alias("n")
    )
    out = lines.groupBy(*within, *IDENTITY).agg(
        F.count("*").alias("occurrence_count"), F.sum("n").alias("evidence_count"), F.max("rank").alias("rank"), F.max("known").alias("known"), F.max("confidence").alias("confidence"), F.min("first").alias("first"), F.min("line_number").alias("line_number"), F.min_by("snippet", "line_number").alias("code_snippet")
    )
    return out.select(
        *within, *IDENTITY, "first.name", "first.quantum_vulnerability", "first.algorithm_class", "first.purl", F.element_at(F.array(*map(F.lit, CRITICALITY)), F.col("rank").cast("int")).alias("business_criticality"),
        F.when(F.col("known") > 0, F.element_at(F.array(*map(F.lit, PROVENANCE)), F.greatest("known", F.lit(1)).cast("int"))).alias("parameter_source"), "confidence", "line_number", "code_snippet", "occurrence_count", "evidence_count",
    )


def merge_scans(assets: DataFrame) -> DataFrame:
    """Assets of all scans merged by identity as aggregate() does: occurrence_count counts the distinct lines of all systems together.

    Beside that source_systems, the systems they were seen in, and most_occurrences, the most lines that one system reports.
    """
    per_line = assets.groupBy(*IDENTITY, "system_name", "line_number").agg(F.lit(1).alias("one"))
    per_system = per_line.groupBy(*IDENTITY, "system_name").agg(F.count("*").alias("lines"))
    seen = per_system.groupBy(*IDENTITY).agg(F.array_sort(F.collect_set("system_name")).alias("source_systems"), F.max("lines").alias("most_occurrences"))
    same = reduce(lambda a, b: a & b, [F.col(f"m.{c}").eqNullSafe(F.col(f"s.{c}")) for c in IDENTITY])
    return aggregate(assets, []).alias("m").join(seen.alias("s"), same).select("m.*", "s.source_systems", "s.most_occurrences")


def nearest_above(evidence: DataFrame, tolerance: int = 6) -> DataFrame:
    """finding_id, target_id, distance: dataflow findings and the record at or above them, within `tolerance` lines.

    Findings are records whose detector names taint; targets are other source_code records of the same scan and
    file (slashes alike) whose key length is not bound; on one line the smallest id counts. A backward as-of join
    by blocks of lines: a target is offered to its own block and the next one, so a finding meets its block's
    targets only, of which there are at most two blocks of lines, however many records the file has. Findings
    without a target near enough have no row; records without a line number take no part.
    """
    e = evidence.filter("line_number is not null and target_type = 'source_code'").select("id", "scan_id", plain_path(F.col("file_path")).alias("path"), "line_number", "key_length", F.contains(F.coalesce(F.col("metadata.detector"), F.lit("")), F.lit("taint")).alias("finding")).dropDuplicates(["id"])
    block = F.floor(F.col("line_number") / (tolerance + 1))
    targets = e.filter(~F.col("finding") & F.col("key_length").isNull()).groupBy("scan_id", "path", "line_number").agg(F.min("id").alias("target_id"))
    offered = targets.select("scan_id", "path", F.col("line_number").alias("at"), "target_id", F.explode(F.array(block, block + 1)).alias("block"))
    met = e.filter("finding").withColumn("block", block).join(offered, ["scan_id", "path", "block"]).withColumn("distance", F.col("line_number") - F.col("at"))
    nearest = met.filter(F.col("distance").between(0, tolerance)).groupBy("id").agg(F.min(F.struct("distance", "target_id")).alias("t"))
    return nearest.select(F.col("id").alias("finding_id"), F.col("t.target_id").alias("target_id"), F.col("t.distance").alias("distance"))


def bind_findings(evidence: DataFrame, tolerance: int = 6) -> DataFrame:
    """finding_id, target_id, distance, binding: every dataflow finding and the record its value belongs to.

    Records are source_code evidence that is no finding and not of NON_ALGORITHMS, whatever their key length. The first
    record on a finding's own line is bound directly; else the nearest record above, within `tolerance` lines, that no
    finding is bound to directly, of one line the last (nearest-generator). The order of appearance is not recorded, so ids
    order the records of a line; nor is the parameter a finding resolves, so each binds as one of a key size does.
    Blocks of lines as in nearest_above; findings without a record have no row, nor have records without a line number.
    """
    e = evidence.filter("line_number is not null and target_type = 'source_code'").select("id", "scan_id", plain_path(F.col("file_path")).alias("path"), "line_number", F.contains(F.coalesce(F.col("metadata.detector"), F.lit("")), F.lit("taint")).alias("finding"), F.coalesce("detected_name", F.lit("")).isin(NON_ALGORITHMS).alias("other")).dropDuplicates(["id"])
    block = F.floor(F.col("line_number") / (tolerance + 1))
    record = F.when(~F.col("finding") & ~F.col("other"), F.col("id"))
    lines = e.groupBy("scan_id", "path", "line_number").agg(F.min(record).alias("first"), F.max(record).alias("last"), F.max("finding").alias("hit")).filter("first is not null")
    free = F.when(~F.col("hit") | (F.col("first") != F.col("last")), F.col("last"))  # a finding binds the first one of its line
    offered = lines.select("scan_id", "path", F.col("line_number").alias("at"), "first", free.alias("free"), F.explode(F.array(block, block + 1)).alias("block"))
    met = e.filter("finding").withColumn("block", block).join(offered, ["scan_id", "path", "block"]).withColumn("distance", F.col("line_number") - F.col("at"))
    met = met.withColumn("target_id", F.when(F.col("distance") == 0, F.col("first")).otherwise(F.col("free"))).filter(F.col("distance").between(0, tolerance) & F.col("target_id").isNotNull())
    nearest = met.groupBy("id").agg(F.min(F.struct("distance", "target_id")).alias("t"))
    return nearest.select(F.col("id").alias("finding_id"), "t.target_id", "t.distance", F.when(F.col("t.distance") == 0, "direct").otherwise("nearest-generator").alias("binding"))


def _source_lines(evidence: DataFrame) -> DataFrame:
    """Source code evidence with a line, ids once: its place, its parameters, whether it is a dataflow finding."""
    e = evidence.filter("line_number is not null and target_type = 'source_code' and id is not null").dropDuplicates(["id"])
    finding = F.contains(F.coalesce(F.col("metadata.detector"), F.lit("")), F.lit("taint"))
    return e.select("id", "scan_id", plain_path(F.col("file_path")).alias("path"), "line_number", "detected_name", "version_or_mode", "key_length", F.when(F.trim("curve_name") != "", F.trim("curve_name")).alias("curve_name"), finding.alias("finding"))


def apply_findings(evidence: DataFrame, tolerance: int = 6) -> DataFrame:
    """The records that dataflow findings resolve: id, final parameters, what was replaced, key_binding.

    A finding gives up to three parameters: the algorithm that its name states, its curve, its key length (1 or more). They
    are applied in this order. Algorithm and curve go to the first record on the finding's own line; the algorithm's mode and
    length go with it, and a name of no known family changes nothing. The key length goes where bind_findings puts it among the
    findings that have one. Of several findings for one record the last by line and id holds. replaced_ columns hold the record's
    own values where they differ (curves without case) and were not null. Records that no finding reaches have no row.
    """
    e = _source_lines(evidence)
    mode, bits = mode_and_bits(F.col("detected_name"))
    findings = e.filter("finding").select("id", "scan_id", "path", "line_number", "key_length", "curve_name", family_of(F.col("detected_name")).alias("family"), mode.alias("mode"), bits.alias("bits"))
    place = ["scan_id", "path", "line_number"]
    curve_found = F.max(F.when(F.col("curve_name").isNotNull(), F.struct("id", "curve_name")))["curve_name"].alias("f_curve_name")
    on_line = findings.groupBy(*place).agg(F.max(F.when(F.col("family").isNotNull(), F.struct("id", "family", "mode", "bits"))).alias("a"), curve_found).filter("a is not null or f_curve_name is not null")
    records = e.filter(~F.col("finding") & ~F.coalesce("detected_name", F.lit("")).isin(NON_ALGORITHMS))
    first = records.groupBy(*place).agg(F.min("id").alias("id"))
    told = on_line.join(first, place).select("id", "a.family", "a.mode", "a.bits", "f_curve_name")
    keyed = evidence.filter(~F.contains(F.coalesce(F.col("metadata.detector"), F.lit("")), F.lit("taint")) | (F.col("key_length") >= 1))
    sizes = bind_findings(keyed, tolerance).join(findings.select(F.col("id").alias("finding_id"), "line_number", F.col("key_length").alias("size")), "finding_id")
    sizes = sizes.groupBy(F.col("target_id").alias("id")).agg(F.max(F.struct("line_number", "finding_id", "size", "binding")).alias("k")).select("id", "k.size", F.col("k.binding").alias("key_binding"))
    out = records.drop("finding", *place).join(told.join(sizes, "id", "full"), "id")
    name, curve = F.coalesce("family", F.when((F.col("detected_name") == "Unresolved-Algorithm") & F.col("f_curve_name").isNotNull(), "ECC"), "detected_name"), F.coalesce("f_curve_name", "curve_name")
    key = F.coalesce("size", F.when(F.col("bits") > 0, F.col("bits")), "key_length")
    return out.select(
        "id", name.alias("detected_name"), F.coalesce("mode", "version_or_mode").alias("version_or_mode"), key.alias("key_length"), curve.alias("curve_name"), "key_binding",
        F.when(F.col("detected_name") != name, F.col("detected_name")).alias("replaced_name"), F.when(F.col("key_length") != key, F.col("key_length")).alias("replaced_key_length"), F.when(F.lower("curve_name") != F.lower(curve), F.col("curve_name")).alias("replaced_curve"),
    )


def added_findings(evidence: DataFrame, tolerance: int = 6) -> DataFrame:
    """finding_id, param, detected_name, version_or_mode, key_length, curve_name: what only dataflow saw, as evidence of its own.

    A parameter of a finding that has no record to go to: the algorithm if its family is known, the curve (of the finding's
    family, else ECC), the key length if the family is known.
    """
    e = _source_lines(evidence)
    findings, place = e.filter("finding"), ["scan_id", "path", "line_number"]
    lines = e.filter(~F.col("finding") & ~F.coalesce("detected_name", F.lit("")).isin(NON_ALGORITHMS)).select(*place).distinct()
    mode, bits = mode_and_bits(F.col("detected_name"))
    alone = findings.join(lines, place, "left_anti").withColumn("family", family_of(F.col("detected_name")))
    keyed = evidence.filter(~F.contains(F.coalesce(F.col("metadata.detector"), F.lit("")), F.lit("taint")) | (F.col("key_length") >= 1))
    unbound = alone.filter("key_length >= 1 and family is not null").join(bind_findings(keyed, tolerance).select(F.col("finding_id").alias("id")), "id", "left_anti")
    null = lambda t: F.lit(None).cast(t)
    row = lambda df, param, name, m, k, c: df.select(F.col("id").alias("finding_id"), F.lit(param).alias("param"), name.alias("detected_name"), m.alias("version_or_mode"), k.alias("key_length"), c.alias("curve_name"))
    family = F.col("family")
    return (
        row(alone.filter("family is not null"), "algorithm", family, mode, bits, null("string"))
        .unionByName(row(alone.filter("curve_name is not null"), "curve", F.coalesce(family, F.lit("ECC")), null("string"), null("int"), F.col("curve_name")))
        .unionByName(row(unbound, "key_size", family, null("string"), F.col("key_length"), null("string")))
    )


# Names of the advisory source's ecosystems by the type of a package URL.
ECOSYSTEMS = {"npm": "npm", "pypi": "PyPI", "maven": "Maven", "golang": "Go", "cargo": "crates.io", "composer": "Packagist", "gem": "RubyGems", "nuget": "NuGet"}


def ecosystem(url: Column) -> Column:
    """Ecosystem of a package URL; null for anything else."""
    kind = F.regexp_extract(url, "^pkg:([^/]*)", 1)
    return reduce(lambda c, kv: c.when(kind == kv[0], kv[1]), ECOSYSTEMS.items(), F.when(F.lit(False), ""))
