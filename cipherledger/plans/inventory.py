"""Queries of normalisation, aggregation and agility over evidence, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherledger.operators import inventory as inv
from cipherledger.operators.context import FAMILY_OF
from cipherledger.sources.tables import table


def n_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of evidence as a typed asset."""
    return inv.normalise(table(spark, sf_dir, "evidence")).drop("snippet", "line_number", "system_name")


def n_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets by family, status and target type."""
    return inv.normalise(table(spark, sf_dir, "evidence")).groupBy("algorithm_family", "quantum_vulnerability", "target_type").agg(F.count("*").alias("n"), F.count("key_size_bits").alias("n_sized"))


def a_aggregated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory of each scan: distinct assets with their occurrences."""
    return inv.aggregate(inv.normalise(table(spark, sf_dir, "evidence")), ["scan_id"]).drop("name")


def a_merged_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets of all scans merged, with the distinct lines of all systems and the systems they were seen in."""
    merged = inv.merge_scans(inv.normalise(table(spark, sf_dir, "evidence")))
    return merged.withColumn("source_systems", F.concat_ws("|", "source_systems")).drop("name")


def a_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged assets of a_merged_places with the most lines that one system reports, not the lines of all."""
    return a_merged_places(spark, sf_dir).select(*inv.IDENTITY, "source_systems", "most_occurrences", "evidence_count", "confidence", "line_number")


def t_nearest_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataflow findings and the nearest unbound record above them in the file."""
    return inv.nearest_above(table(spark, sf_dir, "evidence"))


def t_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataflow findings and the record each is bound to, on its own line or above."""
    return inv.bind_findings(table(spark, sf_dir, "evidence"))


def t_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the parameters that dataflow resolved, and the values these replaced."""
    return inv.apply_findings(table(spark, sf_dir, "evidence"))


def t_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters that dataflow resolved where no record stands, as evidence of its own."""
    return inv.added_findings(table(spark, sf_dir, "evidence"))


def n_ecosystems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets of dependencies by ecosystem, and how many state a version."""
    assets = inv.normalise(table(spark, sf_dir, "evidence")).filter("purl is not null")
    return assets.groupBy(inv.ecosystem(F.col("purl")).alias("ecosystem")).agg(F.count("*").alias("n"), F.count_if(F.contains("purl", F.lit("@"))).alias("n_versioned"))


QUERIES = {"t_applied": t_applied, "t_added": t_added, "n_ecosystems": n_ecosystems, "n_normalised": n_normalised, "n_families": n_families, "a_aggregated": a_aggregated, "a_merged": a_merged, "a_merged_places": a_merged_places, "t_nearest_above": t_nearest_above, "t_bound": t_bound}


def _has(texts: list[str], marks: list[str]) -> str:
    return "(" + " OR ".join(f"contains({t}, '{m}')" for t in texts for m in marks) + ")"


_BRANCH = "CASE " + " ".join(f"WHEN {_has(['nm', 'mt'], marks)} THEN '{b}'" for b, marks, _, _ in inv.FAMILIES) + f" WHEN {_has(['mt'], inv.OLD_PROTOCOLS)} THEN 'old_tls' ELSE 'other' END"
_FAMILY = "CASE branch " + " ".join(f"WHEN '{b}' THEN '{f}'" for b, _, f, _ in inv.FAMILIES) + f" WHEN 'old_tls' THEN '{inv.OLD_PROTOCOL_FAMILY}' ELSE detected_name END"
_CLASS = "CASE branch " + " ".join(f"WHEN '{b}' THEN '{c}'" for b, _, _, c in inv.FAMILIES) + " WHEN 'old_tls' THEN 'legacy_broken' ELSE 'unknown' END"
_EXACT = "CASE lower(trim(curve)) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in inv.CURVE_BITS) + " END"
_INSIDE = "CASE " + " ".join(f"WHEN contains(lower(curve), '{k}') THEN {v}" for k, v in inv.CURVE_BITS) + " END"
_MANIFEST = "CASE regexp_extract(file_path, '[^/]*$') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in inv.MANIFESTS.items()) + " END"

NORMALISED = rf"""
e AS (
  SELECT DISTINCT ON (id) id, scan_id, system_name, target_type, file_path, line_number, snippet, matched_pattern, raw_type, detected_name, version_or_mode AS mode, key_length, curve_name,
         coalesce(metadata.detector, '') AS detector, metadata.parameters_resolved AS resolved, upper(coalesce(detected_name, '')) AS nm, upper(coalesce(matched_pattern, '')) AS mt
  FROM evidence),
f AS (
  SELECT *, {_BRANCH} AS branch, CASE WHEN lower(raw_type) IN ('key', 'certificate', 'protocol', 'library', 'hardware_module', 'cloud_service') THEN lower(raw_type) ELSE 'algorithm' END AS type FROM e),
g AS (SELECT *, CASE WHEN branch = 'ecc' AND coalesce(curve_name, '') = '' THEN 'secp256r1 (P-256)' ELSE curve_name END AS curve FROM f),
h AS (
  SELECT *, CASE WHEN branch IN ('rsa', 'dh') AND coalesce(key_length, 0) = 0 THEN 2048
       WHEN branch = 'ecc' THEN coalesce({_EXACT}, {_INSIDE}, try_cast(regexp_extract(curve, '(\d{{3}})', 1) AS INT))
       WHEN branch = 'chacha' THEN 256 ELSE key_length END AS key_size_bits,
       coalesce(key_length, 0) <> 0 AND key_length <= 1024 AS weak, {_MANIFEST} AS eco, trim(mode) AS vt,
       trim(regexp_replace(regexp_replace(regexp_replace(trim(mode), '^\s*(?:[\^~=<>!]+|v)\s*', ''), '\s*(?:,|\|\||\s-\s|\s+).*$', ''), '^[=<>!~^ ]+|[=<>!~^ ]+$', '', 'g')) AS vb
  FROM g),
i AS (
  SELECT *, regexp_matches(vb, '^\d[\w.\-+]*$') AS whole, vt LIKE '%^%' OR vt LIKE '%~%' OR vt LIKE '%>%' OR vt LIKE '%<%' OR vt LIKE '%*%' OR vt LIKE '%x%' OR vt LIKE '%||%' OR vt LIKE '%,%' OR vt LIKE '% - %' AS marked FROM h),
n AS (
  SELECT id, scan_id, system_name, type, {_FAMILY} AS algorithm_family, {_CLASS} AS algorithm_class,
    CASE branch WHEN 'rsa' THEN if(weak, 'classically_broken', 'fully_broken') WHEN 'ecc' THEN 'fully_broken' WHEN 'dh' THEN 'fully_broken'
      WHEN 'aes' THEN CASE WHEN key_length IS NULL THEN 'unknown' WHEN key_length <= 128 THEN 'degraded' ELSE 'quantum_safe' END
      WHEN 'legacy' THEN 'classically_broken' WHEN 'md5' THEN 'classically_broken' WHEN 'old_tls' THEN 'classically_broken'
      WHEN 'sha2' THEN if(contains(nm, '256') OR contains(mt, '256'), 'degraded', 'quantum_safe') WHEN 'chacha' THEN 'quantum_safe' WHEN 'pqc' THEN 'quantum_safe'
      WHEN 'hybrid' THEN 'hybrid_protected' ELSE 'unknown' END AS quantum_vulnerability,
    CASE WHEN branch = 'rsa' THEN CASE WHEN weak THEN 'Critical' WHEN key_size_bits >= 2048 THEN 'Medium' ELSE 'High' END
      WHEN branch IN ('ecc', 'dh', 'aes', 'chacha', 'md5') THEN 'Medium' WHEN branch IN ('legacy', 'old_tls') THEN 'Critical' WHEN branch IN ('sha2', 'pqc', 'hybrid') THEN 'Low'
      WHEN type IN ('key', 'certificate', 'cloud_service') THEN 'High' WHEN type = 'hardware_module' THEN 'Critical' ELSE 'Medium' END AS business_criticality,
    key_size_bits, curve, mode, file_path AS location, line_number, snippet, target_type,
    CASE WHEN contains(detector, 'taint') THEN 'dataflow' WHEN resolved THEN 'literal' WHEN NOT resolved THEN 'assumed' END AS parameter_source,
    CASE WHEN contains(detector, 'taint') THEN 0.99 WHEN detector = 'ast' THEN 0.98 ELSE 0.90 END::DOUBLE AS confidence,
    CASE WHEN target_type = 'dependency' AND eco IS NOT NULL THEN 'pkg:' || eco || '/' ||
      CASE WHEN eco = 'pypi' THEN regexp_replace(lower(trim(matched_pattern)), '[._]+', '-', 'g') WHEN eco = 'npm' THEN lower(trim(matched_pattern)) WHEN eco = 'maven' THEN regexp_replace(trim(matched_pattern), '^([^:]*):', '\1/') ELSE trim(matched_pattern) END
      || CASE WHEN coalesce(vt, '') NOT IN ('', '*', 'latest') AND whole THEN '@' || vb ELSE '' END END AS purl,
    CASE WHEN target_type <> 'dependency' OR mode IS NULL OR mode = '' THEN false WHEN vt IN ('', '*', 'latest') OR NOT whole THEN true
      WHEN vt LIKE '==%' AND NOT (substr(vt, 3) SIMILAR TO '.*[\^~><*x,].*' OR substr(vt, 3) LIKE '%||%' OR substr(vt, 3) LIKE '% - %') THEN false ELSE marked END AS version_is_range,
    fn || CASE WHEN type = 'certificate' THEN if(contains(lower(fn), 'certificate'), '', ' certificate') WHEN coalesce(mode, '') <> '' AND mode <> 'GCM' THEN '-' || mode ELSE '' END AS name
  FROM (SELECT *, {_FAMILY} || if(coalesce(key_size_bits, 0) <> 0, '-' || key_size_bits, '') || if(coalesce(curve, '') <> '', ' (' || curve || ')', '') AS fn FROM i))"""

# the tokens of algorithm names, as written in context.FAMILY_OF
_TOKENS = ", ".join(f"('{n}', '{f}')" for n, f in FAMILY_OF.items())
_WORDS = ", ".join(f"'{n}'" for n in FAMILY_OF)
_APPLY = rf"""
k(n, f) AS (VALUES {_TOKENS}),
e AS (SELECT DISTINCT ON (id) id, scan_id, regexp_replace(replace(file_path, '\', '/'), '^(\./+)+', '') AS path, line_number, detected_name, version_or_mode, key_length, nullif(trim(curve_name), '') AS curve_name,
    contains(coalesce(metadata.detector, ''), 'taint') AS finding, lower(trim(detected_name)) AS low FROM evidence WHERE line_number IS NOT NULL AND target_type = 'source_code'),
fd AS (SELECT *, coalesce((SELECT f FROM k WHERE n = low), (SELECT f FROM k WHERE n = regexp_extract(low, '^([^/\\ ]*)', 1)),
      (SELECT f FROM k WHERE n = list_filter(regexp_split_to_array(low, '[^a-z0-9.+]+'), lambda x: x IN ({_WORDS}))[1])) AS family,
    CASE {{modes}} END AS mode, try_cast(regexp_extract(detected_name, '(?:^|[^0-9])(\d{{{{3,4}}}})(?:[^0-9]|$)', 1) AS INT) AS bits FROM e WHERE finding),
rec AS (SELECT * FROM e WHERE NOT finding AND coalesce(detected_name, '') NOT IN ('Hardcoded-Private-Key', 'Hardcoded-Public-Key', 'X509-Certificate', 'Cloud KMS Service', 'HSM/PKCS#11 Module')),
nth AS (SELECT *, row_number() OVER (PARTITION BY scan_id, path, line_number ORDER BY id) AS nth FROM rec),
alg AS (SELECT DISTINCT ON (scan_id, path, line_number) scan_id, path, line_number, family, mode, bits FROM fd WHERE family IS NOT NULL ORDER BY scan_id, path, line_number, id DESC),
cur AS (SELECT DISTINCT ON (scan_id, path, line_number) scan_id, path, line_number, curve_name AS fc FROM fd WHERE curve_name IS NOT NULL ORDER BY scan_id, path, line_number, id DESC),
kf AS (SELECT * FROM fd WHERE key_length >= 1),
own AS (SELECT kf.id AS finding_id, kf.line_number, kf.key_length AS size, nth.id AS target_id FROM kf JOIN nth USING (scan_id, path, line_number) WHERE nth = 1),
free AS (SELECT scan_id, path, line_number, max(id) AS target_id FROM rec WHERE id NOT IN (SELECT target_id FROM own) GROUP BY ALL),
near AS (SELECT kf.id AS finding_id, kf.line_number, kf.key_length AS size, t.target_id FROM kf ASOF JOIN free t ON kf.scan_id = t.scan_id AND kf.path = t.path AND kf.line_number >= t.line_number
    WHERE kf.id NOT IN (SELECT finding_id FROM own) AND kf.line_number - t.line_number <= 6),
bound AS (SELECT *, 'direct' AS binding FROM own UNION ALL SELECT *, 'nearest-generator' FROM near),
sz AS (SELECT DISTINCT ON (target_id) target_id, size, binding FROM bound ORDER BY target_id, line_number DESC, finding_id DESC)""".replace(
    "{modes}", " ".join(f"WHEN regexp_matches(lower(detected_name), '(^|[^a-z0-9]){m}([^a-z0-9]|$)') THEN '{m.upper()}'" for m in ("gcm", "cbc", "ctr", "ecb", "cfb", "ofb", "ccm", "xts", "oaep", "pss"))
).replace("{{3,4}}", "{3,4}")

_RANK = "list_position(['Low', 'Medium', 'High', 'Critical'], business_criticality)"
_KNOWN = "coalesce(list_position(['assumed', 'literal', 'dataflow'], parameter_source), 0)"
_ID = ", ".join(inv.IDENTITY)
ORACLE_SQL = {
    "t_applied": f"""WITH {_APPLY},
        j AS (SELECT nth.*, family, mode, bits, fc, size, binding FROM nth LEFT JOIN alg ON nth = 1 AND alg.scan_id = nth.scan_id AND alg.path = nth.path AND alg.line_number = nth.line_number
          LEFT JOIN cur ON nth = 1 AND cur.scan_id = nth.scan_id AND cur.path = nth.path AND cur.line_number = nth.line_number LEFT JOIN sz ON target_id = nth.id WHERE family IS NOT NULL OR fc IS NOT NULL OR size IS NOT NULL),
        o AS (SELECT *, coalesce(family, CASE WHEN detected_name = 'Unresolved-Algorithm' AND fc IS NOT NULL THEN 'ECC' END, detected_name) AS nm, coalesce(size, CASE WHEN bits > 0 THEN bits END, key_length) AS ky, coalesce(fc, curve_name) AS cv FROM j)
        SELECT id, nm AS detected_name, coalesce(mode, version_or_mode) AS version_or_mode, ky AS key_length, cv AS curve_name, binding AS key_binding, CASE WHEN detected_name <> nm THEN detected_name END AS replaced_name,
          CASE WHEN key_length <> ky THEN key_length END AS replaced_key_length, CASE WHEN lower(curve_name) <> lower(cv) THEN curve_name END AS replaced_curve FROM o""",
    "t_added": f"""WITH {_APPLY}, al AS (SELECT fd.* FROM fd ANTI JOIN rec USING (scan_id, path, line_number))
        SELECT id AS finding_id, 'algorithm' AS param, family AS detected_name, mode AS version_or_mode, bits AS key_length, NULL::VARCHAR AS curve_name FROM al WHERE family IS NOT NULL
        UNION ALL SELECT id, 'curve', coalesce(family, 'ECC'), NULL, NULL, curve_name FROM al WHERE curve_name IS NOT NULL
        UNION ALL SELECT id, 'key_size', family, NULL, key_length, NULL FROM al WHERE key_length >= 1 AND family IS NOT NULL AND id NOT IN (SELECT finding_id FROM bound)""",
    "n_ecosystems": f"""WITH {NORMALISED} SELECT CASE regexp_extract(purl, '^pkg:([^/]*)', 1) WHEN 'npm' THEN 'npm' WHEN 'pypi' THEN 'PyPI' WHEN 'maven' THEN 'Maven' WHEN 'golang' THEN 'Go' WHEN 'cargo' THEN 'crates.io'
          WHEN 'composer' THEN 'Packagist' WHEN 'gem' THEN 'RubyGems' WHEN 'nuget' THEN 'NuGet' END AS ecosystem, count(*) AS n, count(*) FILTER (contains(purl, '@')) AS n_versioned FROM n WHERE purl IS NOT NULL GROUP BY ALL""",
    "n_normalised": f"WITH {NORMALISED} SELECT * EXCLUDE (snippet, line_number, system_name) FROM n",
    "n_families": f"WITH {NORMALISED} SELECT algorithm_family, quantum_vulnerability, target_type, count(*) AS n, count(key_size_bits) AS n_sized FROM n GROUP BY ALL",
    "a_aggregated": f"""WITH {NORMALISED}
        SELECT scan_id, {_ID}, arg_min(quantum_vulnerability, id) AS quantum_vulnerability, arg_min(algorithm_class, id) AS algorithm_class, (array_agg(purl ORDER BY id))[1] AS purl,
          ['Low', 'Medium', 'High', 'Critical'][max({_RANK})] AS business_criticality, CASE WHEN max({_KNOWN}) > 0 THEN ['assumed', 'literal', 'dataflow'][max({_KNOWN})] END AS parameter_source,
          max(confidence) AS confidence, min(line_number) AS line_number,
          CASE WHEN min(line_number) IS NOT NULL THEN (array_agg(snippet ORDER BY line_number NULLS LAST, snippet NULLS LAST))[1] END AS code_snippet,
          count(DISTINCT coalesce(line_number, -1)) AS occurrence_count, count(*) AS evidence_count
        FROM n GROUP BY scan_id, {_ID}""",
    "a_merged": f"""WITH {NORMALISED}, s AS (SELECT system_name, {_ID}, count(DISTINCT coalesce(line_number, -1)) AS occ, count(*) AS ev, max(confidence) AS confidence, min(line_number) AS line_number FROM n GROUP BY system_name, {_ID})
        SELECT {_ID}, string_agg(DISTINCT system_name, '|' ORDER BY system_name) AS source_systems, max(occ) AS most_occurrences, sum(ev)::BIGINT AS evidence_count, max(confidence) AS confidence, min(line_number) AS line_number FROM s GROUP BY {_ID}""",
    "a_merged_places": f"""WITH {NORMALISED}, s AS (SELECT system_name, {_ID}, count(DISTINCT coalesce(line_number, -1)) AS occ FROM n GROUP BY system_name, {_ID}),
        p AS (SELECT {_ID}, string_agg(DISTINCT system_name, '|' ORDER BY system_name) AS source_systems, max(occ) AS most_occurrences FROM s GROUP BY {_ID}),
        m AS (SELECT {_ID}, arg_min(quantum_vulnerability, id) AS quantum_vulnerability, arg_min(algorithm_class, id) AS algorithm_class, (array_agg(purl ORDER BY id))[1] AS purl,
          ['Low', 'Medium', 'High', 'Critical'][max({_RANK})] AS business_criticality, CASE WHEN max({_KNOWN}) > 0 THEN ['assumed', 'literal', 'dataflow'][max({_KNOWN})] END AS parameter_source,
          max(confidence) AS confidence, min(line_number) AS line_number,
          CASE WHEN min(line_number) IS NOT NULL THEN (array_agg(snippet ORDER BY line_number NULLS LAST, snippet NULLS LAST))[1] END AS code_snippet,
          count(DISTINCT coalesce(line_number, -1)) AS occurrence_count, count(*) AS evidence_count
          FROM n GROUP BY {_ID})
        SELECT m.*, p.source_systems, p.most_occurrences FROM m JOIN p ON {" AND ".join(f"m.{c} IS NOT DISTINCT FROM p.{c}" for c in inv.IDENTITY)}""",
    "t_nearest_above": r"""
        WITH e AS (SELECT DISTINCT ON (id) id, scan_id, regexp_replace(replace(file_path, '\', '/'), '^(\./+)+', '') AS path, line_number, key_length, contains(coalesce(metadata.detector, ''), 'taint') AS finding
                   FROM evidence WHERE line_number IS NOT NULL AND target_type = 'source_code'),
        t AS (SELECT scan_id, path, line_number, min(id) AS target_id FROM e WHERE NOT finding AND key_length IS NULL GROUP BY ALL)
        SELECT f.id AS finding_id, t.target_id, f.line_number - t.line_number AS distance
        FROM e f ASOF JOIN t ON f.scan_id = t.scan_id AND f.path = t.path AND f.line_number >= t.line_number
        WHERE f.finding AND f.line_number - t.line_number <= 6""",
    "t_bound": rf"""
        WITH e AS (SELECT DISTINCT ON (id) id, scan_id, regexp_replace(replace(file_path, '\', '/'), '^(\./+)+', '') AS path, line_number, contains(coalesce(metadata.detector, ''), 'taint') AS finding,
                     coalesce(detected_name, '') NOT IN ({", ".join(f"'{n}'" for n in inv.NON_ALGORITHMS)}) AS eligible
                   FROM evidence WHERE line_number IS NOT NULL AND target_type = 'source_code'),
        r AS (SELECT *, row_number() OVER (PARTITION BY scan_id, path, line_number ORDER BY id) AS nth FROM e WHERE NOT finding AND eligible),
        own AS (SELECT f.id AS finding_id, r.id AS target_id FROM e f JOIN r USING (scan_id, path, line_number) WHERE f.finding AND r.nth = 1),
        direct AS (SELECT DISTINCT target_id FROM own),
        free AS (SELECT scan_id, path, line_number, max(id) AS target_id FROM r WHERE id NOT IN (SELECT target_id FROM direct) GROUP BY ALL)
        SELECT finding_id, target_id, 0 AS distance, 'direct' AS binding FROM own
        UNION ALL
        SELECT f.id, t.target_id, f.line_number - t.line_number, 'nearest-generator'
        FROM e f ASOF JOIN free t ON f.scan_id = t.scan_id AND f.path = t.path AND f.line_number >= t.line_number
        WHERE f.finding AND f.id NOT IN (SELECT finding_id FROM own) AND f.line_number - t.line_number <= 6""",
}
