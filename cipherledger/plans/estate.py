"""Queries of merged scans, reassessment, wave members, capped pages, paths and bills of materials, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherledger.operators import merging
from cipherledger.operators import register as reg
from cipherledger.operators.scan_documents import bill_vulnerabilities
from cipherledger.plans.assessment import _VERDICTS
from cipherledger.plans.register import _DELTA, _PAGE, _REG, _SHOWN, SHOWN, TODAY, x_delta
from cipherledger.sources.tables import table


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.current(table(spark, sf_dir, "artefact_row"))


def m_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scans of each installation as one inventory, assessed at its smallest horizon."""
    out = merging.merged_register(_current(spark, sf_dir), table(spark, sf_dir, "scan_summary"), TODAY)
    return out.select("installation_id", *merging.SAME_ASSET, "name", "business_criticality", "occurrences", "systems", "shelf_life_x", "migration_time_y", "threat_timeline_z", "mosca_slack", "binding", "band", "overdue", F.col("start_by").cast("string").alias("start_by"))


def m_recalculated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register rows if the horizon were six years and data were kept fifteen, beside the band they have."""
    out = merging.recalculated(_current(spark, sf_dir), TODAY, horizon=6.0, retention=15.0)
    return out.select("scan_id", "artefact_id", F.col("risk_category").alias("band_before"), "band", "binding", "slack", "overdue", F.col("start_by").cast("string").alias("start_by"))


def m_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the walks of each installation's scans saw together."""
    return merging.combined_walks(table(spark, sf_dir, "walk_stats"), table(spark, sf_dir, "scan_summary"))


def m_wave_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every member of each scan's migration waves, the waves numbered without gaps."""
    return reg.wave_sequence(_current(spark, sf_dir), TODAY)


def g_capped_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page by deadline of the matches that the cap leaves."""
    return reg.capped_page(reg.matching(_current(spark, sf_dir), quantum_vulnerability="fully_broken"), 3, 50, "deadline").select(*SHOWN, "results_capped")


def j_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of register rows as they are shown: the file name, and the path with its middle left out."""
    return _current(spark, sf_dir).select("scan_id", "artefact_id", reg.file_name(F.col("location")).alias("file_name"), reg.short_path(F.col("location")).alias("short_path"))


def x_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of each comparison that hold assets, in the order they are shown."""
    return reg.delta_groups(x_delta(spark, sf_dir))


def e_bom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register rows as JSON components of a bill of materials with properties, classification, place and package URL; a missing package URL has no key."""
    rows = _current(spark, sf_dir)
    kind = F.when(F.col("type") == "library", "library").when(F.col("type") == "protocol", "protocol").when(F.col("type") == "hardware_module", "device").otherwise("cryptographic-asset")
    classified = F.struct(F.col("business_criticality").alias("businessCriticality"), F.col("shelf_life_x").alias("dataShelfLifeYears"), F.col("migration_time_y").alias("estimatedMigrationYears"), F.trim("crypto_usage").alias("cryptoUsage"))
    algorithm = F.struct(F.col("algorithm_family").alias("algorithmFamily"), F.col("algorithm_class").alias("algorithmClass"), F.col("key_size_bits").alias("keyLength"), "curve", F.col("quantum_vulnerability").alias("quantumVulnerability"))
    evidence = F.struct(F.array(F.struct("location", F.col("line_number").alias("line"))).alias("occurrences"))
    properties = F.struct(F.col("type").alias("assetType"), algorithm.alias("algorithmProperties"), classified.alias("classification"))
    body = [F.col("artefact_id").alias("bom-ref"), kind.alias("type"), F.col("name"), evidence.alias("evidence"), properties.alias("cryptoProperties")]
    whole = lambda *more: F.to_json(F.struct(*body, *more), {"ignoreNullFields": "false"})
    return rows.select("scan_id", "artefact_id", F.when(F.col("purl").isNull(), whole()).otherwise(whole("purl")).alias("component"))


def e_vulnerabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advisories of stored documents as entries of a bill of materials."""
    return bill_vulnerabilities(table(spark, sf_dir, "scan_document"))


QUERIES = {"m_merged": m_merged, "m_recalculated": m_recalculated, "m_walks": m_walks, "m_wave_sequence": m_wave_sequence, "g_capped_page": g_capped_page, "j_paths": j_paths, "x_groups": x_groups, "e_bom": e_bom, "e_vulnerabilities": e_vulnerabilities}

_CURRENT = _REG.replace("reg AS (", "cur AS (")
_SCANS = "sc AS (SELECT DISTINCT ON (scan_id) scan_id, installation_id, created_at, mosca_global_z FROM scan_summary WHERE scan_id IS NOT NULL)"
_MERGED = f"""{_CURRENT}, {_SCANS},
m AS (
  SELECT sc.installation_id, trim(coalesce(algorithm_family, '')) AS algorithm_family, key_size_bits, trim(coalesce(curve, '')) AS curve, trim(coalesce(type, '')) AS type, trim(coalesce(target_type, '')) AS target_type,
    replace(trim(coalesce(location, '')), '\\', '/') AS location, trim(coalesce(name, '')) AS name, trim(coalesce(algorithm_class, '')) AS algorithm_class, trim(coalesce(quantum_vulnerability, '')) AS quantum_vulnerability,
    CASE trim(business_criticality) WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 WHEN 'Critical' THEN 4 ELSE 0 END AS rk, shelf_life_x, migration_time_y, coalesce(line_number, -1) AS line, system_name, created_at, scan_id, artefact_id
  FROM cur JOIN sc USING (scan_id)),
w AS (SELECT *, row_number() OVER (PARTITION BY {{key}} ORDER BY created_at DESC NULLS LAST, scan_id DESC, artefact_id DESC) AS place FROM m),
g AS (
  SELECT {{key}}, max(name) FILTER (place = 1) AS name, max(algorithm_class) FILTER (place = 1) AS algorithm_class, max(quantum_vulnerability) FILTER (place = 1) AS quantum_vulnerability, max(shelf_life_x) AS shelf_life_x, max(migration_time_y) AS migration_time_y,
    [NULL, 'Low', 'Medium', 'High', 'Critical'][max(rk) + 1] AS business_criticality, count(DISTINCT line) AS occurrences, count(DISTINCT system_name) AS systems
  FROM w GROUP BY {{key}}),
h AS (SELECT installation_id, coalesce(min(mosca_global_z), 8.0::DOUBLE) AS threat_timeline_z FROM sc GROUP BY installation_id),
reg AS (SELECT g.*, h.threat_timeline_z FROM g JOIN h ON g.installation_id IS NOT DISTINCT FROM h.installation_id)""".format(key="installation_id, algorithm_family, key_size_bits, curve, type, target_type, location")
_AGAIN = f"""{_CURRENT},
reg AS (SELECT * REPLACE (CASE WHEN trim(crypto_usage) IN ('authenticity', 'integrity') THEN shelf_life_x ELSE 15.0::DOUBLE END AS shelf_life_x, 6.0::DOUBLE AS threat_timeline_z) FROM cur)"""
_PARTS = "string_split(replace(location, '\\', '/'), '/')"
_DOCUMENTS = """d AS (SELECT scan_id, arg_max(document, received_at) AS doc FROM scan_document WHERE json_valid(document) GROUP BY scan_id),
o AS (SELECT scan_id, CASE WHEN json_type(doc, '$.result') = 'OBJECT' THEN json_extract(doc, '$.result') ELSE doc::JSON END AS doc FROM d),
art AS (SELECT scan_id, unnest(json_extract(doc, '$.artefacts[*]')) AS a FROM o),
kv AS (SELECT scan_id, a->>'$.id' AS artefact_id, CASE json_type(a, '$.known_vulnerabilities') WHEN 'ARRAY' THEN json_extract(a, '$.known_vulnerabilities[*]') WHEN 'OBJECT' THEN [a->'$.known_vulnerabilities'] END AS xs FROM art),
v AS (SELECT scan_id, artefact_id, unnest(xs) AS x, generate_subscripts(xs, 1) - 1 AS pos FROM kv)"""

ORACLE_SQL = {
    "m_merged": f"WITH {_MERGED}, {_VERDICTS} SELECT installation_id, {', '.join(merging.SAME_ASSET)}, name, business_criticality, occurrences, systems, shelf_life_x, migration_time_y, threat_timeline_z, mosca_slack, binding, band, overdue, start_by FROM v",
    "m_recalculated": f"WITH {_AGAIN}, {_VERDICTS} SELECT scan_id, artefact_id, risk_category AS band_before, band, binding, slack, overdue, start_by FROM v",
    "m_walks": f"""WITH {_SCANS}, w AS (SELECT DISTINCT ON (scan_id) * FROM walk_stats)
      SELECT installation_id, count(*) AS scans, count(w.scan_id) AS walks, {", ".join(f"coalesce(sum({c}), 0)::BIGINT AS {c}" for c in ("files_seen", "files_scanned", "files_skipped_size", "files_skipped_type", "dirs_pruned"))},
        coalesce(bool_or(hit_file_limit), false) AS hit_file_limit, coalesce(bool_or(hit_depth_limit), false) AS hit_depth_limit, max(finished_at) AS finished_at,
        (array_agg(files_skipped_type ORDER BY created_at DESC NULLS LAST, sc.scan_id DESC) FILTER (files_skipped_type IS NOT NULL))[1] AS last_skipped_type
      FROM sc LEFT JOIN w ON w.scan_id = sc.scan_id GROUP BY installation_id""",
    "m_wave_sequence": f"""WITH {_REG}, w AS (SELECT scan_id, artefact_id, round((datediff('day', DATE '{TODAY}', must_start_by[1:10]::DATE) / 365.2425::DOUBLE)::DECIMAL(20, 8), 2) AS slack FROM reg WHERE must_start_by IS NOT NULL),
      v AS (SELECT scan_id, artefact_id, CASE WHEN slack <= 0 THEN 0 WHEN slack < 1 THEN 1 WHEN slack < 3 THEN 2 WHEN slack < 5 THEN 3 ELSE 4 END AS wave FROM w)
      SELECT scan_id, (dense_rank() OVER (PARTITION BY scan_id ORDER BY wave) - 1)::INT AS sequence, wave, artefact_id FROM v""",
    "g_capped_page": f"""WITH {_REG}, f AS (SELECT * FROM reg WHERE quantum_vulnerability = 'fully_broken'), c AS (SELECT * FROM f ORDER BY scan_id, artefact_id LIMIT 20000)
      SELECT {_SHOWN}, (SELECT count(*) > 20000 FROM f) AS results_capped FROM c ORDER BY {_PAGE["deadline"]}, scan_id, artefact_id LIMIT 50 OFFSET 100""",
    "j_paths": f"""WITH {_REG}, p AS (SELECT scan_id, artefact_id, location, replace(location, '\\', '/') AS path, {_PARTS} AS parts, {_PARTS}[-1] AS file FROM reg),
      q AS (SELECT *, list_filter(list_transform(range(1, len(parts)), lambda k: array_to_string(parts[1:k], '/') || '/'), lambda x: length(x) <= 44 - length(file))[-1] AS head FROM p)
      SELECT scan_id, artefact_id, CASE WHEN coalesce(location, '') = '' THEN '—' WHEN file = '' THEN location ELSE file END AS file_name,
        CASE WHEN coalesce(location, '') = '' THEN '—' WHEN length(path) <= 48 THEN path WHEN length(file) >= 44 THEN '…/' || file ELSE coalesce(head, '') || '…/' || file END AS short_path FROM q""",
    "x_groups": f"""WITH {_REG}, {_DELTA}, n(bucket, position, label) AS (VALUES ('added', 1, 'New'), ('worsened', 2, 'Worse'), ('parameters_changed', 3, 'Changed'), ('improved', 4, 'Improved'), ('removed', 5, 'Removed'))
      SELECT scan_id, position, label, count(*) AS n FROM d JOIN n USING (bucket) GROUP BY ALL""",
    "e_bom": f"""WITH {_REG}, j AS (SELECT *, CASE type WHEN 'library' THEN 'library' WHEN 'protocol' THEN 'protocol' WHEN 'hardware_module' THEN 'device' ELSE 'cryptographic-asset' END AS kind, json_object('occurrences', [json_object('location', location, 'line', line_number)]) AS ev,
        json_object('assetType', type, 'algorithmProperties', json_object('algorithmFamily', algorithm_family, 'algorithmClass', algorithm_class, 'keyLength', key_size_bits, 'curve', curve, 'quantumVulnerability', quantum_vulnerability),
          'classification', json_object('businessCriticality', business_criticality, 'dataShelfLifeYears', shelf_life_x, 'estimatedMigrationYears', migration_time_y, 'cryptoUsage', trim(crypto_usage))) AS pr FROM reg)
      SELECT scan_id, artefact_id, CASE WHEN purl IS NULL THEN json_object('bom-ref', artefact_id, 'type', kind, 'name', name, 'evidence', ev, 'cryptoProperties', pr)
        ELSE json_object('bom-ref', artefact_id, 'type', kind, 'name', name, 'evidence', ev, 'cryptoProperties', pr, 'purl', purl) END::VARCHAR AS component FROM j""",
    "e_vulnerabilities": f"""WITH {_DOCUMENTS},
      f AS (SELECT scan_id, artefact_id, pos::INT AS pos, x->>'$.id' AS id, x->>'$.reference_url' AS url, x->>'$.summary' AS description, x->>'$.severity' AS sev, x->>'$.fixed_version' AS fixed,
        list_filter(CASE json_type(x, '$.aliases') WHEN 'ARRAY' THEN list_transform(json_extract(x, '$.aliases[*]'), lambda y: y->>'$') WHEN 'VARCHAR' THEN [x->>'$.aliases'] ELSE [] END, lambda y: y IS NOT NULL) AS aliases FROM v),
      s AS (SELECT *, CASE WHEN sev LIKE 'CVSS:%' THEN 'See CVSS' WHEN coalesce(sev, '') = '' THEN 'Unknown' ELSE upper(sev[1]) || lower(sev[2:]) END AS severity FROM f)
      SELECT scan_id, artefact_id, pos, artefact_id || ':' || id AS bom_ref, id, coalesce(nullif(url, ''), 'https://osv.dev') AS url, nullif(description, '') AS description, aliases, severity, CASE WHEN severity <> 'Unknown' THEN lower(severity) END AS rating,
        'Upgrade to ' || nullif(fixed, '') || ' or later.' AS recommendation FROM s WHERE artefact_id IS NOT NULL AND coalesce(id, '') <> ''""",
}
