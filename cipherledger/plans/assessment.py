"""Queries of assessment, agility, stored documents and exports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherledger.operators import assessment as ass
from cipherledger.operators import inventory as inv
from cipherledger.operators import register as reg
from cipherledger.operators.scan_documents import register_rows
from cipherledger.plans.inventory import ORACLE_SQL as INVENTORY_SQL
from cipherledger.plans.register import _REG, TODAY
from cipherledger.sources.tables import table

VERDICT = ["scan_id", "artefact_id", "mosca_slack", "breach_low", "breach_high", "exposure", "binding", "slack", "band", "overdue"]


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.current(table(spark, sf_dir, "artefact_row"))


def r_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models' verdicts on every register row, as of a fixed day."""
    return ass.verdicts(_current(spark, sf_dir), TODAY).select(*VERDICT, F.col("start_by").cast("string").alias("start_by"))


def r_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register rows by binding model and band."""
    return ass.verdicts(_current(spark, sf_dir), TODAY).groupBy("binding", "band").agg(F.count("*").alias("n"), F.count_if("overdue").alias("overdue"))


def k_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register rows by classical strength and the category to migrate to."""
    return ass.strength(_current(spark, sf_dir)).groupBy("algorithm_class", "strength_bits", "target_category").agg(F.count("*").alias("n"))


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.aggregate(inv.normalise(table(spark, sf_dir, "evidence")), ["scan_id"])


def q_agility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How easily each asset of the inventory can be changed."""
    return ass.agility(_inventory(spark, sf_dir)).select("scan_id", *inv.IDENTITY, *[f for f, _ in ass.FACTORS], "score", "grade", "weakest", "multiplier")


def q_estate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets of each scan by grade."""
    return ass.agility(_inventory(spark, sf_dir)).groupBy("scan_id", "grade").agg(F.count("*").alias("n"), F.count_if(F.col("weakest") == "configurability").alias("by_configuration"))


def r_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which register rows are at risk whatever their band, by how much, and which breach is likely."""
    return ass.verdicts(_current(spark, sf_dir), TODAY).select("scan_id", "artefact_id", "is_at_risk", "margin", "breach_likely")


def r_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each asset of the inventory is for, how long it must hold and how long changing it takes."""
    out = ass.risk_inputs(_inventory(spark, sf_dir), table(spark, sf_dir, "scan_summary"))
    return out.select("scan_id", *inv.IDENTITY, "crypto_usage", "shelf_life_x", "migration_time_y")


def q_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean agility score and rigid assets of each scan."""
    return ass.agility_estate(ass.agility(_inventory(spark, sf_dir)), ["scan_id"])


def e_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of the register as text fields for a CSV file, the worst rows first: nulls empty, marks as YES and NO."""
    rows = _current(spark, sf_dir).orderBy(reg.risk_rank(F.col("risk_category")), F.coalesce("occurrence_count", F.lit(0)).desc(), F.coalesce("name", F.lit("")), "scan_id", "artefact_id")
    return rows.select(*[F.when(F.col(c), "YES").otherwise("NO").alias(c) if c == "is_overdue" else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in REGISTER])


def a_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory of each scan, the most critical assets first, then those with most occurrences, then by family."""
    rank = F.array_position(F.array(*map(F.lit, inv.CRITICALITY)), F.col("business_criticality"))
    return _inventory(spark, sf_dir).orderBy("scan_id", rank.desc(), F.desc("occurrence_count"), "algorithm_family", *inv.IDENTITY[1:]).select("scan_id", *inv.IDENTITY, "business_criticality", "occurrence_count")


def g_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register rows built from the stored scan documents."""
    return register_rows(table(spark, sf_dir, "scan_document"))


def u_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of each scan for a build gate: fail on critical, warn on high, else pass."""
    h = reg.histograms(_current(spark, sf_dir), ["scan_id"])
    return h.select("scan_id", "risk_critical", "risk_high", F.when(F.col("risk_critical") > 0, "fail").when(F.col("risk_high") > 0, "warn").otherwise("pass").alias("gate"))


#: The register's columns, in the order of the export.
REGISTER = [
    "scan_id", "installation_id", "system_name", "sensitivity_profile", "artefact_id", "name", "type", "algorithm_family", "algorithm_class", "key_size_bits", "curve", "location", "line_number", "target_type", "quantum_vulnerability",
    "business_criticality", "occurrence_count", "purl", "crypto_usage", "known_vulnerability_count", "risk_category", "must_start_by", "must_complete_by", "is_overdue", "binding_model", "recommended_standard", "nist_category", "migration_urgency",
]
EXPORTED = ["system_name", "artefact_id", "name", "type", "algorithm_family", "key_size_bits", "curve", "location", "risk_category", "must_start_by", "is_overdue", "occurrence_count", "purl"]


def e_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register rows as text fields for a CSV file: nulls empty, marks as YES and NO."""
    rows = _current(spark, sf_dir)
    text = [F.when(F.col(c), "YES").otherwise("NO").alias(c) if c == "is_overdue" else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in EXPORTED]
    return rows.select("scan_id", *text)


def e_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register rows as JSON components of a bill of materials."""
    kind = F.when(F.col("type") == "library", "library").when(F.col("type") == "hardware_module", "device").otherwise("cryptographic-asset")
    body = F.struct(kind.alias("type"), F.col("artefact_id").alias("bom-ref"), "name", F.struct("algorithm_family", "key_size_bits").alias("cryptoProperties"), F.struct("location").alias("evidence"))
    return _current(spark, sf_dir).select("scan_id", "artefact_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("component"))


QUERIES = {"r_verdicts": r_verdicts, "r_bands": r_bands, "k_strength": k_strength, "q_agility": q_agility, "q_estate": q_estate, "g_built": g_built, "u_gate": u_gate, "e_csv": e_csv, "e_register": e_register, "r_flags": r_flags, "r_inputs": r_inputs, "q_scores": q_scores, "a_ordered": a_ordered, "e_components": e_components}

_DAY = f"DATE '{TODAY}'"


def _r(x: str, d: int = 2) -> str:
    return f"round(({x})::DECIMAL(24, 9), {d})::DOUBLE"


def _from(day: str, years: str) -> str:
    return f"({day} + round((({years}) * 365.2425::DOUBLE)::DECIMAL(24, 9), 0)::INT)"


def _curve(k: int) -> str:
    points = " ".join(f"WHEN t <= {b[0]} THEN {_r(f'{a[k]}::DOUBLE + (t - {a[0]}::DOUBLE) / {b[0] - a[0]}::DOUBLE * ({b[k]}::DOUBLE - {a[k]}::DOUBLE)', 3)}" for a, b in zip(ass.CURVE, ass.CURVE[1:]))
    return f"CASE WHEN t <= 0 THEN 0.0::DOUBLE {points} WHEN t IS NOT NULL THEN {ass.CURVE[-1][k]}::DOUBLE END"


_VERDICTS = f"""
v0 AS (
  SELECT *, shelf_life_x AS x, migration_time_y AS y, threat_timeline_z AS z, shelf_life_x + migration_time_y AS t, coalesce(key_size_bits, 0) AS sz,
    coalesce(algorithm_class = 'legacy_broken', false) OR coalesce(coalesce(key_size_bits, 0) > 0 AND key_size_bits < CASE algorithm_class WHEN 'asymmetric_factoring' THEN 2048 WHEN 'asymmetric_discrete_log' THEN if(coalesce(curve, '') <> '', 224, 2048) END, false) AS broken,
    coalesce(algorithm_class IN ('post_quantum', 'hybrid') OR quantum_vulnerability IN ('quantum_safe', 'hybrid_protected'), false) AS safe
  FROM reg),
v1 AS (
  SELECT *, {_r("z - x - y")} AS mosca_slack, {_curve(1)} AS breach_low, {_curve(2)} AS breach_high, greatest(0.0::DOUBLE, {_r("x + y - z")}) AS exposure,
    {_from(_from(_from(_DAY, "z"), "-x"), "-y")} AS ms,
    CASE WHEN algorithm_class IN ('post_quantum', 'hybrid') THEN NULL WHEN broken THEN DATE '2023-12-31' WHEN algorithm_class IN ('asymmetric_factoring', 'asymmetric_discrete_log') THEN DATE '2035-12-31' WHEN algorithm_class IN ('symmetric', 'hash') AND sz > 0 AND sz < 256 THEN DATE '2030-12-31' END AS dis,
    coalesce(algorithm_class IN ('symmetric', 'hash') AND sz > 0 AND sz < 256 AND NOT broken, false) AS nss
  FROM v0),
v2 AS (SELECT *, {_from("dis", "-y")} AS ls FROM v1),
v3 AS (SELECT *, {_r(f"datediff('day', {_DAY}, ls) / 365.2425::DOUBLE")} AS law FROM v2),
v4 AS (SELECT *, CASE WHEN safe AND NOT coalesce(law < 0 AND NOT nss, false) THEN NULL WHEN coalesce(ls < ms, ms IS NULL AND ls IS NOT NULL) THEN 'regulatory' WHEN ms IS NOT NULL THEN 'mosca' END AS binding FROM v3),
v5 AS (SELECT *, CASE binding WHEN 'regulatory' THEN law WHEN 'mosca' THEN mosca_slack END AS slack, CASE binding WHEN 'regulatory' THEN ls WHEN 'mosca' THEN ms END AS sb, coalesce(business_criticality IN ('High', 'Critical'), false) AS heavy FROM v4),
v AS (
  SELECT *, coalesce(slack < 0, false) AS overdue, sb::VARCHAR AS start_by,
    CASE WHEN safe AND NOT coalesce(law < 0 AND NOT nss, false) THEN 'Low' WHEN broken THEN 'Critical' WHEN slack < 1 THEN if(heavy, 'Critical', 'High') WHEN slack < 3 THEN if(heavy, 'High', 'Medium') WHEN slack >= 3 THEN 'Low' END AS band
  FROM v5)"""

_AGILE = f"""
g0 AS (SELECT *, regexp_extract(lower(replace(coalesce(location, ''), '\\', '/')), '[^/]*$') AS nm FROM inv),
g1 AS (
  SELECT *, CASE parameter_source WHEN 'dataflow' THEN 80.0 WHEN 'literal' THEN 30.0 ELSE 50.0 END::DOUBLE AS indirection,
    CASE WHEN type = 'hardware_module' THEN 10.0 WHEN target_type = 'binary' THEN 5.0 WHEN type = 'certificate' THEN 75.0 WHEN target_type = 'dependency' THEN 70.0
      WHEN nm IN ({", ".join(f"'{n}'" for n in ass.CONFIG_NAMES)}) OR (contains(nm, '.') AND regexp_extract(nm, '[^.]*$') IN ({", ".join(f"'{n}'" for n in ass.CONFIG_ENDS)})) THEN 90.0 WHEN type = 'protocol' THEN 85.0 WHEN target_type = 'container' THEN 65.0 ELSE 55.0 END::DOUBLE AS configurability,
    CASE WHEN occurrence_count <= 1 THEN 90.0::DOUBLE ELSE {_r("greatest(20.0::DOUBLE, 90 - 25 * log10(occurrence_count))", 1)} END AS concentration,
    CASE WHEN algorithm_class IN ('post_quantum', 'hybrid') THEN 100.0 WHEN algorithm_class IN ('symmetric', 'hash') THEN 95.0 WHEN algorithm_class IN ('asymmetric_factoring', 'asymmetric_discrete_log') THEN 55.0 WHEN algorithm_class = 'legacy_broken' THEN 70.0 ELSE 40.0 END::DOUBLE AS substitutability
  FROM g0),
ag AS (
  SELECT *, {_r("indirection * 0.30::DOUBLE + configurability * 0.30::DOUBLE + concentration * 0.15::DOUBLE + substitutability * 0.25::DOUBLE", 1)} AS score,
    CASE least(indirection, configurability, concentration, substitutability) WHEN indirection THEN 'indirection' WHEN configurability THEN 'configurability' WHEN concentration THEN 'concentration' ELSE 'substitutability' END AS weakest,
    CASE WHEN indirection >= 70 THEN 0.9 WHEN indirection <= 35 THEN 1.2 ELSE 1.0 END::DOUBLE AS multiplier
  FROM g1)"""
_INV = INVENTORY_SQL["a_aggregated"]
_GRADE = "CASE WHEN score >= 70 THEN 'Agile' WHEN score >= 40 THEN 'Moderate' ELSE 'Rigid' END AS grade"
_SIZE = "CASE WHEN key_size_bits >= 15360 THEN 256 WHEN key_size_bits >= 7680 THEN 192 WHEN key_size_bits >= 3072 THEN 128 WHEN key_size_bits >= 2048 THEN 112 ELSE 80 END"

_INV_NAMED = _INV.replace("arg_min(quantum_vulnerability, id) AS quantum_vulnerability,", "arg_min(quantum_vulnerability, id) AS quantum_vulnerability, arg_min(name, id) AS name,")
_INPUTS = f"""
sc AS (SELECT DISTINCT ON (scan_id) scan_id, coalesce(retention_override_years, CASE sensitivity_profile WHEN 'session' THEN 0.5 WHEN 'general_business' THEN 3 WHEN 'personal_data' THEN 10 WHEN 'health' THEN 25 WHEN 'government' THEN 25 WHEN 'national_security' THEN 50 ELSE 7 END::DOUBLE) AS kept FROM scan_summary),
u AS (
  SELECT inv.*, kept, CASE WHEN algorithm_class = 'hash' THEN 'integrity' WHEN type = 'certificate' OR (regexp_matches(nm, 'DSA|ED25519|ED448|SIGN|DILITHIUM|SPHINCS|FALCON|PSS') AND NOT regexp_matches(nm, 'DH|X25519|X448|KEM|KYBER|KEY EXCHANGE|KEYEXCHANGE|ECIES')) THEN 'authenticity'
      WHEN algorithm_class = 'symmetric' THEN 'confidentiality' WHEN algorithm_class IN ('asymmetric_factoring', 'asymmetric_discrete_log') OR type = 'protocol' THEN 'key_transport' ELSE 'unknown' END AS crypto_usage,
    greatest(CASE target_type WHEN 'source_code' THEN 0.25 WHEN 'dependency' THEN 0.75 WHEN 'binary' THEN 1.5 ELSE 0.5 END::DOUBLE, CASE type WHEN 'protocol' THEN 0.15 WHEN 'certificate' THEN 0.3 WHEN 'key' THEN 0.75 WHEN 'cloud_service' THEN 0.5 WHEN 'hardware_module' THEN 2.5 ELSE 0 END::DOUBLE)
      * {_r("1 + 0.3::DOUBLE * log10(occurrence_count)", 3)} * if(algorithm_class LIKE 'asymmetric%', 1.2::DOUBLE, 1.0::DOUBLE) * CASE business_criticality WHEN 'Critical' THEN 1.3 WHEN 'High' THEN 1.15 ELSE 1 END::DOUBLE * CASE parameter_source WHEN 'dataflow' THEN 0.9 WHEN 'literal' THEN 1.2 ELSE 1 END::DOUBLE AS y
  FROM (SELECT *, upper(concat_ws(' ', algorithm_family, name)) AS nm FROM inv) AS inv LEFT JOIN sc USING (scan_id))"""

ORACLE_SQL = {
    "r_inputs": f"WITH inv AS ({_INV_NAMED}), {_INPUTS} SELECT scan_id, {', '.join(inv.IDENTITY)}, crypto_usage, CASE WHEN crypto_usage IN ('authenticity', 'integrity') THEN CASE type WHEN 'certificate' THEN 1.5 WHEN 'hardware_module' THEN 10 WHEN 'cloud_service' THEN 2 ELSE 3 END::DOUBLE ELSE coalesce(kept, 7.0::DOUBLE) END AS shelf_life_x, {_r('least(6.0::DOUBLE, greatest(0.1::DOUBLE, y))')} AS migration_time_y FROM u",
    "r_flags": f"WITH {_REG}, {_VERDICTS} SELECT scan_id, artefact_id, coalesce(x + y > z, false) AND NOT safe AS is_at_risk, {_r('z - (x + y)')} AS margin, coalesce(breach_high >= 0.5, false) AS breach_likely FROM v",
    "q_scores": f"WITH inv AS ({_INV}), {_AGILE} SELECT scan_id, round(avg(score)::DECIMAL(20, 6), 1)::DOUBLE AS mean_score, count(*) AS n, count(*) FILTER (score < 40) AS rigid FROM ag GROUP BY scan_id",
    "e_register": f"WITH {_REG} SELECT " + ", ".join(f"CASE WHEN {c} THEN 'YES' ELSE 'NO' END AS {c}" if c == "is_overdue" else f"coalesce({c}::VARCHAR, '') AS {c}" for c in REGISTER) + " FROM reg",
    "a_ordered": f"WITH inv AS ({_INV}) SELECT scan_id, {', '.join(inv.IDENTITY)}, business_criticality, occurrence_count FROM inv",
    "r_verdicts": f"WITH {_REG}, {_VERDICTS} SELECT {', '.join(VERDICT)}, start_by FROM v",
    "r_bands": f"WITH {_REG}, {_VERDICTS} SELECT binding, band, count(*) AS n, count(*) FILTER (overdue) AS overdue FROM v GROUP BY ALL",
    "k_strength": f"""WITH {_REG}, s AS (SELECT *, CASE WHEN algorithm_class = 'symmetric' THEN key_size_bits WHEN coalesce(key_size_bits, 0) = 0 THEN NULL
      WHEN algorithm_class = 'asymmetric_discrete_log' AND coalesce(curve, '') <> '' THEN key_size_bits // 2 WHEN algorithm_class LIKE 'asymmetric%' THEN {_SIZE} END AS strength_bits FROM reg)
      SELECT algorithm_class, strength_bits::INT AS strength_bits, CASE WHEN sensitivity_profile = 'national_security' OR strength_bits >= 256 THEN 5 ELSE 3 END AS target_category, count(*) AS n FROM s GROUP BY ALL""",
    "q_agility": f"WITH inv AS ({_INV}), {_AGILE} SELECT scan_id, {', '.join(inv.IDENTITY)}, indirection, configurability, concentration, substitutability, score, {_GRADE}, weakest, multiplier FROM ag",
    "q_estate": f"WITH inv AS ({_INV}), {_AGILE} SELECT scan_id, {_GRADE}, count(*) AS n, count(*) FILTER (weakest = 'configurability') AS by_configuration FROM ag GROUP BY ALL",
    "g_built": """
      WITH d AS (SELECT scan_id, arg_max(document, received_at) AS doc FROM scan_document WHERE json_valid(document) GROUP BY scan_id),
      o AS (SELECT scan_id, CASE WHEN json_type(doc, '$.result') = 'OBJECT' THEN json_extract(doc, '$.result') ELSE doc::JSON END AS doc FROM d),
      art AS (SELECT scan_id, doc->>'$.summary.target_name' AS sys, unnest(json_extract(doc, '$.artefacts[*]')) AS a FROM o),
      kv AS (SELECT *, CASE json_type(a, '$.known_vulnerabilities') WHEN 'ARRAY' THEN json_extract(a, '$.known_vulnerabilities[*]') WHEN 'OBJECT' THEN [a->'$.known_vulnerabilities'] ELSE [] END AS ks FROM art),
      ra AS (
        SELECT scan_id, unnest(json_extract(doc, '$.risk_assessments[*]')) AS x FROM o WHERE json_type(doc, '$.risk_assessments') = 'ARRAY'
        UNION ALL SELECT scan_id, unnest(json_extract(doc, '$.risk_assessments.*')) AS x FROM o WHERE json_type(doc, '$.risk_assessments') = 'OBJECT'),
      r AS (SELECT scan_id, x->>'$.artefact_id' AS id, max(x->>'$.risk_category') AS risk_category, max(x->>'$.shelf_life_x')::DOUBLE AS shelf_life_x, max(x->>'$.migration_time_y')::DOUBLE AS migration_time_y, bool_or((x->>'$.is_overdue') = 'true') AS ov, max(x->>'$.binding_model') AS binding_model FROM ra GROUP BY ALL)
      SELECT kv.scan_id, coalesce(sys, 'Unknown system') AS system_name, a->>'$.id' AS artefact_id, a->>'$.name' AS name, a->>'$.type' AS type, a->>'$.algorithm_family' AS algorithm_family, a->>'$.classification.algorithm_class' AS algorithm_class,
        a->>'$.classification.quantum_vulnerability' AS quantum_vulnerability, a->>'$.target_type' AS target_type, a->>'$.location' AS location, len(ks)::INT AS known_vulnerability_count,
        ['critical', 'high', 'moderate', 'low'][list_min(list_transform(ks, lambda k: CASE lower(k->>'$.severity') WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'moderate' THEN 3 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 END))] AS worst_severity,
        risk_category, shelf_life_x, migration_time_y, coalesce(ov, false) AS is_overdue, binding_model
      FROM kv LEFT JOIN r ON r.scan_id = kv.scan_id AND r.id = a->>'$.id'""",
    "u_gate": f"WITH {_REG}, h AS (SELECT scan_id, count(*) FILTER (risk_category = 'Critical') AS risk_critical, count(*) FILTER (risk_category = 'High') AS risk_high FROM reg GROUP BY scan_id) SELECT *, CASE WHEN risk_critical > 0 THEN 'fail' WHEN risk_high > 0 THEN 'warn' ELSE 'pass' END AS gate FROM h",
    "e_csv": f"WITH {_REG} SELECT scan_id, {', '.join('CASE WHEN is_overdue THEN ' + chr(39) + 'YES' + chr(39) + ' ELSE ' + chr(39) + 'NO' + chr(39) + ' END AS is_overdue' if c == 'is_overdue' else f'coalesce({c}::VARCHAR, {chr(39) * 2}) AS {c}' for c in EXPORTED)} FROM reg",
    "e_components": f"""WITH {_REG} SELECT scan_id, artefact_id, json_object('type', CASE type WHEN 'library' THEN 'library' WHEN 'hardware_module' THEN 'device' ELSE 'cryptographic-asset' END, 'bom-ref', artefact_id, 'name', name,
      'cryptoProperties', json_object('algorithm_family', algorithm_family, 'key_size_bits', key_size_bits), 'evidence', json_object('location', location))::VARCHAR AS component FROM reg""",
}
