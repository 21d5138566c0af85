"""Queries of the core: operators bound to the tables of a data directory, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cipherledger.operators.scan_documents import scan_children, scan_tables
from cipherledger.operators.schema_drift import FIELDS, OTHER_NAMES, drift, path_drift, typed_table
from cipherledger.operators.snapshot_changes import Compared, snapshot_changes
from cipherledger.sources.tables import table

#: Columns that decide whether a register row changed, by kind of comparison (fixed values).
REGISTER_COMPARED = Compared(
    texts=("name", "type", "algorithm_family", "algorithm_class", "curve", "target_type", "quantum_vulnerability", "business_criticality", "purl", "crypto_usage", "risk_category", "binding_model", "recommended_standard", "migration_urgency"),
    paths=("location",),
    dates=("must_start_by", "must_complete_by"),
    exact=("key_size_bits", "known_vulnerability_count", "is_overdue", "nist_category"),
    numbers=("shelf_life_x", "migration_time_y"),
)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register changes between consecutive scans of each series."""
    return snapshot_changes(table(spark, sf_dir, "artefact_row"), table(spark, sf_dir, "scan_summary"), "artefact_id", REGISTER_COMPARED)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of form between consecutive export files of each feed."""
    return drift(table(spark, sf_dir, "raw_record"))


def p4_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of paths at any depth between consecutive export files of each feed."""
    return path_drift(table(spark, sf_dir, "raw_record"))


def p4_risk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk assessments of all export files in uniform types."""
    return typed_table(table(spark, sf_dir, "raw_record"), "MoscaRiskAssessment")


def p4_request_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan requests of all export files in uniform types."""
    return typed_table(table(spark, sf_dir, "raw_record"), "ScanPathRequest")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences, advisory aliases and model verdicts of each scan's last readable document."""
    return scan_children(table(spark, sf_dir, "scan_document"))


def _p6_table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: scan_tables(table(spark, sf_dir, "scan_document"))[name]


QUERIES = {"p2_found": p2_found, "p4_found": p4_found, "p4_paths": p4_paths, "p4_risk_table": p4_risk_table, "p4_request_table": p4_request_table, "p6_found": p6_found, **{f"p6_{t}": _p6_table(t) for t in ("occurrences", "advisories", "verdicts")}}

_TEXTS = ", ".join(f"coalesce(trim({c}), '') AS {c}" for c in REGISTER_COMPARED.texts)
_DATES = ", ".join(f"regexp_replace(coalesce(trim({c}), ''), '[T ]00:00:00$', '') AS {c}" for c in REGISTER_COMPARED.dates)
_SAME = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in [*REGISTER_COMPARED.texts, *REGISTER_COMPARED.paths, *REGISTER_COMPARED.dates, *REGISTER_COMPARED.exact])
_NEAR = " AND ".join(f"(a.{c} IS NOT DISTINCT FROM b.{c} OR coalesce(abs(a.{c} - b.{c}) < 1e-6, false))" for c in REGISTER_COMPARED.numbers)
_P2 = f"""
WITH s AS (SELECT DISTINCT scan_id, installation_id, target_name, created_at FROM scan_summary),
p AS (SELECT scan_id, lag(scan_id) OVER (PARTITION BY installation_id, target_name ORDER BY created_at, scan_id) AS prev FROM s),
l AS (SELECT scan_id, max(delivery_no) AS delivery_no FROM artefact_row GROUP BY scan_id),
r AS (
  SELECT DISTINCT scan_id, lower(artefact_id) AS artefact_id, {_TEXTS}, {_DATES}, replace(coalesce(trim(location), ''), '\\', '/') AS location,
         {", ".join([*REGISTER_COMPARED.exact, *REGISTER_COMPARED.numbers])}
  FROM artefact_row JOIN l USING (scan_id, delivery_no)),
a AS (SELECT p.scan_id AS later, r.* EXCLUDE (scan_id) FROM r JOIN p USING (scan_id) WHERE prev IS NOT NULL),
b AS (SELECT p.scan_id AS later, r.* EXCLUDE (scan_id) FROM r JOIN p ON r.scan_id = p.prev)
SELECT DISTINCT coalesce(a.later, b.later) AS scan_id, coalesce(a.artefact_id, b.artefact_id) AS artefact_id,
       CASE WHEN b.later IS NULL THEN 'added' WHEN a.later IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM a FULL JOIN b ON a.later = b.later AND a.artefact_id = b.artefact_id
WHERE a.later IS NULL OR b.later IS NULL OR NOT ({_SAME} AND {_NEAR})
"""

_P6 = """
WITH d AS (
  SELECT scan_id, arg_max(document, received_at) AS doc FROM scan_document WHERE json_valid(document) GROUP BY scan_id),
o AS (SELECT scan_id, CASE WHEN json_type(doc, '$.result') = 'OBJECT' THEN json_extract(doc, '$.result') ELSE doc::JSON END AS doc FROM d),
art AS (SELECT scan_id, unnest(json_extract(doc, '$.artefacts[*]')) AS a FROM o),
occ AS (
  SELECT scan_id, a->>'$.id' AS artefact_id, CASE json_type(a, '$.occurrences') WHEN 'ARRAY' THEN json_extract(a, '$.occurrences[*]') WHEN 'OBJECT' THEN [a->'$.occurrences'] END AS xs FROM art),
occ1 AS (SELECT scan_id, artefact_id, unnest(xs) AS x, generate_subscripts(xs, 1) - 1 AS pos FROM occ),
kv AS (
  SELECT scan_id, a->>'$.id' AS artefact_id, CASE json_type(a, '$.known_vulnerabilities') WHEN 'ARRAY' THEN json_extract(a, '$.known_vulnerabilities[*]') WHEN 'OBJECT' THEN [a->'$.known_vulnerabilities'] END AS xs FROM art),
kv1 AS (SELECT scan_id, artefact_id, unnest(xs) AS x, generate_subscripts(xs, 1) - 1 AS parent_pos FROM kv),
al AS (
  SELECT scan_id, artefact_id, parent_pos, CASE json_type(x, '$.aliases') WHEN 'ARRAY' THEN json_extract(x, '$.aliases[*]') WHEN 'VARCHAR' THEN [x->'$.aliases'] END AS xs FROM kv1),
al1 AS (SELECT scan_id, artefact_id, parent_pos, unnest(xs) AS x, generate_subscripts(xs, 1) - 1 AS pos FROM al),
ra AS (
  SELECT scan_id, unnest(json_extract(doc, '$.risk_assessments[*]')) AS x FROM o WHERE json_type(doc, '$.risk_assessments') = 'ARRAY'
  UNION ALL SELECT scan_id, unnest(json_extract(doc, '$.risk_assessments.*')) AS x FROM o WHERE json_type(doc, '$.risk_assessments') = 'OBJECT'),
mv AS (
  SELECT scan_id, x->>'$.artefact_id' AS artefact_id, CASE json_type(x, '$.model_verdicts') WHEN 'ARRAY' THEN json_extract(x, '$.model_verdicts[*]') WHEN 'OBJECT' THEN [x->'$.model_verdicts'] WHEN 'VARCHAR' THEN json_extract((x->>'$.model_verdicts')::JSON, '$[*]') END AS xs FROM ra),
mv1 AS (SELECT scan_id, artefact_id, unnest(xs) AS x, generate_subscripts(xs, 1) - 1 AS pos FROM mv)
SELECT * FROM (
  SELECT scan_id, artefact_id, 'occurrence' AS child, 0::INT AS parent_pos, pos::INT AS pos, CASE json_type(x, '$.location') WHEN 'OBJECT' THEN x->>'$.location.path' ELSE x->>'$.location' END AS value FROM occ1
  UNION ALL SELECT scan_id, artefact_id, 'alias', parent_pos::INT, pos::INT, x->>'$' FROM al1
  UNION ALL SELECT scan_id, artefact_id, 'verdict', 0, pos::INT, x->>'$.model' FROM mv1)
WHERE value IS NOT NULL
"""

_P6_PARTS = _P6[: _P6.index("SELECT * FROM (")]
_P6_TABLES = {
    "p6_occurrences": "SELECT scan_id, artefact_id, pos::INT AS pos, CASE json_type(x, '$.location') WHEN 'OBJECT' THEN x->>'$.location.path' ELSE x->>'$.location' END AS location, try_cast(x->>'$.line_number' AS INT) AS line_number, x->>'$.snippet' AS snippet FROM occ1",
    "p6_advisories": "SELECT scan_id, artefact_id, parent_pos::INT AS pos, x->>'$.id' AS advisory_id, x->>'$.severity' AS severity, x->>'$.fixed_version' AS fixed_version FROM kv1",
    "p6_verdicts": "SELECT scan_id, artefact_id, pos::INT AS pos, x->>'$.model' AS model, (x->>'$.at_risk')::BOOLEAN AS at_risk, (x->>'$.slack_years')::DOUBLE AS slack_years, x->>'$.must_start_by' AS must_start_by, (x->>'$.probability.low')::DOUBLE AS low, (x->>'$.probability.high')::DOUBLE AS high FROM mv1",
}

_NAMED = " ".join(
    f"WHEN entity = '{e}' AND plain IN ({', '.join(repr(x.replace('_', '')) for x in [f, *OTHER_NAMES[e].get(f, [])])}) THEN '{f}'" for e, fields in FIELDS.items() for f in fields
)
_P4 = f"""
WITH r AS (SELECT DISTINCT feed_name, file_name, entity, exported_at, line_no, payload::JSON AS doc FROM raw_record WHERE json_valid(payload) AND json_type(CASE WHEN json_valid(payload) THEN payload END) = 'OBJECT'),
files AS (SELECT file_name, min(feed_name) AS feed_name, min(exported_at) AS exported_at, count(DISTINCT line_no) AS n_records FROM r GROUP BY file_name),
steps AS (SELECT *, lag(file_name) OVER (PARTITION BY feed_name ORDER BY exported_at, file_name) AS prev FROM files),
k AS (SELECT file_name, entity, doc, unnest(json_keys(doc)) AS name FROM r),
e AS (SELECT *, lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) AS plain, json_type(doc, '$."' || name || '"') AS t FROM k),
g AS (
  SELECT file_name, name, CASE {_NAMED} ELSE name END AS field,
    CASE WHEN t = 'VARCHAR' THEN 'text' WHEN t = 'BOOLEAN' THEN 'boolean' WHEN t = 'OBJECT' THEN 'object' WHEN t = 'ARRAY' THEN 'list' WHEN t = 'NULL' THEN 'null' ELSE 'number' END AS kind FROM e),
nm AS (SELECT file_name, field, name, count(*) AS n FROM g GROUP BY ALL),
kd AS (SELECT file_name, field, kind, count(*) AS n FROM g WHERE kind <> 'null' GROUP BY ALL),
f AS (
  SELECT nm.file_name, nm.field, (array_agg(name ORDER BY n DESC, name))[1] AS name, (SELECT (array_agg(kind ORDER BY kd.n DESC, kind))[1] FROM kd WHERE kd.file_name = nm.file_name AND kd.field = nm.field) AS kind
  FROM nm JOIN files USING (file_name) GROUP BY nm.file_name, nm.field, n_records HAVING 2 * sum(n) >= n_records),
a AS (SELECT f.* FROM f JOIN steps USING (file_name) WHERE prev IS NOT NULL),
b AS (SELECT steps.file_name, f.field, f.name, f.kind FROM f JOIN steps ON f.file_name = steps.prev),
c AS (SELECT coalesce(a.file_name, b.file_name) AS file_name, coalesce(a.field, b.field) AS field_name, a.name AS an, b.name AS bn, a.kind AS ak, b.kind AS bk FROM a FULL JOIN b ON a.file_name = b.file_name AND a.field = b.field)
SELECT file_name, field_name, 'added' AS change_kind FROM c WHERE bn IS NULL
UNION ALL SELECT file_name, field_name, 'removed' FROM c WHERE an IS NULL
UNION ALL SELECT file_name, field_name, 'renamed' FROM c WHERE an <> bn
UNION ALL SELECT file_name, field_name, 'retyped' FROM c WHERE ak <> bk
"""

_DATE = """CASE WHEN kind = 'object' THEN try_cast(printf('%04d-%02d-%02d', try_cast(v->>'$.year' AS INT), try_cast(v->>'$.month' AS INT), try_cast(v->>'$.day' AS INT)) AS DATE)
  WHEN kind = 'number' AND regexp_full_match(txt, '[0-9]{8}') THEN try_strptime(txt, '%Y%m%d')::DATE
  WHEN kind = 'number' THEN DATE '1970-01-01' + try_cast(txt AS INT)
  WHEN regexp_matches(txt, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_cast(txt[1:10] AS DATE)
  WHEN regexp_full_match(txt, '[0-9]{1,2} [A-Z][a-z]{2} [0-9]{4}') THEN try_strptime(txt, '%d %b %Y')::DATE
  WHEN regexp_full_match(txt, '[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4}') THEN try_strptime(txt, '%d.%m.%Y')::DATE END"""
_CASTS = {
    "date": _DATE,
    "boolean": "CASE WHEN lower(txt) IN ('true', 'yes', '1', 'y') THEN true WHEN lower(txt) IN ('false', 'no', '0', 'n') THEN false END",
    "double": "try_cast(txt AS DOUBLE)",
    "binding_model": "CASE WHEN kind = 'number' THEN ['mosca', 'probabilistic', 'regulatory', 'hndl'][try_cast(txt AS INT) + 1] ELSE lower(txt) END",
    "sensitivity_profile": "CASE WHEN kind <> 'number' THEN lower(translate(txt, ' -', '__')) END",
    "string": "CASE WHEN kind IN ('text', 'number', 'boolean') THEN txt END",
}


def _typed_sql(entity: str, fields: dict[str, str]) -> str:
    """One row for each readable record of the entity with typed fields; its casts are written out here, not taken from the operator."""
    named = " ".join(f"WHEN plain IN ({', '.join(repr(x.replace('_', '')) for x in [f, *OTHER_NAMES[entity].get(f, [])])}) THEN '{f}'" for f in fields)
    casts = {f: _CASTS.get(f, _CASTS[wanted]) for f, wanted in fields.items()}
    columns = ", ".join(f"max({c}) FILTER (field = '{f}') AS {f}" for f, c in casts.items())
    failed = ", ".join(f"CASE WHEN max(kind) FILTER (field = '{f}') <> 'null' AND max({c}) FILTER (field = '{f}') IS NULL THEN '{f}' END" for f, c in casts.items())
    return f"""
WITH r AS (SELECT DISTINCT file_name, line_no, payload::JSON AS doc FROM raw_record WHERE entity = '{entity}' AND file_name IS NOT NULL AND json_valid(payload) AND json_type(CASE WHEN json_valid(payload) THEN payload END) = 'OBJECT'),
k AS (SELECT file_name, line_no, doc, unnest(CASE WHEN len(json_keys(doc)) > 0 THEN json_keys(doc) ELSE [NULL] END) AS name FROM r),
e AS (SELECT file_name, line_no, name, lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) AS plain, json_extract(doc, '$."' || name || '"') AS v, json_type(doc, '$."' || name || '"') AS t FROM k),
n AS (
  SELECT *, CASE {named} END AS field, CASE WHEN t = 'VARCHAR' THEN 'text' WHEN t = 'BOOLEAN' THEN 'boolean' WHEN t = 'OBJECT' THEN 'object' WHEN t = 'ARRAY' THEN 'list' WHEN t = 'NULL' THEN 'null' ELSE 'number' END AS kind,
    CASE WHEN t = 'VARCHAR' THEN v->>'$' WHEN t = 'ARRAY' THEN v->>'$[0]' WHEN t = 'OBJECT' THEN coalesce(v->>'$.model', v->>'$.name') WHEN t = 'NULL' THEN NULL ELSE v::VARCHAR END AS txt FROM e),
f AS (SELECT *, row_number() OVER (PARTITION BY file_name, line_no, field ORDER BY name) AS place FROM n)
SELECT file_name, line_no, {columns}, list_filter([{failed}], lambda x: x IS NOT NULL) AS failed_casts FROM f WHERE place = 1 GROUP BY file_name, line_no
"""


ORACLE_SQL = {"p2_found": _P2, "p4_found": _P4, "p4_risk_table": _typed_sql("MoscaRiskAssessment", FIELDS["MoscaRiskAssessment"]), "p4_request_table": _typed_sql("ScanPathRequest", FIELDS["ScanPathRequest"]), "p6_found": _P6, **{name: _P6_PARTS + sql for name, sql in _P6_TABLES.items()}}
