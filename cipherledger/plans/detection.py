"""Queries of file listing and text detection, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherledger.operators import detection as det
from cipherledger.sources.tables import table


def s_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a walk does with each source file, and which scanners take it."""
    return det.listing(table(spark, sf_dir, "source_file")).withColumn("scanners", F.concat_ws("|", "scanners"))


def s_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files seen, scanned and skipped in each scan."""
    return det.coverage(table(spark, sf_dir, "source_file"))


def s_scanners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by scanner and extension."""
    rows = det.listing(table(spark, sf_dir, "source_file")).select("extension", F.explode("scanners").alias("scanner"))
    return rows.groupBy("scanner", "extension").agg(F.count("*").alias("n"))


def d_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of the text rules in source files."""
    return det.detect(table(spark, sf_dir, "source_file").dropDuplicates(["file_id"]), "file_id", "content").drop("snippet")


def d_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of the text rules in documents, by rule."""
    hits = det.detect(table(spark, sf_dir, "documents"), "doc_id", "text")
    return hits.groupBy("rule", "detected_name").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"), F.sum("key_length").alias("bits"))


def d_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines on which the text rules match in source files, as evidence shows them."""
    return det.detect(table(spark, sf_dir, "source_file").dropDuplicates(["file_id"]), "file_id", "content").select("file_id", "line_number", "rule", "snippet")


def s_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scanners that each scan runs."""
    return det.routed(table(spark, sf_dir, "scan_summary"))


QUERIES = {"d_snippets": d_snippets, "s_routed": s_routed, "s_listing": s_listing, "s_coverage": s_coverage, "s_scanners": s_scanners, "d_source": d_source, "d_documents": d_documents}


def _sql(regex: str | None, group: int = 1) -> str:
    """The rule's expression without look-around, which this SQL engine lacks: borders are read instead."""
    plain = (regex or "").replace(r"(?<!\w)", r"(?:^|[^\w])").replace(r"(?!\w)", r"(?:$|[^\w])").replace("'", "''")
    return f"regexp_extract(line, '{plain}', {group})"


def _rule_sql(r: det.Rule) -> str:
    sizes = [f"try_cast({_sql(r.key, g)} AS INT)" for g in range(1, 3 if r.key == det._KEYR else 2)] if r.key else []
    size = f"coalesce({', '.join([*sizes, str(r.default_key) if r.default_key else 'NULL::INT'])})"
    curve = f"nullif(upper({_sql(r.curve)}), '')" if r.curve else "NULL::VARCHAR"
    mode = f"nullif(upper({_sql(r.mode)}), '')" if r.mode else (f"'{r.default_mode}'" if r.default_mode else "NULL::VARCHAR")
    return f"SELECT id, line_number, '{r.name}' AS rule, '{r.raw_type}' AS raw_type, '{r.detected}' AS detected_name, {_sql(r.regex())} AS matched, {size} AS key_length, {curve} AS curve_name, {mode} AS mode, substr(trim(line), 1, 200) AS snippet FROM lines WHERE {_sql(r.regex())} <> ''"


def _detect_sql(source: str) -> str:
    return (
        f"texts AS ({source}), cut AS (SELECT id, regexp_split_to_array(t, '\\r\\n|\\n|\\r') AS ls FROM texts WHERE regexp_matches(t, '{det.PREFILTER}')), "
        "lines AS (SELECT id, unnest(ls) AS line, generate_subscripts(ls, 1)::INT AS line_number FROM cut), "
        f"hits AS ({' UNION ALL '.join(map(_rule_sql, det.RULES))})"
    )


def _in(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


_LIST = f"""
f AS (SELECT DISTINCT ON (file_id) file_id, scan_id, size_bytes, regexp_replace(replace(file_path, '\\', '/'), '^(\\./+)+', '') AS path FROM source_file WHERE file_path IS NOT NULL),
g AS (SELECT *, string_split(lower(path), '/') AS parts, list_reverse(string_split(lower(path), '/'))[1] AS nm, string_split(lower(path), '/')[:-2] AS dirs FROM f),
h AS (
  SELECT file_id, scan_id, path, nm, CASE WHEN contains(nm, '.') THEN list_reverse(string_split(nm, '.'))[1] ELSE '' END AS extension, len(dirs)::INT AS depth,
    CASE WHEN len(dirs) >= 25 OR len(list_filter(dirs, lambda d: d IN ({_in(det.SKIPPED_DIRS)}) OR (starts_with(d, '.') AND d NOT IN ({_in(det.KEPT_HIDDEN)})) OR ends_with(d, '.egg-info'))) > 0 THEN 'pruned'
      WHEN nm IN ({_in(det.SKIPPED_NAMES)}) OR (starts_with(nm, 'scan_') AND ends_with(nm, '.json')) OR {" OR ".join(f"ends_with(nm, '{e}')" for e in det.SKIPPED_ENDS)} THEN 'skipped_type'
      WHEN size_bytes > 8388608 THEN 'skipped_size' ELSE 'scanned' END AS verdict FROM g),
li AS (SELECT file_id, scan_id, path, extension, depth, verdict, CASE WHEN verdict = 'scanned' THEN concat_ws('|', CASE WHEN extension IN ({_in(det.SOURCE_ENDS)}) OR starts_with(nm, '.env') THEN 'source' END, CASE WHEN nm IN ({_in(det.MANIFESTS)}) THEN 'dependency' END, CASE WHEN starts_with(nm, 'dockerfile') THEN 'container' END) ELSE '' END AS scanners FROM h)"""

ORACLE_SQL = {
    "d_snippets": f"WITH {_detect_sql('SELECT DISTINCT ON (file_id) file_id AS id, content AS t FROM source_file')} SELECT id AS file_id, line_number, rule, snippet FROM hits",
    "s_routed": """
        WITH r(target_type, scanner, seq) AS (VALUES ('source_code', 'source', 1), ('source_code', 'certificate', 5), ('binary', 'binary', 2), ('dependency', 'dependency', 3), ('container', 'container', 4),
          ('multi_target', 'source', 1), ('multi_target', 'binary', 2), ('multi_target', 'dependency', 3), ('multi_target', 'container', 4), ('multi_target', 'certificate', 5)),
        t AS (SELECT DISTINCT scan_id, unnest(target_types) AS target_type FROM scan_summary)
        SELECT scan_id, scanner, min(seq) AS seq FROM t JOIN r USING (target_type) GROUP BY ALL""",
    "s_listing": f"WITH {_LIST} SELECT * FROM li",
    "s_coverage": f"WITH {_LIST} SELECT scan_id, count(*) AS seen, " + ", ".join(f"count(*) FILTER (verdict = '{v}') AS {v}" for v in ("scanned", "pruned", "skipped_type", "skipped_size")) + " FROM li GROUP BY scan_id",
    "s_scanners": f"WITH {_LIST}, x AS (SELECT extension, unnest(string_split(scanners, '|')) AS scanner FROM li WHERE scanners <> '') SELECT scanner, extension, count(*) AS n FROM x GROUP BY ALL",
    "d_source": f"WITH {_detect_sql('SELECT DISTINCT ON (file_id) file_id AS id, content AS t FROM source_file')} SELECT id AS file_id, line_number, rule, raw_type, detected_name, matched, key_length, curve_name, mode FROM hits",
    "d_documents": f"WITH {_detect_sql('SELECT doc_id AS id, text AS t FROM documents')} SELECT rule, detected_name, count(*) AS n, count(DISTINCT id) AS docs, sum(key_length)::BIGINT AS bits FROM hits GROUP BY ALL",
}
