"""Queries of an asset's surroundings and of scan summaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherledger.operators import context as ctx
from cipherledger.operators import register as reg
from cipherledger.operators.snapshot_changes import consecutive_scans
from cipherledger.plans.register import _DELTA, _REG
from cipherledger.sources.tables import table


def c_consequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register rows with their criticality once their place in the tree is known."""
    return ctx.consequence(reg.current(table(spark, sf_dir, "artefact_row"))).select("scan_id", "artefact_id", "business_criticality", "placed_criticality")


def t_algorithm_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Algorithm strings stated in evidence snippets."""
    return ctx.algorithm_strings(table(spark, sf_dir, "evidence"))


def u_coverage_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each scan's walk left out."""
    return ctx.coverage_notes(table(spark, sf_dir, "walk_stats"))


def m_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The horizon and profile that hold for all scans of a system together."""
    return ctx.effective_horizon(table(spark, sf_dir, "scan_summary"))


def u_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each scan's readiness score and its change since the scan before."""
    return ctx.readiness_trend(table(spark, sf_dir, "scan_summary"))


def x_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets present in both of two consecutive scans, by band before and after."""
    delta = reg.scan_delta(reg.current(table(spark, sf_dir, "artefact_row")), consecutive_scans(table(spark, sf_dir, "scan_summary")))
    return delta.filter("rank_now is not null and rank_then is not null").groupBy("rank_then", "rank_now").agg(F.count("*").alias("n"))


QUERIES = {"c_consequence": c_consequence, "t_algorithm_strings": t_algorithm_strings, "u_coverage_notes": u_coverage_notes, "m_horizon": m_horizon, "u_trend": u_trend, "x_movement": x_movement}

_FAMILIES = ", ".join(f"('{n}', '{f}')" for n, f in ctx.FAMILY_OF.items())
ORACLE_SQL = {
    "c_consequence": f"""WITH {_REG}, p AS (SELECT *, CASE WHEN list_has_any(list_transform(string_split(lower(replace(coalesce(location, ''), '\\', '/')), '/'), lambda x: regexp_replace(x, '\\.[^.]*$', '')), {ctx.SENSITIVE}) THEN 'High' ELSE business_criticality END AS c FROM reg)
      SELECT scan_id, artefact_id, business_criticality, CASE WHEN type IN ('hardware_module', 'key') AND c = 'High' THEN 'Critical' WHEN algorithm_class = 'legacy_broken' AND c = 'Low' THEN 'Medium' ELSE c END AS placed_criticality FROM p""",
    "t_algorithm_strings": f"""WITH k(n, f) AS (VALUES {_FAMILIES}), e AS (SELECT DISTINCT ON (id) id, snippet FROM evidence WHERE snippet IS NOT NULL),
      s AS (SELECT id, unnest(list_distinct(regexp_extract_all(snippet, '["'']([A-Za-z0-9][A-Za-z0-9/+._ -]{{1,60}})["'']', 1))) AS stated FROM e),
      t AS (SELECT *, lower(trim(stated)) AS low FROM s),
      u AS (SELECT *, coalesce((SELECT f FROM k WHERE n = low), (SELECT f FROM k WHERE n = regexp_extract(low, '^([^/\\\\ ]*)', 1)),
            (SELECT f FROM k WHERE n = list_filter(regexp_split_to_array(low, '[^a-z0-9.+]+'), lambda x: x IN ({", ".join(f"'{n}'" for n in ctx.FAMILY_OF)}))[1])) AS family FROM t)
      SELECT id, stated, family, CASE {" ".join(f"WHEN regexp_matches(lower(stated), '(^|[^a-z0-9]){m}([^a-z0-9]|$)') THEN '{m.upper()}'" for m in ctx.MODES)} END AS mode, try_cast(regexp_extract(stated, '(?:^|[^0-9])(\\d{{3,4}})(?:[^0-9]|$)', 1) AS INT) AS bits FROM u WHERE family IS NOT NULL""",
    "u_coverage_notes": """SELECT DISTINCT ON (scan_id) scan_id, concat_ws('; ', CASE WHEN hit_file_limit THEN 'stopped after ' || files_scanned || ' files' END, CASE WHEN hit_depth_limit THEN 'directories too deep' END,
      CASE WHEN files_skipped_size > 0 THEN files_skipped_size || ' files too large' END, CASE WHEN dirs_pruned > 0 THEN dirs_pruned || ' directories left out' END) AS notes FROM walk_stats""",
    "m_horizon": """WITH s AS (SELECT DISTINCT ON (scan_id) * FROM scan_summary), y(p, years) AS (VALUES ('session', 0.5), ('general_business', 3.0), ('financial', 7.0), ('personal_data', 10.0), ('health', 25.0), ('government', 25.0), ('national_security', 50.0))
      SELECT target_name, coalesce(min(mosca_global_z), 8.0) AS horizon, count(DISTINCT mosca_global_z) AS horizons, (array_agg(sensitivity_profile ORDER BY coalesce(years, 0) DESC, sensitivity_profile DESC))[1] AS profile, count(DISTINCT sensitivity_profile) AS profiles FROM s LEFT JOIN y ON p = sensitivity_profile GROUP BY target_name""",
    "u_trend": """WITH s AS (SELECT DISTINCT ON (scan_id) * FROM scan_summary)
      SELECT scan_id, quantum_readiness_score AS score, round((quantum_readiness_score - lag(quantum_readiness_score) OVER (PARTITION BY installation_id, target_name ORDER BY created_at, scan_id))::DECIMAL(20, 6), 1)::DOUBLE AS change FROM s""",
    "x_movement": f"WITH {_REG}, {_DELTA} SELECT rank_then, rank_now, count(*) AS n FROM d WHERE rank_now IS NOT NULL AND rank_then IS NOT NULL GROUP BY ALL",
}
