"""Queries over the register of the last deliveries, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherledger.operators import register as reg
from cipherledger.operators.snapshot_changes import consecutive_scans
from cipherledger.sources.tables import table

TODAY = "2026-01-01"
HORIZONS = [2, 4, 6, 8, 10, 12, 15, 20]
SHOWN = ["scan_id", "artefact_id", "name", "risk_category", "must_start_by", "system_name", "occurrence_count"]


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg.current(table(spark, sf_dir, "artefact_row"))


def _over(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(_current(spark, sf_dir))


def g_filter(rows: DataFrame) -> DataFrame:
    return reg.matching(rows, overdue_only=True, quantum_vulnerability="fully_broken", risk_category="High").select(*SHOWN)


def g_search(rows: DataFrame) -> DataFrame:
    return reg.matching(rows, search=" Wallet ").select(*SHOWN)


def g_counts(rows: DataFrame) -> DataFrame:
    return reg.page_counts(reg.matching(rows, risk_category="High"))


def x_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets of consecutive scans by what became of them."""
    return reg.scan_delta(_current(spark, sf_dir), consecutive_scans(table(spark, sf_dir, "scan_summary")))


def x_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the buckets of each scan's comparison."""
    return reg.delta_counts(x_delta(spark, sf_dir))


def x_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of assets that changed between consecutive scans, before and after."""
    return reg.asset_changes(_current(spark, sf_dir), consecutive_scans(table(spark, sf_dir, "scan_summary")))


def x_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the bands of consecutive summaries moved."""
    return reg.band_movement(table(spark, sf_dir, "scan_summary"))


def g_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of all scans, the newest first."""
    scans = table(spark, sf_dir, "scan_summary").dropDuplicates(["scan_id"])
    bands = [F.coalesce(F.element_at("risk_distribution", F.lit(b)), F.lit(0)).alias(b.lower()) for b in reg.BANDS]
    return scans.select("scan_id", "target_name", "created_at", "total_artefacts", *bands, "overdue_artefacts", "files_scanned", "quantum_readiness_score").orderBy(F.desc("created_at"), "scan_id")


def g_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of one installation's scans with the label of their score."""
    scans = table(spark, sf_dir, "scan_summary").filter("installation_id = 'inst-00001'").dropDuplicates(["scan_id"])
    return scans.select("scan_id", "target_name", "total_artefacts", "quantum_readiness_score", reg.readiness_label(F.col("quantum_readiness_score")).alias("label"))


def g_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per scan of the register once the overdue-free scans are deleted, by cascade."""
    rows = _current(spark, sf_dir)
    gone = table(spark, sf_dir, "scan_summary").filter("overdue_artefacts = 0").select("scan_id").distinct()
    return rows.join(gone, "scan_id", "left_anti").groupBy("scan_id").agg(F.count("*").alias("n"))


def j_nearest_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled horizon nearest to each scan's own."""
    return reg.nearest_horizon(table(spark, sf_dir, "scan_summary"), HORIZONS)


def d_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signature matches in binaries, capped per file and pattern."""
    return reg.binary_offsets(table(spark, sf_dir, "evidence"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "g_filter": _over(g_filter),
    "g_search": _over(g_search),
    **{f"g_page_{s}": _over(lambda rows, s=s: reg.page(rows, 3, 50, s).select(*SHOWN)) for s in ("risk", "deadline", "system", "name", "occurrences")},
    "g_counts": _over(g_counts),
    "g_capped": _over(reg.capped),
    "g_facets": _over(reg.facets),
    "g_own": g_own,
    "g_after_delete": g_after_delete,
    "u_readiness": _over(lambda rows: reg.readiness(rows, ["scan_id"])),
    "u_histograms": _over(lambda rows: reg.histograms(rows, ["scan_id"])),
    "u_rollup": _over(lambda rows: reg.rollup(rows, TODAY)),
    "u_estate": _over(reg.estate),
    "j_horizons": _over(lambda rows: reg.horizons(rows, HORIZONS)),
    "j_by_standard": _over(reg.by_standard),
    "j_families": _over(lambda rows: rows.groupBy("algorithm_family", "target_type").agg(F.count("*").alias("n"))),
    "j_urgent": _over(lambda rows: rows.filter(F.col("risk_category").isin("Critical", "High")).orderBy(reg.risk_rank(F.col("risk_category")), F.col("occurrence_count").desc(), "scan_id", "artefact_id").limit(10).select(*SHOWN)),
    "m_waves": _over(lambda rows: reg.waves(rows, TODAY)),
    "x_delta": x_delta,
    "x_parameters": x_parameters,
    "x_bands": x_bands,
    "g_summaries": g_summaries,
    "m_long_lead": _over(reg.long_lead),
    "j_histogram": _over(lambda rows: rows.groupBy("quantum_vulnerability").agg(F.count("*").alias("n")).filter("quantum_vulnerability is not null").orderBy(F.array_position(F.array(*map(F.lit, reg.STATUSES)), F.col("quantum_vulnerability")))),
    "x_counts": x_counts,
    "j_inventory": _over(lambda rows: reg.inventory_filter(rows, "Vault", type="algorithm").select(*SHOWN)),
    "j_wave_members": _over(lambda rows: reg.wave_members(rows, TODAY).select("scan_id", "wave", "place", "artefact_id")),
    "j_nearest_horizon": j_nearest_horizon,
    "d_offsets": d_offsets,
}

_REG = """
l AS (SELECT scan_id, max(delivery_no) AS delivery_no FROM artefact_row GROUP BY scan_id),
reg AS (SELECT DISTINCT ON (scan_id, lower(artefact_id)) * REPLACE (lower(artefact_id) AS artefact_id) FROM artefact_row JOIN l USING (scan_id, delivery_no) ORDER BY scan_id, lower(artefact_id), delivered_at DESC NULLS LAST, _id)"""
_RANK = "CASE risk_category WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 3 ELSE 9 END"
_SHOWN = ", ".join(SHOWN)
_PAGE = {
    "risk": f"{_RANK}, coalesce(must_start_by, '9999-12-31'), coalesce(name, '')",
    "deadline": f"coalesce(must_start_by, '9999-12-31'), {_RANK}",
    "system": "coalesce(system_name, ''), coalesce(name, '')",
    "name": "coalesce(name, '')",
    "occurrences": "coalesce(occurrence_count, 0) DESC",
}
_BAND = """CASE WHEN algorithm_class IN ('post_quantum', 'hybrid') THEN 'Low' WHEN algorithm_class = 'legacy_broken' THEN 'Critical'
  WHEN z - (shelf_life_x + migration_time_y) < 1 THEN if(business_criticality IN ('High', 'Critical'), 'Critical', 'High')
  WHEN z - (shelf_life_x + migration_time_y) < 3 THEN if(business_criticality IN ('High', 'Critical'), 'High', 'Medium')
  WHEN z - (shelf_life_x + migration_time_y) >= 3 THEN 'Low' END"""
_DELTA = f"""
s AS (SELECT DISTINCT scan_id, installation_id, target_name, created_at FROM scan_summary),
p AS (SELECT scan_id, lag(scan_id) OVER (PARTITION BY installation_id, target_name ORDER BY created_at, scan_id) AS prev FROM s),
v AS (
  SELECT DISTINCT ON (scan_id, fam, ty, path) scan_id, coalesce(algorithm_family, '') AS fam, coalesce(type, '') AS ty, replace(trim(coalesce(location, '')), '\\', '/') AS path, artefact_id,
    CASE risk_category WHEN 'Critical' THEN 3 WHEN 'High' THEN 2 WHEN 'Medium' THEN 1 WHEN 'Low' THEN 0 ELSE -1 END AS rank, coalesce(key_size_bits, -1) AS size, trim(coalesce(curve, '')) AS cu, occurrence_count AS occ
  FROM reg ORDER BY scan_id, fam, ty, path, artefact_id DESC),
a AS (SELECT p.scan_id AS sid, v.* FROM v JOIN p USING (scan_id) WHERE prev IS NOT NULL),
b AS (SELECT p.scan_id AS sid, v.* FROM v JOIN p ON v.scan_id = p.prev),
d AS (
  SELECT coalesce(a.sid, b.sid) AS scan_id, coalesce(a.fam, b.fam) AS algorithm_family, coalesce(a.ty, b.ty) AS type, coalesce(a.path, b.path) AS path,
    CASE WHEN b.sid IS NULL THEN 'added' WHEN a.sid IS NULL THEN 'removed' WHEN a.rank > b.rank THEN 'worsened' WHEN a.rank < b.rank THEN 'improved' WHEN a.size <> b.size OR a.cu <> b.cu THEN 'parameters_changed' ELSE 'unchanged' END AS bucket,
    a.occ - b.occ AS occurrence_delta, a.rank AS rank_now, b.rank AS rank_then
  FROM a FULL JOIN b ON a.sid = b.sid AND a.fam = b.fam AND a.ty = b.ty AND a.path = b.path)"""

_PAIRS = """
s AS (SELECT DISTINCT scan_id, installation_id, target_name, created_at FROM scan_summary),
p AS (SELECT scan_id, lag(scan_id) OVER (PARTITION BY installation_id, target_name ORDER BY created_at, scan_id) AS prev FROM s),
v AS (
  SELECT DISTINCT ON (scan_id, fam, ty, path) scan_id, coalesce(algorithm_family, '') AS fam, coalesce(type, '') AS ty, replace(trim(coalesce(location, '')), '\\', '/') AS path, artefact_id, key_size_bits AS size, trim(coalesce(curve, '')) AS cu, name, risk_category AS band, occurrence_count AS occ
  FROM reg ORDER BY scan_id, fam, ty, path, artefact_id DESC),
m AS (SELECT a.scan_id, a.fam, a.ty, a.path, b.size AS s0, a.size AS s1, b.cu AS c0, a.cu AS c1, b.name AS n0, b.band AS b0, a.occ - b.occ AS od FROM v a JOIN p ON p.scan_id = a.scan_id JOIN v b ON b.scan_id = p.prev AND b.fam = a.fam AND b.ty = a.ty AND b.path = a.path)"""

ORACLE_SQL = {
    "x_parameters": f"""WITH {_REG}, {_PAIRS}
      SELECT scan_id, fam AS algorithm_family, ty AS type, path, 'key_size_bits' AS parameter, s0::VARCHAR AS before, s1::VARCHAR AS after, n0 AS previous_name, b0 AS previous_risk_category, od AS occurrence_delta FROM m WHERE s0 IS DISTINCT FROM s1
      UNION ALL SELECT scan_id, fam, ty, path, 'curve', c0, c1, n0, b0, od FROM m WHERE c0 <> c1""",
    "x_bands": """WITH s AS (SELECT DISTINCT ON (scan_id) * FROM scan_summary),
      q AS (SELECT *, lag(scan_id) OVER w AS prev_scan_id, lag(risk_distribution) OVER w AS pd, lag(quantum_readiness_score) OVER w AS ps FROM s WINDOW w AS (PARTITION BY installation_id, target_name ORDER BY created_at, scan_id)),
      b AS (SELECT *, unnest(list_distinct(list_concat(coalesce(map_keys(risk_distribution), []), coalesce(map_keys(pd), [])))) AS band FROM q WHERE prev_scan_id IS NOT NULL)
      SELECT scan_id, prev_scan_id, band, (coalesce(risk_distribution[band], 0) - coalesce(pd[band], 0))::INT AS movement, round((quantum_readiness_score - ps)::DECIMAL(20, 6), 1)::DOUBLE AS readiness_delta FROM b""",
    "g_summaries": "SELECT DISTINCT scan_id, target_name, created_at, total_artefacts, " + ", ".join(f"coalesce(risk_distribution['{b}'], 0)::INT AS {b.lower()}" for b in ("Critical", "High", "Medium", "Low")) + ", overdue_artefacts, files_scanned, quantum_readiness_score FROM scan_summary",
    "m_long_lead": f"WITH {_REG}, c AS (SELECT scan_id, max(migration_time_y) AS critical_path FROM reg GROUP BY scan_id) SELECT scan_id, artefact_id, migration_time_y, critical_path FROM reg JOIN c USING (scan_id) WHERE migration_time_y >= 1.0",
    "j_histogram": f"WITH {_REG} SELECT quantum_vulnerability, count(*) AS n FROM reg WHERE quantum_vulnerability IS NOT NULL GROUP BY ALL",
    "g_filter": f"WITH {_REG} SELECT {_SHOWN} FROM reg WHERE is_overdue AND quantum_vulnerability = 'fully_broken' AND risk_category = 'High'",
    "g_search": f"WITH {_REG} SELECT {_SHOWN} FROM reg WHERE contains(lower(coalesce(name, '') || ' ' || coalesce(algorithm_family, '') || ' ' || coalesce(location, '') || ' ' || coalesce(system_name, '') || ' ' || coalesce(purl, '') || ' ' || artefact_id), 'wallet')",
    **{f"g_page_{k}": f"WITH {_REG} SELECT {_SHOWN} FROM reg ORDER BY {v}, scan_id, artefact_id LIMIT 50 OFFSET 100" for k, v in _PAGE.items()},
    "g_counts": f"WITH {_REG} SELECT count(*) AS total, greatest(1, ceil(count(*) / 50.0))::BIGINT AS total_pages FROM reg WHERE risk_category = 'High'",
    "g_capped": f"WITH {_REG} SELECT least(count(*), 20000) AS kept, count(*) > 20000 AS results_capped FROM reg",
    "g_facets": f"WITH {_REG}, x AS (SELECT unnest([{{'facet': 'system_name', 'value': system_name}}, {{'facet': 'algorithm_family', 'value': algorithm_family}}, {{'facet': 'quantum_vulnerability', 'value': quantum_vulnerability}}]) AS u FROM reg) SELECT u.facet AS facet, u.value AS value, count(*) AS n FROM x WHERE coalesce(u.value, '') <> '' GROUP BY ALL",
    "g_own": "SELECT DISTINCT scan_id, target_name, total_artefacts, quantum_readiness_score, CASE WHEN quantum_readiness_score >= 80 THEN 'Ready' WHEN quantum_readiness_score >= 50 THEN 'Progressing' WHEN quantum_readiness_score >= 25 THEN 'At risk' ELSE 'Exposed' END AS label FROM scan_summary WHERE installation_id = 'inst-00001'",
    "g_after_delete": f"WITH {_REG} SELECT scan_id, count(*) AS n FROM reg WHERE scan_id NOT IN (SELECT scan_id FROM scan_summary WHERE overdue_artefacts = 0) GROUP BY scan_id",
    "u_readiness": f"WITH {_REG} SELECT scan_id, round((100 * (1 - sum(CASE risk_category WHEN 'Critical' THEN 1.0 WHEN 'High' THEN 0.6 WHEN 'Medium' THEN 0.25 ELSE 0 END::DOUBLE) / count(*)))::DECIMAL(20, 6), 1)::DOUBLE AS readiness, count(*) AS n FROM reg GROUP BY scan_id",
    "u_histograms": f"WITH {_REG} SELECT scan_id, "
    + ", ".join(f"count(*) FILTER (risk_category = '{b}') AS risk_{b.lower()}" for b in reg.BANDS)
    + ", "
    + ", ".join(f"count(*) FILTER (quantum_vulnerability = '{x}') AS status_{x}" for x in reg.STATUSES)
    + " FROM reg GROUP BY scan_id",
    "u_rollup": f"WITH {_REG} SELECT scan_id, min(CASE WHEN must_start_by >= '{TODAY}' THEN must_start_by[1:10] END) AS next_deadline, count(*) FILTER (is_overdue) AS overdue, max(migration_time_y) AS longest_y, sum(occurrence_count)::BIGINT AS occurrences, sum(known_vulnerability_count)::BIGINT AS advisories, count(*) AS assets FROM reg GROUP BY scan_id",
    "u_estate": f"WITH {_REG} SELECT system_name, grouping(system_name)::INT AS is_total, count(*) AS assets, count(DISTINCT scan_id) AS scans, sum(occurrence_count)::BIGINT AS occurrences, count(*) FILTER (risk_category = 'Critical') AS critical, count(*) FILTER (is_overdue) AS overdue FROM reg GROUP BY GROUPING SETS ((system_name), ())",
    "j_horizons": f"WITH {_REG}, h AS (SELECT unnest({HORIZONS})::INT AS z), b AS (SELECT unnest(['Critical', 'High', 'Medium', 'Low']) AS band), c AS (SELECT z, {_BAND} AS band, count(*) AS n FROM reg, h GROUP BY ALL) SELECT z, band, coalesce(n, 0)::BIGINT AS n FROM h CROSS JOIN b LEFT JOIN c USING (z, band)",
    "j_by_standard": f"WITH {_REG} SELECT recommended_standard, count(*) AS n, min({_RANK})::INT AS worst_rank FROM reg WHERE recommended_standard IS NOT NULL GROUP BY ALL",
    "j_families": f"WITH {_REG} SELECT algorithm_family, target_type, count(*) AS n FROM reg GROUP BY ALL",
    "j_urgent": f"WITH {_REG} SELECT {_SHOWN} FROM reg WHERE risk_category IN ('Critical', 'High') ORDER BY {_RANK}, occurrence_count DESC, scan_id, artefact_id LIMIT 10",
    "m_waves": f"""WITH {_REG}, w AS (SELECT *, must_start_by[1:10]::DATE AS s, must_complete_by[1:10]::DATE AS e, round((datediff('day', DATE '{TODAY}', must_start_by[1:10]::DATE) / 365.2425::DOUBLE)::DECIMAL(20, 8), 2) AS slack FROM reg WHERE must_start_by IS NOT NULL),
      g AS (SELECT scan_id, CASE WHEN slack <= 0 THEN 0 WHEN slack < 1 THEN 1 WHEN slack < 3 THEN 2 WHEN slack < 5 THEN 3 ELSE 4 END AS wave, count(*) AS assets, greatest(min(s), DATE '{TODAY}') AS st, min(e) AS dl, max(migration_time_y) AS longest_y,
        {", ".join(f"count(*) FILTER (risk_category = '{b}') AS {b.lower()}" for b in reg.BANDS)} FROM w GROUP BY ALL),
      y AS (SELECT *, round((longest_y - round((datediff('day', st, dl) / 365.2425::DOUBLE)::DECIMAL(20, 8), 2)::DOUBLE)::DECIMAL(20, 8), 2)::DOUBLE AS shortfall FROM g)
      SELECT scan_id, wave, assets, st::VARCHAR AS starts, dl::VARCHAR AS deadline, longest_y, critical, high, medium, low, shortfall, shortfall > 0 AS infeasible, dl < st AS breached FROM y""",
    "x_delta": f"WITH {_REG}, {_DELTA} SELECT * FROM d",
    "x_counts": f"WITH {_REG}, {_DELTA} SELECT scan_id, bucket, count(*) AS n, count(*) FILTER (rank_now = 3) AS critical FROM d GROUP BY ALL",
    "j_inventory": f"WITH {_REG} SELECT {_SHOWN} FROM reg WHERE type = 'algorithm' AND (contains(lower(coalesce(name, '')), 'vault') OR contains(lower(coalesce(algorithm_family, '')), 'vault') OR contains(lower(coalesce(location, '')), 'vault') OR contains(artefact_id, 'vault'))",
    "j_wave_members": f"""WITH {_REG}, w AS (SELECT *, round((datediff('day', DATE '{TODAY}', must_start_by[1:10]::DATE) / 365.2425::DOUBLE)::DECIMAL(20, 8), 2) AS slack FROM reg WHERE must_start_by IS NOT NULL),
      v AS (SELECT *, CASE WHEN slack <= 0 THEN 0 WHEN slack < 1 THEN 1 WHEN slack < 3 THEN 2 WHEN slack < 5 THEN 3 ELSE 4 END AS wave FROM w),
      o AS (SELECT *, row_number() OVER (PARTITION BY scan_id, wave ORDER BY {_RANK}, coalesce(must_complete_by, '9999-12-31'), artefact_id) AS place FROM v)
      SELECT scan_id, wave, place, artefact_id FROM o WHERE place <= 20""",
    "j_nearest_horizon": f"SELECT DISTINCT scan_id, CASE WHEN mosca_global_z IS NOT NULL THEN (SELECT arg_min(h, abs(mosca_global_z - h) * 1000 + h) FROM (SELECT unnest({HORIZONS})::INT AS h)) END AS horizon FROM scan_summary",
    "d_offsets": """WITH e AS (SELECT DISTINCT ON (id) id, scan_id, file_path, matched_pattern, column_number FROM evidence WHERE target_type = 'binary' AND id IS NOT NULL),
      o AS (SELECT scan_id, file_path, matched_pattern, column_number, min(id) AS id FROM e GROUP BY ALL),
      n AS (SELECT id, row_number() OVER (PARTITION BY scan_id, file_path, matched_pattern ORDER BY column_number NULLS LAST, id) AS place, count(*) OVER (PARTITION BY scan_id, file_path, matched_pattern) AS total FROM o)
      SELECT * FROM n WHERE place <= 12""",
}
