"""Queries that run as streams over what is there, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherledger.functions.scale import shared_folder
from cipherledger.streaming.evidence import evidence_stream, register_upserts, run_to_table, windowed_counts


def st_evidence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence by week and type, counted by a stream with state."""
    counts = windowed_counts(evidence_stream(spark, f"{sf_dir}/evidence.parquet"), lateness="3650 days")
    return run_to_table(counts).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "raw_type", "n")


def st_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each scan in a register that a stream of deliveries keeps up to date."""
    at = shared_folder(spark)
    register_upserts(evidence_stream(spark, f"{sf_dir}/artefact_row.parquet"), f"{at}/register", f"{at}/state").awaitTermination()
    kept = spark.read.parquet(f"{at}/register")
    return kept.groupBy("scan_id").agg(F.count("*").alias("n"), F.max("delivery_no").alias("delivery_no"))


QUERIES = {"st_evidence_windows": st_evidence_windows, "st_register": st_register}

ORACLE_SQL = {
    "st_register": """
        WITH l AS (SELECT scan_id, max(delivery_no) AS delivery_no FROM artefact_row WHERE scan_id IS NOT NULL GROUP BY scan_id)
        SELECT scan_id, count(DISTINCT _id) AS n, max(delivery_no) AS delivery_no FROM artefact_row JOIN l USING (scan_id, delivery_no) GROUP BY scan_id""",
    "st_evidence_windows": """
        WITH e AS (SELECT DISTINCT ON (id) id, raw_type, recorded_at FROM evidence WHERE recorded_at IS NOT NULL AND id IS NOT NULL)
        SELECT time_bucket(INTERVAL 7 DAY, recorded_at, TIMESTAMP '1970-01-01') AS window_start, raw_type, count(*) AS n FROM e GROUP BY ALL""",
}
