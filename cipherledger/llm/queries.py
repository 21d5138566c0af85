"""Queries of the operators for training data, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherledger.llm.code_origin import file_origins
from cipherledger.llm.contamination import leaks, redacted, without_leaks
from cipherledger.llm.mixing import mix_sources, mixture_report
from cipherledger.llm.reading import reading_levels, train
from cipherledger.llm.secrets import masked_snippets, secrets_in
from cipherledger.llm.survivors import agreement, survivors
from cipherledger.sources.tables import table


#: Evidence snippets are cut off at so many characters by their source.
SNIPPET_CHARS = 200


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each literal secret of the evidence snippets starts."""
    return secrets_in(table(spark, sf_dir, "evidence"), cut_at=SNIPPET_CHARS).select("id", "start_char").distinct()


def p1_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every evidence snippet with its secrets masked."""
    return masked_snippets(table(spark, sf_dir, "evidence"), cut_at=SNIPPET_CHARS)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report whose value is kept, for each group of reports of one finding and each field."""
    return survivors(table(spark, sf_dir, "evidence")).select("group_id", "field_name", "survivor_id")


def p3_withheld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the learned order of values gives the survivor that the times give, half of the times being withheld."""
    return agreement(table(spark, sf_dir, "evidence"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files that are generated, minified, vendored or data."""
    return file_origins(table(spark, sf_dir, "source_file")).filter("origin <> 'own'").select("file_id")


def p5_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and their share by origin, for each system."""
    files = table(spark, sf_dir, "source_file").select("file_id", "system_name").distinct()
    return file_origins(table(spark, sf_dir, "source_file")).join(files, "file_id").groupBy("system_name", "origin").agg(F.count("*").alias("n_files"), F.round(F.avg("shared"), 4).alias("mean_shared"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item")).select("doc_id", "item_id")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each leaked item: documents that hold it and the longest stretch."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))
    return found.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("words").alias("longest"))


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a leaked passage."""
    return without_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item")).select("doc_id", "lang", "source", "project")


def p7_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents from which leaked stretches were cut out: how many, how many words, and how long the rest is."""
    texts = redacted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))
    return texts.filter("stretches > 0").select("doc_id", "stretches", "words_removed", F.length("text").alias("n_chars"))


def p8_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture, in the order in which the sources are served."""
    selection, _, _ = mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_target"))
    return selection


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of all tokens that each source reaches beside its target."""
    return mixture_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_target"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading level of every English document with enough prose."""
    documents = table(spark, sf_dir, "documents")
    return reading_levels(documents, train(documents, table(spark, sf_dir, "reading_label"))).select("doc_id", "reading_level")


def p9_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents and their words by source and reading level."""
    documents = table(spark, sf_dir, "documents")
    levels = reading_levels(documents, train(documents, table(spark, sf_dir, "reading_label")))
    sources = documents.select("doc_id", "source").distinct()
    return levels.join(sources, "doc_id").groupBy("source", "reading_level").agg(F.count("*").alias("n_docs"), F.sum("words").alias("n_words"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_masked": p1_masked,
    "p3_found": p3_found,
    "p3_withheld": p3_withheld,
    "p5_found": p5_found,
    "p5_origins": p5_origins,
    "p7_found": p7_found,
    "p7_items": p7_items,
    "p7_clean": p7_clean,
    "p7_redacted": p7_redacted,
    "p8_selection": p8_selection,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_profile": p9_profile,
}

_P3 = """
WITH r AS (
  SELECT id, recorded_at, concat_ws('|', scan_id, line_number, raw_type, regexp_replace(replace(file_path, '\\', '/'), '^(\\./+)+', '')) AS grp,
         CASE WHEN metadata.detector ILIKE '%taint%' THEN 3 WHEN metadata.parameters_resolved THEN 2 WHEN NOT metadata.parameters_resolved THEN 1 ELSE 0 END AS rank,
         detected_name, CASE WHEN key_length >= 1 THEN key_length::VARCHAR END AS key_length, curve_name, version_or_mode
  FROM evidence WHERE line_number IS NOT NULL AND scan_id IS NOT NULL AND raw_type IS NOT NULL AND file_path IS NOT NULL
), g AS (SELECT grp, min(id) AS group_id FROM r GROUP BY grp HAVING count(DISTINCT id) > 1
), v AS (
  SELECT grp, id, rank, recorded_at, 'detected_name' AS field_name, trim(detected_name) AS val FROM r
  UNION ALL SELECT grp, id, rank, recorded_at, 'key_length', key_length FROM r
  UNION ALL SELECT grp, id, rank, recorded_at, 'curve_name', trim(curve_name) FROM r
  UNION ALL SELECT grp, id, rank, recorded_at, 'version_or_mode', trim(version_or_mode) FROM r
), o AS (
  SELECT v.*, group_id, row_number() OVER (PARTITION BY grp, field_name ORDER BY rank DESC, recorded_at DESC, id) AS n
  FROM v JOIN g USING (grp) WHERE val IS NOT NULL AND lower(val) NOT IN ('', 'unknown', 'n/a', '-')
)
SELECT group_id, field_name, id AS survivor_id FROM o WHERE n = 1
"""

ORACLE_SQL: dict[str, str] = {"p3_found": _P3}
