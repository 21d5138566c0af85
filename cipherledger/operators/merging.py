"""The merged view of stored scans, reassessment at another horizon, and the walks of several scans taken together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherledger.functions.scale import salted_join
from cipherledger.functions.text import slashed
from cipherledger.operators.assessment import verdicts
from cipherledger.operators.inventory import CRITICALITY

DEFAULT_HORIZON = 8.0
LEAST_HORIZON, MOST_HORIZON = 0.5, 30.0
SAME_ASSET = ["algorithm_family", "key_size_bits", "curve", "type", "target_type", "location"]


def _owner() -> Column:
    """An installation as a join key, null being an owner of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col("installation_id")), F.lit(""))


def _scans(scans: DataFrame) -> DataFrame:
    return scans.filter("scan_id is not null").dropDuplicates(["scan_id"]).withColumn("_own", _owner())


def merged_register(rows: DataFrame, scans: DataFrame, today: str) -> DataFrame:
    """All scans of an installation as one inventory, assessed at the smallest of their horizons (8 where none is stated).

    rows: the register's current rows. Assets are the same if family, size, curve, type, target and location are, outer blanks,
    null against blank and slashes aside. Merging never softens: the largest X, Y and criticality hold. Name, class and status come
    from the newest scan, of equals from the larger scan and artefact id. occurrences counts distinct lines, no line being one of them; systems counts
    the systems that hold the asset. Scans without rows count for the horizon; rows of unknown scans are left out; empty tables give no rows.
    """
    known = _scans(scans)
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    rank = F.array_position(F.array(*map(F.lit, CRITICALITY)), text("business_criticality"))
    plain = rows.select("scan_id", "artefact_id", "system_name", "line_number", "key_size_bits", "shelf_life_x", "migration_time_y", rank.alias("_rank"), *[text(c).alias(c) for c in ("algorithm_family", "curve", "type", "target_type")],
                        slashed(text("location")).alias("location"), *[text(c).alias(c) for c in ("name", "algorithm_class", "quantum_vulnerability")])
    placed = salted_join(plain, known.select("scan_id", "_own", "created_at"), ["scan_id"], ["artefact_id"])
    merged = placed.groupBy("_own", *SAME_ASSET).agg(
        F.max(F.struct("created_at", "scan_id", "artefact_id", "name", "algorithm_class", "quantum_vulnerability")).alias("newest"), F.max("shelf_life_x").alias("shelf_life_x"), F.max("migration_time_y").alias("migration_time_y"), F.max("_rank").alias("_rank"),
        F.count_distinct(F.coalesce("line_number", F.lit(-1))).alias("occurrences"), F.count_distinct("system_name").alias("systems"),
    )
    horizon = known.groupBy("_own").agg(F.coalesce(F.min("mosca_global_z"), F.lit(DEFAULT_HORIZON)).alias("threat_timeline_z"))
    at = salted_join(merged, horizon, ["_own"], ["location"])
    criticality = F.get(F.array(*map(F.lit, CRITICALITY)), F.col("_rank").cast("int") - 1).alias("business_criticality")
    owner = F.when(F.col("_own") != "", F.expr("substring(_own, 2)")).alias("installation_id")
    return verdicts(at.select(owner, *SAME_ASSET, "newest.name", "newest.algorithm_class", "newest.quantum_vulnerability", criticality, "occurrences", "systems", "shelf_life_x", "migration_time_y", "threat_timeline_z"), today)


def recalculated(rows: DataFrame, today: str, horizon: float, retention: float | None = None) -> DataFrame:
    """The register's rows assessed at `horizon` years; the rows themselves are not changed.

    With `retention` years X becomes that, but for assets whose use is authenticity or integrity: their X doesn't follow
    how long data are kept. A horizon outside 0.5 to 30 is an error.
    """
    if not LEAST_HORIZON <= horizon <= MOST_HORIZON:
        raise ValueError(f"the horizon must be between {LEAST_HORIZON} and {MOST_HORIZON} years")
    x = F.col("shelf_life_x")
    if retention is not None:
        bound = F.coalesce(F.trim("crypto_usage").isin("authenticity", "integrity"), F.lit(False))
        x = F.when(bound, x).otherwise(F.lit(float(retention)))
    return verdicts(rows.withColumns({"shelf_life_x": x, "threat_timeline_z": F.lit(float(horizon))}), today)


def combined_walks(walks: DataFrame, scans: DataFrame) -> DataFrame:
    """What the walks of an installation's scans saw together: sums, whether any hit a limit, the last end.

    last_skipped_type is that of the newest scan which states one, of equals the larger scan id's. Nulls add nothing; repeated rows count once; scans without a
    walk count in scans only, walks of unknown scans not at all.
    """
    counted, limits = ["files_seen", "files_scanned", "files_skipped_size", "files_skipped_type", "dirs_pruned"], ["hit_file_limit", "hit_depth_limit"]
    walked = walks.select("scan_id", *counted, *limits, "finished_at", F.lit(True).alias("_walked")).dropDuplicates(["scan_id"])
    seen = _scans(scans).select("scan_id", "_own", "created_at").join(walked, "scan_id", "left")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counted]
    stated = F.when(F.col("files_skipped_type").isNotNull(), F.struct("created_at", "scan_id", "files_skipped_type"))
    out = seen.groupBy("_own").agg(
        F.count("*").alias("scans"), F.count("_walked").alias("walks"), *sums, *[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in limits], F.max("finished_at").alias("finished_at"), F.max(stated).getField("files_skipped_type").alias("last_skipped_type"),
    )
    return out.select(F.when(F.col("_own") != "", F.expr("substring(_own, 2)")).alias("installation_id"), *out.columns[1:])
