"""What changed between consecutive full snapshots.

EXCEPT ALL both ways removes the rows that two consecutive snapshots share; the residues are then
full-joined by key, and each key is labelled added, removed or changed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherledger.functions.scale import previous_in_series, salted_join
from cipherledger.functions.text import day_only, slashed, trimmed


@dataclass(frozen=True)
class Compared:
    """Columns that decide whether a record changed, by the way in which they are compared."""

    texts: Sequence[str] = ()
    paths: Sequence[str] = ()
    dates: Sequence[str] = ()
    exact: Sequence[str] = ()
    numbers: Sequence[str] = ()  #: equal when they differ by less than `tolerance`
    tolerance: float = 1e-6

    def packed(self) -> list[Column]:
        """What must be equal, in one notation, as a hash of 128 bits (_h1, _h2), and the numbers as they are.

        Null and blank are one for texts, paths and dates, and a value of its own for the exact columns.
        """
        same = [
            *[trimmed(F.col(c)) for c in self.texts],
            *[slashed(trimmed(F.col(c))) for c in self.paths],
            *[day_only(trimmed(F.col(c))) for c in self.dates],
            *[x for c in self.exact for x in (F.col(c).isNull(), F.col(c))],
        ]
        return [F.xxhash64(F.lit(1), *same).alias("_h1"), F.xxhash64(F.lit(2), *same).alias("_h2"), F.struct(F.lit(0), *[F.col(c).cast("double").alias(c) for c in self.numbers]).alias("_n")]

    def differs(self, a: str, b: str) -> Column:
        """Whether two records (structs of the packed columns) differ; null equals null."""
        far = (F.col(f"{a}._h1") != F.col(f"{b}._h1")) | (F.col(f"{a}._h2") != F.col(f"{b}._h2"))
        for c in self.numbers:
            x, y = F.col(f"{a}._n.{c}"), F.col(f"{b}._n.{c}")
            far = far | ~(x.eqNullSafe(y) | F.coalesce(F.abs(x - y) < self.tolerance, F.lit(False)))
        return far


def consecutive_scans(scans: DataFrame) -> DataFrame:
    """scan_id, prev_scan_id: each scan and the scan before it in its series; null for a series' first.

    A series is (installation_id, target_name), null being a value of its own; order is created_at,
    then scan_id. Repeated rows count once. Scans without a scan_id are left out.
    """
    once = scans.filter(F.col("scan_id").isNotNull()).groupBy("scan_id").agg(F.min(F.struct("created_at", "installation_id", "target_name")).alias("s")).select("scan_id", "s.*")
    return previous_in_series(once, ["installation_id", "target_name"], F.col("created_at"), "scan_id", ["scan_id"]).select("scan_id", "prev_scan_id")


def last_delivery(rows: DataFrame) -> DataFrame:
    """scan_id, delivery_no: each scan's highest delivery_no; a later delivery replaces an earlier one whole."""
    return rows.groupBy("scan_id").agg(F.max("delivery_no").alias("delivery_no"))


def snapshot_changes(rows: DataFrame, scans: DataFrame, key: str, compared: Compared) -> DataFrame:
    """scan_id, key, change_kind for each record added, removed or changed since the scan before.

    rows: scan_id, delivery_no, delivered_at, `key` and the compared columns; other columns are not
    read. scans: scan_id, installation_id, target_name, created_at. Keys compare without case and
    outer blanks; rows with a null or blank key are not records and are left out. A repeated row
    counts once; if one delivery holds a key twice with different values, the later delivered_at
    holds, then the row with the larger hash. A scan without rows is an empty snapshot. Rows of scans that
    `scans` lacks belong to no series and yield nothing. Empty tables yield no rows.
    """
    pairs = consecutive_scans(scans)
    sides = pairs.filter("prev_scan_id is not null")
    # later: the scan that a row is compared in, once as the new state and once as the old one
    roles = sides.select("scan_id", F.col("scan_id").alias("later"), F.lit(1).alias("side")).unionByName(sides.select(F.col("prev_scan_id").alias("scan_id"), F.col("scan_id").alias("later"), F.lit(-1).alias("side")))
    roles = roles.groupBy("scan_id").agg(F.collect_list(F.struct("later", "side")).alias("roles"))  # two at most

    # from here on a row is its key and 128 bits of hash with the numbers, however wide it was
    records = rows.select("scan_id", "delivery_no", "delivered_at", F.lower(trimmed(F.col(key))).alias("key"), *compared.packed()).filter(F.col("key") != "")
    row = F.struct("_h1", "_h2", "_n")
    never = F.lit("0001-01-01").cast(rows.schema["delivered_at"].dataType)
    newest = F.max(F.struct("delivery_no", F.coalesce("delivered_at", never).alias("at"), row.alias("row"))).alias("m")
    once = records.filter("delivery_no is not null").groupBy("scan_id", "key").agg(newest).select("scan_id", "key", "m.delivery_no", "m.row")
    # a key that the last delivery lacks is gone with the delivery that it replaced
    held = salted_join(once, last_delivery(rows).join(roles, "scan_id"), ["scan_id", "delivery_no"], ["key"])
    sided = held.select(F.explode("roles").alias("_role"), "key", "row").select("_role.*", "key", "row")

    # EXCEPT ALL in both directions in one pass: identical rows of the two sides cancel
    residue = sided.repartition("later", "key").groupBy("later", "key", "row").agg(F.sum("side").alias("side")).filter("side <> 0")
    new = residue.filter("side > 0").select("later", "key", F.col("row").alias("new"))
    old = residue.filter("side < 0").select("later", "key", F.col("row").alias("old"))
    both = new.join(old, ["later", "key"], "full")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(compared.differs("new", "old"), "changed")
    return both.select(F.col("later").alias("scan_id"), F.col("key").alias(key), kind.alias("change_kind")).filter("change_kind is not null")
