"""Helpers that keep plans safe when one key holds a large part of the rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ways in which the rows of one key are spread when a dimension is joined without a broadcast.
SALTS = 8


def salted_join(facts: DataFrame, dim: DataFrame, keys: list[str], by: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Joins facts to a dimension with unique keys; the rows of a hot key go to `salts` tasks by the hash of the columns `by`.

    Spark still broadcasts the dimension where its measured size is below
    spark.sql.autoBroadcastJoinThreshold; beyond it both sides are shuffled by (keys, salt),
    with the dimension's rows repeated once for each salt. Null keys match nothing.
    """
    spread = F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")
    wide = dim.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return facts.withColumn("_salt", spread).join(wide, [*keys, "_salt"], how).drop("_salt")


def previous_in_series(df: DataFrame, series: list[str], when: Column, tie: str, take: list[str], prefix: str = "prev_") -> DataFrame:
    """Adds, for each row, the columns `take` of the row before it in its series as prev_...

    Rows are ordered by (when, tie). A long series is cut into calendar months of `when`: the lag
    runs within a month, and the first row of a month takes the last row of the series' month
    before. So no task sorts more than a month of a series, plus one row for each month.
    Rows whose `when` is null come first, in a month of their own. Nulls in `series` equal nulls.
    """
    month = F.coalesce(F.date_format(when, "yyyy-MM"), F.lit(""))
    rows = df.withColumn("_when", when).withColumn("_month", month)
    order = [F.col("_when").asc_nulls_first(), F.col(tie).asc_nulls_first()]
    within = Window.partitionBy(*series, "_month").orderBy(*order)
    packed = F.struct(*[F.col(c) for c in take])
    lagged = rows.withColumn("_row", packed).withColumn("_before", F.lag("_row").over(within))
    lasts = rows.groupBy(*series, "_month").agg(F.max_by(packed, F.struct(F.col("_when"), F.col(tie))).alias("_last"))
    across = Window.partitionBy(*series).orderBy("_month")
    edges = lasts.withColumn("_edge", F.lag("_last").over(across)).drop("_last")
    on = [lagged[c].eqNullSafe(edges[c]) for c in [*series, "_month"]]
    joined = lagged.join(edges, on, "left").select(lagged["*"], edges["_edge"])
    before = F.coalesce(F.col("_before"), F.col("_edge"))
    return joined.select(*[F.col(c) for c in df.columns], *[before[c].alias(prefix + c) for c in take])


def spread(df: DataFrame) -> DataFrame:
    """Rows moved to all cores where a scan has splits for less than half of them, as with one small file.

    A larger input has more splits than that and stays where it is read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the one that spark.checkpoint.dir names, which all executors share; in local mode (tests) one of its own where none is set."""
    return f"{_checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def _checkpoint_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder that spark.checkpoint.dir names."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()
