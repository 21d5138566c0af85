"""Evidence and register rows as streams: windowed counts with late data, and upserts by scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cipherledger.functions.scale import shared_folder

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Folders of a register.
BUCKETS = 64


def evidence_stream(spark: SparkSession, path: str) -> DataFrame:
    """A parquet folder or file of evidence as a stream; files that arrive later are read later."""
    table = spark.read.parquet(path)
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(table.schema)
    if any(f.rpartition("/")[2] == name for f in table.inputFiles()[:1]):  # one file: a stream reads its folder, by name
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def windowed_counts(evidence: DataFrame, window: str = "7 days", lateness: str = "30 days") -> DataFrame:
    """window_start, raw_type, n: evidence by window of recorded_at; works on streams and tables alike.

    Repeated ids within `lateness` count once on a stream, at all on a table; on a stream rows later than
    that are dropped. Rows without a time or id are left out.
    """
    rows = evidence.filter("recorded_at is not null and id is not null").select("id", "raw_type", F.col("recorded_at").cast("timestamp").alias("at"))
    once = rows.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["id"]) if rows.isStreaming else rows.dropDuplicates(["id"])
    return once.groupBy(F.window("at", window), "raw_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "raw_type", "n")


def run_to_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and returns its result, kept in the shared checkpoint folder.

    In complete mode every batch replaces the result; in append mode batches are added. State is kept on disk,
    as the ids that are remembered grow with the input.
    """
    spark = stream.sparkSession
    at = shared_folder(spark)
    how = "overwrite" if mode == "complete" else "append"
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ON_DISK)
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").foreachBatch(lambda batch, _: batch.write.mode(how).parquet(f"{at}/result")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(STATE_STORE, before)
    return spark.read.schema(stream.schema).parquet(f"{at}/result")


def register_upserts(rows: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keeps a register up to date from a stream of register rows.

    A batch replaces whole scans: of those it delivers, the rows of the highest delivery_no, if it is not
    below the one that is kept. Other scans keep their rows. Rows that a batch adds to the delivery
    already kept are merged with it; repeated rows count once.

    Scans lie in `buckets` folders by the hash of scan_id, so a register has no more folders and files than
    that, however many scans it holds. A batch rewrites the buckets of its scans (dynamic partition overwrite);
    a register keeps the number of buckets that it began with, any other is an error.
    """
    spark = rows.sparkSession
    bucket = f"bucket_of_{buckets}"

    def replace(batch: DataFrame, number: int) -> None:
        # copies of the rows that the buckets held, complete before one is replaced: a batch that broke off begins again from them
        before = f"{checkpoint}/kept/{number}"
        both = batch.filter("scan_id is not null").withColumn(bucket, F.pmod(F.xxhash64("scan_id"), F.lit(buckets)).cast("int"))
        there = _names(spark, path)
        if any(not name.startswith((f"{bucket}=", "_", ".")) for name in there):
            raise ValueError(f"the register in {path} isn't kept in {buckets} buckets")
        copied = "_SUCCESS" in _names(spark, before)
        if there and not copied:
            touched = [r[0] for r in both.select(bucket).distinct().collect()]
            spark.read.schema(both.schema).parquet(path).filter(F.col(bucket).isin(touched)).write.mode("overwrite").parquet(before)
        if there or copied:
            both = both.unionByName(spark.read.schema(both.schema).parquet(before))
        # the rows of a bucket meet in one task, which writes one file
        scan = Window.partitionBy(bucket, "scan_id").orderBy(F.col("delivery_no").desc_nulls_last(), "_id")
        last = F.first("delivery_no").over(scan.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        repeated = F.lag(F.struct("_id")).over(scan).eqNullSafe(F.struct("_id"))
        newest = both.repartition(bucket).withColumns({"_last": last, "_repeated": repeated}).filter("delivery_no = _last and not _repeated")
        newest.select(*both.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(bucket).parquet(path)
        for copies in (f"{before}/_SUCCESS", before):  # no longer whole, as soon as one is missing
            _remove(spark, copies)

    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(replace).trigger(availableNow=True).start()


def _names(spark: SparkSession, path: str) -> list[str]:
    """Files and folders in a folder, none where it is missing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
