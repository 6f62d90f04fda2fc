"""Streams: documents that arrive in a folder, and event trends with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hierarchy import latest


def follow(spark: SparkSession, folder: str, schema, files: int = 100) -> DataFrame:
    """Rows of the parquet files that arrive in a folder, at most ``files`` files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def daily_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", late: str = "2 days") -> DataFrame:
    """Counts by day and key; rows later than ``late`` behind the newest one are dropped with their window's state."""
    windowed = events.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), F.col(key))
    return windowed.agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), key, "n")


def distinct_rows(rows: DataFrame, key: str, ts: str, late: str = "2 days") -> DataFrame:
    """Each key once, resent rows within the watermark dropped."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


#: Folders among which the keys of an upserted table are spread.
UPSERT_BUCKETS = 64


def upsert(target: str, keys: list[str], order: str, buckets: int = UPSERT_BUCKETS) -> Callable[[DataFrame, int], None]:
    """A batch function that keeps the latest row of each key in a table that :func:`upserted` reads.

    A batch only rewrites the buckets that hold its keys, each as a new version.  A batch
    that is repeated after a failure starts from the versions before it.  Whether there is
    a table is asked of the file system, so no failed read passes for an empty table.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        placed = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        merged = placed
        if _exists(spark, target):
            before = upserted(spark, target, below=batch_id, keep_bucket=True)
            touched = F.broadcast(placed.select("bucket").distinct())  # at most ``buckets`` rows
            merged = before.join(touched, "bucket", "left_semi").select(*placed.columns).unionByName(placed)
        newest = latest(merged, [*keys, "bucket"], order).withColumn("version", F.lit(batch_id))
        newest.repartition("bucket").write.partitionBy("bucket", "version").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(target)

    return write


def upserted(spark: SparkSession, target: str, below: int | None = None, keep_bucket: bool = False) -> DataFrame:
    """The rows of an upserted table: the newest version of each bucket, or the newest before version ``below``."""
    rows = spark.read.parquet(target)
    if below is not None:
        rows = rows.where(F.col("version") < below)
    newest = rows.select("bucket", "version").distinct().groupBy("bucket").agg(F.max("version").alias("version"))
    found = rows.join(F.broadcast(newest), ["bucket", "version"])  # one row a bucket
    return found.drop("version") if keep_bucket else found.drop("version", "bucket")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def run_available(df: DataFrame, target: str, checkpoint: str, mode: str = "append"):
    """Work off what is there and stop."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.format("parquet").option("path", target).start()
