"""Scans that arrive as a stream of files, kept up to date as snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfmark.operators.catalogue import scan_difference, scan_stats, upsert
from shelfmark.runtime import ship
from shelfmark.tables import FILES


def latest_per_path(scanned: DataFrame) -> DataFrame:
    """One row per path, that of the greatest scanned_at; of equals the greatest row."""
    cols = [c for c in scanned.columns if c not in ("path", "scanned_at")]
    key = F.struct(F.coalesce("scanned_at", F.lit(-(2**63)).cast("bigint")).alias("_at"), F.struct("scanned_at", *cols).alias("_row"))
    return scanned.where("path IS NOT NULL").groupBy("path").agg(F.max(key)["_row"].alias("_r")).select("path", "_r.*").select(*scanned.columns)


def follow_scans(spark: SparkSession, arrivals: str, snapshots: str, checkpoint: str) -> StreamingQuery:
    """Upsert each batch of scan files that arrives in a folder into the newest snapshot below `snapshots`.

    Each batch writes snapshot `epoch=<n>` from the newest earlier one, so a batch that is repeated
    after a failure writes the same snapshot again. Its counts go to `stats/epoch=<n>`.
    """
    ship(spark)
    stream = spark.readStream.schema(FILES).parquet(arrivals)

    def step(batch: DataFrame, epoch: int) -> None:
        own = batch.sparkSession
        before = newest_snapshot(own, snapshots, epoch)
        scanned = latest_per_path(batch)
        at = scanned.agg(F.max("scanned_at")).head()[0] or 0
        scan_stats(scan_difference(scanned, before)).write.mode("overwrite").parquet(f"{snapshots}/stats/epoch={epoch}")
        upsert(before, scanned, at).write.mode("overwrite").parquet(f"{snapshots}/epoch={epoch}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step).trigger(availableNow=True).start()


def newest_snapshot(spark: SparkSession, snapshots: str, before: int = 2**31) -> DataFrame:
    """The catalogue as of the newest snapshot below an epoch; empty if there is none."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(snapshots)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    epochs = [int(s.getPath().getName()[6:]) for s in fs.listStatus(folder) if s.getPath().getName().startswith("epoch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))] if fs.exists(folder) else []
    epochs = [e for e in epochs if e < before]
    if not epochs:
        return spark.createDataFrame([], FILES)
    return spark.read.schema(FILES).parquet(f"{snapshots}/epoch={max(epochs)}")
