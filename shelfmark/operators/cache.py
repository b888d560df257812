"""Eviction of a file cache by a running total."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.ordering import running_total


def cache_size(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def evicted(manifest: DataFrame, limit: int) -> DataFrame:
    """name, size of the entries to delete, oldest first by (mtime, name), until a tenth-wise 80 % of limit is reached.

    manifest: name, mtime, size. Nothing goes if limit is 0 or the total is within it. An entry goes
    if what is left before it is above the target; null sizes count 0, null mtimes are oldest.
    """
    total = manifest.agg(F.sum("size").alias("t")).head()["t"] or 0
    if limit == 0 or total <= limit:
        return manifest.select("name", "size").limit(0)
    target = limit // 10 * 8
    summed = running_total(manifest.select("name", "mtime", "size"), [F.col("mtime").asc_nulls_first(), F.col("name").asc()], "size", "through")
    return summed.where(F.lit(total) - (F.col("through") - F.coalesce("size", F.lit(0))) > target).select("name", "size")


def trim_report(manifest: DataFrame, limit: int) -> DataFrame:
    """removed, freed, remaining of an eviction in which every delete succeeds."""
    gone = evicted(manifest, limit).agg(F.count("*").alias("removed"), F.coalesce(F.sum("size"), F.lit(0)).alias("freed"))
    # two rows of totals
    return gone.crossJoin(F.broadcast(cache_size(manifest))).select("removed", "freed", (F.col("bytes") - F.col("freed")).alias("remaining"))


def missing_thumbs(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """id and name of the normal files whose thumbnail the cache lacks."""
    wanted = files.where("status = 'normal'").select("id", F.concat_ws("_", "id", "mtime").alias("k")).select("id", F.concat("k", F.lit(".jpg")).alias("name"))
    return wanted.join(manifest.select("name"), "name", "left_anti").select("id", "name")
