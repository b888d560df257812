"""Totals and distributions of the catalogue's normal rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the label of files without extension.
NO_EXT = "未知"
SIDE_STEP, SIDE_BUCKETS = 200, 40


def normal(files: DataFrame) -> DataFrame:
    return files.where(F.col("status") == "normal")


def library_stats(files: DataFrame) -> DataFrame:
    """total, bytes and last_scan_at; one row, of zeros, for an empty catalogue."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return normal(files).agg(F.count("*").alias("total"), zero(F.sum("size")).alias("bytes"), zero(F.max("scanned_at")).alias("last_scan_at"))


def format_stats(files: DataFrame) -> DataFrame:
    """Files per extension as stored; the label of none may also be an extension's, then both have a row."""
    return normal(files).groupBy(F.col("ext").alias("_ext")).agg(F.count("*").alias("n")).select(F.coalesce("_ext", F.lit(NO_EXT)).alias("ext"), "n")


def _dense(spark_df: DataFrame, bucket: Column, edges: list[int]) -> DataFrame:
    """bucket, lo, hi, n for every bucket, empty ones too; buckets outside are dropped."""
    counted = spark_df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    frame = spark_df.sparkSession.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))], "bucket bigint, lo bigint, hi bigint")
    return frame.join(counted, "bucket", "left").select("bucket", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def _doubling(value: Column, first: int, buckets: int) -> Column:
    """Bucket i holds values below 2^(first + i + 1); the last is open."""
    out = F.lit(buckets - 1)
    for i in reversed(range(buckets - 1)):
        out = F.when(value < 2 ** (first + i + 1), i).otherwise(out)
    return out.cast("bigint")


def short_side_histogram(files: DataFrame) -> DataFrame:
    rows = normal(files).where("short_side IS NOT NULL")
    bucket = F.when(F.col("short_side") >= SIDE_STEP * (SIDE_BUCKETS - 1), SIDE_BUCKETS - 1).otherwise(F.call_function("div", F.col("short_side"), F.lit(SIDE_STEP)))
    return _dense(rows, bucket.cast("bigint"), [i * SIDE_STEP for i in range(SIDE_BUCKETS + 1)])


def size_histogram(files: DataFrame) -> DataFrame:
    return _dense(normal(files).where("size IS NOT NULL"), _doubling(F.col("size"), 10, 20), [2 ** (10 + i) for i in range(21)])


def pixel_histogram(files: DataFrame) -> DataFrame:
    rows = normal(files).where("width IS NOT NULL AND height IS NOT NULL")
    return _dense(rows, _doubling(F.col("width") * F.col("height"), 12, 18), [2 ** (12 + i) for i in range(19)])


def wide(histogram: DataFrame) -> DataFrame:
    """A histogram as one row: edges, buckets and the greatest count."""
    rows = F.array_sort(F.collect_list(F.struct("bucket", "lo", "hi", "n")))
    return histogram.agg(rows.alias("b")).select(F.concat(F.col("b.lo"), F.array(F.element_at("b.hi", -1))).alias("edges"), F.col("b.n").alias("buckets"), F.array_max("b.n").alias("max"))
