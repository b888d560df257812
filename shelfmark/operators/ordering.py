"""Global numbering and running totals without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.runtime import Written, shuffle_partitions


def _ranged(df: DataFrame, order: list[Column], columns: list[str], value: Column, total: str) -> DataFrame:
    """df with column `total`: the inclusive running sum of value in the global order.

    Rows are range partitioned by the order, each partition sums on its own, and the sums of the
    partitions before it, one number per partition, are added. The order must tell all rows apart.
    """
    n = shuffle_partitions(df.sparkSession)
    placed = Written(df.withColumn("_value", value).repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ordered").df
    sums = {r["_part"]: r["s"] or 0 for r in placed.groupBy("_part").agg(F.sum("_value").alias("s")).collect()}
    before, at = {}, 0
    for part in range(n):
        before[part] = at
        at += sums.get(part, 0)
    # one row per partition
    offsets = df.sparkSession.createDataFrame([(p, int(x)) for p, x in before.items()], "_part int, _offset bigint")
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn(total, F.sum("_value").over(w)).join(F.broadcast(offsets), "_part").withColumn(total, F.col(total) + F.col("_offset")).select(*columns, total)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its place from 1 in the global order."""
    return _ranged(df, order, df.columns, F.lit(1).cast("bigint"), name)


def running_total(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """df with the running sum of a column up to and with each row; null counts 0."""
    return _ranged(df, order, df.columns, F.coalesce(F.col(value), F.lit(0)).cast("bigint"), name)


def at_rank(df: DataFrame, group: str, value: str, tie: str, places: Column) -> DataFrame:
    """The rows of each group at the given places: `places` is an array of places from 0, an expression over n, the group's size.

    Null groups are a group; null values are left out. A group of any size is spread over tasks:
    a place within a group is the global place less the group's first.
    """
    rows = df.where(F.col(value).isNotNull()).select(group, value, tie)
    global_ = numbered(rows, [F.col(group).asc_nulls_first(), F.col(value).asc(), F.col(tie).asc()], "_n")
    sizes = global_.groupBy(group).agg(F.min("_n").alias("_first"), F.count("*").alias("n"))
    wanted = sizes.select(F.col(group).alias("_group"), "n", "_first", F.explode(places).alias("place"))
    return global_.join(wanted, F.col("_n") == F.col("_first") + F.col("place")).select(group, "n", "place", value)


def nearest_rank(df: DataFrame, group: str, value: str, tie: str, percent: int) -> DataFrame:
    """group, n and the nearest-rank percentile of value, halves of a place rounded up."""
    place = F.array(F.floor(F.lit(percent) * (F.col("n") - 1) / 100 + 0.5))
    return at_rank(df, group, value, tie, place).select(group, "n", F.col(value).alias(f"p{percent}"))


def median(df: DataFrame, group: str, value: str, tie: str) -> DataFrame:
    """group, n and the median of value: the middle one, or the mean of the two in the middle."""
    places = F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))
    return at_rank(df, group, value, tie, places).groupBy(group, "n").agg(F.avg(value).alias("median"))
