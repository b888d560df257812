"""Tables kept as snapshots in a folder: each write is a new version, readers take the newest whole one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.runtime import delete_path, shuffle_partitions
from shelfmark.tables import SCHEMAS


class Store:
    """Named tables below one folder. A version counts once it is written to the end; the one before it stays for readers that have begun, older ones are deleted."""

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home = spark, home.rstrip("/")

    def versions(self, name: str) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.home}/{name}")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        found = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("v=")]
        return sorted(int(p.getName()[2:]) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self, name: str) -> DataFrame:
        """The newest version, empty before the first."""
        have = self.versions(name)
        if not have:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.home}/{name}/v={have[-1]}")

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        """A new version. Files are range partitioned by size, the order they are paged in, so that bounds on size skip row groups."""
        have = self.versions(name)
        path = f"{self.home}/{name}/v={(have[-1] if have else 0) + 1}"
        rows = rows.select(*self.spark.createDataFrame([], SCHEMAS[name]).columns)
        if name == "files":
            rows = rows.repartitionByRange(shuffle_partitions(self.spark), "size", "id").sortWithinPartitions("size", "id")
        rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
        for old in have[:-1]:
            delete_path(self.spark, f"{self.home}/{name}/v={old}")
        return self.read(name)

    def views(self) -> None:
        """The tables as views of the session."""
        for name in SCHEMAS:
            self.read(name).createOrReplaceTempView(name)
