"""Session helpers: the shared folder, written intermediate tables, partition counts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only where that setting is missing and the session runs on one machine, as in tests, a
    temporary folder is made and kept in the session; on a cluster a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("shelfmark.shared.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shelfmark-")
        spark.conf.set("shelfmark.shared.dir", folder)
    return folder.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table_state(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """(files, bytes, newest change) of a table's folder or file: what changes when the table does."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return len(found), sum(f.getLen() for f in found), max((f.getModificationTime() for f in found), default=0)


class Written:
    """A table written once to the shared folder: its lineage is one file scan, so a lost executor costs nothing."""

    def __init__(self, df: DataFrame, tag: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{tag}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        _written.append((self.spark, self.path))
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def rows(self) -> int:
        return self.df.count()

    def drop(self) -> None:
        """Delete the table; nothing may read it afterwards."""
        delete_path(self.spark, self.path)
        _written.remove((self.spark, self.path))


@atexit.register
def _sweep() -> None:
    """Delete what is left of written tables; a table that can't be deleted, as without its session, doesn't keep the others."""
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is None:
                shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
            else:
                delete_path(spark, path)
        except Exception:  # noqa: BLE001, S112
            continue


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("shelfmark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application; they needn't have it on their path."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="shelfmark-code-"), "shelfmark_code"), "zip", os.path.dirname(here), os.path.basename(here))
        spark.sparkContext.addPyFile(made)
        _shipped.add(app)
