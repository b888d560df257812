"""Schemas of the catalogue's tables and the normal forms of their columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.runtime import ship

FILES = (
    "id bigint, path string, root string, size bigint, mtime bigint, ext string, format string, width bigint, "
    "height bigint, short_side bigint, pid bigint, artist string, content_hash string, phash string, "
    "gray_score double, decode_error string, scanned_at bigint, fingerprinted_at bigint, status string"
)
DUP_GROUPS = "id bigint, kind string, keep_file_id bigint, created_at bigint"
DUP_MEMBERS = "group_id bigint, file_id bigint, distance bigint"
QUARANTINE = (
    "id bigint, file_id bigint, original_path string, moved_path string, batch_id string, moved_at bigint, restored_at bigint"
)
DELETE_LOG = "id bigint, path string, size bigint, purged_at bigint, batch_id string"

SCHEMAS = {"files": FILES, "dup_groups": DUP_GROUPS, "dup_members": DUP_MEMBERS, "quarantine": QUARANTINE, "delete_log": DELETE_LOG}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    return reader.parquet(f"{folder}/{name}.parquet")


def current_files(files: DataFrame, columns: Sequence[str] | dict[str, Column]) -> DataFrame:
    """The current row of every id: the one with the greatest scanned_at, null counting as the least.

    columns: names, or expressions by name, that the result has beside id. Rows without an id are
    no files and are left out. Equal scanned_at with unequal columns: the greatest columns win,
    compared in the order given, so that the result doesn't depend on the order of rows.
    One shuffle by id; only the columns asked for travel, after a partial maximum per task.
    """
    exprs = {c: F.col(c) for c in columns} if not isinstance(columns, dict) else columns
    stamp = F.coalesce(F.col("scanned_at"), F.lit(-(2**63)).cast("bigint"))
    rows = files.where(F.col("id").isNotNull()).select("id", F.struct(stamp.alias("_at"), *(e.alias(c) for c, e in exprs.items())).alias("_row"))
    return rows.groupBy("id").agg(F.max("_row").alias("_row")).select("id", *(F.col("_row")[c].alias(c) for c in exprs))


def phash_bits(phash: Column) -> Column:
    """The fingerprint as a signed 64-bit number, null if it isn't usable.

    Case, blanks, hyphens and a 0x prefix don't count; exactly 16 hex digits must remain and the
    value may not be 0.
    """
    x = F.regexp_replace(F.lower(phash), r"[\s\p{Z}\-]+", "")
    x = F.when(F.length(x) == 18, F.regexp_replace(x, "^0x", "")).otherwise(x)
    bits = F.conv(F.when(x.rlike("^[0-9a-f]{16}$"), x), 16, -10).cast("bigint")
    return F.when(bits != 0, bits)


def valid_hash(content_hash: Column) -> Column:
    """The content hash in lower case, null if it isn't 64 hex digits without surrounding blanks."""
    x = F.lower(F.regexp_replace(content_hash, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(x.rlike("^[0-9a-f]{64}$"), x)


def seconds(t: Column) -> Column:
    """Epoch seconds of a time that is in milliseconds if it is 10^11 or more."""
    return F.when(t >= 10**11, F.call_function("div", t, F.lit(1000))).otherwise(t)
