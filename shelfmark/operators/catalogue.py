"""Incremental upkeep of the catalogue: difference, upsert, updates, deletes. Tables are snapshots; each operator returns a new one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.scalars import short_side, status_or_normal

#: What a scan knows anew of a file; all else is cleared when the file has changed.
SCANNED = ("root", "size", "mtime", "ext", "format", "width", "height", "pid", "artist")
CLEARED = ("content_hash", "phash", "gray_score", "decode_error", "fingerprinted_at")


def scan_difference(scanned: DataFrame, known: DataFrame) -> DataFrame:
    """scanned with `change`: inserted, updated, skipped, or failed where size or mtime couldn't be read.

    Unchanged means the same size and mtime, whatever the status. A path scanned twice, as from
    overlapping roots, must be made one before. known: path, id, size, mtime.
    """
    k = known.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.lit(True).alias("_known"))
    change = (
        F.when(F.col("size").isNull() | F.col("mtime").isNull(), "failed")
        .when(F.col("_known").isNull(), "inserted")
        .when((F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime")), "skipped")
        .otherwise("updated")
    )
    return scanned.join(k, "path", "left").withColumn("change", change).select(*scanned.columns, "change")


def scan_stats(difference: DataFrame, cancelled: bool = False) -> DataFrame:
    """seen, inserted, updated, skipped, failed, and whether the scan was broken off, in one row."""
    return difference.agg(F.count("*").alias("seen"), *(F.count_if(F.col("change") == c).alias(c) for c in ("inserted", "updated", "skipped", "failed"))).withColumn("cancelled", F.lit(cancelled))


def hash_stats(candidates: DataFrame, hashed: DataFrame) -> DataFrame:
    """groups (sizes that several files share), hashed and failed of one hashing run.

    candidates: rows of size_candidates(). hashed: content_hash of each file that was read, null
    where it couldn't be.
    """
    groups = candidates.agg(F.count_distinct("size").alias("groups"))
    done = hashed.agg(F.count("content_hash").alias("hashed"), F.count_if(F.col("content_hash").isNull()).alias("failed"))
    # two rows of totals
    return groups.join(F.broadcast(done))


def visual_stats(prints: DataFrame, before: DataFrame) -> DataFrame:
    """total, done, failed of one fingerprinting run (rows with phash or decode_error), and skipped: the catalogue's rows that have a fingerprint after it.

    before: the catalogue as the run found it.
    """
    run = prints.agg(F.count("*").alias("total"), F.count("phash").alias("done"), F.count_if(F.col("phash").isNull()).alias("failed"))
    return run.join(F.broadcast(visual_done(before))).select("total", "done", "failed", (F.col("n") + F.col("done")).alias("skipped"))


def upsert(catalogue: DataFrame, scanned: DataFrame, now: int, keep_decode_error: bool = False) -> DataFrame:
    """The catalogue after a scan: new paths added, changed ones renewed, all others as they were.

    A changed file loses its hash, fingerprint, grayness and, unless keep_decode_error, its new error
    too, and is normal again; a new one keeps what the scan found, an empty status is normal. Ids of
    known paths stay; new rows take the scan's id. One outer join by path.
    """
    difference = scan_difference(scanned, catalogue.select("path", "id", "size", "mtime")).where(F.col("change").isin("inserted", "updated"))
    new = difference.select("path", *(F.col(c).alias(f"n_{c}") for c in catalogue.columns if c != "path"), F.col("change"))
    old = catalogue.select("path", *(F.col(c).alias(f"o_{c}") for c in catalogue.columns if c != "path"))
    j = old.join(new, "path", "full_outer")
    fresh, changed = F.col("change") == "inserted", F.col("change") == "updated"
    value = {
        "id": F.coalesce("o_id", "n_id"),
        "short_side": F.when(fresh | changed, short_side(F.col("n_width"), F.col("n_height"))).otherwise(F.col("o_short_side")),
        "scanned_at": F.when(fresh | changed, F.lit(now).cast("bigint")).otherwise(F.col("o_scanned_at")),
        "status": F.when(changed, "normal").when(fresh, status_or_normal(F.col("n_status"))).otherwise(F.col("o_status")),
    }
    for c in SCANNED:
        value[c] = F.when(fresh | changed, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}"))
    for c in CLEARED:
        value[c] = F.when(fresh, F.col(f"n_{c}")).when(changed, F.col("n_decode_error") if keep_decode_error and c == "decode_error" else None).otherwise(F.col(f"o_{c}"))
    return j.select(*(F.col("path") if c == "path" else value[c].alias(c) for c in catalogue.columns))


def update_columns(catalogue: DataFrame, updates: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """The catalogue with columns replaced where updates has the key; a null there is a value. Keys of updates must be unique."""
    u = updates.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in columns))
    j = catalogue.join(u, catalogue[key] == u["_key"], "left")
    return j.select(*(F.when(F.col("_key").isNotNull(), F.col(f"_{c}")).otherwise(catalogue[c]).alias(c) if c in columns else catalogue[c] for c in catalogue.columns))


def set_fingerprints(catalogue: DataFrame, prints: DataFrame, now: int) -> DataFrame:
    """phash, gray_score or decode_error of fingerprinted rows (id, phash, gray_score, decode_error)."""
    return update_columns(catalogue, prints.withColumn("fingerprinted_at", F.when(F.col("phash").isNotNull(), F.lit(now).cast("bigint"))), ["phash", "gray_score", "decode_error", "fingerprinted_at"])


def set_status(catalogue: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    return update_columns(catalogue, ids.select("id", F.lit(status).alias("status")).distinct(), ["status"])


def delete_rows(table: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The table without the rows whose column is among the keys."""
    return table.join(keys.select(column).distinct(), column, "left_anti").select(*table.columns)


def replace_rows(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Append; rows with a known key replace the old ones, and of rows with one key the greatest counts."""
    rest = [c for c in table.columns if c not in key]
    rows = rows.groupBy(*key).agg(F.max(F.struct(*rest)).alias("_r")).select(*key, "_r.*") if rest else rows.select(*key).distinct()
    kept = table.join(rows.select(*key).distinct(), key, "left_anti").select(*table.columns)
    return kept.unionByName(rows.select(*table.columns))


def visual_done(catalogue: DataFrame) -> DataFrame:
    """Rows with a fingerprint, of any status."""
    return catalogue.agg(F.count("phash").alias("n"))


def work_stats(catalogue: DataFrame) -> DataFrame:
    """Where hashing and fingerprinting stand among the normal rows."""
    normal = F.col("status") == "normal"
    return catalogue.agg(
        F.count_if(normal).alias("total"), F.count_if(normal & F.col("phash").isNotNull()).alias("done"), F.count_if(normal & F.col("phash").isNull() & F.col("decode_error").isNotNull()).alias("failed"),
        F.count_if(normal & F.col("phash").isNull() & F.col("decode_error").isNull()).alias("waiting"), F.count_if(normal & F.col("content_hash").isNotNull()).alias("hashed"),
    )
