"""The quarantine ledger: batches, move, restore, purge, and their reports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.names import base_name
from shelfmark.operators.ordering import numbered, running_total
from shelfmark.runtime import Written


def open_rows(ledger: DataFrame) -> DataFrame:
    """Ledger rows not restored; repeated rows count once."""
    return ledger.distinct().where("restored_at IS NULL")


def batches(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """batch_id, n, moved_at, bytes of every batch with open rows. Rows count whether or not files has their file; bytes only where it has."""
    rows = open_rows(ledger).join(files.select(F.col("id").alias("file_id"), "size"), "file_id", "left")
    return rows.groupBy("batch_id").agg(F.count("*").alias("n"), F.max("moved_at").alias("moved_at"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def batch_files(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """batch_id and the files of open rows, a row per ledger row."""
    rows = open_rows(ledger).select("batch_id", F.col("id").alias("row_id"), "file_id")
    return rows.join(files.withColumnRenamed("id", "file_id"), "file_id").select("batch_id", "row_id", "file_id", "path", "size")


def totals(batch_rows: DataFrame) -> DataFrame:
    return batch_rows.agg(F.count("*").alias("batches"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))


#: A stem with a number behind it, as a second file of that name gets.
_NUMBERED = r"(?s)^(.+)__([1-9]\d{0,8})$"


def _named(df: DataFrame, name: Column) -> DataFrame:
    """df with _name, _stem, _ext (with its dot) and _family: names that numbering can bring into each other's way."""
    ext = F.when(name.rlike(r"(?s)^.+\.[^.]+$"), F.concat(F.lit("."), F.regexp_extract(name, r"(?s)^.+\.([^.]+)$", 1))).otherwise("")
    out = df.withColumn("_name", name).withColumn("_stem", F.regexp_replace(name, r"(?s)^(.+)\.[^.]*$", "$1")).withColumn("_ext", ext)
    return out.withColumn("_family", F.concat(F.regexp_replace("_stem", r"(?s)^(.*?.)(?:__[1-9]\d{0,8})+$", "$1"), F.lit("/"), "_ext"))


def unique_names(moves: DataFrame, taken: DataFrame, path: str, key: str) -> DataFrame:
    """moves with `dest`: in order of key each gets its base name, or name__n.ext with the smallest n that is free by then.

    taken: column name, what lies in the folder already. Names that differ in case are different;
    repeated rows of moves are moves of their own, null paths have a null dest.

    Where all moves of a family have one name, the k-th of them gets the k-th free number, which is k
    and the number of taken ones t_i, in order, with t_i - i <= k: a running total over both, range
    partitioned, so that a name that a third of all files have is spread. Where names like x.jpg and
    x__1.jpg meet, who comes first decides what the other finds, so those families are gone through
    in order, streamed, with only the numbers in use in memory.
    """
    rows = Written(_named(moves.withColumn("_row", F.monotonically_increasing_id()), base_name(F.col(path))), "moves").df
    named = rows.where("_name IS NOT NULL")
    kinds = named.groupBy("_family").agg((F.min("_name") != F.max("_name")).alias("_mixed"))
    there = _named(taken.where("name IS NOT NULL").select("name").distinct(), F.col("name")).drop("name").join(kinds, "_family")
    own = named.join(kinds, "_family")

    plain = own.where("NOT _mixed")
    names = plain.groupBy("_family").agg(F.min("_name").alias("_own"), F.min("_stem").alias("_own_stem"))
    number = F.when(F.col("_name") == F.col("_own"), 0).when(F.regexp_extract("_stem", _NUMBERED, 1) == F.col("_own_stem"), F.regexp_extract("_stem", _NUMBERED, 2).cast("bigint"))
    used = there.where("NOT _mixed").join(names, "_family").withColumn("_t", number).where("_t IS NOT NULL AND (_t > 0 OR _name = _own)").select("_family", "_t").distinct()

    def placed(df: DataFrame, order: list[str]) -> DataFrame:
        """df with _k, its place from 0 within its family."""
        n = Written(numbered(df, [F.col("_family").asc(), *(F.col(c).asc_nulls_first() for c in order)], "_n"), "numbered").df
        return n.join(n.groupBy("_family").agg(F.min("_n").alias("_first")), "_family").withColumn("_k", F.col("_n") - F.col("_first")).drop("_n", "_first")

    free = placed(used, ["_t"]).select("_family", (F.col("_t") - F.col("_k")).alias("_at"), F.lit(0).alias("_move"), F.lit(None).cast("bigint").alias("_row"), F.lit(1).alias("_one"), F.col("_t").alias("_tie"))
    asked = placed(plain.select("_family", key, "_row"), [key, "_row"]).select("_family", F.col("_k").alias("_at"), F.lit(1).alias("_move"), "_row", F.lit(0).alias("_one"), F.col("_row").alias("_tie"))
    total = Written(running_total(free.unionByName(asked), [F.col(c).asc() for c in ("_family", "_at", "_move", "_tie")], "_one", "_through"), "slots").df
    before = total.groupBy("_family").agg(F.min(F.col("_through") - F.col("_one")).alias("_before"))
    slot = total.where("_move = 1").join(before, "_family").select("_row", (F.col("_at") + F.col("_through") - F.col("_before")).alias("_n"))

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        family, names_in_use, after = None, set(), {}
        for pdf in frames:
            out = []
            for fam, row, name, stem, ext in zip(pdf["_family"], pdf["_row"], pdf["_name"], pdf["_stem"], pdf["_ext"]):
                if fam != family:
                    family, names_in_use, after = fam, set(), {}
                dest = name
                if row >= 0:
                    n = after.get(name, 0)
                    while dest in names_in_use:
                        n += 1
                        dest = f"{stem}__{n}{ext}"
                    after[name] = max(n - 1, 0)
                    out.append((row, dest))
                names_in_use.add(dest)
            yield pd.DataFrame(out, columns=["_row", "dest"])

    columns = ["_family", "_row", "_name", "_stem", "_ext"]
    queue = there.where("_mixed").select("_family", F.lit(-1).cast("bigint").alias("_row"), "_name", "_stem", "_ext", F.lit(0).alias("_move"), F.lit(None).cast(moves.schema[key].dataType).alias("_key")).unionByName(own.where("_mixed").select(*columns, F.lit(1).alias("_move"), F.col(key).alias("_key")))
    walked = queue.repartition("_family").sortWithinPartitions("_family", "_move", F.col("_key").asc_nulls_first(), "_row").select(*columns).mapInPandas(walk, "_row bigint, dest string")

    straight = own.join(slot, "_row").select("_row", F.when(F.col("_n") == 0, F.col("_name")).otherwise(F.concat("_stem", F.lit("__"), F.col("_n").cast("string"), "_ext")).alias("dest"))
    return rows.join(straight.unionByName(walked), "_row", "left").select(*moves.columns, "dest")


def plan_moves(files: DataFrame, ids: DataFrame, batch_id: str, folder: str, taken: DataFrame, now: int) -> DataFrame:
    """The ledger rows that moving these files to the folder would give; taken: column name, what lies in it. Ids that files lacks have no row.

    A ledger row's id is a hash of file and batch, so that it needs no count of the rows before it.
    """
    found = files.join(ids.select("id").distinct(), "id", "left_semi")
    named = unique_names(found.select("id", "path"), taken, "path", "id")
    return named.select(
        F.xxhash64("id", F.lit(batch_id)).alias("id"),
        F.col("id").alias("file_id"), F.col("path").alias("original_path"), F.concat(F.lit(folder.rstrip("/") + "/"), "dest").alias("moved_path"),
        F.lit(batch_id).alias("batch_id"), F.lit(now).cast("bigint").alias("moved_at"), F.lit(None).cast("bigint").alias("restored_at"),
    )


def move_effect(files: DataFrame, ids: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Catalogue, new ledger rows and report (moved, failed, bytes) after moves were tried.

    moves: rows of plan_moves() with `error`, null where the file is moved. Only those enter the
    ledger and are quarantined; the others, and ids that files lacks, count as failed. bytes are the
    catalogue's sizes.
    """
    done = moves.where("error IS NULL")
    rows = done.select("id", "file_id", "original_path", "moved_path", "batch_id", "moved_at", "restored_at")
    gone = done.select(F.col("file_id").alias("id"), F.lit(True).alias("_moved")).distinct()
    after = files.join(gone, "id", "left").withColumn("status", F.when(F.col("_moved"), "quarantined").otherwise(F.col("status"))).select(*files.columns)
    report = ids.select("id").distinct().join(gone, "id", "left").join(files.select("id", "size"), "id", "left").agg(F.count("_moved").alias("moved"), F.count_if(F.col("_moved").isNull()).alias("failed"), F.coalesce(F.sum(F.when(F.col("_moved"), F.col("size"))), F.lit(0)).alias("bytes"))
    return after, rows, report


def restore_effect(ledger: DataFrame, files: DataFrame, restored: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Ledger and catalogue after the files of these ledger rows (column id) were moved back.

    Every open row of a restored file is marked, as the file is back; its status is normal.
    """
    back = open_rows(ledger).join(restored.select("id").distinct(), "id", "left_semi").select("file_id").where("file_id IS NOT NULL").distinct().withColumn("_back", F.lit(True))
    rows = ledger.join(back, "file_id", "left").withColumn("restored_at", F.when(F.col("_back") & F.col("restored_at").isNull(), F.lit(now).cast("bigint")).otherwise(F.col("restored_at"))).select(*ledger.columns)
    after = files.join(back.withColumnRenamed("file_id", "id"), "id", "left").withColumn("status", F.when(F.col("_back"), "normal").otherwise(F.col("status"))).select(*files.columns)
    return rows, after


def purged(ledger: DataFrame, gone: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Ledger, and new rows of the delete log, after files were deleted for good.

    gone: ledger rows with `size`. All ledger rows of a purged file go, restored history included.
    """
    log = gone.select("id", F.col("moved_path").alias("path"), "size", F.lit(now).cast("bigint").alias("purged_at"), "batch_id")
    rest = ledger.join(gone.select("file_id").where("file_id IS NOT NULL").distinct(), "file_id", "left_anti")
    return rest.join(gone.select("id").distinct(), "id", "left_anti").select(*ledger.columns), log


def purge_effect(ledger: DataFrame, files: DataFrame, which: Column, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ledger, new rows of the delete log, and report (purged, bytes) by batch, of purging the chosen batches.

    The catalogue keeps its status. The size is the catalogue's, where it has the file.
    """
    gone = open_rows(ledger).where(which)
    sized = gone.join(files.select(F.col("id").alias("file_id"), "size"), "file_id", "left")
    rest, log = purged(ledger, sized, now)
    report = sized.groupBy("batch_id").agg(F.count("*").alias("purged"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return rest, log, report


def dropped_by_association(before: int, after: int, moved: int) -> int:
    """Rows that left a view without being moved."""
    return max(0, before - after - moved)
