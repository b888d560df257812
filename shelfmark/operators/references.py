"""References to records that don't exist, or don't exist yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.tables import seconds


def period_of(t: Column) -> Column:
    """Month in UTC as yyyy-mm of epoch seconds; `unknown` for null and 0."""
    return F.coalesce(F.date_format(F.timestamp_seconds(F.when(t != 0, t)), "yyyy-MM"), F.lit("unknown"))


def broken_references(references: DataFrame, parents: DataFrame, reference: str, time: str, parent_key: str, parent_time: str) -> DataFrame:
    """The references whose parent is missing (state `absent`) or came later than the reference (`later`).

    references: any columns, among them the foreign key and the time of the reference in seconds.
    parents: rows of the parent table, repeated keys allowed; a parent exists since the smallest
    known time of its rows. The result has the references' own columns, `state` and no others, one
    row per row of references.

    Null foreign keys refer to nothing and never come out. Null parent keys match nothing. `later`
    needs both times. An empty parent table makes every reference absent. Columns of the same name
    in both tables don't clash: of parents only key and time are read.

    Distinct foreign keys are anti-joined with the distinct parent keys, so a key that a third of
    all references name is one row there; joined back, such a key is one row on the small side, and
    the large side's partition is split by adaptive execution.
    """
    first = parents.where(F.col(parent_key).isNotNull()).groupBy(F.col(parent_key).alias("_key")).agg(F.min(parent_time).alias("_since"))
    keys = references.where(F.col(reference).isNotNull()).select(F.col(reference).alias("_key")).distinct()
    absent = keys.join(first, "_key", "left_anti").select("_key", F.lit(None).cast("bigint").alias("_since"))
    known = keys.join(first.where(F.col("_since").isNotNull()), "_key")
    suspects = absent.unionByName(known)
    back = references.join(suspects, references[reference] == suspects["_key"])
    state = F.when(F.col("_since").isNull(), "absent").when(F.col("_since") > F.col(time), "later")
    return back.withColumn("state", state).where(F.col("state").isNotNull()).select(*(references[c] for c in references.columns), "state")


def catalogue_references(dup_members: DataFrame, dup_groups: DataFrame, quarantine: DataFrame) -> DataFrame:
    """The catalogue's references to files: src_table, row_key, file_id, at (epoch seconds).

    A member's time is that of its group; without one, or without a row of the group, there is none.
    If a group's id has several rows, its smallest known time counts. Distinct rows.
    """
    created = dup_groups.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("group_id")).agg(F.min(seconds(F.col("created_at"))).alias("at"))
    members = dup_members.where(F.col("file_id").isNotNull()).select("group_id", "file_id").distinct()
    rows = lambda df, name, key, ref, at: df.where(ref.isNotNull()).select(F.lit(name).alias("src_table"), F.coalesce(key, F.lit(0)).cast("bigint").alias("row_key"), ref.alias("file_id"), at.alias("at"))
    return (
        rows(members.join(created, "group_id", "left"), "dup_members", F.col("group_id"), F.col("file_id"), F.col("at"))
        .unionByName(rows(dup_groups, "dup_groups", F.col("id"), F.col("keep_file_id"), seconds(F.col("created_at"))))
        .unionByName(rows(quarantine, "quarantine", F.col("id"), F.col("file_id"), seconds(F.col("moved_at"))))
        .distinct()
    )


def catalogue_broken(files: DataFrame, dup_members: DataFrame, dup_groups: DataFrame, quarantine: DataFrame) -> DataFrame:
    """src_table, row_key, file_id, period, state of every broken reference, distinct."""
    refs = catalogue_references(dup_members, dup_groups, quarantine)
    # a time of 0 is unknown, so nothing can be later than it
    refs = refs.withColumn("at", F.when(F.col("at") != 0, F.col("at")))
    found = broken_references(refs, files, "file_id", "at", "id", "scanned_at")
    return found.select("src_table", "row_key", "file_id", period_of(F.col("at")).alias("period"), "state").distinct()


def broken_counts(found: DataFrame) -> DataFrame:
    """References and distinct missing keys by table, period and state."""
    return found.groupBy("src_table", "period", "state").agg(F.count("*").alias("refs"), F.countDistinct("file_id").alias("files"))
