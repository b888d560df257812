"""Exact duplicates: candidates, groups, keepers, and the views over recorded groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.operators.facets import normal
from shelfmark.operators.ordering import numbered

#: The wording of why a record is kept, in the order of the rules.
REASONS = ("", "文件名里带作品 ID", "路径更短", "收藏时间更早", "内容完全相同，留哪张都一样")
TILES = 8


def size_candidates(files: DataFrame) -> DataFrame:
    """Normal rows that share their size with another normal row. Sizes are counted with partial sums; the rows then find theirs."""
    shared = normal(files).where("size IS NOT NULL").groupBy("size").agg(F.count("*").alias("same_size")).where("same_size > 1")
    return normal(files).join(shared, "size").select(*files.columns, "same_size")


def needs_content(files: DataFrame) -> DataFrame:
    """Candidates whose content hash is still to be computed."""
    return size_candidates(files).where("content_hash IS NULL")


def needs_visual(files: DataFrame) -> DataFrame:
    """Normal rows without a fingerprint and without an error: a broken-off run goes on here."""
    return normal(files).where("phash IS NULL AND decode_error IS NULL")


def keeper_key() -> Column:
    """Sort key of the record to keep: with a work id, shorter path in bytes, earlier, smaller id."""
    return F.struct(F.col("pid").isNull().alias("no_pid"), F.octet_length("path").alias("bytes"), F.col("mtime").alias("mtime"), F.col("id").alias("id"), F.col("path").alias("path"), F.col("size").alias("size"))


def _hashed(files: DataFrame) -> DataFrame:
    return normal(files).where("content_hash IS NOT NULL")


def exact_keepers(files: DataFrame) -> DataFrame:
    """content_hash, keep_id, members, savings of every hash with more than one normal row.

    Minimum, count and sum are partial per task, so a hash of any weight is one row per task.
    """
    groups = _hashed(files).groupBy("content_hash").agg(F.min(keeper_key()).alias("k"), F.count("*").alias("members"), F.sum("size").alias("bytes"))
    return groups.where("members > 1").select("content_hash", F.col("k.id").alias("keep_id"), "members", (F.col("bytes") - F.coalesce("k.size", F.lit(0))).alias("savings"))


def exact_members(files: DataFrame) -> DataFrame:
    """content_hash, keep_id, id: one row per member of an exact group, the keeper among them."""
    return _hashed(files).select("content_hash", "id").join(exact_keepers(files).select("content_hash", "keep_id"), "content_hash")


def keeper_reasons(files: DataFrame) -> DataFrame:
    """content_hash, keep_id, reason. The others are the members with another path."""
    keep = _hashed(files).groupBy("content_hash").agg(F.min(keeper_key()).alias("k"), F.count("*").alias("members")).where("members > 1")
    others = _hashed(files).join(keep, "content_hash").where(F.col("path") != F.col("k.path"))
    seen = others.groupBy("content_hash").agg(F.bool_or(F.col("pid").isNull()).alias("lacks"), F.max(F.octet_length("path")).alias("longest"), F.max("mtime").alias("latest"))
    j = keep.join(seen, "content_hash", "left")
    return j.select("content_hash", F.col("k.id").alias("keep_id"), reason(~F.col("k.no_pid"), F.col("k.bytes"), F.col("k.mtime"), F.col("lacks"), F.col("longest"), F.col("latest")).alias("reason"))


def reason(has_pid: Column, size: Column, mtime: Column, lacks: Column, longest: Column, latest: Column) -> Column:
    """First rule that sets the kept record apart from the others; lacks is null if there are none."""
    rule = F.when(lacks.isNull(), 0).when(has_pid & lacks, 1).when(longest > size, 2).when(latest > mtime, 3).otherwise(4)
    return F.element_at(F.array(*map(F.lit, REASONS)), rule + 1)


def content_representatives(files: DataFrame) -> DataFrame:
    """Normal rows with a fingerprint: one per content hash by the keeper's rule, and all without a hash."""
    rows = normal(files).where("phash IS NOT NULL")
    best = rows.where("content_hash IS NOT NULL").groupBy("content_hash").agg(F.min(keeper_key()).alias("k")).select(F.col("k.id").alias("id"))
    alone = rows.where("content_hash IS NULL").select("id")
    return rows.join(best.unionByName(alone), "id", "left_semi").select(*files.columns)


def recorded_groups(files: DataFrame, kind: str = "exact") -> tuple[DataFrame, DataFrame]:
    """dup_groups and dup_members as a rebuild would write them for exact groups, numbered in order of hash."""
    keys = numbered(exact_keepers(files).select("content_hash", "keep_id"), [F.col("content_hash").asc()], "id")
    groups = keys.select("id", F.lit(kind).alias("kind"), F.col("keep_id").alias("keep_file_id"))
    members = _hashed(files).select("content_hash", F.col("id").alias("file_id")).join(keys.select("content_hash", F.col("id").alias("group_id")), "content_hash").select("group_id", "file_id", F.lit(0).cast("bigint").alias("distance"))
    return groups, members


def plain_kind(kind: Column) -> Column:
    return F.lower(F.trim(kind))


def group_members(files: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """group_id, kind, keep_file_id, file_id, distance, size, path, pid, mtime of each group's members but its keeper.

    Members that files lacks have no row, whatever their status the others have. Of a member
    recorded twice the smaller known distance counts, null counts 0.
    """
    g = groups.select(F.col("id").alias("group_id"), plain_kind(F.col("kind")).alias("kind"), "keep_file_id").distinct()
    m = members.where("group_id IS NOT NULL AND file_id IS NOT NULL").groupBy("group_id", "file_id").agg(F.coalesce(F.min("distance"), F.lit(0)).alias("distance"))
    f = files.select(F.col("id").alias("file_id"), "size", "path", "pid", "mtime")
    return m.join(g, "group_id").where("file_id <> keep_file_id").join(f, "file_id")


def group_views(files: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """group_id, kind, keep_file_id, members, savings, nearest, farthest, reason of groups whose keeper exists.

    Scalars only, so that a group of any size is one row; its members are rows of group_members().
    """
    own = group_members(files, groups, members)
    keep = files.select(F.col("id").alias("keep_file_id"), F.col("pid").alias("k_pid"), F.col("path").alias("k_path"), F.col("mtime").alias("k_mtime"))
    g = groups.select(F.col("id").alias("group_id"), plain_kind(F.col("kind")).alias("kind"), "keep_file_id").distinct().join(keep, "keep_file_id")
    other = F.col("path") != F.col("k_path")
    seen = own.join(keep, "keep_file_id").groupBy("group_id").agg(
        F.count("*").alias("members"), F.sum("size").alias("savings"), F.min("distance").alias("nearest"), F.max("distance").alias("farthest"),
        F.bool_or(F.when(other, F.col("pid").isNull())).alias("lacks"), F.max(F.when(other, F.octet_length("path"))).alias("longest"), F.max(F.when(other, F.col("mtime"))).alias("latest"),
    )
    why = reason(F.col("k_pid").isNotNull(), F.octet_length("k_path"), F.col("k_mtime"), F.col("lacks"), F.col("longest"), F.col("latest"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return g.join(seen, "group_id", "left").select("group_id", "kind", "keep_file_id", zero("members"), zero("savings"), "nearest", "farthest", why.alias("reason"))


def group_page(files: DataFrame, groups: DataFrame, members: DataFrame, kind: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """group_views() of one page of a kind's groups by id; limit is 1 at least, a negative offset 0. Groups without a keeper in files take their place but have no row."""
    chosen = groups.where(plain_kind(F.col("kind")) == kind).select("id", "kind", "keep_file_id").distinct().orderBy("id").offset(max(0, offset)).limit(max(1, limit))
    return group_views(files, chosen, members.join(chosen.select(F.col("id").alias("group_id")), "group_id", "left_semi"))


def list_groups(files: DataFrame, groups: DataFrame, members: DataFrame, kind: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """One page of a kind's groups with all that a list shows: group_id, keep, file_id, distance, the group's members, savings and reason, and the record's columns.

    A row per record instead of a list per group, so that a group of any size is rows and never one
    value. keep marks the kept record, at distance 0; a list has it first, the others by distance and
    id. Groups whose keeper files lacks take their place in the page but have no row.
    """
    chosen = groups.where(plain_kind(F.col("kind")) == kind).select("id", "kind", "keep_file_id").distinct().orderBy("id").offset(max(0, offset)).limit(max(1, limit))
    belongs = members.join(chosen.select(F.col("id").alias("group_id")), "group_id", "left_semi")
    views = group_views(files, chosen, belongs).select("group_id", "keep_file_id", "members", "savings", "reason")
    record = [c for c in files.columns if c != "id"]
    kept = views.select("group_id", F.col("keep_file_id").alias("file_id"), F.lit(0).cast("bigint").alias("distance"), F.lit(True).alias("keep"))
    others = group_members(files, chosen, belongs).select("group_id", "file_id", "distance", F.lit(False).alias("keep"))
    rows = kept.unionByName(others).join(views, "group_id").join(files.select(F.col("id").alias("file_id"), *record), "file_id")
    return rows.select("group_id", "keep", "file_id", "distance", "members", "savings", "reason", *record)


def group_tiles(files: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """group_id, shown (the keeper and the first members by distance and id, 8 at most), more (how many are left).

    Members beyond those shown are dropped in each task before any list is made.
    """
    own = group_members(files, groups, members)
    nth = F.row_number().over(Window.partitionBy("group_id").orderBy("distance", "file_id"))
    first = own.withColumn("nth", nth).where(F.col("nth") < TILES).groupBy("group_id", "keep_file_id").agg(F.array_sort(F.collect_list(F.struct("nth", "file_id"))).alias("m"))
    shown = first.select("group_id", F.concat(F.array("keep_file_id"), F.transform("m", lambda x: x["file_id"])).alias("shown"))
    total = own.groupBy("group_id").agg(F.count("*").alias("n"))
    return shown.join(total, "group_id").select("group_id", "shown", F.greatest(F.col("n") + 1 - TILES, F.lit(0)).alias("more"))


def default_selection(files: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """group_id, file_id, size ticked at first: of exact groups all but the keeper, of similar ones none."""
    return group_members(files, groups, members).where("kind = 'exact'").select("group_id", "file_id", "size")


def select_also(chosen: DataFrame, more: DataFrame) -> DataFrame:
    """file_id of both selections, once each."""
    return chosen.select("file_id").unionByName(more.select("file_id")).distinct()


def deselect(chosen: DataFrame, fewer: DataFrame) -> DataFrame:
    return chosen.select("file_id").distinct().join(fewer.select("file_id"), "file_id", "left_anti")


def toggle(chosen: DataFrame, touched: DataFrame) -> DataFrame:
    """The selection with every touched file switched: in if it was out, out if it was in."""
    return deselect(chosen, touched).unionByName(deselect(touched, chosen))


def visible_selection(chosen: DataFrame, shown: DataFrame) -> DataFrame:
    """What is selected among the files shown (column id)."""
    return chosen.select("file_id").distinct().join(shown.select(F.col("id").alias("file_id")), "file_id", "left_semi")


def selection_totals(selected: DataFrame) -> DataFrame:
    return selected.select("file_id", "size").distinct().agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def count_groups(groups: DataFrame) -> DataFrame:
    """Groups per kind, repeated rows counted once."""
    return groups.select("id", plain_kind(F.col("kind")).alias("kind")).distinct().groupBy("kind").agg(F.count("*").alias("n"))


def set_keeper(groups: DataFrame, group_id: int, file_id: int) -> DataFrame:
    """groups with another keeper in one of them; distances stay as recorded."""
    return groups.withColumn("keep_file_id", F.when(F.col("id") == group_id, file_id).otherwise(F.col("keep_file_id")))


def clear_groups(groups: DataFrame, members: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """groups and members without those of a kind."""
    of_kind = F.coalesce(plain_kind(F.col("kind")) == kind, F.lit(False))
    gone = groups.where(of_kind).select(F.col("id").alias("group_id"))
    return groups.where(~of_kind), members.join(gone, "group_id", "left_anti")
