"""The catalogue as a service: every command over tables that are kept as snapshots."""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.names import check_quarantine_dir
from shelfmark.functions.pixels import fingerprint_images
from shelfmark.operators import cache, catalogue, facets, filters, grouping, ledger, similar
from shelfmark.operators.filters import Filter
from shelfmark.runtime import Written, ship
from shelfmark.sources import scan, settings, thumbs
from shelfmark.sources.store import Store

HISTOGRAMS = {"short_side": facets.short_side_histogram, "size": facets.size_histogram, "pixels": facets.pixel_histogram}


class Library:
    """A catalogue in a folder that all executors see. Commands that change it write new snapshots and return their report as one row.

    now: the time that changes are stamped with, in epoch seconds; the clock's if it is left out.
    """

    def __init__(self, spark: SparkSession, home: str):
        ship(spark)
        self.spark, self.home = spark, home.rstrip("/")
        self.store = Store(spark, f"{self.home}/tables")

    # settings

    @property
    def _settings_path(self) -> str:
        return f"{self.home}/settings.json"

    def get_settings(self) -> settings.Settings:
        return settings.load(self._settings_path)

    def save_settings(self, s: settings.Settings) -> None:
        """ValueError if a setting is out of range, or the quarantine folder lies in a scanned one."""
        if bad := s.problems():
            raise ValueError(f"out of range: {', '.join(bad)}")
        if s.quarantine_dir:
            check_quarantine_dir(s.quarantine_dir, s.roots)
        settings.save(s, self._settings_path)

    # scanning and fingerprints

    def start_scan(self, roots: list[str] | None = None, now: int | None = None) -> DataFrame:
        """Scan the roots and upsert what is new or changed: seen, inserted, updated, skipped, failed, cancelled."""
        known = self.store.read("files")
        seen = Written(scan.scan(self.spark, roots if roots is not None else self.get_settings().roots), "scan").df
        report = Written(catalogue.scan_stats(catalogue.scan_difference(seen, filters.known_files(known))), "report").df
        self.store.write("files", catalogue.upsert(known, seen, _now(now), keep_decode_error=True))
        return report

    def start_fingerprint(self, now: int | None = None) -> DataFrame:
        """Hash what shares its size, fingerprint what has no fingerprint yet: groups, hashed, total, done, failed, skipped.

        What a broken-off run has written is not done again. failed counts pictures; unread hashes stay null.
        """
        files = self.store.read("files")
        candidates = Written(grouping.size_candidates(files), "candidates").df
        todo = candidates.where("content_hash IS NULL").select("id", "path")
        hashed = Written(scan.content_hashes(todo).join(todo, "path"), "hashed").df
        files = self.store.write("files", catalogue.update_columns(files, hashed.where("content_hash IS NOT NULL"), ["content_hash"]))
        waiting = grouping.needs_visual(files).select("id", "path")
        prints = Written(waiting.join(self._prints(), "path", "left").select("id", "phash", "gray_score", F.when(F.col("phash").isNull(), F.coalesce("decode_error", F.lit("cannot be decoded"))).alias("decode_error")), "prints").df
        report = Written(catalogue.hash_stats(candidates, hashed).withColumnRenamed("failed", "unread").join(F.broadcast(catalogue.visual_stats(prints, files))), "report").df
        self.store.write("files", catalogue.set_fingerprints(files, prints, _now(now)))
        return report

    def _images(self) -> DataFrame:
        return self.spark.read.format("image").option("recursiveFileLookup", "true").load(self.get_settings().roots)

    def _prints(self) -> DataFrame:
        if not self.get_settings().roots:
            return self.spark.createDataFrame([], "path string, phash string, gray_score double, decode_error string")
        return fingerprint_images(self._images()).withColumn("path", F.regexp_replace("path", "^file:/*", "/"))

    # queries

    def query_files(self, f: Filter = Filter(), after: dict[str, object] | None = None) -> DataFrame:  # noqa: B008
        """One page; after a known row it is found by a predicate, else by the filter's offset."""
        gray = self.get_settings().gray_threshold
        return filters.page_after(self.store.read("files"), f, after, gray) if after else filters.page(self.store.read("files"), f, gray)

    def count_files(self, f: Filter = Filter()) -> int:  # noqa: B008
        return filters.count_matching(self.store.read("files"), f, self.get_settings().gray_threshold).head()["n"]

    def histogram(self, kind: str) -> DataFrame:
        return facets.wide(HISTOGRAMS[kind](self.store.read("files")))

    def format_stats(self) -> DataFrame:
        return facets.format_stats(self.store.read("files")).orderBy(F.desc("n"), "ext")

    def library_stats(self) -> DataFrame:
        return facets.library_stats(self.store.read("files"))

    def sql(self, query: str, **args: object) -> DataFrame:
        """Any query over the tables, with named parameters (:name)."""
        self.store.views()
        return self.spark.sql(query, args=args)

    # groups

    def _groups(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return tuple(self.store.read(t) for t in ("files", "dup_groups", "dup_members"))

    def count_dup_groups(self, kind: str) -> int:
        row = grouping.count_groups(self.store.read("dup_groups")).where(F.col("kind") == kind).head()
        return row["n"] if row else 0

    def list_dup_groups(self, kind: str, limit: int = 20, offset: int = 0) -> DataFrame:
        return grouping.list_groups(*self._groups(), kind, limit, offset)

    def set_keeper(self, group_id: int, file_id: int) -> None:
        self.store.write("dup_groups", grouping.set_keeper(self.store.read("dup_groups"), group_id, file_id))

    def rebuild_groups(self, kind: str, now: int | None = None) -> int:
        """Compute the groups of a kind (exact or similar) anew in place of the recorded ones; how many there are."""
        files, groups, members = self._groups()
        new_groups, new_members = grouping.recorded_groups(files) if kind == "exact" else similar.recorded_groups(files, self.get_settings().similar_threshold)
        kept_groups, kept_members = grouping.clear_groups(groups, members, kind)
        first = kept_groups.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).head()["m"]
        added = Written(new_groups.withColumn("id", F.col("id") + first).withColumn("created_at", F.lit(_now(now)).cast("bigint")), "groups").df
        belongs = Written(new_members.withColumn("group_id", F.col("group_id") + first), "members").df
        self.store.write("dup_groups", kept_groups.unionByName(added))
        self.store.write("dup_members", kept_members.unionByName(belongs))
        return added.count()

    # quarantine

    def move_to_quarantine(self, ids: DataFrame, batch_id: str, now: int | None = None) -> DataFrame:
        """Move files (column id) into the quarantine folder: moved, failed, bytes. Only what was moved changes its status."""
        s = self.get_settings()
        check_quarantine_dir(s.quarantine_dir, s.roots)
        files, rows = self.store.read("files"), self.store.read("quarantine")
        plan = Written(ledger.plan_moves(files, ids, batch_id, s.quarantine_dir, scan.folder_names(self.spark, s.quarantine_dir), _now(now)), "plan").df
        tried = Written(scan.relocate_all(plan.select("original_path", "moved_path")), "moved").df
        after, new, report = ledger.move_effect(files, ids, plan.join(tried.drop("bytes"), ["original_path", "moved_path"]))
        report = Written(report, "report").df
        self.store.write("quarantine", rows.unionByName(new))
        self.store.write("files", after)
        return report

    def restore_batch(self, batch_id: str, now: int | None = None) -> DataFrame:
        """Move a batch's files back: moved, failed. Files that are gone, or whose place is taken, stay in the ledger."""
        rows, files = self.store.read("quarantine"), self.store.read("files")
        open_ = ledger.open_rows(rows).where(F.col("batch_id") == batch_id)
        tried = Written(scan.relocate_all(open_.select("moved_path", "original_path"), "moved_path", "original_path"), "restored").df
        back = Written(open_.join(tried.where("error IS NULL").select("moved_path"), "moved_path").select("id").distinct(), "back").df
        new_rows, after = ledger.restore_effect(rows, files, back, _now(now))
        self.store.write("quarantine", new_rows)
        self.store.write("files", after)
        return tried.agg(F.count_if(F.col("error").isNull()).alias("moved"), F.count_if(F.col("error").isNotNull()).alias("failed"))

    def purge_batch(self, batch_id: str | None, now: int | None = None) -> DataFrame:
        """Delete a batch's files for good, or with None those of all batches: purged, bytes."""
        rows, log = self.store.read("quarantine"), self.store.read("delete_log")
        open_ = Written(ledger.open_rows(rows).where(F.lit(True) if batch_id is None else F.col("batch_id") == batch_id), "open").df
        gone = Written(scan.delete_all(open_, "moved_path").where("error IS NULL"), "purged").df
        purged = open_.join(gone.select("moved_path", F.col("bytes").alias("size")), "moved_path")
        rest, new_log = ledger.purged(rows, purged, _now(now))
        report = Written(purged.agg(F.count("*").alias("purged"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")), "report").df
        new_log = Written(new_log, "log").df
        self.store.write("quarantine", rest)
        self.store.write("delete_log", log.unionByName(new_log))
        return report

    def purge_all_quarantine(self, now: int | None = None) -> DataFrame:
        return self.purge_batch(None, now)

    def list_quarantine_batches(self) -> DataFrame:
        return ledger.batches(self.store.read("quarantine"), self.store.read("files")).orderBy(F.desc("moved_at"), "batch_id")

    def quarantine_batch_files(self, batch_id: str) -> DataFrame:
        return ledger.batch_files(self.store.read("quarantine"), self.store.read("files")).where(F.col("batch_id") == batch_id).orderBy(F.desc("size"), "file_id")

    # small pictures

    @property
    def cache_dir(self) -> str:
        return f"{self.home}/thumbs"

    def make_thumbs(self) -> DataFrame:
        return thumbs.make_thumbs(self._images(), self.store.read("files"), self.cache_dir, self.get_settings().thumb_edge)

    def make_previews(self, ids: DataFrame) -> DataFrame:
        """Large pictures of some files (column id), in a cache of their own."""
        files = self.store.read("files").join(ids.select("id").distinct(), "id", "left_semi")
        return thumbs.make_thumbs(self._images(), files, f"{self.home}/previews", thumbs.PREVIEW_EDGE)

    def thumb(self, file_id: int, folder: str | None = None) -> bytes | None:
        """A cached picture's bytes, None if it isn't there."""
        row = filters.find_by(self.store.read("files"), id=file_id).select("id", "mtime").head()
        path = f"{folder or self.cache_dir}/{row['id']}_{row['mtime']}.jpg" if row else ""
        return scan.read_retrying(path) if row and os.path.isfile(path) else None

    def preview(self, file_id: int) -> bytes | None:
        return self.thumb(file_id, f"{self.home}/previews")

    def thumb_cache_stats(self) -> int:
        return cache.cache_size(thumbs.manifest(self.spark, self.cache_dir)).head()["bytes"]

    def trim_thumb_cache(self) -> DataFrame:
        return thumbs.trim(self.spark, self.cache_dir, self.get_settings().cache_mb << 20)


def _now(now: int | None) -> int:
    return int(time.time()) if now is None else now
