"""Near duplicates: an exact Hamming self-join, its components, and their medoids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.names import page_of, stem
from shelfmark.functions.scalars import from_hex, hamming, pages_conflict
from shelfmark.operators import hamming as blocks
from shelfmark.operators.grouping import content_representatives
from shelfmark.operators.ordering import numbered
from shelfmark.runtime import Written, shuffle_partitions

THRESHOLD = 8


def visual_records(files: DataFrame) -> DataFrame:
    """id, bits, pid, page of one normal row per content; fingerprints that are no hex number are left out."""
    rows = content_representatives(files)
    return rows.select("id", from_hex(F.col("phash")).alias("bits"), "pid", page_of(stem(F.col("path"))).alias("page")).where("bits IS NOT NULL")


def _routed(bits: DataFrame, payload: list[str], threshold: int, limit: int) -> tuple[DataFrame, int, np.ndarray]:
    parts = blocks.plan_parts(bits.count(), threshold)
    counts = blocks.token_counts(bits, parts)
    routed = blocks.route(bits, payload, parts, threshold, counts, limit)
    return routed.repartition(shuffle_partitions(bits.sparkSession), "bucket").sortWithinPartitions("bucket"), parts, blocks.ranks(counts, parts)


def near_bits(bits: DataFrame, threshold: int, limit: int = 100_000) -> DataFrame:
    """(a, b, distance) of distinct 64-bit numbers (column bits) that differ in at most threshold bits, a < b. No pair is missed.

    The listing of pairs is the result here; near_forest() is for what needs only who hangs together.
    """
    routed, parts, rank = _routed(bits, [], threshold, limit)

    def work(bucket: int, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        for rows, starts, lengths in blocks.runs_of(bucket, x, parts, threshold, rank):
            for p, q in blocks.pairs_of_runs(rows, starts, lengths):
                d = blocks.distance(x[p], x[q])
                near = np.flatnonzero(d <= threshold)
                if len(near):
                    u, v = x[p[near]], x[q[near]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(d[near])], ["a", "b", "distance"])

    return routed.mapInArrow(blocks.by_bucket(work), "a bigint, b bigint, distance int").distinct()


def near_forest(prints: DataFrame, threshold: int, limit: int = 100_000) -> DataFrame:
    """(a, b) of near fingerprints that may link, enough of them to connect what all such pairs connect.

    prints: distinct bits, and pid, page, plain (bigints, -1 for unknown). Two prints link unless both
    have one known pid and different known pages. Of pairs of plain prints each bucket gives back
    only a spanning forest, so a cluster of any density costs its rows and not its pairs; pairs with
    a print that isn't plain all come back.
    """
    routed, parts, rank = _routed(prints, ["pid", "page", "plain"], threshold, limit)

    def work(bucket: int, x: np.ndarray, pid: np.ndarray, page: np.ndarray, plain: np.ndarray) -> Iterator[pa.RecordBatch]:
        forest = blocks.Forest(len(x))
        for rows, starts, lengths in blocks.runs_of(bucket, x, parts, threshold, rank):
            for p, q in blocks.pairs_of_runs(rows, starts, lengths):
                near = blocks.distance(x[p], x[q]) <= threshold
                both = (plain[p] == 1) & (plain[q] == 1)
                clash = (pid[p] == pid[q]) & (pid[p] >= 0) & (page[p] != page[q]) & (page[p] >= 0) & (page[q] >= 0)
                own, rest = np.flatnonzero(near & both & ~clash), np.flatnonzero(near & ~both)
                take = np.concatenate((own[forest.joining(p[own], q[own])], rest))
                if len(take):
                    yield pa.RecordBatch.from_arrays([pa.array(x[p[take]]), pa.array(x[q[take]])], ["a", "b"])

    return routed.mapInArrow(blocks.by_bucket(work), "a bigint, b bigint").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_links(records: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(id, other): links that connect exactly what all pairs within the threshold would.

    Two different known pages of one work never link directly. Records of equal bits, work and page
    are one class; its copies link to the smallest. Of the classes of one fingerprint two stand for
    all: the smallest, r1, and the smallest that may link to r1, r2. Whoever conflicts with r1 is
    of its work and can't conflict with r2, so with an r2 all classes of the fingerprint are
    connected by one link each, and without one none is. For two near fingerprints it is enough to
    link r1, or every class where there is no r2, to the other's r1 or r2, and equal pages of one
    work with each other. So links grow with the records and never with pairs inside a fingerprint;
    nor with pairs of near fingerprints, of which near_forest() gives a spanning forest per bucket.
    """
    classes = Written(records.groupBy("bits", "pid", "page").agg(F.min("id").alias("id")), "classes").df
    key = lambda c: F.struct(F.coalesce(c("pid"), F.lit(-1)), F.coalesce(c("page"), F.lit(-1)))
    mine = classes.select(F.col("bits").alias("_bits"), key(F.col).alias("_key"), F.col("id").alias("other"))
    copies = records.join(mine, (F.col("bits") == F.col("_bits")) & (key(F.col) == F.col("_key"))).where("id <> other").select("id", "other")

    clash = lambda c, r: pages_conflict(F.col("pid"), F.col("page"), F.col(f"{r}.pid"), F.col(f"{r}.page"))  # noqa: ARG005, E731
    first = classes.groupBy("bits").agg(F.min(F.struct("id", "pid", "page")).alias("r1"))
    second = classes.join(first, "bits").where(F.col("id") != F.col("r1.id")).where(~clash("c", "r1")).groupBy("bits").agg(F.min(F.struct("id", "pid", "page")).alias("r2"))
    heads = Written(first.join(second, "bits", "left"), "heads").df
    target = F.when(~clash("c", "r1"), F.col("r1.id")).when(F.col("r2").isNotNull() & ~clash("c", "r2"), F.col("r2.id"))
    inside = classes.join(heads, "bits").select("id", target.alias("other"), F.col("r1.id").alias("_r1"), F.col("r2.id").alias("_r2")).select("id", F.when(F.col("id") == F.col("_r1"), F.col("_r2")).otherwise(F.col("other")).alias("other"))

    # a print is plain if it is one class, or if all its classes hang together by r2
    shape = classes.groupBy("bits").agg(F.count("*").alias("n")).join(heads, "bits")
    known = lambda c: F.when(F.col("r2").isNull(), F.coalesce(F.col(f"r1.{c}").cast("bigint"), F.lit(-1))).otherwise(F.lit(-1)).alias(c)
    prints = Written(shape.select("bits", known("pid"), known("page"), ((F.col("n") == 1) | F.col("r2").isNotNull()).cast("bigint").alias("plain")), "prints").df
    near = Written(near_forest(prints, threshold), "near").df
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    speaks = classes.join(heads, "bits").where(F.col("r2").isNull() | (F.col("id") == F.col("r1.id"))).select(F.col("bits").alias("a"), "id", "pid", "page")
    across = both.join(speaks, "a").join(heads.withColumnRenamed("bits", "b"), "b").select("id", target.alias("other"))
    paged = speaks.where("pid IS NOT NULL AND page IS NOT NULL")
    equal = near.join(paged, "a").join(paged.select(F.col("a").alias("b"), F.col("id").alias("other"), "pid", "page"), ["b", "pid", "page"]).select("id", "other")

    links = copies.unionByName(inside).unionByName(across).unionByName(equal).where("other IS NOT NULL AND id <> other")
    return links.select(F.greatest("id", "other").alias("id"), F.least("id", "other").alias("other")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, root) by alternating star operations: every id with a link and the smallest id it reaches.

    Large-star hands a vertex's greater neighbours to its least one, small-star its smaller ones;
    both only ever join neighbours' lists by key, and the number of rounds grows with the logarithm
    of the longest chain. Each round is a written table; it ends when a round changes nothing.
    """
    edges = Written(links.where("id <> other").select(F.greatest("id", "other").alias("u"), F.least("id", "other").alias("v")).distinct(), "stars")
    while True:
        both = edges.df.unionByName(edges.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = Written(large, "stars")
        low = large.df.groupBy("u").agg(F.min("v").alias("m"))
        small = large.df.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = Written(small, "stars")
        large.drop()
        changed = after.df.join(edges.df, ["u", "v"], "left_anti").limit(1).count() + edges.df.join(after.df, ["u", "v"], "left_anti").limit(1).count()
        edges.drop()
        edges = after
        if not changed:
            break
    return edges.df.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.df.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def medoids(members: DataFrame) -> DataFrame:
    """root, keep_id, keep_bits: the member with the least sum of distances to all others, of equals the smaller id.

    members: root, id, bits. The sum is taken bit by bit: a set bit differs from all members that lack
    it. 64 counts per component, partial per task, stand for all its pairs.
    """
    bit = lambda b: F.shiftrightunsigned("bits", b).bitwiseAND(F.lit(1))
    ones = members.groupBy("root").agg(F.array(*(F.sum(bit(b)) for b in range(64))).alias("ones"), F.count("*").alias("n"))
    each = members.join(ones, "root")
    total = sum((F.when(bit(b) == 1, F.col("n") - F.col("ones")[b]).otherwise(F.col("ones")[b]) for b in range(64)), F.lit(0))
    return each.select("root", F.struct(total.alias("s"), "id", "bits").alias("k")).groupBy("root").agg(F.min("k").alias("k")).select("root", F.col("k.id").alias("keep_id"), F.col("k.bits").alias("keep_bits"))


def similar_groups(files: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """group_no, keep_id, file_id, distance: near-duplicate groups as a rebuild records them, the keeper at distance 0.

    Groups are numbered from 1 by their nearest member's distance, then by keeper.
    """
    records = Written(visual_records(files), "visual").df
    roots = components(similar_links(records, threshold))
    members = Written(roots.join(records, "id").select("root", "id", "bits"), "members").df
    kept = members.join(medoids(members), "root").withColumn("distance", hamming(F.col("bits"), F.col("keep_bits")))
    first = kept.where("id <> keep_id").groupBy("root", "keep_id").agg(F.min("distance").alias("first"))
    order = numbered(first, [F.col("first").asc(), F.col("keep_id").asc()], "group_no")
    return kept.select("root", F.col("id").alias("file_id"), "distance").join(order.select("root", "keep_id", "group_no"), "root").select("group_no", "keep_id", "file_id", F.col("distance").cast("bigint").alias("distance"))


def recorded_groups(files: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """dup_groups and dup_members as a rebuild writes them for near duplicates, the keeper among the members at distance 0."""
    found = Written(similar_groups(files, threshold), "similar").df
    groups = found.select(F.col("group_no").alias("id"), F.lit("similar").alias("kind"), F.col("keep_id").alias("keep_file_id")).distinct()
    return groups, found.select(F.col("group_no").alias("group_id"), "file_id", "distance")
