"""Groups of records that are linked directly or through others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.runtime import Written
from shelfmark.tables import current_files, phash_bits


def star_edges(memberships: DataFrame, hub: str, member: str) -> DataFrame:
    """Edges (a, b) with b < a from every member to the smallest member of its hub.

    A hub of any size gives one edge per member, never its pairs; the smallest member is a partial
    minimum per task, so a hub with a third of all rows is one row when it is joined back. Null hubs
    and null members link nothing, repeated rows count once, a hub of one member has no edge.
    """
    rows = memberships.where(F.col(hub).isNotNull() & F.col(member).isNotNull()).select(F.col(hub).alias("_hub"), F.col(member).alias("a"))
    least = rows.groupBy("_hub").agg(F.min("a").alias("b"))
    return rows.join(least, "_hub").where(F.col("a") != F.col("b")).select("a", "b")


def connected_components(edges: DataFrame, jumps: int = 2) -> DataFrame:
    """(id, root): every id that has an edge, with the smallest id that it reaches.

    edges: two columns of ids; nulls link nothing, loops and repeated edges are ignored, an id that
    has loops only doesn't come out. No edges, no rows.

    Each round gives every vertex the smallest label among itself and its neighbours, follows those
    labels `jumps` times (pointer jumping), and then moves the edges to the labels; edges within one
    label vanish. At least half of the vertices of each round are gone in the next, on a path all
    but one in 2^jumps, so the rounds grow with the logarithm of the longest chain. Labels and edges
    of each round are written to the shared folder, which ends their lineage; the last round is the
    one that leaves no edge, when no label can change any more.
    """
    a, b = edges.columns
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("a"), F.col(b).alias("b"))
    links = Written(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    labels = None
    while links.rows():
        both = links.df.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(links.df.select(F.col("b").alias("id"), F.col("a").alias("to")))
        up = Written(both.groupBy("id").agg(F.least(F.col("id"), F.min("to")).alias("root")), "up")
        for _ in range(jumps):
            far = up.df.select(F.col("id").alias("root"), F.col("root").alias("next"))
            # roots point to themselves, so the join loses nobody
            jumped = Written(up.df.join(far, "root").select("id", F.col("next").alias("root")), "up")
            up.drop()
            up = jumped
        if labels is None:
            new_labels = up
        else:
            far = up.df.select(F.col("id").alias("root"), F.col("root").alias("next"))
            new_labels = Written(labels.df.join(far, "root", "left").select("id", F.coalesce("next", "root").alias("root")), "labels")
            labels.drop()
        to = lambda side: up.df.select(F.col("id").alias(side), F.col("root").alias(f"{side}_root"))  # noqa: B023, E731
        moved = links.df.join(to("a"), "a").join(to("b"), "b").where("a_root != b_root")
        new_links = Written(moved.select(F.greatest("a_root", "b_root").alias("a"), F.least("a_root", "b_root").alias("b")).distinct(), "links")
        links.drop()
        if labels is not None:
            up.drop()
        links, labels = new_links, new_labels
    links.drop()
    if labels is None:
        return pairs.select(F.col("a").alias("id"), F.col("b").alias("root")).limit(0)
    return labels.df


def match_groups(dup_members: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, root_id) of all files linked by recorded groups or by equal usable fingerprints.

    Groups with null or negative ids link nothing; ids that files lacks link all the same.
    """
    recorded = star_edges(dup_members.where("group_id >= 0"), "group_id", "file_id")
    alike = star_edges(current_files(files, {"bits": phash_bits(F.col("phash"))}), "bits", "id")
    return connected_components(recorded.unionByName(alike)).select(F.col("id").alias("file_id"), F.col("root").alias("root_id"))
