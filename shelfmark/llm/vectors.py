"""The most similar vectors of every vector, by a block matrix join."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.operators import hamming
from shelfmark.runtime import Written, shuffle_partitions
from shelfmark.tables import current_files, phash_bits

#: Elements of one batch of product tiles; bounds a worker's memory.
TILE_CELLS = 2_000_000


class Heaps:
    """The k nearest partners of each of n rows, as n heaps side by side: nearer first, then smaller tie.

    A candidate that the worst of its row's heap beats is dropped before anything is sorted, and a
    partner that comes again counts once. So memory is n times k and one chunk of candidates.
    """

    def __init__(self, n: int, k: int):
        self.k = k
        self.d, self.tie, self.at = np.full((n, k), np.iinfo(np.int32).max, np.int32), np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -1)

    def push(self, rows: np.ndarray, partners: np.ndarray, d: np.ndarray, tie: np.ndarray) -> None:
        worst, last = self.d[rows, -1], self.tie[rows, -1]
        ok = np.flatnonzero((d < worst) | ((d == worst) & (tie < last)))
        if not len(ok):
            return
        touched = np.unique(rows[ok])
        held = self.at[touched] >= 0
        row = np.concatenate((np.repeat(touched, held.sum(axis=1)), rows[ok]))
        d, tie, at = (np.concatenate((own[touched][held], new[ok])) for own, new in ((self.d, d), (self.tie, tie), (self.at, partners)))
        order = np.lexsort((tie, d, row))
        row, d, tie, at = row[order], d[order], tie[order], at[order]
        fresh = np.concatenate(([True], (row[1:] != row[:-1]) | (tie[1:] != tie[:-1])))
        row, d, tie, at = row[fresh], d[fresh], tie[fresh], at[fresh]
        first = np.concatenate(([True], row[1:] != row[:-1]))
        place = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))
        top = place < self.k
        to = (row[top], place[top])
        self.d[to], self.tie[to], self.at[to] = d[top], tie[top], at[top]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, partner, distance, tie) of all that is held."""
        row, place = np.nonzero(self.at >= 0)
        return row, self.at[row, place], self.d[row, place], self.tie[row, place]


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit vectors, their scales and the lengths of what rounding took away."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-30) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    lost = np.linalg.norm(x - codes * scale[:, None], axis=1)
    return codes, scale, lost


def error_bound(lost_a: np.ndarray | float, lost_b: np.ndarray | float) -> np.ndarray | float:
    """By how much the product of two unit vectors can differ from that of their codes; the last term is for rounding in float32."""
    return lost_a + lost_b + lost_a * lost_b + 1e-6


def sign_vectors(bits: np.ndarray) -> np.ndarray:
    """64-bit fingerprints as unit vectors, a bit as a sign: two that differ in d bits have the product 1 - d / 32."""
    return (np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32) * 2 - 1) / 8


def tile_pairs(codes: np.ndarray, rows: np.ndarray, starts: np.ndarray, lengths: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ordered pairs (a, b), a != b, within each run of rows whose int8 codes have a product of at least `least`.

    Runs are padded to tiles of equal width and multiplied as one batch; longer runs go tile by tile.
    Products of 64 int8 codes are whole numbers below 2^24, which float32 holds exactly.
    """
    width = 1 << np.ceil(np.log2(lengths)).astype(int)
    for w in np.unique(width):
        of = np.flatnonzero(width == w)
        if w > 512:
            for s, n in zip(starts[of], lengths[of]):
                own = rows[s : s + n]
                for i in range(0, n, 1024):
                    left = codes[own[i : i + 1024]].astype(np.float32)
                    for j in range(0, n, 1024):
                        p, q = np.nonzero(left @ codes[own[j : j + 1024]].astype(np.float32).T >= least)
                        p, q = p + i, q + j
                        other = p != q
                        yield own[p[other]], own[q[other]]
            continue
        step = max(1, TILE_CELLS // (w * max(w, codes.shape[1])))
        lane = np.arange(w)
        for g in range(0, len(of), step):
            s, n = starts[of[g : g + step]], lengths[of[g : g + step]]
            real = lane < n[:, None]
            at = rows[np.where(real, s[:, None] + lane, s[:, None])]
            tile = codes[at].astype(np.float32)
            tile[~real] = 0
            product = tile @ tile.transpose(0, 2, 1)
            product[:, lane, lane] = -np.inf
            hit = np.flatnonzero(product.ravel() >= least)
            cell, p = np.divmod(hit, w)
            tile_no, q = np.divmod(cell, w)
            yield at[tile_no, p], at[tile_no, q]


def nearest_fingerprints(fingerprints: DataFrame, radius: int, k: int, parts: int | None = None, limit: int = 100_000) -> DataFrame:
    """For every distinct fingerprint the first k others within `radius` bits, nearer first, then smaller least id.

    fingerprints: distinct bits (bigint) and least (the smallest id that has them). The result is
    bits, other, distance. Exact: blocks come from shared parts (module operators.hamming), in which
    every pair within the radius meets. A block's vectors are quantised to int8 and multiplied tile
    by tile; a pair is dropped if even with the bound on the quantisation error its product is too
    small, all others are recomputed on the fingerprints. Each row of a block keeps a heap of its k
    best, and the heaps of all blocks are merged by fingerprint.
    """
    spark = fingerprints.sparkSession
    parts = parts or hamming.plan_parts(fingerprints.count(), radius)
    counts = hamming.token_counts(fingerprints, parts)
    rank = hamming.ranks(counts, parts)
    routed = hamming.route(fingerprints, ["least"], parts, radius, counts, limit).repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket")

    def work(bucket: int, bits: np.ndarray, least: np.ndarray) -> Iterator[pa.RecordBatch]:
        codes, scale, lost = quantise(sign_vectors(bits))
        worth = (1 - radius / 32 - error_bound(lost.max(), lost.max())) / scale.max() ** 2
        heaps = Heaps(len(bits), k)
        for rows, starts, lengths in hamming.runs_of(bucket, bits, parts, radius, rank):
            for a, b in tile_pairs(codes, rows, starts, lengths, worth):
                d = hamming.distance(bits[a], bits[b])
                near = np.flatnonzero(d <= radius)
                heaps.push(a[near], b[near], d[near], least[b[near]])
        row, at, d, tie = heaps.rows()
        if len(row):
            yield pa.RecordBatch.from_arrays([pa.array(bits[row]), pa.array(bits[at]), pa.array(d), pa.array(tie)], ["bits", "other", "distance", "least"])

    def best(bits: np.ndarray, other: np.ndarray, d: np.ndarray, tie: np.ndarray) -> list[np.ndarray]:
        own, row = np.unique(bits, return_inverse=True)
        heaps = Heaps(len(own), k)
        heaps.push(row, np.arange(len(other)), d, tie)
        row, at, d, tie = heaps.rows()
        return [own[row], other[at], d, tie]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, t) for t in (np.int64, np.int64, np.int32, np.int64)]
        for b in batches:
            if b.num_rows:
                all_ = [np.concatenate((h, c.to_numpy(zero_copy_only=False))) for h, c in zip(held, b.columns)]
                cut = int(np.searchsorted(all_[0], all_[0][-1]))
                if cut:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in best(*(c[:cut] for c in all_))[:3]], ["bits", "other", "distance"])
                held = best(*(c[cut:] for c in all_))
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[:3]], ["bits", "other", "distance"])

    found = routed.mapInArrow(hamming.by_bucket(work), "bits bigint, other bigint, distance int, least bigint")
    return found.repartition(shuffle_partitions(spark), "bits").sortWithinPartitions("bits").mapInArrow(merge, "bits bigint, other bigint, distance int")


def nearest_files(files: DataFrame, k: int = 5, radius: int = 6, parts: int | None = None, limit: int = 100_000) -> DataFrame:
    """(file_id, other_id, distance): the k nearest other files of every current file with a usable fingerprint.

    Nearer first, then the smaller id; at most `radius` bits away; fewer than k where there are no
    more. Files with equal fingerprints are one vector with its k + 1 smallest ids, which are all
    that can be among anybody's first k, so a fingerprint that a third of all files share costs what
    one file costs. Files without a usable fingerprint take no part. Empty input, no rows.
    """
    usable = Written(current_files(files, {"bits": phash_bits(F.col("phash"))}).where(F.col("bits").isNotNull()), "usable").df
    nth = F.row_number().over(Window.partitionBy("bits").orderBy("id"))
    few = Written(usable.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("bits").agg(F.array_sort(F.collect_list("id")).alias("ids")), "vectors").df
    near = nearest_fingerprints(few.select("bits", F.col("ids")[0].alias("least")), radius, k + 1, parts, limit)
    ids = few.select(F.col("bits").alias("other"), "ids")
    reach = near.join(ids, "other").select("bits", F.transform("ids", lambda x: F.struct(F.col("distance").alias("d"), x.alias("id"))).alias("c"))
    own = few.where(F.size("ids") > 1).select("bits", F.transform("ids", lambda x: F.struct(F.lit(0).alias("d"), x.alias("id"))).alias("c"))
    # at most (k + 2)(k + 1) candidates a fingerprint, k + 1 of which can matter
    lists = reach.unionByName(own).groupBy("bits").agg(F.slice(F.array_sort(F.flatten(F.collect_list("c"))), 1, k + 1).alias("c"))
    picked = usable.join(lists, "bits").select("id", F.slice(F.filter("c", lambda x: x["id"] != F.col("id")), 1, k).alias("c"))
    return picked.select(F.col("id").alias("file_id"), F.explode("c").alias("c")).select("file_id", F.col("c.id").alias("other_id"), F.col("c.d").alias("distance"))


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """(file_a, file_b), a < b, of files one of which is a neighbour of the other."""
    return near.select(F.least("file_id", "other_id").alias("file_a"), F.greatest("file_id", "other_id").alias("file_b")).distinct()


def most_similar(vectors: DataFrame, key: str, vector: str, k: int, queries: DataFrame, block: int = 4096) -> DataFrame:
    """(query_id, other_id, similarity): the k vectors of greatest cosine to each query, itself left out; ties to the smaller id.

    vectors: numeric arrays of one dimension; null vectors, vectors with a null or non-finite entry,
    of length zero or of another dimension than most take no part, and of a repeated key the
    greatest vector counts. queries: rows of the same columns (a stated set, such as every twentieth
    id). Exact: a block of queries is multiplied with a block of vectors as int8 tiles; with unit
    vectors q = s c + e the true cosine differs from the quantised one by at most
    |e_q| + |e_v| + |e_q||e_v|, so only pairs whose upper bound reaches the k-th best lower bound are
    recomputed in float64. Each block pair leaves k per query, which heaps merge.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        x = F.transform(F.col(vector), lambda v: v.cast("double"))
        fine = F.col(key).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 1e300)) & F.exists(x, lambda v: v != 0)
        return df.where(fine).groupBy(F.col(key).alias("id")).agg(F.max(x).alias("x"))

    data = Written(clean(vectors), "unit-vectors").df
    asked = Written(clean(queries), "queries").df
    common = data.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").head()
    schema = "query_id bigint, other_id bigint, similarity double"
    if common is None:
        return spark.createDataFrame([], schema)
    data, asked = data.where(F.size("x") == common["d"]), asked.where(F.size("x") == common["d"])
    nv, nq = max(1, -(-data.count() // block)), max(1, -(-asked.count() // block))
    pair = lambda df, n, other, mine: df.withColumn("mine", F.pmod(F.xxhash64("id"), F.lit(n))).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(other - 1)))).select(F.col("mine" if mine == "q" else "other").cast("int").alias("q_block"), F.col("other" if mine == "q" else "mine").cast("int").alias("v_block"), "id", "x")

    def tile(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": [], "other_id": [], "similarity": []}).astype({"query_id": "int64", "other_id": "int64"})
        unit = lambda c: (m := np.vstack(c.to_numpy())) / np.linalg.norm(m, axis=1)[:, None]
        a, b, qi, vi = unit(q["x"]), unit(v["x"]), q["id"].to_numpy(), v["id"].to_numpy()
        (ca, sa, ea), (cb, sb, eb) = quantise(a), quantise(b)
        rough = (ca.astype(np.float32) @ cb.astype(np.float32).T) * sa[:, None] * sb[None, :]
        error = error_bound(ea[:, None], eb[None, :])
        low = np.where(qi[:, None] == vi[None, :], -np.inf, rough - error)
        floor = np.partition(low, -min(k, low.shape[1]), axis=1)[:, -min(k, low.shape[1])]
        i, j = np.nonzero((rough + error >= floor[:, None]) & (qi[:, None] != vi[None, :]))
        exact = np.einsum("nd,nd->n", a[i], b[j])
        rows = []
        cuts = np.searchsorted(i, np.arange(len(qi) + 1))
        for n, (s, e) in enumerate(zip(cuts, cuts[1:])):
            rows += [(qi[n], other, -m) for m, other in heapq.nsmallest(k, zip(-exact[s:e], vi[j[s:e]]))]
        return pd.DataFrame(rows, columns=["query_id", "other_id", "similarity"])

    tiles = pair(asked, nq, nv, "q").groupBy("q_block", "v_block").cogroup(pair(data, nv, nq, "v").groupBy("q_block", "v_block")).applyInPandas(lambda q, v: tile(q, v), schema)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "other_id"))
    return tiles.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")
