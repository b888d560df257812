"""Exact candidate blocks for 64-bit fingerprints that differ in few bits.

A fingerprint is cut into parts; each (part, value) is a token. Two fingerprints that differ in at
most `radius` bits share at least parts - radius tokens, `need`. Tokens have one global order, rare
ones first. The first shared token of a pair, in that order, is among the first parts - need + 1
tokens of both (the prefix); need - 1 further shared tokens come later in the order. So each
fingerprint goes to the buckets of its prefix tokens, and within a bucket only fingerprints that
share need - 1 later tokens are compared. A token that a third of all fingerprints share comes last
in the order of each of them and hardly ever makes a bucket; buckets that are too large all the same
are cut by the next shared token, and those once more into pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 64
#: Parts are numbered in five bits, values of a part in sixteen.
LEAST_PARTS, MOST_PARTS, T_BITS = 4, 32, 21
#: Blocks that one bucket is cut into at most, by the bits left for their number; beyond it blocks grow.
MOST_BLOCKS = 1000
#: What comparing two fingerprints costs, against sorting one.
COMPARE = 0.05


def plan_parts(rows: int, radius: int) -> int:
    """Number of parts for that many fingerprints.

    More parts mean that a pair shares more of them, so that more is sorted and less compared; the
    sum of the two, for fingerprints without order, decides. Any number of parts loses nothing.
    """
    if not 0 <= radius <= MOST_PARTS - 2:
        raise ValueError(f"a radius of {radius} bits can't be searched by shared parts")

    def cost(parts: int) -> float:
        need = parts - radius
        return rows * (radius + 1) * comb(parts - 1, need - 1) + COMPARE * comb(parts, need) * rows**2 / 2 ** (BITS * need / parts)

    return min(range(max(radius + 2, LEAST_PARTS), min(radius + 9, MOST_PARTS + 1)), key=cost)


def bounds(parts: int) -> list[tuple[int, int]]:
    """(first bit, width) of each part; widths differ by one at most."""
    cuts = [BITS * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def tokens(bits: np.ndarray, parts: int) -> np.ndarray:
    """(rows, parts) of token numbers below parts << 16."""
    x = bits.view(np.uint64)
    return np.stack([(np.right_shift(x, np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int32) + (k << 16) for k, (at, width) in enumerate(bounds(parts))], axis=1)


def token_counts(fingerprints: DataFrame, parts: int) -> dict[int, int]:
    """How many fingerprints hold each token. There are at most parts * 2^width tokens, whatever the number of rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(parts << 16, np.int64)
        for b in batches:
            total += np.bincount(tokens(b.column(0).to_numpy(zero_copy_only=False), parts).ravel(), minlength=parts << 16)
        t = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(total[t])], ["token", "n"])

    counted = fingerprints.select("bits").mapInArrow(count, "token int, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    return {r["token"]: r["n"] for r in counted.collect()}


def ranks(counts: dict[int, int], parts: int) -> np.ndarray:
    """Place of each token in the global order, rare ones first; tokens never counted come before all."""
    n = np.zeros(parts << 16, np.int64)
    n[list(counts)] = list(counts.values())
    rank = np.empty(len(n), np.int32)
    rank[np.lexsort((np.arange(len(n)), n))] = np.arange(len(n), dtype=np.int32)
    return rank


def route(fingerprints: DataFrame, payload: list[str], parts: int, radius: int, counts: dict[int, int], limit: int = 100_000, blocked: bool = True, cut: list[int] | None = None) -> DataFrame:
    """Each fingerprint once per bucket: bucket, bits and the payload columns (bigints, none of them null).

    bucket is the prefix token. In buckets of more than `limit` fingerprints it also holds the next
    shared token, and the fingerprints go to each such smaller bucket; one that is still too large is
    cut into blocks by a hash of the fingerprint, and they go to every pair of blocks that has theirs.
    So no task gets more than about twice the limit, and no pair is lost. The number of blocks comes
    from these fingerprints alone; where two inputs are to meet, `blocked` is False for both, no
    smaller bucket is cut, and in_blocks() cuts the two by one count. cut: the tokens whose buckets
    are to be divided by the next token, where counts and limit aren't to tell.
    """
    if not radius + 2 <= parts <= MOST_PARTS or parts < LEAST_PARTS:
        raise ValueError(f"{parts} parts don't do for a radius of {radius}")
    prefix = radius + 1
    rank = ranks(counts, parts)
    large = np.zeros(parts << 16, bool)
    large[[t for t, n in counts.items() if n > limit] if cut is None else cut] = True
    any_large = bool(large.any())

    def spreading(blocks: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        split = np.array(sorted(blocks), np.int64)
        number = np.array([blocks[x] for x in sorted(blocks)], np.int64)

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                bits, *extra = (c.to_numpy(zero_copy_only=False) for c in b.columns)
                t = tokens(bits, parts)
                t = np.take_along_axis(t, np.argsort(rank[t], axis=1), axis=1).astype(np.int64)
                for k in range(prefix):
                    cut = large[t[:, k]] if any_large else None
                    keep = np.arange(len(bits)) if cut is None else np.flatnonzero(~cut)
                    if len(keep):
                        yield _batch(t[keep, k], bits[keep], [x[keep] for x in extra])
                    if cut is None or not cut.any():
                        continue
                    rows = np.flatnonzero(cut)
                    for later in range(k + 1, parts):
                        bucket = t[rows, k] | (t[rows, later] + 1) << T_BITS
                        at = np.searchsorted(split, bucket)
                        n = np.where((at < len(split)) & (split[np.minimum(at, len(split) - 1)] == bucket), number[np.minimum(at, len(split) - 1)], 1) if len(split) else np.ones(len(rows), np.int64)
                        own = ((bits[rows].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n
                        for other in range(int(n.max())):
                            has = np.flatnonzero(other < n)
                            lo, hi = np.minimum(own[has], other), np.maximum(own[has], other)
                            pair = hi * (hi + 1) // 2 + lo
                            yield _batch(bucket[has] | pair << (2 * T_BITS + 1), bits[rows[has]], [x[rows[has]] for x in extra])

        return spread

    _batch = lambda bucket, bits, extra: pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket, bits, *extra)], ["bucket", "bits", *payload])
    schema = "bucket bigint, bits bigint" + "".join(f", {c} bigint" for c in payload)
    source = fingerprints.select("bits", *payload)
    blocks: dict[int, int] = {}
    if any_large and blocked:
        sizes = source.mapInArrow(spreading({}), schema).where(F.col("bucket") >= 1 << T_BITS).groupBy("bucket").count().where(F.col("count") > limit)
        # fewer rows than one in `limit` fingerprints times the pairs of parts
        blocks = {r["bucket"]: min(-(-r["count"] // limit), MOST_BLOCKS) for r in sizes.collect()}
    return source.mapInArrow(spreading(blocks), schema)


def in_blocks(stored: DataFrame, asking: DataFrame, limit: int, sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Both inputs (bucket, bits, ...), uncut, with every bucket of more than `limit` rows cut into blocks in which each stored row meets each asking row once.

    A bucket of n times the limit stored and m times the limit asking rows has n * m blocks; a stored
    row goes to the m blocks of its part, an asking row to the n blocks of its own. Sizes are of
    what is there now, so that rows stored at different times, in whatever numbers, fit together.
    sizes: bucket and n of the stored rows, where they are known; counted if it is left out.
    """
    s = sizes if sizes is not None else stored.groupBy("bucket").agg(F.count("*").alias("n"))
    both = asking.groupBy("bucket").agg(F.count("*").alias("a")).join(s.groupBy("bucket").agg(F.sum("n").alias("s")), "bucket")
    over = both.where((F.col("s") > limit) | (F.col("a") > limit)).collect()
    if not over:
        return stored, asking
    cuts = F.broadcast(stored.sparkSession.createDataFrame([(r["bucket"], min(-(-r["s"] // limit), MOST_BLOCKS), min(-(-r["a"] // limit), MOST_BLOCKS)) for r in over], "bucket bigint, n bigint, m bigint"))
    n, m, other = F.coalesce("n", F.lit(1)), F.coalesce("m", F.lit(1)), F.col("other")

    def cut(df: DataFrame, own: Column, others: Column, block: Callable[[Column], Column]) -> DataFrame:
        spread = df.join(cuts, "bucket", "left").withColumn("own", F.pmod(F.xxhash64("bits"), own)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), others - 1)))
        return spread.withColumn("bucket", F.col("bucket").bitwiseOR(F.shiftleft(block(F.col("own")), 2 * T_BITS + 1))).select(df.columns)

    return cut(stored, n, m, lambda own: own * m + other), cut(asking, m, n, lambda own: other * m + own)


def runs_of(bucket: int, bits: np.ndarray, parts: int, radius: int, rank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sets of the bucket's rows that share its token and need - 1 later ones: (rows, starts, lengths), lengths of 2 or more."""
    need = parts - radius
    first, second = bucket & ((1 << T_BITS) - 1), (bucket >> T_BITS & ((1 << (T_BITS + 1)) - 1)) - 1
    t = tokens(bits, parts)
    later = rank[t] > rank[first]
    others = [k for k in range(parts) if k != first >> 16]
    widths = [w for _, w in bounds(parts)]
    fixed = [] if second < 0 else [second >> 16]
    for chosen in combinations(others, need - 1):
        if fixed and fixed[0] not in chosen:
            continue
        ok = np.flatnonzero(np.logical_and.reduce([later[:, k] for k in chosen])) if chosen else np.arange(len(bits))
        if len(ok) < 2:
            continue
        key = np.zeros(len(ok), np.int64)
        for k in chosen:
            key = key << widths[k] | (t[ok, k] & 0xFFFF)
        order = np.argsort(key.astype(np.uint16) if len(chosen) < 2 else key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        lengths = np.diff(np.append(starts, len(key)))
        keep = lengths > 1
        if keep.any():
            yield ok[order], starts[keep], lengths[keep]


def pairs_of_runs(rows: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within each run, lag by lag, so that no more than one pair per row is held at a time."""
    at = np.repeat(starts, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left = np.repeat(starts + lengths, lengths) - at - 1
    live = np.arange(len(at))
    for lag in range(1, int(lengths.max())):
        live = live[left[live] >= lag]
        yield rows[at[live]], rows[at[live] + lag]


class Forest:
    """Components of n rows, grown by chunks of edges; of the edges given only those come back that join two trees."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def joining(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Places of the edges that joined trees: a spanning forest of all edges so far, never more than n - 1 in total."""
        kept, live = [], np.arange(len(p))
        while True:
            a, b = self.root[p[live]], self.root[q[live]]
            apart = a != b
            live, low, high = live[apart], np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            if not len(live):
                return np.concatenate(kept) if kept else np.empty(0, np.int64)
            which, first = np.unique(high, return_index=True)
            self.root[which] = low[first]
            kept.append(live[first])
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up


def by_bucket(work: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Yields from work(bucket, bits, *payload) for every bucket of a partition that is sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        now: int | None = None
        for b in batches:
            bucket, *rest = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
            for a, z in zip([0, *cuts], [*cuts, len(bucket)]):
                if a == z:
                    continue
                if now is not None and bucket[a] != now:
                    yield from work(now, *map(np.concatenate, zip(*held)))
                    held = []
                now = int(bucket[a])
                held.append([x[a:z] for x in rest])
        if held:
            yield from work(now, *map(np.concatenate, zip(*held)))

    return run


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).astype(np.int32)
