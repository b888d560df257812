"""Duplicates of new batches in all that came before, by an incremental index."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import hamming
from shelfmark.runtime import Written, delete_path, shared_dir, shuffle_partitions
from shelfmark.tables import current_files, phash_bits, valid_hash

#: Rows that a slot of the index is planned for: slots grow in number with what is appended, not in size.
SLOT_ROWS = 250_000
#: Generations after which the next append puts all of them together.
MOST_GENERATIONS = 16
#: Distinct keys that are broadcast to leave out other rows before a shuffle, some 64 MB; beyond it they are joined.
BROADCAST_KEYS = 2_000_000


class PrefixIndex:
    """Inverted index of fingerprints' rare-token prefixes, on disk, partitioned by token.

    A posting is (bucket, bits, stamp): the fingerprint under one of its prefix tokens, and the
    number of the batch that brought it first; content hashes are kept likewise. Tokens are ordered by
    how rare they were in the batch that founded the index; that order is stored and never changes,
    as a prefix filter needs. Each append is a generation of its own, in slots by the hash of the
    bucket, as many as its rows ask for. Tokens that more than `limit` of a generation's fingerprints
    hold are divided there by the next shared token, and a probe is routed for each generation as
    that was; so a token that grows hot later is divided from then on, and compact(), which puts
    generations together and routes them anew, divides the rest.

    append() writes the new batch's postings and reads nothing else; probe() opens the slots that the
    batch's tokens name, and compares postings with the batch, not with each other.
    """

    def __init__(self, spark: SparkSession, path: str, radius: int = 6, limit: int = 100_000):
        self.spark, self.path, self.radius, self.limit = spark, path, radius, limit
        # neither changes once written
        self._orders: tuple[int, dict[int, int]] | None = None
        self._cuts: dict[int, list[int]] = {}

    def found(self, fingerprints: DataFrame, rows: int) -> PrefixIndex:
        """Start the index with the token order of these fingerprints (column bits)."""
        parts = hamming.plan_parts(rows, self.radius)
        counts = hamming.token_counts(fingerprints, parts)
        data = [(parts, int(t), int(n)) for t, n in counts.items()] or [(parts, 0, 0)]
        self.spark.createDataFrame(data, "parts int, token int, n bigint").coalesce(1).write.parquet(f"{self.path}/order")
        return self

    def drop(self) -> None:
        delete_path(self.spark, self.path)

    def _order(self) -> tuple[int, dict[int, int]]:
        if self._orders is None:
            rows = self.spark.read.parquet(f"{self.path}/order").collect()
            self._orders = rows[0]["parts"], {r["token"]: r["n"] for r in rows}
        return self._orders

    def generations(self, part: str) -> list[tuple[int, int]]:
        """(number, slots) of the generations of postings or hashes that are written to the end."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        found = [s.getPath() for s in fs.listStatus(folder)]
        return sorted(tuple(map(int, p.getName().split("."))) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _cut(self, number: int) -> list[int]:
        """The tokens that a generation divides."""
        if number not in self._cuts:
            self._cuts[number] = [r["token"] for r in self.spark.read.parquet(f"{self.path}/cut/{number}").collect()]
        return self._cuts[number]

    def append(self, fingerprints: DataFrame) -> None:
        """Add postings of distinct fingerprints: bits and stamp."""
        have = self.generations("postings")
        if len(have) >= MOST_GENERATIONS:
            self.compact()
            have = self.generations("postings")
        self._generation(fingerprints, 1 + max((n for n, _ in have), default=0))

    def _generation(self, fingerprints: DataFrame, number: int) -> None:
        parts, counts = self._order()
        own = hamming.token_counts(fingerprints, parts)
        self._cuts[number] = cut = [t for t, n in own.items() if n > self.limit]
        self.spark.createDataFrame([(t,) for t in cut], "token int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/cut/{number}")
        routed = hamming.route(fingerprints, ["stamp"], parts, self.radius, counts, self.limit, blocked=False, cut=cut)
        # each fingerprint has one token of every part
        rows = sum(n for t, n in own.items() if t < 1 << 16)
        written = self._add(routed.select("bucket", "bits", F.col("stamp").cast("int").alias("stamp")), "bucket", "postings", number, rows * (self.radius + 1))
        # a row per bucket, far fewer than there are postings
        written.groupBy("bucket").agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/sizes/{number}")

    def append_hashes(self, hashes: DataFrame) -> None:
        """Add distinct content hashes: hash and stamp."""
        number = 1 + max((n for n, _ in self.generations("hashes")), default=0)
        self._add(hashes.select("hash", F.col("stamp").cast("int").alias("stamp")), "hash", "hashes", number, hashes.count())

    def _add(self, rows: DataFrame, key: str, part: str, number: int, expected: int) -> DataFrame:
        slots = max(1, -(-expected // SLOT_ROWS))
        placed = rows.withColumn("slot", _slot(key, slots)).repartition(slots, "slot").sortWithinPartitions("slot", key)
        placed.write.mode("overwrite").partitionBy("slot").option("compression", "zstd").parquet(f"{self.path}/{part}/{number}.{slots}")
        return self._read(part, ", ".join(f"{c} {t}" for c, t in rows.dtypes), (number, slots))

    def compact(self) -> None:
        """Put all generations together as one, routed anew. Should it break off, what is there twice does no harm."""
        for part, schema in (("postings", _POSTINGS), ("hashes", _HASHES)):
            old = self.generations(part)
            if len(old) < 2:
                continue
            rows = reduce(DataFrame.unionByName, (self._read(part, schema, g) for g in old))
            number = old[-1][0] + 1
            if part == "postings":
                prints = Written(rows.groupBy("bits").agg(F.min("stamp").cast("bigint").alias("stamp")), "fingerprints")
                self._generation(prints.df, number)
                prints.drop()
            else:
                self._add(rows, "hash", part, number, rows.count())
            for n, slots in old:
                delete_path(self.spark, f"{self.path}/{part}/{n}.{slots}")

    def _read(self, part: str, schema: str, generation: tuple[int, int]) -> DataFrame:
        return self.spark.read.schema(f"{schema}, slot int").parquet(f"{self.path}/{part}/{generation[0]}.{generation[1]}").drop("slot")

    def _named(self, part: str, schema: str, key: str, keys: DataFrame) -> DataFrame:
        """Rows of the index in the slots that the distinct keys fall in; other slots' files are not opened."""
        generations = self.generations(part)
        sizes = sorted({slots for _, slots in generations if slots > 1})
        # at most a number per slot
        named = keys.agg(*(F.collect_set(_slot(key, n)).alias(str(n)) for n in sizes)).head().asDict() if sizes else {}
        out = self.spark.createDataFrame([], schema)
        for n, slots in generations:
            rows = self.spark.read.schema(f"{schema}, slot int").parquet(f"{self.path}/{part}/{n}.{slots}")
            if slots > 1 and len(named[str(slots)]) < slots:
                rows = rows.where(F.col("slot").isin(named[str(slots)]))
            out = out.unionByName(rows.drop("slot"))
        return out

    def postings_for(self, probes: DataFrame) -> DataFrame:
        """(bucket, bits, stamp) of the buckets that the probes are in."""
        buckets = Written(probes.select("bucket").distinct(), "buckets").df
        few = buckets.count() <= BROADCAST_KEYS
        return self._named("postings", _POSTINGS, "bucket", buckets).join(F.broadcast(buckets) if few else buckets, "bucket", "left_semi")

    def sizes(self) -> DataFrame:
        """bucket and n, a row per generation: how many postings a bucket has."""
        numbers = [n for n, _ in self.generations("postings")]
        return self.spark.read.schema("bucket bigint, n bigint").parquet(*(f"{self.path}/sizes/{n}" for n in numbers)) if numbers else self.spark.createDataFrame([], "bucket bigint, n bigint")

    def known_hashes(self, hashes: DataFrame) -> DataFrame:
        """(hash) of the distinct hashes asked for that the index holds."""
        return hashes.select("hash").join(self._named("hashes", _HASHES, "hash", hashes), "hash", "left_semi")

    def routed_probes(self, fingerprints: DataFrame) -> DataFrame:
        """bucket, bits, stamp of the fingerprints, as the generations have theirs."""
        parts, counts = self._order()
        ways = {tuple(sorted(self._cut(n))) for n, _ in self.generations("postings")} or {()}
        routes = [hamming.route(fingerprints, ["stamp"], parts, self.radius, counts, self.limit, blocked=False, cut=list(cut)) for cut in sorted(ways)]
        return routes[0] if len(routes) == 1 else reduce(DataFrame.unionByName, routes).distinct()

    def probe(self, fingerprints: DataFrame) -> DataFrame:
        """(bits, first, known): the smallest stamp among postings within the radius, of the fingerprints that have one below their own `stamp`; known if one of these is equal.

        fingerprints: distinct bits, and stamp, the batch that asks; only postings of earlier stamps
        count. Only postings of buckets that a fingerprint is in are shuffled, and only fingerprints
        and postings are compared, not postings with each other.
        """
        parts, counts = self._order()
        rank = hamming.ranks(counts, parts)
        probes = Written(self.routed_probes(fingerprints).withColumn("extra", F.col("stamp") * 2 + 1).drop("stamp"), "probes").df
        postings = self.postings_for(probes).select("bucket", "bits", (F.col("stamp").cast("bigint") * 2).alias("extra"))
        radius = self.radius

        def work(bucket: int, bits: np.ndarray, extra: np.ndarray) -> Iterator[pa.RecordBatch]:
            first = np.argsort(extra & 1 ^ 1, kind="stable")  # who asks comes first, in each run too
            bits, extra = bits[first], extra[first]
            asks, stamp = (extra & 1) == 1, (extra >> 1).astype(np.int32)
            if not asks.any() or asks.all():
                return
            best = np.full(len(bits), np.iinfo(np.int32).max, np.int32)
            known = np.zeros(len(bits), bool)
            for rows, starts, lengths in hamming.runs_of(bucket, bits, parts, radius, rank):
                before = np.concatenate(([0], np.cumsum(asks[rows])))
                asking = before[starts + lengths] - before[starts]
                both = (asking > 0) & (asking < lengths)
                starts, asking, stored = starts[both], asking[both], (lengths - asking)[both]
                if not len(starts):
                    continue
                at = np.repeat(starts, asking) + np.arange(asking.sum()) - np.repeat(np.cumsum(asking) - asking, asking)
                base, left = np.repeat(starts + asking, asking), np.repeat(stored, asking)
                x, s = bits[rows].view(np.uint64), stamp[rows]
                live = np.arange(len(at))
                for lag in range(int(stored.max())):
                    live = live[left[live] > lag]
                    p, q = at[live], base[live] + lag
                    d = np.bitwise_count(x[p] ^ x[q])
                    good = np.flatnonzero((d <= radius) & (s[q] < s[p]))
                    np.minimum.at(best, rows[p[good]], s[q[good]])
                    known[rows[p[good[d[good] == 0]]]] = True
            hit = np.flatnonzero(asks & (best < stamp))
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(bits[hit]), pa.array(best[hit]), pa.array(known[hit])], ["bits", "first", "known"])

        postings, probes = hamming.in_blocks(postings, probes, self.limit, self.sizes())
        both = postings.unionByName(probes).repartition(shuffle_partitions(self.spark), "bucket").sortWithinPartitions("bucket")
        near = both.mapInArrow(hamming.by_bucket(work), "bits bigint, first int, known boolean")
        return near.groupBy("bits").agg(F.min("first").alias("first"), F.max("known").alias("known"))


_POSTINGS, _HASHES = "bucket bigint, bits bigint, stamp int", "hash binary, stamp int"


def _slot(key: str, slots: int) -> Column:
    return F.pmod(F.hash(key), F.lit(slots))


def batch_of(scanned_at: Column, batches: DataFrame) -> Column:
    """Number of the batch with start <= scanned_at < end, null for none; of several the smallest.

    The batches are a table of one row per arrival (8 here), read to the driver behind a check of
    its size.
    """
    rows = batches.select("batch_no", "batch_start", "batch_end").dropna().distinct().limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 batches: merge old ones first")
    out = F.lit(None).cast("int")
    for r in sorted(rows, key=lambda r: -r["batch_no"]):
        out = F.when((scanned_at >= r["batch_start"]) & (scanned_at < r["batch_end"]), r["batch_no"]).otherwise(out)
    return out


def batch_files(files: DataFrame, batches: DataFrame) -> DataFrame:
    """id, batch, hash, bits of the current rows that are in a batch and have a valid hash or a usable fingerprint."""
    columns = {"batch": batch_of(F.col("scanned_at"), batches), "hash": F.unhex(valid_hash(F.col("content_hash"))), "bits": phash_bits(F.col("phash"))}
    return current_files(files, columns).where(F.col("batch").isNotNull() & (F.col("hash").isNotNull() | F.col("bits").isNotNull()))


def repeats_of_earlier(rows: DataFrame, index: PrefixIndex, history: int = 0, keep: bool = True) -> DataFrame:
    """(file_id) of the rows (id, batch, hash, bits) that repeat an earlier batch's hash or come near its fingerprint.

    The history, batches up to that number, founds the index; then each later batch, in order, probes it and is appended. The
    work for a batch is its own rows and the buckets and slots of the index that they name. Equal
    hashes and fingerprints of a batch are one row each before anything is joined, so hot values cost one row,
    and what the index holds already isn't added again. Rows without a hash are judged by the
    fingerprint alone and the other way round; rows of the first batch never count. Without keep
    the last batch isn't appended, as nothing comes after it.
    """
    stamps = F.col("batch").cast("bigint").alias("stamp")
    # distinct within a batch; batches lie one after the other, so that one is read by itself
    own = lambda key, tag: Written(rows.where(F.col(key).isNotNull()).select(key, F.greatest(stamps, F.lit(history)).alias("stamp")).distinct().sortWithinPartitions("stamp"), tag).df
    prints, hashes = own("bits", "fingerprints"), own("hash", "hashes")
    old = prints.where(F.col("stamp") == history)
    index.found(old, old.count())
    index.append(old)
    index.append_hashes(hashes.where(F.col("stamp") == history))
    near, same = [], []
    later = sorted(r["batch"] for r in rows.where(F.col("batch") > history).select("batch").distinct().collect())
    for n in later:
        new, new_hashes = prints.where(F.col("stamp") == n), hashes.where(F.col("stamp") == n)
        close, held = Written(index.probe(new), "near").df, Written(index.known_hashes(new_hashes), "same").df
        near.append(close.select("bits", F.lit(n).alias("batch")))
        same.append(held.select("hash", F.lit(n).alias("batch")))
        if n != later[-1] or keep:
            index.append(new.join(close.where("known"), "bits", "left_anti"))
            index.append_hashes(new_hashes.join(held, "hash", "left_anti"))
    if not later:
        return rows.where("false").select(F.col("id").alias("file_id"))
    late = rows.where(F.col("batch") > history)
    by_print = late.select("id", "batch", "bits").join(reduce(DataFrame.unionByName, near), ["bits", "batch"]).select("id")
    by_hash = late.select("id", "batch", "hash").join(reduce(DataFrame.unionByName, same), ["hash", "batch"]).select("id")
    return by_print.unionByName(by_hash).distinct().select(F.col("id").alias("file_id"))


def repeated_files(files: DataFrame, batches: DataFrame, radius: int = 6) -> DataFrame:
    """repeats_of_earlier() for the catalogue's batches, by an index that lives as long as the call.

    Membership in a batch goes by current rows, so that a later scan takes a file out of an earlier
    batch; an index kept from an earlier state of the table would still hold it. Where batches are
    final, keep a PrefixIndex and give it each batch as it comes.
    """
    spark = files.sparkSession
    rows = Written(batch_files(files, batches).sortWithinPartitions("batch"), "batch-files")
    index = PrefixIndex(spark, f"{shared_dir(spark)}/prefix-index-{rows.path.rpartition('-')[2]}", radius)
    try:
        return repeats_of_earlier(rows.df, index, keep=False)
    finally:
        index.drop()
