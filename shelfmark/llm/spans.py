"""Long spans that stand verbatim in more than one record."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.runtime import Written

_B = np.uint64(0xD6E8FEB86659FD93)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_B), n, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def window_hashes(codes: np.ndarray, size: int) -> dict[int, np.ndarray]:
    """Unmixed hashes of all windows of size, 2 size and 4 size code points, by doubling."""
    h: dict[int, np.ndarray] = {1: _mixed(codes.astype(np.uint64) + np.uint64(1))}
    n = 1
    while n * 2 <= size:
        h[n * 2] = h[n][: len(h[n]) - n] * _power(n) + h[n][n:]
        n *= 2
    whole, have = h[n], n
    for bit in sorted((k for k in h if k < n), reverse=True):
        if have + bit <= size:
            m = len(codes) - have - bit + 1
            whole = whole[:m] * _power(bit) + h[bit][have : have + m]
            have += bit
    double = whole[: len(whole) - size] * _power(size) + whole[size:]
    quad = double[: len(double) - 2 * size] * _power(2 * size) + double[2 * size :]
    return {size: whole, 2 * size: double, 4 * size: quad}


def _slide(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over each window of that width."""
    n = 1
    while n * 2 <= width:
        x = pick(x[:-n], x[n:])
        n *= 2
    return pick(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


def anchors(codes: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Positions that stand for every window of `length` within one record, and the window hashes.

    codes: code points of several records on end, ends: where each stops. A position is taken if its
    hash of length/4 is the least in some window of `length`; equal windows take equal positions, so
    two records that share a span share an anchor in it.
    """
    size = length // 4
    if len(codes) < length:
        return np.empty(0, np.int64), {}
    h = window_hashes(codes, size)
    key = _mixed(h[size])
    n = len(codes) - length + 1
    width = length - size + 1
    least = _slide(key, width, np.minimum)[:n]
    starts = np.concatenate(([0], ends[:-1]))
    inside = np.zeros(len(codes) + 1, np.int8)
    ok = ends - starts >= length
    np.add.at(inside, starts[ok], 1)
    np.add.at(inside, (ends - length + 1)[ok], -1)
    valid = np.cumsum(inside[:n]).astype(bool)
    least = np.where(valid, least, np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    most = _slide(np.concatenate((pad, least, pad)), width, np.maximum)
    m = min(len(key), len(most))
    return np.flatnonzero((key[:m] == most[:m]) & (most[:m] > 0)), h


def _texts(b: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, code points on end, ends) of the batch's texts of at least that length, in parts of about a million code points."""
    ids, texts, n = [], [], 0
    for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
        if doc is None or text is None or len(text) < length:
            continue
        ids.append(doc)
        texts.append(text)
        n += len(text)
        if n > 1_000_000:
            yield _joined(ids, texts)
            ids, texts, n = [], [], 0
    if ids:
        yield _joined(ids, texts)


def _joined(ids: list[int], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array(ids, np.int64), np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum([len(t) for t in texts])


def _starts(ends: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], ends[:-1]))


def corpus_anchors(documents: DataFrame, length: int) -> DataFrame:
    """h, near, doc_id, at: each anchor with the hash of its window of length/4, and 21-bit hashes of the longer windows around it.

    near holds those of the three windows of 3/4 length that start 0, 1/4 and 1/2 length before the
    anchor; 0 stands for a window beyond the text. They only serve to drop anchors early; windows of
    the whole length are compared by 64 bits later on, and then as texts.
    """
    size = length // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, codes, ends in _texts(b, length):
                at, h = anchors(codes, ends, length)
                which = np.searchsorted(ends, at, side="right")
                own = at - _starts(ends)[which]

                def short(hashes: np.ndarray, before: int) -> np.ndarray:
                    start = at - before * size  # noqa: B023
                    x = _mixed(hashes[np.clip(start, 0, len(hashes) - 1)]) >> np.uint64(43)
                    return np.where((own < before * size) | (start + 3 * size > ends[which]), np.uint64(0), np.maximum(x, np.uint64(1))).astype(np.int64)  # noqa: B023

                near = key = np.empty(0, np.int64)
                if len(at):
                    three = h[2 * size][: len(codes) - 3 * size + 1] * _power(size) + h[size][2 * size :]
                    near = short(three, 0) | short(three, 1) << 21 | short(three, 2) << 42
                    key = _mixed(h[size][at]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(near), pa.array(ids[which]), pa.array(own.astype(np.int32))], ["h", "near", "doc_id", "at"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "h bigint, near bigint, doc_id bigint, at int")


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that rows of two documents have. The partial minimum and maximum make a hot key one row per task."""
    return rows.groupBy(*keys).agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b")).where("_a < _b").select(*keys)


#: Rows of ids that are broadcast so that texts or slices needn't be shuffled, some 32 MB; with more of them they are.
BROADCAST_IDS = 500_000


def _verbatim(windows: DataFrame) -> DataFrame:
    """The windows (h, doc_id, text and others) whose text stands in two documents. Where texts of one hash differ they are told apart by the texts themselves."""
    seen = windows.groupBy("h").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b"), (F.min("text") != F.max("text")).alias("_mixed")).where("_a < _b")
    seen = Written(seen.select("h", "_mixed"), "verbatim").df
    mixed = windows.join(seen.where("_mixed"), "h", "left_semi")
    same = windows.drop("text").join(seen.where("NOT _mixed"), "h", "left_semi")
    return same.unionByName(mixed.join(_repeated(mixed, ["h", "text"]), ["h", "text"]).drop("text").select(*same.columns))


def _survivors(documents: DataFrame, length: int) -> DataFrame:
    """doc_id, at of the anchors whose window of length/4, and then one of 3/4 length around it, another document has too."""
    first = Written(corpus_anchors(documents, length), "anchors")
    one = Written(first.df.join(_repeated(first.df, ["h"]), "h"), "level1")
    first.drop()
    code = lambda k: F.shiftrightunsigned("near", 21 * k).bitwiseAND(F.lit((1 << 21) - 1))
    longer = one.df.select(F.explode(F.array(*(F.when(code(k) != 0, F.xxhash64("h", F.lit(k), code(k))) for k in range(3)))).alias("key"), "doc_id", "at").where(F.col("key").isNotNull())
    two = Written(longer.join(_repeated(longer, ["key"]), "key").select("doc_id", "at").distinct(), "level2")
    one.drop()
    return two.df


def _slices(documents: DataFrame, alive: DataFrame, length: int) -> DataFrame:
    """doc_id, at, base, slice, near, full: for each anchor the text that any window around it can cover, from place `base` on.

    near has the hashes of the three windows of 3/4 length that start 0, 1/4 and 1/2 length before the
    anchor, full those of the four of the whole length; null beyond the text. Texts are joined to the
    anchors once, and only those that have some; all that follows reads the slices.
    """
    size = length // 4
    # anchors of one document, of which its text holds a bounded number
    listed = Written(alive.groupBy("doc_id").agg(F.collect_set("at").alias("places")), "places").df
    texts = documents.select(F.col("doc_id").cast("bigint"), "text").where(F.char_length("text") >= length)
    if listed.count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(listed.select("doc_id")), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, text, places in zip(b.column(0), b.column(1), b.column(2)):
                text, at = text.as_py(), np.sort(places.values.to_numpy())
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                h = window_hashes(codes, size)
                three = h[2 * size][: len(codes) - 3 * size + 1] * _power(size) + h[size][2 * size :]

                def lists(hashes: np.ndarray, width: int, count: int) -> pa.Array:
                    start = at[:, None] - size * np.arange(count)  # noqa: B023
                    ok = (start >= 0) & (start + width <= len(codes))  # noqa: B023
                    values = _mixed(hashes[np.clip(start, 0, len(hashes) - 1)]).view(np.int64).ravel()
                    return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * count), pa.array(values, mask=~ok.ravel()))  # noqa: B023

                base = np.maximum(at - 3 * size, 0)
                pieces = pa.array([text[i:j] for i, j in zip(base.tolist(), (at + length).tolist())], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), doc.as_py(), np.int64)), pa.array(at.astype(np.int32)), pa.array(base.astype(np.int32)), pieces, lists(three, 3 * size, 3), lists(h[4 * size], length, 4)], ["doc_id", "at", "base", "slice", "near", "full"])

    return texts.join(listed, "doc_id").mapInArrow(run, "doc_id bigint, at int, base int, slice string, near array<bigint>, full array<bigint>")


def _every_window(slices: DataFrame, length: int) -> DataFrame:
    """h, doc_id, start, at: for each slice (doc_id, at, base, slice, kind) the windows of `length` that hold the kind's window of 3/4 length, each once, with one of the anchors whose slice covers it."""
    size = length // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, at, base, text, kind in zip(*(c.to_pylist() for c in b.columns)):
                h = window_hashes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), size)[4 * size]
                start = at - base - kind * size - np.arange(size + 1)
                start = start[(start >= 0) & (start < len(h))]
                if len(start):
                    yield pa.RecordBatch.from_arrays([pa.array(_mixed(h[start]).view(np.int64)), pa.array(np.full(len(start), doc, np.int64)), pa.array((start + base).astype(np.int32)), pa.array(np.full(len(start), at, np.int32))], ["h", "doc_id", "start", "at"])

    every = slices.select("doc_id", "at", "base", "slice", "kind").mapInArrow(run, "h bigint, doc_id bigint, start int, at int")
    return every.groupBy("h", "doc_id", "start").agg(F.min("at").alias("at"))


def _with_slices(alive: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (doc_id, at and others) with base and slice; only a bounded number of rows is broadcast, more are joined."""
    slices = alive.select("doc_id", "at", "base", "slice")
    return slices.join(F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows, ["doc_id", "at"])


def shared_windows(documents: DataFrame, length: int, all_of_them: bool) -> DataFrame:
    """(doc_id, start) of windows of `length` that another document has too.

    Windows grow level by level: those of a quarter of the length at anchors (anchors(): every window
    of the length holds one, chosen by its content alone) are kept if another document has them, then
    those of three quarters around the anchor, then those of the full length at four places. What
    stands alone at one level is not extended. (Three quarters instead of a half: a half around the
    anchor is part of each, and one level less is shuffled.) A shared window that holds the anchor at
    none of the four places holds one of three windows of 3/4 length; only where one of these stands
    elsewhere are all places between compared, one by one.

    All this goes by hashes; windows of the whole length that pass are then compared as texts, so
    that what comes out stands verbatim in both documents. Longer spans are covered by their windows
    of the length asked for, so no level beyond it is needed.

    With all_of_them the windows found cover everything that is shared; else at least one window
    comes out for every document that has any, and documents settled early are not looked at again.
    """
    if length < 4 or length % 4:
        raise ValueError("the length must be a multiple of 4")
    alive = Written(_slices(documents, _survivors(documents, length), length), "level4").df
    size = length // 4
    places = alive.select("doc_id", "at", F.posexplode("full").alias("k", "h")).where(F.col("h").isNotNull())
    text = lambda start: F.col("slice").substr(start - F.col("base") + 1, F.lit(length)).alias("text")
    told = lambda rows: Written(_with_slices(alive, rows).select("h", "doc_id", "at", "k", text(F.col("at") - F.col("k") * size)), "told").df
    found = Written(places.join(_repeated(places, ["h"]), "h"), "found").df
    if all_of_them:
        hits = Written(_verbatim(told(found)), "hits").df
        # an anchor is settled if all its windows within the text stand elsewhere: they cover all that can be shared around it
        settled = hits.groupBy("doc_id", "at").agg(F.count("*").alias("n"))
        rest = alive.join(settled, ["doc_id", "at"], "left").where(F.coalesce("n", F.lit(0)) < 4)
    else:
        # one window a document will do; only where its text differs from the others' are all looked at
        one = found.groupBy("doc_id").agg(F.min("h").alias("h")).select("h").distinct()
        hits = Written(_verbatim(told(found.join(one, "h", "left_semi"))), "hits").df
        unsure = found.join(hits.select("doc_id").distinct(), "doc_id", "left_anti")
        if unsure.head() is not None:
            hits = hits.unionByName(Written(_verbatim(told(found.join(unsure.select("h").distinct(), "h", "left_semi"))), "hits").df)
        rest = alive.join(hits.select("doc_id").distinct(), "doc_id", "left_anti")
    kinds = lambda df: df.select("doc_id", "at", F.posexplode("near").alias("kind", "h")).where(F.col("h").isNotNull())
    asked = Written(kinds(rest).select("kind", "h").distinct(), "asked").df
    held = Written(kinds(alive).join(F.broadcast(asked) if asked.count() <= BROADCAST_IDS else asked, ["kind", "h"]), "held").df
    wanted = Written(held.join(_repeated(held, ["kind", "h"]), ["kind", "h"]).select("doc_id", "at", "kind").distinct(), "wanted").df
    probes = Written(_every_window(_with_slices(alive, wanted), length), "probes").df
    met = Written(probes.join(_repeated(probes, ["h"]), "h"), "met").df
    late = _verbatim(Written(_with_slices(alive, met).select("h", "doc_id", "start", text(F.col("start"))), "told").df).select("doc_id", "start")
    return late.unionByName(hits.select("doc_id", (F.col("at") - size * F.col("k")).alias("start"))).distinct()


def documents_with_shared_spans(documents: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id): documents with a span of at least `length` code points that stands verbatim in another document too.

    Null texts and texts shorter than that share nothing; rows of one doc_id are one document; spans
    repeated within a document don't count. ValueError if length is no multiple of 4. See shared_windows().
    """
    return shared_windows(documents, length, all_of_them=False).select("doc_id").distinct()


def shared_spans(documents: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, first, last): disjoint stretches [first, last) of each document covered by spans that another document has too."""
    starts = shared_windows(documents, length, all_of_them=True)
    w = Window.partitionBy("doc_id").orderBy("start")
    fresh = F.when(F.col("start") <= F.lag("start").over(w) + length, 0).otherwise(1)
    runs = starts.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "run").agg(F.min("start").alias("first"), (F.max("start") + length).alias("last")).drop("run")


def shared_share(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """For each document with shared spans: how many code points they cover, and of how many."""
    covered = spans.groupBy("doc_id").agg(F.count("*").alias("spans"), F.sum(F.col("last") - F.col("first")).alias("shared_chars"))
    return covered.join(documents.select("doc_id", F.char_length("text").cast("bigint").alias("chars")), "doc_id")
