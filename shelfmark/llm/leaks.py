"""Evaluation passages that stand in the corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.runtime import Written

WORD = re.compile(r"[^\W_]+")
_TIME = r"\d{1,3}\s*:\s*\d{1,2}(?:\s*:\s*\d{1,2})?(?:\s*[,.:]\s*\d{1,4})?"
#: A line with two times and an arrow between them, or a line of digits only.
DROPPED_LINE = re.compile(rf"^[^\w\n]*(?:{_TIME}\s*(?:[-–—=]*>|→)\s*{_TIME}[^\n]*|\d+[^\S\n]*)$", re.M)
BRACKETS = re.compile(r"<[^<>]*>|\{[^{}]*\}|\[[^\[\]]*\]|\([^()]*\)")
LINE_END = re.compile(r"\r\n?|[  \x85\x0b\x0c]")


def words_of(text: str | None) -> list[str]:
    """The unbroken runs of letters or digits, in lower case."""
    return [w.lower() for w in WORD.findall(text or "")]


def dialogue_words(text: str | None) -> list[str]:
    """words_of() a subtitle file without its timing lines, lines of digits, and what is in brackets of any kind."""
    if not text:
        return []
    if "\r" in text or not text.isascii():
        text = LINE_END.sub("\n", text)
    return words_of(BRACKETS.sub(" ", DROPPED_LINE.sub("", text)))


class Numbers(dict):
    """64-bit numbers of words, the same in every process; it starts anew when it has grown large."""

    MOST = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = n = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return n

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _shingles(numbers: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words."""
    n = len(numbers) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + numbers[k : k + n]
    return out ^ (out >> np.uint64(32))


#: Bits of the filter of the items' shingles for each of them, and the places it looks at.
BITS_EACH, LOOKS = 32, 4
#: The filter's greatest size, 32 MB. With more shingles than it is made for it lets more through and loses none.
FILTER_BITS = 1 << 28


def shingle_filter(shingles: DataFrame, most: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter, as 64-bit words, of distinct shingle hashes (column h), put together where they are; at most `most` bits come to the driver."""
    bits = 64
    while bits < min(most, BITS_EACH * shingles.count()):
        bits *= 2
    low, high = F.col("h").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("h", 32).bitwiseOR(F.lit(1))
    places = shingles.select(F.explode(F.array(*((low + high * k).bitwiseAND(F.lit(bits - 1)) for k in range(LOOKS)))).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("b")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


def in_filter(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the hashes that may be in the filter."""
    at, mask = np.arange(len(h)), np.uint64(len(words) * 64 - 1)
    for k in range(LOOKS):
        x = h[at]
        p = ((x & np.uint64(0xFFFFFFFF)) + ((x >> np.uint64(32)) | np.uint64(1)) * np.uint64(k)) & mask
        at = at[(words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1]
    return at


def item_windows(items: DataFrame, words: int, shingle: int) -> DataFrame:
    """item_id, window (its words), shingles (their hashes) of every run of `words` words of a passage, distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers()
        for b in batches:
            out = []
            for item, passage in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = words_of(passage)
                h = _shingles(numbers.of(own), shingle).view(np.int64)
                out += [(item, own[i : i + words], h[i : i + words - shingle + 1].tolist()) for i in range(len(own) - words + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.string())), pa.array([x[2] for x in out], pa.list_(pa.int64()))], ["item_id", "window", "shingles"])

    known = items.select(F.col("item_id").cast("bigint"), "passage").dropna().distinct()
    return known.mapInArrow(run, "item_id bigint, window array<string>, shingles array<bigint>").distinct()


def leaked_items(documents: DataFrame, items: DataFrame, words: int = 12, shingle: int = 5, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, item_id): documents that hold `words` consecutive words of an item's passage, markup and timing of the document left out.

    documents: doc_id, text. items: item_id, passage. Null and empty texts and passages hold nothing,
    passages of fewer than `words` words can't leak; rows with null ids are left out, repeated rows
    count once. Items stay a table, however many; the corpus is read once.

    A window of `words` words is contained only if all its shingles are, so its rarest one is the
    necessary prefix. The pass over the corpus keeps the places whose shingle is in a filter of the
    items' shingles, of bounded size, with the words around them. Over these, which hold every
    occurrence of an item's shingle, shingles are counted by document. A window with a shingle that no
    document has is dropped; the others are joined by their rarest shingle, a hit must leave room for
    the whole window in its document (length and position), and the words are compared one by one.
    """
    if words < shingle:
        raise ValueError("a window must hold a shingle")
    spark = documents.sparkSession
    windows = Written(item_windows(items, words, shingle), "windows").df
    asked = Written(windows.select(F.explode("shingles").alias("h")).distinct(), "shingles").df
    shared = spark.sparkContext.broadcast(shingle_filter(asked, filter_bits))
    before = words - shingle

    def hits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, numbers = shared.value, Numbers()
        for b in batches:
            docs, hashes, backs, contexts = [], [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = dialogue_words(text)
                if doc is None or len(own) < shingle:
                    continue
                h = _shingles(numbers.of(own), shingle)
                for at in in_filter(wanted, h).tolist():
                    start = max(0, at - before)
                    docs.append(doc)
                    hashes.append(h[at])
                    backs.append(at - start)
                    contexts.append(own[start : at + words])
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(backs, pa.int32()), pa.array(contexts, pa.list_(pa.string()))], ["doc_id", "h", "back", "context"])

    hits = Written(documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(hits_of, "doc_id bigint, h bigint, back int, context array<string>").join(asked, "h", "left_semi"), "hits").df
    df = hits.groupBy("h").agg(F.count_distinct("doc_id").alias("df"))
    texts = windows.select("window", "shingles").distinct()
    numbered = texts.select("window", F.posexplode("shingles").alias("offset", "h"))
    rarest = numbered.join(df, "h", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "offset")).alias("r")).where("r.df > 0")
    found = hits.join(rarest.select("window", "r.h", "r.offset"), "h")
    start = F.col("back") - F.col("offset")
    fits = (start >= 0) & (start + words <= F.size("context"))
    held = found.where(fits).where(F.slice("context", F.greatest(start, F.lit(0)) + 1, words) == F.col("window")).select("doc_id", "window").distinct()
    return held.join(windows.select("item_id", "window"), "window").select("doc_id", "item_id").distinct()


def leak_report(leaks: DataFrame, items: DataFrame) -> DataFrame:
    """For each suite the items that leaked and the documents that hold them."""
    return leaks.join(items.select("item_id", "suite").distinct(), "item_id").groupBy("suite").agg(F.count_distinct("item_id").alias("items"), F.count_distinct("doc_id").alias("docs"))
