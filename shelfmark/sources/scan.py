"""Folders of pictures as records: listing, header reading, thumbnails, relocation."""

from __future__ import annotations

import hashlib
import os
import re
import shutil
import struct
import time
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import names
from shelfmark.functions.scalars import short_side
from shelfmark.runtime import Written, shuffle_partitions

#: Fixed value: the extensions taken for pictures.
IMAGE_EXTS = ("jpg", "jpeg", "png", "gif", "webp", "bmp")
PREFIX = 64 * 1024


_ENTRIES = "path string, root string, size bigint, mtime bigint, folder boolean"


def _entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Files and folders right below each folder; what can't be read is passed over, links aren't followed."""
    for pdf in frames:
        for path, root in zip(pdf["path"], pdf["root"]):
            out = []
            try:
                with os.scandir(path) as entries:
                    for e in entries:
                        try:
                            if e.is_dir(follow_symlinks=False):
                                out.append((e.path, root, None, None, True))
                            elif e.is_file(follow_symlinks=False):
                                st = e.stat(follow_symlinks=False)
                                out.append((e.path, root, st.st_size, max(0, int(st.st_mtime // 1)), False))
                        except OSError:
                            continue
                        if len(out) >= 10_000:
                            yield pd.DataFrame(out, columns=["path", "root", "size", "mtime", "folder"]).astype({"size": "Int64", "mtime": "Int64"})
                            out = []
            except OSError:
                pass
            if out:
                yield pd.DataFrame(out, columns=["path", "root", "size", "mtime", "folder"]).astype({"size": "Int64", "mtime": "Int64"})


def list_files(spark: SparkSession, roots: list[str], exts: tuple[str, ...] = IMAGE_EXTS) -> DataFrame:
    """path, root, size, mtime, ext of every file below the roots with one of these extensions in any case.

    Roots are folders that all executors see, with or without file: in front; ValueError if one is
    no folder. Hidden and empty files are listed as well. Folders are read level by level where the
    rows are; a level's folders are spread over tasks, files of one folder come as a stream. A file
    under two roots comes out once, under the longer root.
    """
    roots = [re.sub("^file:/*", "/", r) for r in roots]
    for r in roots:
        if not os.path.isdir(r):
            raise ValueError(f"not a folder: {r}")
    level = spark.createDataFrame([(r, r) for r in roots], "path string, root string")
    found = None
    while level.head() is not None:
        seen = Written(level.repartition(shuffle_partitions(spark)).mapInPandas(_entries, _ENTRIES), "listing").df
        files = seen.where("NOT folder").drop("folder")
        found = files if found is None else found.unionByName(files)
        level = seen.where("folder").select("path", "root")
    if found is None:
        return spark.createDataFrame([], "path string, root string, size bigint, mtime bigint, ext string")
    pictures = found.withColumn("ext", names.extension(F.col("path"))).where(F.col("ext").isin(*exts))
    return pictures.groupBy("path").agg(F.max_by(F.struct("root", "size", "mtime", "ext"), F.length("root")).alias("f")).select("path", "f.root", "f.size", "f.mtime", "f.ext")


def sniff(head: bytes) -> tuple[str, int, int] | None:
    """(format, width, height) from a file's first bytes, None if they don't tell."""
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
        return ("png", *struct.unpack(">II", head[16:24]))
    if head[:6] in (b"GIF87a", b"GIF89a") and len(head) >= 10:
        return ("gif", *struct.unpack("<HH", head[6:10]))
    if head[:2] == b"BM" and len(head) >= 26:
        w, h = struct.unpack("<ii", head[18:26])
        return "bmp", w, abs(h)
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP" and len(head) >= 30:
        kind = head[12:16]
        if kind == b"VP8X":
            return "webp", int.from_bytes(head[24:27], "little") + 1, int.from_bytes(head[27:30], "little") + 1
        if kind == b"VP8L":
            bits = int.from_bytes(head[21:25], "little")
            return "webp", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        w, h = struct.unpack("<HH", head[26:30])
        return "webp", w & 0x3FFF, h & 0x3FFF
    if head[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(head):
            if head[at] != 0xFF:
                return None
            marker = head[at + 1]
            if marker == 0xFF or marker == 0x01 or 0xD0 <= marker <= 0xD8:
                at += 1 if marker == 0xFF else 2
                continue
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", head[at + 5 : at + 9])
                return "jpeg", w, h
            at += 2 + struct.unpack(">H", head[at + 2 : at + 4])[0]
    return None


def retrying(read: Callable[[], Any], attempts: int = 4, pause: float = 0.2) -> Any:
    """What read() gives; another program may hold a file for a moment."""
    for k in range(attempts):
        try:
            return read()
        except OSError:
            if k == attempts - 1:
                raise
            time.sleep(pause)
    return None


def read_retrying(path: str, size: int = -1) -> bytes:
    """A file's first bytes, or all."""

    def read() -> bytes:
        with open(path, "rb") as f:
            return f.read(size)

    return retrying(read)


def digest(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while piece := f.read(1 << 20):
            h.update(piece)
    return h.hexdigest()


def _headers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        out = []
        for p in pdf["path"]:
            try:
                seen = sniff(read_retrying(p, PREFIX)) or sniff(read_retrying(p))
                error = None if seen else "header unreadable"
            except OSError as e:
                seen, error = None, f"io: {e.strerror}"
            out.append((p, *(seen or (None, None, None)), error))
        yield pd.DataFrame(out, columns=["path", "format", "width", "height", "decode_error"]).astype({"width": "Int64", "height": "Int64"})


def scan(spark: SparkSession, roots: list[str]) -> DataFrame:
    """One record per picture below the roots, as an upsert takes it: dimensions from the first 64 KiB, the whole file where those don't do."""
    listed = list_files(spark, roots)
    heads = listed.select("path").mapInPandas(_headers, "path string, format string, width bigint, height bigint, decode_error string")
    stem = names.stem(F.col("path"))
    none = lambda kind: F.lit(None).cast(kind)
    return listed.join(heads, "path").select(
        F.xxhash64("path").alias("id"), "path", "root", "size", "mtime", "ext", "format", "width", "height", short_side(F.col("width"), F.col("height")).alias("short_side"),
        names.parse_pid(stem).alias("pid"), names.parse_artist(stem).alias("artist"), none("string").alias("content_hash"), none("string").alias("phash"), none("double").alias("gray_score"),
        "decode_error", none("bigint").alias("scanned_at"), none("bigint").alias("fingerprinted_at"), F.lit("normal").alias("status"),
    )


def content_hashes(files: DataFrame) -> DataFrame:
    """path and SHA-256 of the whole content; null where it can't be read after four attempts. Read in pieces of 1 MiB."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for p in pdf["path"]:
                try:
                    out.append((p, retrying(lambda: digest(p))))  # noqa: B023
                except OSError:
                    out.append((p, None))
            yield pd.DataFrame(out, columns=["path", "content_hash"])

    return files.select("path").mapInPandas(run, "path string, content_hash string")


def relocate(source: str, target: str) -> int:
    """Move one file and return its size; across volumes it is copied, compared by hash, and then deleted. An existing target is never overwritten.

    A source that is gone while its target is there was moved by an earlier try of the same task.
    """
    if os.path.exists(target) and not os.path.exists(source):
        return os.path.getsize(target)
    if os.path.exists(target):
        raise FileExistsError(target)
    Path(target).parent.mkdir(parents=True, exist_ok=True)
    size = os.path.getsize(source)
    try:
        os.rename(source, target)
    except OSError:
        shutil.copy2(source, target)
        if retrying(lambda: digest(source)) != retrying(lambda: digest(target)):
            os.remove(target)
            raise OSError(f"copy differs: {target}") from None
        os.remove(source)
    return size


def relocate_all(moves: DataFrame, source: str = "original_path", target: str = "moved_path") -> DataFrame:
    """moves with `bytes` and `error` of each relocation, done where the rows are; a file that failed has only an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            done = []
            for a, b in zip(pdf["_source"], pdf["_target"]):
                try:
                    done.append((relocate(a, b), None))
                except OSError as e:
                    done.append((None, str(e)))
            yield pd.DataFrame({"_source": pdf["_source"], "_target": pdf["_target"], "bytes": pd.array([d[0] for d in done], "Int64"), "error": [d[1] for d in done]})

    return moves.select(F.col(source).alias("_source"), F.col(target).alias("_target")).mapInPandas(run, "_source string, _target string, bytes bigint, error string").withColumnsRenamed({"_source": source, "_target": target})


def delete_all(rows: DataFrame, path: str) -> DataFrame:
    """rows with `bytes` of the deleted file (0 if there was none) and `error` where it couldn't be deleted."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            done = []
            for p in pdf["_path"]:
                try:
                    size = os.path.getsize(p) if os.path.exists(p) else 0
                    if os.path.exists(p):
                        os.remove(p)
                    done.append((size, None))
                except OSError as e:
                    done.append((None, str(e)))
            yield pd.DataFrame({"_path": pdf["_path"], "bytes": pd.array([d[0] for d in done], "Int64"), "error": [d[1] for d in done]})

    return rows.select(F.col(path).alias("_path")).distinct().mapInPandas(run, "_path string, bytes bigint, error string").withColumnRenamed("_path", path)


def folder_names(spark: SparkSession, folder: str) -> DataFrame:
    """name of everything that lies right in a folder; none if there is no such folder."""
    level = spark.createDataFrame([(folder, folder)], "path string, root string")
    return level.mapInPandas(_entries, _ENTRIES).select(names.base_name(F.col("path")).alias("name"))
