"""The cache of small pictures: names, what is missing, writing, and its upkeep on disk."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import jpeg, names
from shelfmark.functions.pixels import rgb_of
from shelfmark.operators import cache
from shelfmark.runtime import Written
from shelfmark.sources.scan import _ENTRIES, _entries, delete_all

#: Fixed value: the longer edge of a preview.
PREVIEW_EDGE = 1600


def fitted(width: int, height: int, edge: int) -> tuple[int, int]:
    """The size with the same proportions whose longer side is `edge`; a side is 1 at least."""
    ratio = edge / max(width, height)
    return max(1, round(width * ratio)), max(1, round(height * ratio))


@lru_cache(maxsize=256)
def triangle(size: int, out: int) -> np.ndarray:
    """(out, size) weights of a linear resize whose support grows with the reduction."""
    scale = size / out
    centre = (np.arange(out)[:, None] + 0.5) * scale - 0.5
    w = np.maximum(0.0, 1 - np.abs(np.arange(size)[None, :] - centre) / max(scale, 1.0))
    return w / w.sum(axis=1, keepdims=True)


def shrink(rgb: np.ndarray, edge: int) -> np.ndarray:
    h, w = rgb.shape[:2]
    tw, th = fitted(w, h, edge)
    out = np.einsum("ah,hwc,bw->abc", triangle(h, th), rgb.astype(np.float64), triangle(w, tw), optimize=True)
    return np.clip(np.rint(out), 0, 255)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """name, mtime, size of the files in the cache; none if there is no such folder."""
    level = spark.createDataFrame([(folder, folder)], "path string, root string")
    return level.mapInPandas(_entries, _ENTRIES).where("NOT folder").select(names.base_name(F.col("path")).alias("name"), "mtime", "size")


def make_thumbs(images: DataFrame, files: DataFrame, folder: str, edge: int) -> DataFrame:
    """id, name, error of every normal file's thumbnail that the cache lacks, written where its picture is decoded.

    images: rows of Spark's image source. A name tells id and mtime, so a changed file gets a new
    one; what is there is not written again. Each is written under another name and then renamed, so
    that nobody sees half a file and a repeated task does no harm. Files without a picture, and
    pictures that can't be decoded, have an error.
    """
    wanted = cache.missing_thumbs(files, manifest(files.sparkSession, folder)).join(files.select("id", "path"), "id")
    picture = images.select(F.regexp_replace(F.col("image.origin"), "^file:/*", "/").alias("path"), F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("c"), F.col("image.data").alias("data"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for pdf in frames:
            out = []
            for id_, name, h, w, c, data in zip(pdf["id"], pdf["name"], pdf["h"], pdf["w"], pdf["c"], pdf["data"]):
                rgb = rgb_of(h, w, c, data)
                if rgb is None:
                    out.append((id_, name, "cannot be decoded"))
                    continue
                part = os.path.join(folder, f"{name}.{uuid.uuid4().hex}.tmp")
                with open(part, "wb") as f:
                    f.write(jpeg.encode(shrink(rgb, edge)))
                os.replace(part, os.path.join(folder, name))
                out.append((id_, name, None))
            yield pd.DataFrame(out, columns=["id", "name", "error"])

    return Written(wanted.join(picture, "path", "left").select("id", "name", "h", "w", "c", "data").mapInPandas(run, "id bigint, name string, error string"), "thumbs").df


def trim(spark: SparkSession, folder: str, limit: int) -> DataFrame:
    """removed, freed, remaining after the oldest entries were deleted down to 80 % of the limit; a delete that fails frees nothing."""
    have = Written(manifest(spark, folder), "manifest").df
    gone = cache.evicted(have, limit).select("size", F.concat(F.lit(folder.rstrip("/") + "/"), "name").alias("path"))
    done = Written(delete_all(gone, "path").where("error IS NULL"), "trimmed").df
    freed = done.join(have.select(F.concat(F.lit(folder.rstrip("/") + "/"), "name").alias("path"), "size"), "path").agg(F.count("*").alias("removed"), F.coalesce(F.sum("size"), F.lit(0)).alias("freed"))
    # two rows of totals
    return freed.join(F.broadcast(cache.cache_size(have))).select("removed", "freed", (F.col("bytes") - F.col("freed")).alias("remaining"))
