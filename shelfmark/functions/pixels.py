"""Perceptual hash and grayness of decoded pictures, as vectorised kernels over image bytes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

HASH_SIDE, KEPT, GRAY_SIDE = 32, 8, 64


@lru_cache(maxsize=256)
def lanczos(size: int, out: int) -> np.ndarray:
    """(out, size) weights of a three-lobed Lanczos resize whose support grows with the reduction."""
    scale = size / out
    reach = max(scale, 1.0)
    centre = (np.arange(out)[:, None] + 0.5) * scale - 0.5
    x = (np.arange(size)[None, :] - centre) / reach
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resize(pixels: np.ndarray, side: int) -> np.ndarray:
    """(side, side, channels) of whole values from (height, width, channels)."""
    h, w = pixels.shape[:2]
    out = np.einsum("ah,hwc,bw->abc", lanczos(h, side), pixels.astype(np.float64), lanczos(w, side), optimize=True)
    return np.clip(np.rint(out), 0, 255)


@lru_cache(maxsize=4)
def dct_matrix(n: int) -> np.ndarray:
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    m = np.cos((2 * i + 1) * k * np.pi / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


def phash(rgb: np.ndarray) -> int:
    """63 meaningful bits: whether each low frequency but the constant one lies above their median, row by row from bit 0."""
    luma = resize(rgb, HASH_SIDE) @ np.array([0.2126, 0.7152, 0.0722])
    d = dct_matrix(HASH_SIDE)
    low = (d @ np.floor(luma) @ d.T)[:KEPT, :KEPT].ravel()[1:]
    return sum(1 << i for i in np.flatnonzero(low > np.median(low)).tolist())


def nearest_rank(values: np.ndarray, percent: float) -> float:
    """The value at place round(percent/100 (n - 1)) of the sorted ones, halves rounded up; 0 of none."""
    if not len(values):
        return 0.0
    return float(np.sort(values)[int(percent / 100 * (len(values) - 1) + 0.5)])


def gray_score(rgb: np.ndarray) -> float:
    """95th percentile of the greatest gap between channels; 0 is black, white and gray only."""
    small = resize(rgb, GRAY_SIDE)
    return nearest_rank((small.max(axis=2) - small.min(axis=2)).ravel(), 95.0)


def rgb_of(height: float | None, width: float | None, channels: float | None, data: bytes | None) -> np.ndarray | None:
    """RGB of the image source's bytes, which are gray, BGR or BGRA; None if it couldn't decode them."""
    if data is None or height is None or not height > 0 or channels not in (1, 3, 4):
        return None
    x = np.frombuffer(data, np.uint8).reshape(int(height), int(width), int(channels))
    return np.repeat(x, 3, axis=2) if channels == 1 else x[:, :, 2::-1]


@F.pandas_udf(StructType([StructField("phash", StringType()), StructField("gray_score", DoubleType()), StructField("decode_error", StringType())]))
def _fingerprint(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.DataFrame:
    out = []
    for h, w, c, b in zip(height, width, channels, data):
        rgb = rgb_of(h, w, c, b)
        out.append((None, None, "cannot be decoded") if rgb is None else (f"{phash(rgb):016x}", gray_score(rgb), None))
    return pd.DataFrame(out, columns=["phash", "gray_score", "decode_error"])


def fingerprint_images(images: DataFrame) -> DataFrame:
    """path, phash, gray_score, decode_error of rows of Spark's image source; pictures that can't be decoded have only the error."""
    i = F.col("image")
    done = images.select(i["origin"].alias("path"), _fingerprint(i["height"], i["width"], i["nChannels"], i["data"]).alias("f"))
    return done.select("path", "f.phash", "f.gray_score", "f.decode_error")


def content_digest(content: Column) -> Column:
    """SHA-256 of the bytes in hex."""
    return F.sha2(content, 256)
