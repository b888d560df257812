"""Numbers of fingerprints and dimensions, and their wording, whose units and phrases are fixed values. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_side(width: Column, height: Column) -> Column:
    """The smaller side, null if either is."""
    return F.when(width.isNotNull() & height.isNotNull(), F.least(width, height))


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits of two 64-bit numbers."""
    return F.bit_count(a.bitwiseXOR(b))


def to_hex(bits: Column) -> Column:
    """16 lower-case digits."""
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def from_hex(text: Column) -> Column:
    """1 to 16 hex digits as a signed 64-bit number, else null."""
    return F.conv(F.when(text.rlike("^[0-9a-fA-F]{1,16}$"), text), 16, -10).cast("bigint")


def pages_conflict(pid_a: Column, page_a: Column, pid_b: Column, page_b: Column) -> Column:
    """Two different known pages of one known work."""
    return F.coalesce((pid_a == pid_b) & (page_a != page_b), F.lit(False))


def similarity_percent(distance: Column) -> Column:
    return 100 - distance / 64 * 100


def status_or_normal(status: Column) -> Column:
    return F.when(status == "", "normal").otherwise(status)


def _fixed(x: Column, digits: int) -> Column:
    """Plain digits with that many decimals, half up, of a value that is exact in decimal."""
    return F.round(x.cast("decimal(38,12)"), digits).cast(f"decimal(38,{digits})").cast("string")


def format_bytes(size: Column) -> Column:
    """Size in words: KB whole, MB with one decimal and GB with two, either without from 100 on, TB with two; `0 MB` for null, 0 and less."""
    unit = lambda power: size / F.lit(1024.0**power)
    kb, mb, gb = 1024, 1024**2, 1024**3
    return (
        F.when(size.isNull() | (size <= 0), "0 MB")
        .when(size >= gb * kb, F.concat(_fixed(unit(4), 2), F.lit(" TB")))
        .when(size >= gb * 100, F.concat(_fixed(unit(3), 0), F.lit(" GB")))
        .when(size >= gb, F.concat(_fixed(unit(3), 2), F.lit(" GB")))
        .when(size >= mb * 100, F.concat(_fixed(unit(2), 0), F.lit(" MB")))
        .when(size >= mb, F.concat(_fixed(unit(2), 1), F.lit(" MB")))
        .otherwise(F.concat(_fixed(unit(1), 0), F.lit(" KB")))
    )


def format_count(n: Column) -> Column:
    """With a comma between thousands."""
    return F.format_number(n.cast("bigint"), 0)


def format_pixels(pixels: Column) -> Column:
    """Pixels in words, by 10^4 and 10^8; `0 像素` for null, 0 and less."""
    return (
        F.when(pixels.isNull() | (pixels <= 0), "0 像素")
        .when(pixels >= 10**8, F.concat(_fixed(pixels / F.lit(1e8), 2), F.lit(" 亿像素")))
        .when(pixels >= 10**4, F.concat(format_count(F.round(pixels / F.lit(1e4))), F.lit(" 万像素")))
        .otherwise(F.concat(format_count(pixels), F.lit(" 像素")))
    )


def format_eta(seconds: Column) -> Column:
    """Remaining time in words; empty for null, 0 and less."""
    whole = lambda x: F.round(x).cast("bigint").cast("string")
    return (
        F.when(seconds.isNull() | F.isnan(seconds.cast("double")) | (seconds <= 0), "")
        .when(seconds < 1, "马上好")
        .when(seconds < 60, F.concat(F.lit("还要 "), whole(seconds), F.lit(" 秒")))
        .when(seconds < 3600, F.concat(F.lit("还要约 "), whole(seconds / 60), F.lit(" 分钟")))
        .otherwise(F.concat(F.lit("还要约 "), _fixed(seconds / F.lit(3600.0), 1), F.lit(" 小时")))
    )


def format_datetime(seconds: Column) -> Column:
    """Year/month/day hour:minute in the session's time zone; a dash for null and 0."""
    return F.when(seconds.isNull() | (seconds == 0), "—").otherwise(F.date_format(F.timestamp_seconds(seconds), "yyyy/M/d HH:mm"))


def format_relative(seconds: Column, now: Column) -> Column:
    """Time since, in minutes, hours or days, with the present given."""
    minutes = F.round((now - seconds) / F.lit(60.0))
    hours = F.round(minutes / 60)
    said = lambda n, unit: F.concat(F.abs(n).cast("bigint").cast("string"), F.when(n >= 0, unit + "前").otherwise(unit + "后"))
    return (
        F.when(seconds.isNull() | (seconds == 0), "还没有记录")
        .when(F.abs(minutes) < 1, "刚刚")
        .when(F.abs(minutes) < 60, said(minutes, "分钟"))
        .when(F.abs(hours) < 24, said(hours, "小时"))
        .otherwise(said(F.round(hours / 24), "天"))
    )


def progress_percent(seen: Column, total: Column) -> Column:
    """Whole percent, 100 at most; 0 of nothing."""
    return F.when(total > 0, F.least(F.lit(100), F.round(seen / total * 100).cast("int"))).otherwise(0)


def throughput(done: Column, elapsed: Column) -> Column:
    """Per second; 0 within the first 0.05 seconds."""
    return F.when(elapsed > 0.05, done / elapsed).otherwise(0.0)


def slider_position(value: Column, low: float, high: float, log: bool = False) -> Column:
    """Share of the way from low to high, 0 to 1, on a linear or logarithmic scale."""
    share = (F.ln(value / low) / F.ln(F.lit(high / low))) if log else (value - low) / (high - low)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))


def slider_value(position: Column, low: float, high: float, log: bool = False) -> Column:
    return F.round(low * F.pow(F.lit(high / low), position)) if log else F.round(low + position * (high - low))
