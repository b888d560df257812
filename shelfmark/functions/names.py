"""Columns parsed from paths and file names. Built-in functions only; null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"[\s\p{Z}]"
#: How a work id is written in a file name, tagged and bare.
_TAGGED = rf"(?i)pid{_BLANK}*={_BLANK}*(\d{{5,12}})"
_BARE = r"(?:^|[^0-9])(\d{5,12})(?:[^0-9]|$)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def unicode_trim(c: Column) -> Column:
    """Without blanks of any script at both ends."""
    return F.regexp_replace(c, rf"^{_BLANK}+|{_BLANK}+$", "")


def base_name(path: Column) -> Column:
    """What follows the last / or \\."""
    return F.regexp_extract(path, r"(?s)([^/\\]*)$", 1)


def extension(path: Column) -> Column:
    """What follows the last dot of the base name, ASCII lower case; null without one or if the dot starts the name."""
    x = F.regexp_extract(base_name(path), r"(?s)^.+\.([^.]*)$", 1)
    return F.when(base_name(path).rlike(r"(?s)^.+\.[^.]*$"), ascii_lower(x))


def stem(path: Column) -> Column:
    """The base name without its extension; a name that only starts with a dot is all stem."""
    return F.regexp_replace(base_name(path), r"(?s)^(.+)\.[^.]*$", "$1")


def parse_pid(name: Column) -> Column:
    """Work id of a stem: the digits after `pid=`, else the greatest of its runs of 5 to 12 digits. A run uses up the character behind it."""
    tagged = F.regexp_extract(name, _TAGGED, 1)
    bare = F.array_max(F.transform(F.regexp_extract_all(name, F.lit(_BARE), F.lit(1)), lambda x: x.cast("bigint")))
    return F.when(name.isNotNull(), F.coalesce(F.when(tagged != "", tagged).cast("bigint"), bare))


def parse_artist(name: Column) -> Column:
    """The third part of a stem cut at ` - `, blank parts and parts with a work id left out; null if shorter or beyond 80 bytes."""
    parts = F.filter(F.transform(F.split(name, " - "), unicode_trim), lambda x: (x != "") & ~x.rlike(_TAGGED) & ~x.rlike(_BARE))
    third = F.get(parts, F.lit(2))
    return F.when(F.octet_length(third) <= 80, third)


def page_of(name: Column) -> Column:
    """Page number after the last `_p` in any case; null without digits or above 32 bits."""
    digits = F.regexp_extract(ascii_lower(name), "(?s)^.*_p([0-9]*)", 1)
    number = F.when((digits != "") & (F.length(F.ltrim(digits, F.lit("0"))) <= 10), digits.cast("bigint"))
    return F.when(number <= 4294967295, number)


def volume_of(path: Column) -> Column:
    """First component of a path, lower case."""
    return ascii_lower(F.substring_index(F.translate(path, "\\", "/"), "/", 1))


def same_volume(a: Column, b: Column) -> Column:
    return F.coalesce(volume_of(a) == volume_of(b), F.lit(False))


def thumb_name(id_: Column, mtime: Column) -> Column:
    return F.concat(id_.cast("string"), F.lit("_"), mtime.cast("string"), F.lit(".jpg"))


def normal_path(path: str) -> str:
    """Backslashes, no trailing one, ASCII lower case."""
    return path.replace("/", "\\").rstrip("\\").translate(str.maketrans(UPPER, LOWER))


def check_quarantine_dir(folder: str, roots: list[str]) -> None:
    """ValueError if the folder is blank, is a scan root or lies under one: a later scan would take its files in again."""
    if not folder.strip():
        raise ValueError("the quarantine folder must be named")
    own = normal_path(folder)
    for root in filter(None, map(normal_path, roots)):
        if own == root or own.startswith(root + "\\"):
            raise ValueError(f"the quarantine folder lies in a scanned folder: {root}")
