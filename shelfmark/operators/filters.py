"""The filter, sort, page and count surface of the catalogue."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.names import LOWER, UPPER, ascii_lower

GRAY_THRESHOLD = 8.0
DEFAULT_LIMIT = 200
_NO_ESCAPE = "\u0001"


@dataclass(frozen=True)
class Filter:
    """Conditions on files; None, empty and False ask nothing."""

    min_pixels: int | None = None
    max_pixels: int | None = None
    min_size: int | None = None
    max_size: int | None = None
    exts: tuple[str, ...] = ()
    only_gray: bool = False
    only_duplicated: bool = False
    only_decode_error: bool = False
    search: str | None = None
    sort: str = "size_desc"
    limit: int = DEFAULT_LIMIT
    offset: int = 0

    def is_default(self) -> bool:
        return not self.conditions()

    def conditions(self) -> list[str]:
        """The names of the conditions that ask something."""
        asks = lambda v: bool(v.strip()) if isinstance(v, str) else len(v) > 0 if isinstance(v, (tuple, list)) else v is not None and v is not False
        return [f.name for f in fields(self) if f.name not in ("sort", "limit", "offset") and asks(getattr(self, f.name))]

    def without(self, condition: str) -> Filter:
        """The filter with one of its conditions cleared."""
        return replace(self, **{condition: Filter.__dataclass_fields__[condition].default})


def toggle_ext(known: list[str], chosen: list[str], ext: str) -> list[str]:
    """Switch one format: from all chosen, it is left out; the last one stays; all chosen is written as none."""
    now = list(chosen or known)
    now = [e for e in now if e != ext] if ext in now else [e for e in known if e in now or e == ext]
    if not now:
        return list(chosen)
    return [] if set(now) == set(known) else now


def contains_term(path: Column, term: str) -> Column:
    """LIKE '%term%' without regard to ASCII case; % and _ of the term are wildcards, a backslash is itself."""
    pattern = f"%{term.strip()}%".translate(str.maketrans(UPPER, LOWER))
    return F.call_function("like", ascii_lower(path), F.lit(pattern), F.lit(_NO_ESCAPE))


def predicate(f: Filter, gray_threshold: float = GRAY_THRESHOLD) -> Column:
    """All row-wise conditions of the filter; only rows with status normal ever match.

    A bound on pixels leaves out rows without dimensions. only_duplicated isn't row-wise, see
    matching().
    """
    pixels = F.col("width") * F.col("height")
    terms = [F.col("status") == "normal"]
    for bound, ok in ((f.min_pixels, lambda v: pixels >= v), (f.max_pixels, lambda v: pixels <= v), (f.min_size, lambda v: F.col("size") >= v), (f.max_size, lambda v: F.col("size") <= v)):
        if bound is not None:
            terms.append(ok(bound))
    if f.exts:
        terms.append(F.col("ext").isin(*(e.lower() for e in f.exts)))
    if f.only_gray:
        terms.append(F.col("gray_score") <= gray_threshold)
    if f.only_decode_error:
        terms.append(F.col("decode_error").isNotNull())
    if f.search and f.search.strip():
        terms.append(contains_term(F.col("path"), f.search))
    return reduce(and_, terms)


def duplicated_hashes(files: DataFrame) -> DataFrame:
    """Hashes that more than one normal row has, wherever a filter looks."""
    return files.where("status = 'normal' AND content_hash IS NOT NULL").groupBy("content_hash").agg(F.count("*").alias("copies")).where("copies > 1")


def matching(files: DataFrame, f: Filter, gray_threshold: float = GRAY_THRESHOLD) -> DataFrame:
    """All rows of the catalogue that the filter lets through."""
    rows = files.where(predicate(f, gray_threshold))
    if f.only_duplicated:
        rows = rows.where(F.col("content_hash").isNotNull()).join(duplicated_hashes(files).select("content_hash"), "content_hash", "left_semi")
    return rows.select(*files.columns)


def order_of(sort: str) -> list[Column]:
    """Sort keys, then id, so that equal keys have one order."""
    pixels = F.col("width") * F.col("height")
    keys = {
        "size_desc": F.col("size").desc(), "size_asc": F.col("size").asc(), "pixels_desc": pixels.desc_nulls_last(),
        "pixels_asc": pixels.asc_nulls_last(), "path_asc": F.col("path").asc(),
    }
    return [keys[sort], F.col("id").asc()]


def page(files: DataFrame, f: Filter, gray_threshold: float = GRAY_THRESHOLD) -> DataFrame:
    """One page: sorted, `offset` rows passed over (negative is 0), `limit` taken (0 and less is 200)."""
    return matching(files, f, gray_threshold).orderBy(*order_of(f.sort)).offset(max(0, f.offset)).limit(f.limit if f.limit > 0 else DEFAULT_LIMIT)


def after(sort: str, last: dict[str, object]) -> Column:
    """Whether a row comes after `last` (its sort value and id) in that order: a predicate instead of an offset.

    last: id, and size, path, or pixels, which may be None where rows without dimensions have begun.
    """
    key, descending, nullable = {"size_desc": ("size", True, False), "size_asc": ("size", False, False), "path_asc": ("path", False, False), "pixels_desc": ("pixels", True, True), "pixels_asc": ("pixels", False, True)}[sort]
    value = F.col("width") * F.col("height") if key == "pixels" else F.col(key)
    at, beyond_id = last.get(key), F.col("id") > last["id"]
    if at is None:
        return value.isNull() & beyond_id
    further = (value < at) if descending else (value > at)
    out = further | ((value == at) & beyond_id)
    return out | value.isNull() if nullable else out


def page_after(files: DataFrame, f: Filter, last: dict[str, object], gray_threshold: float = GRAY_THRESHOLD) -> DataFrame:
    """The page that follows the row `last` in the filter's order, see after(). The work of a page doesn't grow with its place."""
    return matching(files, f, gray_threshold).where(after(f.sort, last)).orderBy(*order_of(f.sort)).limit(f.limit if f.limit > 0 else DEFAULT_LIMIT)


def count_matching(files: DataFrame, f: Filter, gray_threshold: float = GRAY_THRESHOLD) -> DataFrame:
    return matching(files, f, gray_threshold).agg(F.count("*").alias("n"))


def page_size_for_refresh(loaded: int, extra: int) -> int:
    """Rows to ask for when a list is read again in place."""
    return min(3000, max(300, loaded + extra))


def find_by(files: DataFrame, **keys: object) -> DataFrame:
    """The row with these values; none or one."""
    return files.where(reduce(and_, (F.col(k) == v for k, v in keys.items()))).limit(1)


def known_files(files: DataFrame) -> DataFrame:
    """What a scan needs of the catalogue, whatever the status."""
    return files.select("path", "id", "size", "mtime")


def badges(files: DataFrame, gray_threshold: float = GRAY_THRESHOLD) -> DataFrame:
    """id and whether a tile is marked gray, duplicated or bad, among the normal rows given."""
    normal = files.where("status = 'normal'")
    copies = duplicated_hashes(files)
    marked = normal.join(copies, "content_hash", "left")
    return marked.select("id", F.coalesce(F.col("gray_score") <= gray_threshold, F.lit(False)).alias("gray"), F.coalesce("copies", F.when(F.col("content_hash").isNotNull(), 1).otherwise(0)).cast("bigint").alias("copies"), F.col("decode_error").isNotNull().alias("bad"))


def query(spark: SparkSession, sql: str, args: dict[str, object], **tables: DataFrame) -> DataFrame:
    """Any SQL over the given tables, named in it as {name}, with values bound to :name and never spliced in."""
    return spark.sql(sql, args=args, **tables)
