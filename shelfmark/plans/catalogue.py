"""Queries of the catalogue and their SQL. The catalogue is the current row of every file; ledgers and groups are taken as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import names, scalars
from shelfmark.operators import cache, catalogue, facets, filters, grouping, ledger, ordering, similar
from shelfmark.operators.filters import Filter
from shelfmark.streaming.ingest import latest_per_path
from shelfmark.runtime import Written, shuffle_partitions, table_state
from shelfmark.tables import FILES, current_files, table

Query = Callable[[SparkSession, str], DataFrame]

#: Scans before this time are the catalogue, later ones the new scan, in the queries on increments.
HISTORY_END, NOW = 1_751_328_000, 1_755_561_600
COLUMNS = [c.split()[0] for c in FILES.split(", ")]
SHOWN = ["id", "path", "size", "width", "height", "ext"]

WANTED = Filter(min_pixels=400_000, max_size=3_000_000, exts=("JPG", "png"))
DUPLICATED = Filter(only_duplicated=True)


_snapshots: dict[tuple, DataFrame] = {}


def files(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue: the current row of every file, stored as a snapshot that queries read with pushed filters.

    Written once per session and state of the table, range partitioned by size, the order it is
    paged in; a changed table gets a new snapshot.
    """
    source = f"{d}/files.parquet"
    key = (spark.sparkContext.applicationId, source, table_state(spark, source))
    if key not in _snapshots:
        current = current_files(table(spark, d, "files"), [c for c in COLUMNS if c != "id"]).select(*COLUMNS)
        _snapshots[key] = Written(current.repartitionByRange(shuffle_partitions(spark), "size", "id").sortWithinPartitions("size", "id"), "catalogue").df
    return _snapshots[key]


def _groups(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return files(spark, d), table(spark, d, "dup_groups"), table(spark, d, "dup_members")


def _paged(**conditions: object) -> Query:
    return lambda spark, d: filters.page(files(spark, d), Filter(**conditions)).select(*SHOWN)


def _next(sort: str, **last: object) -> Query:
    return lambda spark, d: filters.page_after(files(spark, d), Filter(limit=300, sort=sort), last | {"id": 5_000}).select(*SHOWN)


def _matching(f: Filter) -> Query:
    return lambda spark, d: filters.matching(files(spark, d), f).select("id", "path")


def _increment(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "files")
    return latest_per_path(rows.where(F.coalesce("scanned_at", F.lit(0)) < HISTORY_END)), latest_per_path(rows.where(F.col("scanned_at") >= HISTORY_END))


def _difference(spark: SparkSession, d: str) -> DataFrame:
    known, scanned = _increment(spark, d)
    return catalogue.scan_difference(scanned, filters.known_files(known))


def upsert_files(spark: SparkSession, d: str) -> DataFrame:
    known, scanned = _increment(spark, d)
    return catalogue.upsert(known, scanned, NOW)


def parse_names(spark: SparkSession, d: str) -> DataFrame:
    stem = names.stem(F.col("path"))
    return files(spark, d).select(
        "id", names.base_name(F.col("path")).alias("name"), names.extension(F.col("path")).alias("file_ext"), stem.alias("stem"), names.parse_pid(stem).alias("file_pid"),
        names.parse_artist(stem).alias("file_artist"), names.page_of(stem).alias("page"), names.volume_of(F.col("path")).alias("volume"), names.thumb_name(F.col("id"), F.col("mtime")).alias("thumb"),
    )


def format_words(spark: SparkSession, d: str) -> DataFrame:
    pixels = F.col("width") * F.col("height")
    return files(spark, d).select(
        "id", scalars.format_bytes(F.col("size")).alias("size_words"), scalars.format_pixels(pixels).alias("pixel_words"), scalars.format_count(F.col("size")).alias("size_count"),
        scalars.format_eta(F.col("size") / F.lit(100.0)).alias("eta"), scalars.format_datetime(F.col("mtime")).alias("changed"), scalars.format_relative(F.col("scanned_at"), F.lit(NOW)).alias("seen"),
        scalars.short_side(F.col("width"), F.col("height")).alias("side"), scalars.progress_percent(F.col("width"), F.col("height")).alias("percent"),
    )


def hex_round_trip(spark: SparkSession, d: str) -> DataFrame:
    bits = scalars.from_hex(F.col("phash"))
    return files(spark, d).select("id", bits.alias("bits"), scalars.to_hex(bits).alias("hex"), scalars.hamming(bits, F.lit(0).cast("bigint")).cast("bigint").alias("ones"), scalars.similarity_percent(scalars.hamming(bits, F.lit(0).cast("bigint"))).alias("similarity"))


def exact_groups(spark: SparkSession, d: str) -> DataFrame:
    groups, members = grouping.recorded_groups(files(spark, d))
    return members.join(groups.select(F.col("id").alias("group_id"), "kind", "keep_file_id"), "group_id")


def similar_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Distinct fingerprints of content representatives within 8 bits."""
    return _pairs(8)(spark, d)


def _pairs(threshold: int) -> Query:
    return lambda spark, d: similar.near_bits(similar.visual_records(files(spark, d)).select("bits").distinct(), threshold)


def similar_components(spark: SparkSession, d: str) -> DataFrame:
    return similar.components(similar.similar_links(similar.visual_records(files(spark, d))))


def default_selection(spark: SparkSession, d: str) -> DataFrame:
    return grouping.default_selection(*_groups(spark, d))


def _restored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "quarantine").distinct()
    return ledger.restore_effect(rows, files(spark, d), rows.where("batch_id IS NOT NULL").select("id"), NOW)


def restore_effect(spark: SparkSession, d: str) -> DataFrame:
    return _restored(spark, d)[1].groupBy("status").agg(F.count("*").alias("n"))


def restored_ledger(spark: SparkSession, d: str) -> DataFrame:
    return _restored(spark, d)[0].select("id", "file_id", "restored_at")


def _moves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Moving the recorded groups' other members; every fifth fails."""
    f, groups, members = _groups(spark, d)
    ids = members.where("file_id IS NOT NULL").select(F.col("file_id").alias("id"))
    plan = ledger.plan_moves(f, ids, "b", "/q", spark.createDataFrame([], "name string"), NOW)
    return ledger.move_effect(f, ids, plan.withColumn("error", F.when(F.col("file_id") % 5 == 0, "io")))


def move_status(spark: SparkSession, d: str) -> DataFrame:
    return _moves(spark, d)[0].groupBy("status").agg(F.count("*").alias("n"))


def _purge(k: int) -> Query:
    return lambda spark, d: ledger.purge_effect(table(spark, d, "quarantine").distinct(), files(spark, d), F.col("batch_id").isNotNull(), NOW)[k]


def unique_dest(spark: SparkSession, d: str) -> DataFrame:
    """Names for moving every file of the catalogue into a folder that holds what the ledger's open rows name, and some numbered ones."""
    f = files(spark, d).select("id", "path")
    open_ = ledger.open_rows(table(spark, d, "quarantine")).select(names.base_name(F.col("moved_path")).alias("name"))
    numbered = f.where("id % 3 = 0").select(F.concat(names.stem(F.col("path")), F.lit("__"), (F.col("id") % 4 + 1).cast("string"), F.lit("."), names.extension(F.col("path"))).alias("name"))
    return ledger.unique_names(f, open_.unionByName(numbered), "path", "id").select("id", "dest")


def hash_stats(spark: SparkSession, d: str) -> DataFrame:
    """What hashing found for the candidates of the history that lacked a hash, by what the files have now."""
    known = _increment(spark, d)[0]
    now = files(spark, d).select("id", F.col("content_hash").alias("now"))
    return catalogue.hash_stats(grouping.size_candidates(known), grouping.needs_content(known).select("id").join(now, "id").select(F.col("now").alias("content_hash")))


def visual_stats(spark: SparkSession, d: str) -> DataFrame:
    known = _increment(spark, d)[0]
    return catalogue.visual_stats(grouping.needs_visual(known).select("id").join(files(spark, d), "id").select("phash", "decode_error"), known)


def similar_recorded(spark: SparkSession, d: str) -> DataFrame:
    groups, members = similar.recorded_groups(files(spark, d), 4)
    return members.join(groups.select(F.col("id").alias("group_id"), "kind", "keep_file_id"), "group_id")


def list_groups(spark: SparkSession, d: str) -> DataFrame:
    return grouping.list_groups(*_groups(spark, d), "similar", 25, 10).select("group_id", "keep", "file_id", "distance", "members", "savings", "reason", "path", "size", "mtime")


def cleared_groups(spark: SparkSession, d: str) -> DataFrame:
    groups, members = grouping.clear_groups(table(spark, d, "dup_groups"), table(spark, d, "dup_members"), "exact")
    return groups.select(F.lit("groups").alias("part"), F.col("id").alias("key")).unionByName(members.select(F.lit("members").alias("part"), F.col("group_id").alias("key"))).groupBy("part").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


def thumbs_missing(spark: SparkSession, d: str) -> DataFrame:
    return cache.missing_thumbs(files(spark, d), _manifest(spark, d))


def toggled(spark: SparkSession, d: str) -> DataFrame:
    return grouping.toggle(default_selection(spark, d), files(spark, d).where("id % 3 = 0").select(F.col("id").alias("file_id")))


def visible_selection(spark: SparkSession, d: str) -> DataFrame:
    return grouping.visible_selection(default_selection(spark, d), filters.matching(files(spark, d), WANTED))


def by_root(spark: SparkSession, d: str) -> DataFrame:
    return filters.query(spark, "SELECT root, count(*) AS n, sum(size) AS bytes FROM {files} WHERE size >= :least AND status = :status GROUP BY root", {"least": 1000, "status": "normal"}, files=files(spark, d))


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).where("phash IS NOT NULL").select(names.thumb_name(F.col("id"), F.col("mtime")).alias("name"), "mtime", F.call_function("div", F.col("size"), F.lit(50)).alias("size"))


def _half(manifest: DataFrame) -> int:
    return (manifest.agg(F.sum("size")).head()[0] or 0) // 2


def cache_evict(spark: SparkSession, d: str) -> DataFrame:
    m = _manifest(spark, d)
    return cache.evicted(m, _half(m))


def cache_report(spark: SparkSession, d: str) -> DataFrame:
    m = _manifest(spark, d)
    return cache.trim_report(m, _half(m))


def group_tiles(spark: SparkSession, d: str) -> DataFrame:
    return grouping.group_tiles(*_groups(spark, d)).select("group_id", F.array_join(F.transform("shown", lambda x: x.cast("string")), ",").alias("shown"), "more")


def queries() -> dict[str, Query]:
    q = lambda f: lambda spark, d: f(files(spark, d))
    return {
        "filter_clarity_size_ext": _matching(WANTED),
        "filter_gray": _matching(Filter(only_gray=True)),
        "filter_decode_error": _matching(Filter(only_decode_error=True)),
        "filter_duplicated": _matching(DUPLICATED),
        "filter_search": _matching(Filter(search=" IMG%1 ")),
        "filter_search_separator": _matching(Filter(search="\\scans")),
        "filter_everything": _matching(Filter(min_size=1000, max_pixels=5_000_000, only_gray=True, only_duplicated=True, search="_P")),
        "sort_size_desc": _paged(),
        "sort_size_asc": _paged(sort="size_asc"),
        "sort_pixels_desc_nulls_last": _paged(sort="pixels_desc"),
        "sort_pixels_asc_nulls_last": _paged(sort="pixels_asc"),
        "sort_path": _paged(sort="path_asc", limit=0),
        "page_offset": _paged(limit=300, offset=600),
        "page_keyset": _next("size_desc", size=1_000_000),
        "page_keyset_size_asc": _next("size_asc", size=1_000_000),
        "page_keyset_pixels_desc": _next("pixels_desc", pixels=50_000),
        "page_keyset_pixels_asc": _next("pixels_asc", pixels=5_000_000),
        "page_keyset_nulls": _next("pixels_asc", pixels=None),
        "page_keyset_path": _next("path_asc", path="F"),
        "count_filtered": lambda spark, d: filters.count_matching(files(spark, d), WANTED),
        "count_duplicated": lambda spark, d: filters.count_matching(files(spark, d), DUPLICATED),
        "library_stats": q(facets.library_stats),
        "format_stats": q(facets.format_stats),
        "hist_short_side": q(facets.short_side_histogram),
        "hist_size": q(facets.size_histogram),
        "hist_pixels": q(facets.pixel_histogram),
        "parse_names": parse_names,
        "format_words": format_words,
        "hex_round_trip": hex_round_trip,
        "size_candidates": lambda spark, d: grouping.size_candidates(files(spark, d)).select("id", "size", "same_size"),
        "needs_content": lambda spark, d: grouping.needs_content(files(spark, d)).select("id"),
        "needs_visual": lambda spark, d: grouping.needs_visual(files(spark, d)).select("id"),
        "visual_done": q(catalogue.visual_done),
        "work_stats": q(catalogue.work_stats),
        "exact_keeper": q(grouping.exact_keepers),
        "exact_groups": exact_groups,
        "keeper_reason": q(grouping.keeper_reasons),
        "content_representatives": lambda spark, d: grouping.content_representatives(files(spark, d)).select("id"),
        "dup_badges": q(filters.badges),
        "similar_pairs": similar_pairs,
        "similar_pairs_1": _pairs(1),
        "similar_pairs_11": _pairs(11),
        "similar_recorded": similar_recorded,
        "list_groups": list_groups,
        "cleared_groups": cleared_groups,
        "hash_stats": hash_stats,
        "visual_stats": visual_stats,
        "move_status": move_status,
        "move_report": lambda spark, d: _moves(spark, d)[2],
        "move_ledger": lambda spark, d: _moves(spark, d)[1].select("file_id", "original_path", "batch_id", "moved_at", "restored_at"),
        "thumbs_missing": thumbs_missing,
        "toggled": toggled,
        "visible_selection": visible_selection,
        "by_root": by_root,
        "similar_components": similar_components,
        "similar_groups": q(similar.similar_groups),
        "group_members": lambda spark, d: grouping.group_members(*_groups(spark, d)).select("group_id", "kind", "file_id", "distance", "size"),
        "group_view": lambda spark, d: grouping.group_views(*_groups(spark, d)),
        "group_page": lambda spark, d: grouping.group_page(*_groups(spark, d), "exact", 20, 40),
        "group_tiles": group_tiles,
        "default_selection": default_selection,
        "selection_totals": lambda spark, d: grouping.selection_totals(default_selection(spark, d)),
        "count_groups": lambda spark, d: grouping.count_groups(table(spark, d, "dup_groups")),
        "scan_diff": lambda spark, d: _difference(spark, d).select("path", "change"),
        "scan_stats": lambda spark, d: catalogue.scan_stats(_difference(spark, d)),
        "upsert_files": upsert_files,
        "quarantine_batches": lambda spark, d: ledger.batches(table(spark, d, "quarantine"), files(spark, d)),
        "quarantine_batch_files": lambda spark, d: ledger.batch_files(table(spark, d, "quarantine"), files(spark, d)),
        "quarantine_totals": lambda spark, d: ledger.totals(ledger.batches(table(spark, d, "quarantine"), files(spark, d))),
        "restore_effect": restore_effect,
        "restored_ledger": restored_ledger,
        "purge_ledger": _purge(0),
        "purge_log": _purge(1),
        "purge_report": _purge(2),
        "unique_dest": unique_dest,
        "cache_evict": cache_evict,
        "cache_report": cache_report,
        "nearest_rank_p95": lambda spark, d: ordering.nearest_rank(files(spark, d), "ext", "gray_score", "id", 95),
        "median_size": lambda spark, d: ordering.median(files(spark, d), "ext", "size", "id"),
    }


_CUR = "cur AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY scanned_at DESC NULLS LAST) AS rn FROM files) WHERE rn = 1)"
_LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_DUP = "SELECT content_hash FROM cur WHERE status = 'normal' AND content_hash IS NOT NULL GROUP BY content_hash HAVING count(*) > 1"
_BASE = r"regexp_extract(path, '([^/\\]*)$', 1)"
_STEM = rf"regexp_replace({_BASE}, '(?s)^(.+)\.[^.]*$', '\1')"
_TAGGED = r"(?i)pid[\s\p{Z}]*=[\s\p{Z}]*(\d{5,12})"
_BARE = r"(?:^|[^0-9])(\d{5,12})(?:[^0-9]|$)"
_KEY = "(pid IS NULL), strlen(path), mtime, id"


def _where(condition: str) -> str:
    return f"WITH {_CUR} SELECT id, path FROM cur WHERE status = 'normal' AND {condition}"


def _like(term: str) -> str:
    return f"translate(path, {_LOW}) LIKE '%{term}%'"


def _page(order: str, limit: int = 200, offset: int = 0, more: str = "") -> str:
    return f"WITH {_CUR} SELECT {', '.join(SHOWN)} FROM cur WHERE status = 'normal'{more} ORDER BY {order}, id LIMIT {limit} OFFSET {offset}"


def _histogram(bucket: str, edges: list[int], condition: str) -> str:
    frame = ", ".join(f"({i}, {lo}, {hi})" for i, (lo, hi) in enumerate(zip(edges, edges[1:])))
    return f"""WITH {_CUR}, counted AS (SELECT {bucket} AS b, count(*) AS c FROM cur WHERE status = 'normal' AND {condition} GROUP BY 1)
SELECT CAST(f.bucket AS BIGINT) AS bucket, CAST(f.lo AS BIGINT) AS lo, CAST(f.hi AS BIGINT) AS hi, coalesce(c.c, 0) AS n FROM (VALUES {frame}) AS f(bucket, lo, hi) LEFT JOIN counted c ON c.b = f.bucket"""


def _steps(value: str, first: int, buckets: int) -> str:
    return "CASE " + " ".join(f"WHEN {value} < {2 ** (first + i + 1)} THEN {i}" for i in range(buckets - 1)) + f" ELSE {buckets - 1} END"


_FIXED = "CAST(CAST(round(CAST({} AS DECIMAL(38, 12)), {}) AS DECIMAL(38, {})) AS VARCHAR)"


def _fixed(x: str, n: int) -> str:
    return _FIXED.format(x, n, n)


_WORDS = rf"""WITH {_CUR} SELECT id,
CASE WHEN size IS NULL OR size <= 0 THEN '0 MB' WHEN size >= 1099511627776 THEN {_fixed('size / 1099511627776.0', 2)} || ' TB'
  WHEN size >= 107374182400 THEN {_fixed('size / 1073741824.0', 0)} || ' GB' WHEN size >= 1073741824 THEN {_fixed('size / 1073741824.0', 2)} || ' GB'
  WHEN size >= 104857600 THEN {_fixed('size / 1048576.0', 0)} || ' MB' WHEN size >= 1048576 THEN {_fixed('size / 1048576.0', 1)} || ' MB'
  ELSE {_fixed('size / 1024.0', 0)} || ' KB' END AS size_words,
CASE WHEN width * height IS NULL OR width * height <= 0 THEN '0 像素' WHEN width * height >= 100000000 THEN {_fixed('width * height / 1e8', 2)} || ' 亿像素'
  WHEN width * height >= 10000 THEN format('{{:,}}', CAST(round(width * height / 1e4) AS BIGINT)) || ' 万像素' ELSE format('{{:,}}', width * height) || ' 像素' END AS pixel_words,
format('{{:,}}', size) AS size_count,
CASE WHEN size IS NULL OR size <= 0 THEN '' WHEN size < 100 THEN '马上好' WHEN size < 6000 THEN '还要 ' || CAST(round(size / 100.0) AS BIGINT) || ' 秒'
  WHEN size < 360000 THEN '还要约 ' || CAST(round(size / 6000.0) AS BIGINT) || ' 分钟' ELSE '还要约 ' || {_fixed('size / 360000.0', 1)} || ' 小时' END AS eta,
CASE WHEN coalesce(mtime, 0) = 0 THEN '—' ELSE strftime(to_timestamp(mtime) AT TIME ZONE 'UTC', '%Y/%-m/%-d %H:%M') END AS changed,
CASE WHEN coalesce(scanned_at, 0) = 0 THEN '还没有记录' WHEN abs(m) < 1 THEN '刚刚' WHEN abs(m) < 60 THEN CAST(abs(m) AS BIGINT) || CASE WHEN m >= 0 THEN '分钟前' ELSE '分钟后' END
  WHEN abs(h) < 24 THEN CAST(abs(h) AS BIGINT) || CASE WHEN h >= 0 THEN '小时前' ELSE '小时后' END
  ELSE CAST(abs(round(h / 24)) AS BIGINT) || CASE WHEN round(h / 24) >= 0 THEN '天前' ELSE '天后' END END AS seen,
CASE WHEN width IS NOT NULL AND height IS NOT NULL THEN least(width, height) END AS side,
CASE WHEN height > 0 THEN coalesce(least(100, CAST(round(width / CAST(height AS DOUBLE) * 100) AS INTEGER)), 100) ELSE 0 END AS percent
FROM (SELECT *, round(m / 60) AS h FROM (SELECT *, round(({NOW} - scanned_at) / 60.0::DOUBLE) AS m FROM cur))"""

_EXACT = f"""exact AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY {_KEY}) AS k, count(*) OVER (PARTITION BY content_hash) AS c
FROM cur WHERE status = 'normal' AND content_hash IS NOT NULL), kept AS (SELECT * FROM exact WHERE k = 1 AND c > 1)"""
_REASON = "CASE WHEN lacks IS NULL THEN '' WHEN {pid} IS NOT NULL AND lacks THEN '文件名里带作品 ID' WHEN longest > strlen({path}) THEN '路径更短' WHEN latest > {mtime} THEN '收藏时间更早' ELSE '内容完全相同，留哪张都一样' END"

_REPRESENTED = f"""{_CUR}, rep AS (SELECT * EXCLUDE (k) FROM (SELECT *, CASE WHEN content_hash IS NOT NULL THEN row_number() OVER (PARTITION BY content_hash ORDER BY {_KEY}) ELSE 1 END AS k
FROM cur WHERE status = 'normal' AND phash IS NOT NULL) WHERE k = 1)"""
_VISUAL = rf"""{_REPRESENTED}, vis AS (SELECT id, pid, CAST('0x' || phash AS UBIGINT) AS v, CASE WHEN TRY_CAST(nullif(digits, '') AS HUGEINT) <= 4294967295 THEN TRY_CAST(nullif(digits, '') AS HUGEINT) END AS page
FROM (SELECT *, regexp_extract(translate({_STEM}, {_LOW}), '(?s)^.*_p([0-9]*)', 1) AS digits FROM rep WHERE regexp_full_match(phash, '[0-9a-fA-F]{{1,16}}')))"""


def _components(threshold: int) -> str:
    return f"""{_VISUAL}, pair AS (SELECT a.id AS x, b.id AS y FROM vis a JOIN vis b ON a.id < b.id WHERE bit_count(xor(a.v, b.v)) <= {threshold} AND NOT coalesce(a.pid = b.pid AND a.page <> b.page, FALSE)),
edge AS (SELECT x, y FROM pair UNION ALL SELECT y, x FROM pair),
walk(id, root) AS (SELECT DISTINCT x, x FROM edge UNION SELECT e.y, w.root FROM walk w JOIN edge e ON e.x = w.id WHERE w.root < e.y),
comp AS (SELECT id, min(root) AS root FROM walk GROUP BY id)"""


def _grouped(threshold: int) -> str:
    return f"""{_components(threshold)}, mem AS (SELECT c.root, v.id, v.v FROM comp c JOIN vis v USING (id)),
total AS (SELECT a.root, a.id, a.v, sum(bit_count(xor(a.v, b.v))) AS s FROM mem a JOIN mem b USING (root) GROUP BY ALL),
base AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY s, id) AS k FROM total) WHERE k = 1),
dist AS (SELECT m.root, b.id AS keep_id, m.id AS file_id, CAST(bit_count(xor(m.v, b.v)) AS BIGINT) AS distance FROM mem m JOIN base b USING (root)),
firsts AS (SELECT root, keep_id, min(distance) FILTER (file_id <> keep_id) AS f FROM dist GROUP BY ALL),
grouped AS (SELECT dense_rank() OVER (ORDER BY f.f, f.keep_id) AS group_no, d.keep_id, d.file_id, d.distance FROM dist d JOIN firsts f USING (root))"""


def _near(threshold: int) -> str:
    return f"""WITH {_VISUAL}, b AS (SELECT DISTINCT CASE WHEN v >= 9223372036854775808 THEN CAST(CAST(v AS HUGEINT) - 18446744073709551616 AS BIGINT) ELSE CAST(v AS BIGINT) END AS s, v FROM vis)
SELECT x.s AS a, y.s AS b, CAST(bit_count(xor(x.v, y.v)) AS INTEGER) AS distance FROM b x JOIN b y ON x.s < y.s WHERE bit_count(xor(x.v, y.v)) <= {threshold}"""


_MEMBERS = f"""{_CUR}, g AS (SELECT DISTINCT id AS group_id, lower(trim(kind)) AS kind, keep_file_id FROM dup_groups),
m AS (SELECT group_id, file_id, coalesce(min(distance), 0) AS distance FROM dup_members WHERE group_id IS NOT NULL AND file_id IS NOT NULL GROUP BY ALL),
gm AS (SELECT g.group_id, g.kind, g.keep_file_id, m.file_id, m.distance, c.size, c.path, c.pid, c.mtime FROM m JOIN g USING (group_id) JOIN cur c ON c.id = m.file_id WHERE m.file_id <> g.keep_file_id)"""
_SEEN = """, seen AS (SELECT gm.group_id, count(*) AS n, CAST(sum(gm.size) AS BIGINT) AS s, min(gm.distance) AS nearest, max(gm.distance) AS farthest,
  bool_or(CASE WHEN gm.path <> k.path THEN gm.pid IS NULL END) AS lacks, max(CASE WHEN gm.path <> k.path THEN strlen(gm.path) END) AS longest, max(CASE WHEN gm.path <> k.path THEN gm.mtime END) AS latest
  FROM gm JOIN cur k ON k.id = gm.keep_file_id GROUP BY gm.group_id)"""
_VIEW = f"""
SELECT p.group_id, p.kind, p.keep_file_id, coalesce(n, 0) AS members, coalesce(s, 0) AS savings, nearest, farthest, {_REASON.format(pid="k.pid", path="k.path", mtime="k.mtime")} AS reason
FROM {{page}} p JOIN cur k ON k.id = p.keep_file_id LEFT JOIN seen USING (group_id)"""
_VIEWS = _MEMBERS + _SEEN + _VIEW

_INCREMENT = f"""known AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY scanned_at DESC NULLS LAST) AS rn FROM files WHERE coalesce(scanned_at, 0) < {HISTORY_END}) WHERE rn = 1),
scanned AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY scanned_at DESC) AS rn FROM files WHERE scanned_at >= {HISTORY_END}) WHERE rn = 1),
diff AS (SELECT s.*, CASE WHEN s.size IS NULL OR s.mtime IS NULL THEN 'failed' WHEN k.path IS NULL THEN 'inserted' WHEN s.size = k.size AND s.mtime = k.mtime THEN 'skipped' ELSE 'updated' END AS change
  FROM scanned s LEFT JOIN known k USING (path))"""


def _upserted(c: str) -> str:
    if c in ("path", "id"):
        return c if c == "path" else "coalesce(k.id, s.id) AS id"
    if c == "scanned_at":
        return f"CASE WHEN s.change IS NOT NULL THEN {NOW} ELSE k.scanned_at END AS scanned_at"
    if c == "short_side":
        return "CASE WHEN s.change IS NOT NULL THEN CASE WHEN s.width IS NOT NULL AND s.height IS NOT NULL THEN least(s.width, s.height) END ELSE k.short_side END AS short_side"
    if c == "status":
        return "CASE s.change WHEN 'updated' THEN 'normal' WHEN 'inserted' THEN CASE WHEN s.status = '' THEN 'normal' ELSE s.status END ELSE k.status END AS status"
    if c in catalogue.SCANNED:
        return f"CASE WHEN s.change IS NOT NULL THEN s.{c} ELSE k.{c} END AS {c}"
    return f"CASE s.change WHEN 'inserted' THEN s.{c} WHEN 'updated' THEN NULL ELSE k.{c} END AS {c}"


_LEDGER = f"{_CUR}, q AS (SELECT DISTINCT * FROM quarantine), open AS (SELECT * FROM q WHERE restored_at IS NULL)"
_BATCHES = "SELECT o.batch_id, count(*) AS n, max(o.moved_at) AS moved_at, CAST(coalesce(sum(c.size), 0) AS BIGINT) AS bytes FROM open o LEFT JOIN cur c ON c.id = o.file_id GROUP BY o.batch_id"
_THUMBS = f"""{_CUR}, m AS (SELECT id || '_' || mtime || '.jpg' AS name, mtime, size // 50 AS size FROM cur WHERE phash IS NOT NULL),
t AS (SELECT sum(size) AS total, sum(size) // 2 AS lim FROM m),
gone AS (SELECT name, size FROM (SELECT *, sum(size) OVER (ORDER BY mtime NULLS FIRST, name ROWS UNBOUNDED PRECEDING) AS through FROM m), t WHERE total > lim AND lim > 0 AND total - (through - size) > lim // 10 * 8)"""
_EXT = r"CASE WHEN regexp_full_match(name, '(?s).+\.[^.]+') THEN '.' || regexp_extract(name, '(?s)^.+\.([^.]+)$', 1) ELSE '' END"
_RANKED = "WITH {cur}, r AS (SELECT ext, {v} AS v, row_number() OVER (PARTITION BY ext ORDER BY {v}, id) - 1 AS place, count(*) OVER (PARTITION BY ext) AS n FROM cur WHERE {v} IS NOT NULL) "


def oracle_sql() -> dict[str, str]:
    wanted = "width * height >= 400000 AND size <= 3000000 AND ext IN ('jpg', 'png')"
    sizes, sides, pixels = [2 ** (10 + i) for i in range(21)], [200 * i for i in range(41)], [2 ** (12 + i) for i in range(19)]
    own = f"WITH {_CUR} "
    return {
        "filter_clarity_size_ext": _where(wanted),
        "filter_gray": _where("gray_score <= 8"),
        "filter_decode_error": _where("decode_error IS NOT NULL"),
        "filter_duplicated": _where(f"content_hash IN ({_DUP})"),
        "filter_search": _where(_like("img%1")),
        "filter_search_separator": _where(_like("\\scans")),
        "filter_everything": _where(f"size >= 1000 AND width * height <= 5000000 AND gray_score <= 8 AND content_hash IN ({_DUP}) AND " + _like("_p")),
        "sort_size_desc": _page("size DESC"),
        "sort_size_asc": _page("size"),
        "sort_pixels_desc_nulls_last": _page("width * height DESC NULLS LAST"),
        "sort_pixels_asc_nulls_last": _page("width * height ASC NULLS LAST"),
        "sort_path": _page("path"),
        "page_offset": _page("size DESC", 300, 600),
        "page_keyset": _page("size DESC", 300, 0, " AND (size < 1000000 OR (size = 1000000 AND id > 5000))"),
        "page_keyset_size_asc": _page("size", 300, 0, " AND (size > 1000000 OR (size = 1000000 AND id > 5000))"),
        "page_keyset_pixels_desc": _page("width * height DESC NULLS LAST", 300, 0, " AND (width * height < 50000 OR (width * height = 50000 AND id > 5000) OR width * height IS NULL)"),
        "page_keyset_pixels_asc": _page("width * height NULLS LAST", 300, 0, " AND (width * height > 5000000 OR (width * height = 5000000 AND id > 5000) OR width * height IS NULL)"),
        "page_keyset_nulls": _page("width * height NULLS LAST", 300, 0, " AND width * height IS NULL AND id > 5000"),
        "page_keyset_path": _page("path", 300, 0, " AND (path > 'F' OR (path = 'F' AND id > 5000))"),
        "count_filtered": f"{own}SELECT count(*) AS n FROM cur WHERE status = 'normal' AND {wanted}",
        "count_duplicated": f"{own}SELECT count(*) AS n FROM cur WHERE status = 'normal' AND content_hash IN ({_DUP})",
        "library_stats": f"{own}SELECT count(*) AS total, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, coalesce(max(scanned_at), 0) AS last_scan_at FROM cur WHERE status = 'normal'",
        "format_stats": f"{own}SELECT coalesce(e, '{facets.NO_EXT}') AS ext, n FROM (SELECT ext AS e, count(*) AS n FROM cur WHERE status = 'normal' GROUP BY ext)",
        "hist_short_side": _histogram("CASE WHEN short_side >= 7800 THEN 39 ELSE short_side // 200 END", sides, "short_side IS NOT NULL"),
        "hist_size": _histogram(_steps("size", 10, 20), sizes, "size IS NOT NULL"),
        "hist_pixels": _histogram(_steps("width * height", 12, 18), pixels, "width IS NOT NULL AND height IS NOT NULL"),
        "parse_names": f"WITH {_CUR}" + rf""", named AS (SELECT id, path, mtime, {_BASE} AS name, {_STEM} AS stem FROM cur)
SELECT id, name, CASE WHEN regexp_full_match(name, '(?s).+\.[^.]*') THEN translate(regexp_extract(name, '(?s)^.+\.([^.]*)$', 1), {_LOW}) END AS file_ext, stem,
coalesce(TRY_CAST(nullif(regexp_extract(stem, '{_TAGGED}', 1), '') AS BIGINT), list_max(list_transform(regexp_extract_all(stem, '{_BARE}', 1), lambda x: CAST(x AS BIGINT)))) AS file_pid,
CASE WHEN strlen(parts[3]) <= 80 THEN parts[3] END AS file_artist,
CASE WHEN TRY_CAST(nullif(digits, '') AS HUGEINT) <= 4294967295 THEN CAST(TRY_CAST(nullif(digits, '') AS HUGEINT) AS BIGINT) END AS page,
translate(regexp_extract(replace(path, '\', '/'), '^([^/]*)', 1), {_LOW}) AS volume, id || '_' || mtime || '.jpg' AS thumb
FROM (SELECT *, regexp_extract(translate(stem, {_LOW}), '(?s)^.*_p([0-9]*)', 1) AS digits,
  list_filter(list_transform(string_split(stem, ' - '), lambda x: regexp_replace(x, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), lambda z: z <> '' AND NOT regexp_matches(z, '{_TAGGED}') AND NOT regexp_matches(z, '{_BARE}')) AS parts FROM named)""",
        "format_words": _WORDS,
        "hex_round_trip": own + """SELECT id, CASE WHEN v >= 9223372036854775808 THEN CAST(CAST(v AS HUGEINT) - 18446744073709551616 AS BIGINT) ELSE CAST(v AS BIGINT) END AS bits,
lower(lpad(to_hex(v), 16, '0')) AS hex, CAST(bit_count(CAST(CAST(v AS VARCHAR) AS UBIGINT)) AS BIGINT) AS ones, 100 - bit_count(v) / 64.0::DOUBLE * 100 AS similarity
FROM (SELECT id, CASE WHEN regexp_full_match(phash, '[0-9a-fA-F]{1,16}') THEN CAST('0x' || phash AS UBIGINT) END AS v FROM cur)""",
        "size_candidates": f"{own}SELECT id, size, same_size FROM (SELECT *, count(*) OVER (PARTITION BY size) AS same_size FROM cur WHERE status = 'normal' AND size IS NOT NULL) WHERE same_size > 1",
        "needs_content": f"{own}SELECT id FROM (SELECT *, count(*) OVER (PARTITION BY size) AS c FROM cur WHERE status = 'normal' AND size IS NOT NULL) WHERE c > 1 AND content_hash IS NULL",
        "needs_visual": f"{own}SELECT id FROM cur WHERE status = 'normal' AND phash IS NULL AND decode_error IS NULL",
        "visual_done": f"{own}SELECT count(phash) AS n FROM cur",
        "work_stats": f"""{own}SELECT count(*) AS total, count(phash) AS done, count(*) FILTER (phash IS NULL AND decode_error IS NOT NULL) AS failed,
count(*) FILTER (phash IS NULL AND decode_error IS NULL) AS waiting, count(content_hash) AS hashed FROM cur WHERE status = 'normal'""",
        "exact_keeper": f"WITH {_CUR}, {_EXACT} SELECT k.content_hash, k.id AS keep_id, k.c AS members, CAST(sum(e.size) - k.size AS BIGINT) AS savings FROM kept k JOIN exact e USING (content_hash) GROUP BY k.content_hash, k.id, k.c, k.size",
        "exact_groups": f"WITH {_CUR}, {_EXACT} SELECT dense_rank() OVER (ORDER BY k.content_hash) AS group_id, e.id AS file_id, CAST(0 AS BIGINT) AS distance, 'exact' AS kind, k.id AS keep_file_id FROM kept k JOIN exact e USING (content_hash)",
        "keeper_reason": f"""WITH {_CUR}, {_EXACT} SELECT k.content_hash, k.id AS keep_id, {_REASON.format(pid="k.pid", path="k.path", mtime="k.mtime")} AS reason
FROM kept k LEFT JOIN (SELECT e.content_hash, bool_or(e.pid IS NULL) AS lacks, max(strlen(e.path)) AS longest, max(e.mtime) AS latest FROM exact e JOIN kept k USING (content_hash) WHERE e.path <> k.path GROUP BY 1) USING (content_hash)""",
        "content_representatives": f"WITH {_REPRESENTED} SELECT id FROM rep",
        "dup_badges": f"""{own}SELECT id, coalesce(gray_score <= 8, FALSE) AS gray, CASE WHEN content_hash IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY content_hash) END AS copies, decode_error IS NOT NULL AS bad FROM cur WHERE status = 'normal'""",
        "similar_pairs": _near(8),
        "similar_pairs_1": _near(1),
        "similar_pairs_11": _near(11),
        "similar_recorded": f"WITH RECURSIVE {_grouped(4)} SELECT g.group_no AS group_id, g.file_id, g.distance, 'similar' AS kind, g.keep_id AS keep_file_id FROM grouped g",
        "list_groups": f"""WITH {_MEMBERS}{_SEEN}, page AS (SELECT * FROM g WHERE kind = 'similar' ORDER BY group_id LIMIT 25 OFFSET 10), view AS ({_VIEW.format(page="page")}),
rows AS (SELECT group_id, TRUE AS keep, keep_file_id AS file_id, CAST(0 AS BIGINT) AS distance FROM view UNION ALL SELECT group_id, FALSE, file_id, distance FROM gm WHERE group_id IN (SELECT group_id FROM view))
SELECT r.group_id, r.keep, r.file_id, r.distance, v.members, v.savings, v.reason, c.path, c.size, c.mtime FROM rows r JOIN view v USING (group_id) JOIN cur c ON c.id = r.file_id""",
        "cleared_groups": """SELECT 'groups' AS part, count(*) AS n, count(DISTINCT id) AS keys FROM dup_groups WHERE coalesce(lower(trim(kind)), '') <> 'exact'
UNION ALL SELECT 'members', count(*), count(DISTINCT group_id) FROM dup_members WHERE group_id IS NULL OR group_id NOT IN (SELECT id FROM dup_groups WHERE lower(trim(kind)) = 'exact' AND id IS NOT NULL)""",
        "hash_stats": f"""WITH {_CUR}, {_INCREMENT}, c AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY size) AS n FROM known WHERE status = 'normal' AND size IS NOT NULL) WHERE n > 1),
r AS (SELECT u.content_hash AS h FROM c JOIN cur u ON u.id = c.id WHERE c.content_hash IS NULL)
SELECT (SELECT count(DISTINCT size) FROM c) AS groups, count(h) AS hashed, count(*) - count(h) AS failed FROM r""",
        "visual_stats": f"""WITH {_CUR}, {_INCREMENT}, r AS (SELECT u.phash AS p FROM known k JOIN cur u ON u.id = k.id WHERE k.status = 'normal' AND k.phash IS NULL AND k.decode_error IS NULL)
SELECT count(*) AS total, count(p) AS done, count(*) - count(p) AS failed, count(p) + (SELECT count(phash) FROM known) AS skipped FROM r""",
        "move_status": f"{own}SELECT status, count(*) AS n FROM (SELECT CASE WHEN id % 5 <> 0 AND id IN (SELECT file_id FROM dup_members) THEN 'quarantined' ELSE status END AS status FROM cur) GROUP BY status",
        "move_report": f"""{own}SELECT count(*) FILTER (m) AS moved, count(*) FILTER (NOT m) AS failed, CAST(coalesce(sum(size) FILTER (m), 0) AS BIGINT) AS bytes
FROM (SELECT c.size, c.id IS NOT NULL AND i.file_id % 5 <> 0 AS m FROM (SELECT DISTINCT file_id FROM dup_members WHERE file_id IS NOT NULL) i LEFT JOIN cur c ON c.id = i.file_id)""",
        "move_ledger": f"{own}SELECT id AS file_id, path AS original_path, 'b' AS batch_id, CAST({NOW} AS BIGINT) AS moved_at, CAST(NULL AS BIGINT) AS restored_at FROM cur WHERE id % 5 <> 0 AND id IN (SELECT file_id FROM dup_members)",
        "thumbs_missing": f"{own}SELECT id, id || '_' || mtime || '.jpg' AS name FROM cur WHERE status = 'normal' AND phash IS NULL",
        "toggled": f"WITH {_MEMBERS}, s AS (SELECT DISTINCT file_id FROM gm WHERE kind = 'exact'), t AS (SELECT id AS file_id FROM cur WHERE id % 3 = 0) (SELECT file_id FROM s EXCEPT SELECT file_id FROM t) UNION (SELECT file_id FROM t EXCEPT SELECT file_id FROM s)",
        "visible_selection": f"WITH {_MEMBERS} SELECT DISTINCT file_id FROM gm WHERE kind = 'exact' AND file_id IN (SELECT id FROM cur WHERE status = 'normal' AND {wanted})",
        "by_root": f"{own}SELECT root, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM cur WHERE size >= 1000 AND status = 'normal' GROUP BY root",
        "similar_components": f"WITH RECURSIVE {_components(8)} SELECT id, root FROM comp",
        "similar_groups": f"WITH RECURSIVE {_grouped(8)} SELECT * FROM grouped",
        "group_members": f"WITH {_MEMBERS} SELECT group_id, kind, file_id, distance, size FROM gm",
        "group_view": "WITH " + _VIEWS.format(page="g"),
        "group_page": "WITH " + _VIEWS.format(page="(SELECT * FROM g WHERE kind = 'exact' ORDER BY group_id LIMIT 20 OFFSET 40)"),
        "group_tiles": f"""WITH {_MEMBERS}, o AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY distance, file_id) AS k, count(*) OVER (PARTITION BY group_id) AS n FROM gm)
SELECT group_id, keep_file_id || ',' || string_agg(CAST(file_id AS VARCHAR), ',' ORDER BY k) AS shown, CAST(greatest(n - 7, 0) AS BIGINT) AS more FROM o WHERE k <= 7 GROUP BY group_id, keep_file_id, n""",
        "default_selection": f"WITH {_MEMBERS} SELECT group_id, file_id, size FROM gm WHERE kind = 'exact'",
        "selection_totals": f"WITH {_MEMBERS} SELECT count(*) AS files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM (SELECT DISTINCT file_id, size FROM gm WHERE kind = 'exact')",
        "count_groups": "SELECT kind, count(*) AS n FROM (SELECT DISTINCT id, lower(trim(kind)) AS kind FROM dup_groups) GROUP BY kind",
        "scan_diff": f"WITH {_INCREMENT} SELECT path, change FROM diff",
        "scan_stats": f"""WITH {_INCREMENT} SELECT count(*) AS seen, count(*) FILTER (change = 'inserted') AS inserted, count(*) FILTER (change = 'updated') AS updated,
count(*) FILTER (change = 'skipped') AS skipped, count(*) FILTER (change = 'failed') AS failed, FALSE AS cancelled FROM diff""",
        "upsert_files": f"WITH {_INCREMENT}, s AS (SELECT * FROM diff WHERE change IN ('inserted', 'updated')) SELECT {', '.join(map(_upserted, COLUMNS))} FROM known k FULL JOIN s USING (path)",
        "quarantine_batches": f"WITH {_LEDGER} {_BATCHES}",
        "quarantine_batch_files": f"WITH {_LEDGER} SELECT o.batch_id, o.id AS row_id, o.file_id, c.path, c.size FROM open o JOIN cur c ON c.id = o.file_id",
        "quarantine_totals": f"WITH {_LEDGER} SELECT count(*) AS batches, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM ({_BATCHES})",
        "restore_effect": f"WITH {_LEDGER} SELECT status, count(*) AS n FROM (SELECT CASE WHEN id IN (SELECT file_id FROM open WHERE batch_id IS NOT NULL) THEN 'normal' ELSE status END AS status FROM cur) GROUP BY status",
        "restored_ledger": f"WITH {_LEDGER} SELECT id, file_id, CASE WHEN restored_at IS NULL AND file_id IN (SELECT file_id FROM open WHERE batch_id IS NOT NULL) THEN {NOW} ELSE restored_at END AS restored_at FROM q",
        "purge_ledger": f"WITH {_LEDGER} SELECT * FROM q WHERE NOT EXISTS (SELECT 1 FROM open o WHERE o.batch_id IS NOT NULL AND (o.file_id = q.file_id OR o.id = q.id))",
        "purge_log": f"WITH {_LEDGER} SELECT o.id, o.moved_path AS path, c.size, CAST({NOW} AS BIGINT) AS purged_at, o.batch_id FROM open o LEFT JOIN cur c ON c.id = o.file_id WHERE o.batch_id IS NOT NULL",
        "purge_report": f"WITH {_LEDGER} SELECT o.batch_id, count(*) AS purged, CAST(coalesce(sum(c.size), 0) AS BIGINT) AS bytes FROM open o LEFT JOIN cur c ON c.id = o.file_id WHERE o.batch_id IS NOT NULL GROUP BY o.batch_id",
        "unique_dest": rf"""WITH {_LEDGER}, r AS (SELECT id, name, stem, row_number() OVER (PARTITION BY name ORDER BY id) - 1 AS k FROM (SELECT id, {_BASE} AS name, {_STEM} AS stem FROM cur)),
f AS (SELECT regexp_extract(moved_path, '([^/\\]*)$', 1) AS name FROM open UNION SELECT stem || '__' || (id % 4 + 1) || '.' || regexp_extract(name, '([^.]*)$', 1) FROM r WHERE id % 3 = 0),
t AS (SELECT name, t, row_number() OVER (PARTITION BY name ORDER BY t) - 1 AS i FROM (SELECT DISTINCT n.name, s.t FROM (SELECT DISTINCT name, stem FROM r) n JOIN (SELECT name AS held, 0 AS t, name AS own FROM f
  UNION ALL SELECT name, CAST(regexp_extract(name, '__([1-9][0-9]*)\.[^.]*$', 1) AS BIGINT), regexp_replace(name, '__[1-9][0-9]*(\.[^.]*)$', '\1') FROM f WHERE regexp_matches(name, '__[1-9][0-9]*\.[^.]*$')) s ON s.own = n.name)),
p AS (SELECT id, name, stem, k + (SELECT count(*) FROM t WHERE t.name = r.name AND t.t - t.i <= r.k) AS n FROM r)
SELECT id, CASE WHEN n = 0 THEN name ELSE stem || '__' || n || {_EXT} END AS dest FROM p""",
        "cache_evict": f"WITH {_THUMBS} SELECT name, size FROM gone",
        "cache_report": f"WITH {_THUMBS} SELECT count(*) AS removed, CAST(coalesce(sum(size), 0) AS BIGINT) AS freed, CAST((SELECT total FROM t) - coalesce(sum(size), 0) AS BIGINT) AS remaining FROM gone",
        "nearest_rank_p95": _RANKED.format(cur=_CUR, v="gray_score") + "SELECT ext, n, v AS p95 FROM r WHERE place = (2 * 95 * (n - 1) + 100) // 200",
        "median_size": _RANKED.format(cur=_CUR, v="size") + "SELECT ext, n, avg(v) AS median FROM r WHERE place IN ((n - 1) // 2, n // 2) GROUP BY ext, n",
    }
