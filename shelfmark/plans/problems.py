"""Queries and SQL of the general data-quality operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import heavy, references
from shelfmark.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return references.catalogue_broken(*(table(spark, d, t) for t in ("files", "dup_members", "dup_groups", "quarantine")))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return references.broken_counts(p3_found(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy.heavy_values(table(spark, d, "files")).select("field_name", "key_value")


def p4_values(spark: SparkSession, d: str) -> DataFrame:
    return heavy.aggregate_by_range(heavy.file_values(table(spark, d, "files")), ["id"]).select("field_name", "key_value", "n", F.col("bytes"), "newest")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p3_found, p3_counts, p4_found, p4_values)}


_BROKEN = """WITH refs AS (
SELECT DISTINCT 'dup_members' AS src_table, coalesce(m.group_id, 0) AS row_key, m.file_id, g.created_at AS t FROM dup_members m LEFT JOIN dup_groups g ON g.id = m.group_id WHERE m.file_id IS NOT NULL
UNION SELECT 'dup_groups', id, keep_file_id, created_at FROM dup_groups WHERE keep_file_id IS NOT NULL
UNION SELECT 'quarantine', id, file_id, moved_at FROM quarantine WHERE file_id IS NOT NULL),
timed AS (SELECT src_table, row_key, file_id, nullif(CASE WHEN t >= 100000000000 THEN t // 1000 ELSE t END, 0) AS t FROM refs),
parents AS (SELECT id, min(scanned_at) AS since FROM files GROUP BY id),
found AS (SELECT DISTINCT src_table, row_key, file_id, coalesce(strftime(to_timestamp(t) AT TIME ZONE 'UTC', '%Y-%m'), 'unknown') AS period,
  CASE WHEN p.id IS NULL THEN 'absent' WHEN p.since > t THEN 'later' END AS state
FROM timed LEFT JOIN parents p ON p.id = timed.file_id WHERE p.id IS NULL OR p.since > t) """

_VALUES = r"""WITH v AS (
SELECT 'size' AS field_name, CAST(size AS VARCHAR) AS key_value, size, mtime FROM files
UNION ALL SELECT 'content_hash', lower(trim(content_hash)), size, mtime FROM files WHERE regexp_full_match(lower(trim(content_hash)), '[0-9a-f]{64}')) """


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _BROKEN + "SELECT * FROM found",
        "p3_counts": _BROKEN + "SELECT src_table, period, state, count(*) AS refs, count(DISTINCT file_id) AS files FROM found GROUP BY ALL",
        "p4_found": _VALUES + "SELECT field_name, key_value FROM v WHERE key_value IS NOT NULL GROUP BY ALL HAVING count(*) >= 0.01 * (SELECT count(*) FROM files)",
        "p4_values": _VALUES + "SELECT field_name, key_value, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, max(mtime) AS newest FROM v WHERE key_value IS NOT NULL GROUP BY field_name, key_value",
    }
