"""Queries and SQL of the operators in this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import components, increments, leaks, spans, survivors, tokenizer, vectors
from shelfmark.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return components.match_groups(table(spark, d, "dup_members"), table(spark, d, "files"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return vectors.neighbour_pairs(vectors.nearest_files(table(spark, d, "files")))


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return vectors.nearest_files(table(spark, d, "files"))


def p2_embeddings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return vectors.most_similar(e, "vec_id", "embedding", 5, e.where("vec_id % 20 = 0")).select("query_id", "other_id", F.round("similarity", 6).alias("similarity"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.disputed_keepers(*(table(spark, d, t) for t in ("dup_groups", "dup_members", "files"))).select("group_id", "file_id")


def p5_keepers(spark: SparkSession, d: str) -> DataFrame:
    return survivors.disputed_keepers(*(table(spark, d, t) for t in ("dup_groups", "dup_members", "files")))


def p5_consensus(spark: SparkSession, d: str) -> DataFrame:
    return survivors.consensus_paths(*(table(spark, d, t) for t in ("dup_groups", "dup_members", "files")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return increments.repeated_files(table(spark, d, "files"), table(spark, d, "scan_batches"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_suites(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leak_report(p8_found(spark, d), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.documents_with_shared_spans(table(spark, d, "documents"))


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return spans.shared_share(documents, spans.shared_spans(documents))


def queries() -> dict[str, Query]:
    found = [p1_found, p2_found, p2_neighbours, p2_embeddings, p5_found, p5_keepers, p5_consensus, p6_found, p7_ids, p8_found, p8_suites, p9_found, p9_shared]
    return {f.__name__: f for f in found}


_CURRENT = "cur AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY scanned_at DESC NULLS LAST) AS rn FROM files) WHERE rn = 1)"
_BITS = r"""prints AS (SELECT id, scanned_at, CAST('0x' || h AS UBIGINT) AS v FROM (SELECT id, scanned_at, regexp_replace(regexp_replace(lower(phash), '[\s\-]+', '', 'g'), '^0x', '') AS h FROM cur) WHERE regexp_full_match(h, '[0-9a-f]{16}') AND h <> '0000000000000000')"""

_KEEPERS = """WITH """ + _CURRENT + """, members AS (
  SELECT DISTINCT m.group_id, m.file_id FROM dup_members m JOIN dup_groups g ON g.id = m.group_id WHERE lower(trim(g.kind)) = 'exact'),
best AS (SELECT * FROM (SELECT m.group_id, c.id AS file_id, c.pid, c.path, c.mtime,
  row_number() OVER (PARTITION BY m.group_id ORDER BY (c.pid IS NULL), strlen(c.path), c.mtime, c.id) AS rn FROM members m JOIN cur c ON c.id = m.file_id) WHERE rn = 1)
SELECT DISTINCT b.group_id, b.file_id{more} FROM best b JOIN dup_groups g ON g.id = b.group_id WHERE g.keep_file_id IS NULL OR g.keep_file_id <> b.file_id"""


def oracle_sql() -> dict[str, str]:
    return {
        # min-label walk over the star edges of every hub
        "p1_found": "WITH RECURSIVE " + _CURRENT + ", " + _BITS + """,
hub AS (SELECT 'g' || group_id AS h, file_id AS f FROM dup_members WHERE group_id >= 0 AND file_id IS NOT NULL UNION SELECT 'p' || v, id FROM prints),
star AS (SELECT h, f, min(f) OVER (PARTITION BY h) AS c FROM hub),
edge AS (SELECT f AS a, c AS b FROM star WHERE f <> c UNION SELECT c, f FROM star WHERE f <> c),
walk(id, root) AS (SELECT DISTINCT a, a FROM edge UNION SELECT e.b, w.root FROM walk w JOIN edge e ON e.a = w.id WHERE w.root < e.b)
SELECT id AS file_id, min(root) AS root_id FROM walk GROUP BY id""",
        "p5_found": _KEEPERS.format(more=""),
        "p5_keepers": _KEEPERS.format(more=", b.pid, b.path, b.mtime"),
        "p2_embeddings": """SELECT query_id, other_id, round(s, 6) AS similarity FROM (
SELECT q.vec_id AS query_id, v.vec_id AS other_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS s,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) DESC, v.vec_id) AS rn
FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0) WHERE rn <= 5""",
        "p6_found": "WITH " + _CURRENT + ", " + _BITS + r""",
b AS (SELECT c.id, s.batch_no AS n, CASE WHEN regexp_full_match(lower(trim(c.content_hash)), '[0-9a-f]{64}') THEN lower(trim(c.content_hash)) END AS h, p.v
  FROM cur c JOIN scan_batches s ON c.scanned_at >= s.batch_start AND c.scanned_at < s.batch_end LEFT JOIN prints p ON p.id = c.id),
hs AS (SELECT h, min(n) AS n FROM b WHERE h IS NOT NULL GROUP BY h), vs AS (SELECT v, min(n) AS n FROM b WHERE v IS NOT NULL GROUP BY v)
SELECT b.id AS file_id FROM b JOIN hs ON hs.h = b.h WHERE hs.n < b.n
UNION SELECT b.id FROM b JOIN vs ON vs.n < b.n WHERE bit_count(xor(b.v, vs.v)) <= 6""",
    }
