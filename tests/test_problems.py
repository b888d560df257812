"""Broken references and heavy keys on small tables with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import heavy, references

MEMBERS, GROUPS = "group_id bigint, file_id bigint, distance bigint", "id bigint, kind string, keep_file_id bigint, created_at bigint"
LEDGER = "id bigint, file_id bigint, original_path string, moved_path string, batch_id string, moved_at bigint, restored_at bigint"
T = 1_700_000_000  # November 2023


def test_catalogue_broken(rows, files, got):
    f = files({"id": 1, "scanned_at": T + 50}, {"id": 1, "scanned_at": None}, {"id": 2, "scanned_at": T + 500}, {"id": 2, "scanned_at": T}, {"id": 3, "scanned_at": None}, {"id": None})
    members = rows([(1, 1, 0), (1, 1, 3), (1, 9, 0), (None, 9, 0), (7, 1, 0), (7, None, 0), (-1, 8, 0), (1, 3, 0)], MEMBERS)
    groups = rows([(1, "exact", 2, T * 1000), (1, "exact", 2, T * 1000), (2, "exact", None, T), (3, "exact", 9, 0), (4, "exact", 9, None), (5, "x", 1, T)], GROUPS)
    q = rows([(1, 1, "", "", "b", T + 60, None), (2, 1, "", "", "b", T, None), (3, None, "", "", "b", T, None), (4, 5, "", "", "b", 0, None), (5, 2, "", "", "b", 0, None)], LEDGER)
    found = references.catalogue_broken(f, members, groups, q)
    assert got(found) == sorted([
        ("dup_members", 1, 1, "2023-11", "later"), ("dup_members", 1, 9, "2023-11", "absent"), ("dup_members", 0, 9, "unknown", "absent"), ("dup_members", -1, 8, "unknown", "absent"),
        ("dup_groups", 3, 9, "unknown", "absent"), ("dup_groups", 4, 9, "unknown", "absent"), ("dup_groups", 5, 1, "2023-11", "later"),
        ("quarantine", 2, 1, "2023-11", "later"), ("quarantine", 4, 5, "unknown", "absent"),
    ], key=repr)
    assert ("dup_members", "2023-11", "absent", 1, 1) in got(references.broken_counts(found))
    empty = references.catalogue_broken(f.where("false"), members, groups, q)
    assert {r.state for r in empty.collect()} == {"absent"}
    assert references.catalogue_broken(f, members.where("false"), groups.where("false"), q.where("false")).count() == 0


def test_clashing_columns(rows):
    refs = rows([(1, 5, "a"), (1, 5, "a"), (2, None, "b"), (3, 1, "c")], "id bigint, ref bigint, state string").withColumnRenamed("state", "name")
    refs = refs.withColumn("at", F.lit(10).cast("bigint"))
    parents = rows([(1, 20, "n"), (1, 30, "m")], "id bigint, at bigint, name string")
    out = references.broken_references(refs, parents, "ref", "at", "id", "at").collect()
    assert sorted(tuple(r) for r in out) == [(1, 5, "a", 10, "absent"), (1, 5, "a", 10, "absent"), (3, 1, "c", 10, "later")]


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_aggregate_by_range(rows, got, partitions):
    rnd = random.Random(partitions)
    data = [(rnd.choice("ab"), rnd.choice(["hot", "hot", "hot", "1", "22", "x y", ""]), rnd.choice([None, 1, 5, 10**12]), rnd.choice([None, -3, 7]), i) for i in range(900)]
    data += [(None, "k", 1, 1, 1), ("a", None, 1, 1, 1), ("a", "nulls", None, None, 1), ("a", "hot", 1, 1, 5), ("a", "hot", 1, 1, 5)]
    want = {}
    for f, k, b, m, _ in data:
        if f is not None and k is not None:
            n, s, t = want.get((f, k), (0, None, None))
            want[f, k] = (n + 1, s if b is None else (s or 0) + b, t if m is None else max(m, t if t is not None else m))
    out = heavy.aggregate_by_range(rows(data, "field_name string, key_value string, bytes bigint, newest bigint, id bigint"), ["id"], partitions)
    assert {(r.field_name, r.key_value): (r.n, r.bytes, r.newest) for r in out.collect()} == want
    assert heavy.aggregate_by_range(out.withColumn("id", F.lit(1)).where("false"), ["id"], partitions).count() == 0


def test_heavy_values(files, got):
    t = files(*({"size": 5, "content_hash": "A" * 64 if i % 2 else " " + "a" * 64} for i in range(30)), *({"size": 100 + i, "content_hash": "pending"} for i in range(40)))
    assert got(heavy.heavy_values(t, 0.1).select("field_name", "key_value", "n")) == [("content_hash", "a" * 64, 30), ("size", "5", 30)]
    assert heavy.heavy_values(t.where("false")).count() == 0
