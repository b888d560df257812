"""Filters, facets, names, groups, increments and ledger on small tables with known answers."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.functions import names, scalars
from shelfmark.operators import cache, catalogue, facets, filters, grouping, ledger, ordering, similar
from shelfmark.operators.filters import Filter
from shelfmark.tables import current_files, phash_bits, valid_hash


@pytest.fixture(scope="module")
def seed(files):
    return files(
        {"path": "a.jpg", "ext": "jpg", "size": 1000, "width": 800, "height": 600, "gray_score": 20.0, "content_hash": "h1"},
        {"path": "b.png", "ext": "png", "size": 5000, "width": 1600, "height": 1200, "gray_score": 200.0, "content_hash": "h1"},
        {"path": "c.gif", "ext": "gif", "size": 300, "width": 320, "height": 240, "gray_score": 5.0},
        {"path": "d.jpg", "ext": "jpg", "size": 900, "status": "quarantined"},
    )


@pytest.mark.parametrize(
    ("f", "want"),
    [
        (Filter(), "abc"), (Filter(min_pixels=400_000), "ab"), (Filter(min_pixels=1_000_000), "b"), (Filter(max_pixels=100_000), "c"),
        (Filter(exts=("PNG",)), "b"), (Filter(search="C.GIF"), "c"), (Filter(search="  "), "abc"), (Filter(only_gray=True), "c"),
        (Filter(only_duplicated=True), "ab"), (Filter(only_duplicated=True, exts=("png",)), "b"), (Filter(only_decode_error=True), ""),
        (Filter(min_size=1000, max_size=1000), "a"), (Filter(search="_.j"), "a"), (Filter(search="a\\"), ""),
    ],
)
def test_filters(seed, f, want):
    assert sorted(r.path[0] for r in filters.matching(seed, f).collect()) == list(want)
    assert filters.count_matching(seed, f).head()[0] == len(want)


def test_pages(seed):
    order = lambda f: [r.path[0] for r in filters.page(seed, f).collect()]
    assert order(Filter()) == list("bac")
    assert order(Filter(offset=-5, limit=-1, sort="path_asc")) == list("abc")
    assert order(Filter(offset=1, limit=1)) == ["a"]
    assert [r.path[0] for r in filters.page_after(seed, Filter(), {"size": 5000, "id": 2}).collect()] == ["a", "c"]
    assert order(Filter(sort="pixels_asc")) == list("cab")


def test_search_is_ascii_only(files):
    t = files({"path": "ÀBC.jpg"}, {"path": "àbc.jpg"}, {"path": "x\\a\\b.jpg"})
    found = lambda s: {r.id for r in filters.matching(t, Filter(search=s)).collect()}
    assert found("àb") == {2} and found("bc") == {1, 2} and found("\\A\\") == {3} and found("%.jpg") == {1, 2, 3}


def test_filter_words():
    assert Filter().is_default() and Filter(search=" ").is_default()
    assert Filter(min_size=0, only_gray=True).without("min_size").conditions() == ["only_gray"] and Filter(search="a").without("search").is_default()
    assert Filter(min_size=0, only_gray=True).conditions() == ["min_size", "only_gray"]
    assert filters.toggle_ext(["a", "b"], [], "a") == ["b"]
    assert filters.toggle_ext(["a", "b"], ["b"], "b") == ["b"]
    assert filters.toggle_ext(["a", "b"], ["b"], "a") == []
    assert [filters.page_size_for_refresh(*x) for x in ((0, 0), (500, 20), (9000, 1))] == [300, 520, 3000]


def test_histograms(files):
    t = files({"short_side": 250, "size": 1 << 20}, {"short_side": 1500, "size": 1 << 20}, {"short_side": 9000, "size": 1 << 20}, {"short_side": 1000, "size": 512}, {"short_side": 1000, "size": 100}, {"short_side": 1000, "size": 2 << 20})
    w = facets.wide(facets.short_side_histogram(t)).head()
    assert len(w.buckets) == 40 and len(w.edges) == 41 and w.edges[40] == 8000 and w.max == 3
    assert {i: n for i, n in enumerate(w.buckets) if n} == {1: 1, 5: 3, 7: 1, 39: 1}
    w = facets.wide(facets.size_histogram(t)).head()
    assert w.edges[0] == 1024 and {i: n for i, n in enumerate(w.buckets) if n} == {0: 2, 10: 3, 11: 1}
    t = files({"width": 640, "height": 480, "ext": "jpg"}, {"width": 1920, "height": 1080, "ext": "png"}, {"width": 4000, "height": 3000, "ext": "png"}, {"width": 5})
    w = facets.wide(facets.pixel_histogram(t)).head()
    assert w.edges[0] == 4096 and {i: n for i, n in enumerate(w.buckets) if n} == {6: 1, 8: 1, 11: 1}
    assert {tuple(r) for r in facets.format_stats(t).collect()} == {("png", 2), ("jpg", 1), (facets.NO_EXT, 1)}


def test_facets_of_nothing(files):
    t = files().where("false")
    assert tuple(facets.library_stats(t).head()) == (0, 0, 0)
    assert facets.size_histogram(t).agg(F.sum("n")).head()[0] == 0
    assert facets.format_stats(t).count() == 0


STEMS = [
    ("白ウサギ - 赤倉@初画集＆個展 - [pid=115088821] -", 115088821, None, None), ("#1 - ∞ - Rella - 133377800 -", 133377800, "Rella", None), ("[pid=65519461]", 65519461, None, None),
    ("-.jpg", None, None, None), ("_LM7_ - 105", None, None, None), ("#1 - 白ウサギ - 赤倉@初画集＆個展 - [pid=115088821] -", 115088821, "赤倉@初画集＆個展", None),
    ("x pid　=　12345 y", 12345, None, None), ("12345678_P3", 12345678, None, 3), ("a_p3_pixiv", None, None, None), ("a_p99999999999", 99999999999, None, None), ("12345_67890", 12345, None, None),
    ("　a　 - b -  c  - d", None, "c", None), (None, None, None, None), ("", None, None, None),
]


def test_names(rows):
    t = rows([(i, s[0]) for i, s in enumerate(STEMS)], "id int, s string")
    out = t.select("id", names.parse_pid(F.col("s")), names.parse_artist(F.col("s")), names.page_of(F.col("s"))).orderBy("id").collect()
    for r, s in zip(out, STEMS):
        assert tuple(r)[1:] == s[1:], s
    p = rows([("D:\\x\\A.JPG",), ("/y/.hidden",), ("/y/a.b.c",), ("/y/plain",), ("/y/dot.",), (None,)], "p string")
    assert [tuple(r) for r in p.select(names.stem(F.col("p")), names.extension(F.col("p")), names.base_name(F.col("p"))).collect()] == [("A", "jpg", "A.JPG"), (".hidden", None, ".hidden"), ("a.b", "c", "a.b.c"), ("plain", None, "plain"), ("dot", "", "dot."), (None, None, None)]
    assert p.select(names.same_volume(F.col("p"), F.lit("d:/q"))).head()[0]


def test_quarantine_folder():
    names.check_quarantine_dir("D:/keep", ["D:\\pics\\"])
    for bad in ("", "d:/PICS", "D:/pics/sub/"):
        with pytest.raises(ValueError):
            names.check_quarantine_dir(bad, ["D:\\pics\\"])


def test_words(rows):
    t = rows([(None,), (0,), (1536,), (1234567,), (200 << 20,), (3 << 30,), (150 << 30,), (3 << 40,)], "n bigint")
    assert [r[0] for r in t.select(scalars.format_bytes(F.col("n"))).collect()] == ["0 MB", "0 MB", "2 KB", "1.2 MB", "200 MB", "3.00 GB", "150 GB", "3.00 TB"]
    t = rows([(None,), (500,), (1920000,), (250000000,)], "n bigint")
    assert [r[0] for r in t.select(scalars.format_pixels(F.col("n"))).collect()] == ["0 像素", "500 像素", "192 万像素", "2.50 亿像素"]
    t = rows([(0.0,), (0.5,), (30.2,), (120.0,), (5400.0,)], "s double")
    assert [r[0] for r in t.select(scalars.format_eta(F.col("s"))).collect()] == ["", "马上好", "还要 30 秒", "还要约 2 分钟", "还要约 1.5 小时"]
    t = rows([(3, 10, 0.01)], "a int, b int, e double")
    assert tuple(t.select(scalars.progress_percent(F.col("a"), F.col("b")), scalars.progress_percent(F.col("a"), F.lit(0)), scalars.throughput(F.col("a"), F.col("e"))).head()) == (30, 0, 0.0)
    v = rows([(100.0,)], "v double").select(scalars.slider_position(F.col("v"), 1, 10000, True).alias("p")).select("p", scalars.slider_value(F.col("p"), 1, 10000, True)).head()
    assert tuple(v) == (0.5, 100.0)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=20))
def test_hex_round_trip(rows, values):
    t = rows([(f"{v:016x}", f"0x{v:016X}"[:2] + f" {v:016X}") for v in values], "h string, odd string")
    for v, r in zip(values, t.select(scalars.to_hex(scalars.from_hex(F.col("h"))), scalars.hamming(scalars.from_hex(F.col("h")), F.lit(0).cast("bigint")), phash_bits(F.col("odd"))).collect()):
        assert r[0] == f"{v:016x}" and r[1] == bin(v).count("1") and (r[2] or 0) % 2**64 == v


def test_normal_forms(rows):
    t = rows([(x,) for x in (None, "", "0" * 16, "zz", " 0XAb-cd ef01 2345 6789 ", "12345", "0" * 17 + "1", "0x0123456789abcdef0")], "p string")
    assert [r[0] for r in t.select(phash_bits(F.col("p"))).collect()] == [None, None, None, None, 0xABCDEF0123456789 - 2**64, None, None, None]
    t = rows([(None,), (" " + "A" * 64 + "\u3000",), ("a" * 63,), ("g" * 64,)], "h string")
    assert [r[0] for r in t.select(valid_hash(F.col("h"))).collect()] == [None, "a" * 64, None, None]


def test_current_rows(files):
    t = files({"id": 1, "scanned_at": None, "size": 9}, {"id": 1, "scanned_at": 3, "size": 1}, {"id": 1, "scanned_at": 3, "size": 1}, {"id": 2, "scanned_at": None, "size": 7}, {"id": None, "size": 5})
    assert sorted(tuple(r) for r in current_files(t, ["size"]).collect()) == [(1, 1), (2, 7)]


def test_keepers(files, got):
    t = files({"path": "thumb_x.png", "content_hash": "h"}, {"path": "12345678_p0.png", "pid": 12345678, "content_hash": "h"})
    assert got(grouping.keeper_reasons(t)) == [("h", 2, grouping.REASONS[1])]
    t = files({"path": "sub/dir/deep/aaa.jpg", "content_hash": "h"}, {"path": "aaa.jpg", "content_hash": "h"})
    assert got(grouping.keeper_reasons(t)) == [("h", 2, grouping.REASONS[2])]
    t = files({"path": "late9.jpg", "mtime": 99, "content_hash": "h", "size": 4}, {"path": "early.jpg", "mtime": 5, "content_hash": "h", "size": 4}, {"content_hash": "x"}, {"content_hash": None})
    assert got(grouping.keeper_reasons(t)) == [("h", 2, grouping.REASONS[3])]
    assert got(grouping.exact_keepers(t)) == [("h", 2, 2, 4)]
    t = files({"path": "色图/a", "content_hash": "h"}, {"path": "abcdef/a", "content_hash": "h"})
    assert got(grouping.exact_keepers(t))[0][1] == 1  # equal bytes, so the smaller id
    assert got(grouping.exact_keepers(t.where("false"))) == []


def test_size_candidates(files):
    t = files({"size": 100}, {"size": 100, "content_hash": "x"}, {"size": 100}, {"size": 200}, {"size": 200, "status": "quarantined"}, {"size": None}, {"size": None})
    assert {r.id for r in grouping.size_candidates(t).collect()} == {1, 2, 3}
    assert {r.id for r in grouping.needs_content(t).collect()} == {1, 3}


def test_recorded_groups(files, rows, got):
    t = files({"content_hash": "h"}, {"content_hash": "h"}, {"content_hash": "g"}, {"content_hash": "g", "size": 7}, {"content_hash": "z"})
    g, m = grouping.recorded_groups(t)
    assert got(g) == [(1, "exact", 3), (2, "exact", 1)] and got(m) == [(1, 3, 0), (1, 4, 0), (2, 1, 0), (2, 2, 0)]
    view = {r.group_id: r for r in grouping.group_views(t, g, m).collect()}
    assert view[1].savings == 7 and view[1].members == 1 and view[1].reason == grouping.REASONS[4]
    assert got(grouping.default_selection(t, g, m)) == [(1, 4, 7), (2, 2, 1)]
    gone = rows([(7, "exact", 99), (8, "exact", None)], "id bigint, kind string, keep_file_id bigint")
    assert grouping.group_views(t, gone, m).count() == 0
    assert [r.group_id for r in grouping.group_page(t, g.union(gone), m, "exact", 0, -3).collect()] == [1]
    page = grouping.list_groups(t, g.union(gone), m, "exact", 1, 1).collect()
    assert {(r.group_id, r.keep, r.file_id, r.distance, r.savings, r.path) for r in page} == {(2, True, 1, 0, 1, "/r/f1.jpg"), (2, False, 2, 0, 1, "/r/f2.jpg")}
    left = grouping.clear_groups(g.withColumn("kind", F.lit(" Exact ")), m, "exact")
    assert left[0].count() == left[1].count() == 0
    assert {tuple(r) for r in grouping.set_keeper(g, 1, 4).collect()} == {(1, "exact", 4), (2, "exact", 1)}


def _hex(v):
    return f"{v % 2**64:016x}"


@pytest.mark.parametrize(
    ("records", "groups"),
    [
        ([{"phash": _hex(0)}, {"phash": _hex(-1)}], 0),
        ([{"phash": _hex(5), "pid": 100, "path": "1_p0.png"}, {"phash": _hex(5), "pid": 100, "path": "1_p1.png"}], 0),
        ([{"phash": _hex(5), "pid": 100, "path": "1_p0.png"}, {"phash": _hex(4), "pid": 100, "path": "x/1_p0.png"}], 1),
        ([{"phash": _hex(5), "pid": 100, "path": "1_p0.png"}, {"phash": _hex(4), "pid": 100, "path": "1.png"}], 1),
        ([{"phash": _hex(0)}, {"phash": _hex(2**8 - 1)}, {"phash": _hex(2**16 - 1)}], 1),
        ([{"phash": "zzz"}, {"phash": None}], 0),
        ([], 0),
    ],
)
def test_similar_groups(files, records, groups):
    out = similar.similar_groups(files(*records)).collect()
    assert len({r.group_no for r in out}) == groups
    assert all(r.distance == 0 for r in out if r.file_id == r.keep_id)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 5), st.sampled_from([None, 1, 2]), st.sampled_from([None, 0, 1, 2])), min_size=2, max_size=24))
def test_similar_links_connect_what_all_pairs_do(rows, picked):
    # fingerprints far apart but for 0|1|2 and 3|4, so that chains and conflicts mix
    bits = [0, 3, 15, 2**40 - 1, 2**40 - 2, 2**63 - 2**20]
    recs = [(i, bits[b], p, g) for i, (b, p, g) in enumerate(picked)]
    want = list(range(len(recs)))

    def find(x):
        while want[x] != x:
            x = want[x]
        return x

    for i, a in enumerate(recs):
        for j in range(i):
            b = recs[j]
            if bin(a[1] ^ b[1]).count("1") <= 3 and not (None not in (a[2], b[2], a[3], b[3]) and a[2] == b[2] and a[3] != b[3]):
                x, y = sorted((find(i), find(j)))
                want[y] = x
    t = rows(recs, "id bigint, bits bigint, pid bigint, page bigint")
    out = {r.id: r.root for r in similar.components(similar.similar_links(t, 3)).collect()}
    full = {i: find(i) for i in range(len(recs))}
    assert out == {i: r for i, r in full.items() if list(full.values()).count(r) > 1}


@pytest.mark.parametrize("threshold", [0, 1, 2, 8, 15, 16])
def test_near_bits_at_every_threshold(rows, threshold):
    rnd = random.Random(threshold)
    centres = [rnd.getrandbits(64) for _ in range(8)] + [0, 2**64 - 1]
    values = {c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(threshold + 2))) for c in centres for _ in range(25)} | {rnd.getrandbits(64) for _ in range(60)}
    signed = {v: v - 2**64 if v >= 2**63 else v for v in values}
    want = {(*sorted((signed[a], signed[b])), d) for a in values for b in values if a < b and (d := bin(a ^ b).count("1")) <= threshold}
    t = rows([(v,) for v in signed.values()], "bits bigint")
    for limit in (100_000, 20):
        assert {tuple(r) for r in similar.near_bits(t, threshold, limit).collect()} == want
    prints = t.select("bits", *(F.lit(x).cast("bigint").alias(c) for c, x in (("pid", -1), ("page", -1), ("plain", 1))))
    forest = similar.near_forest(prints, threshold, 20)
    assert {tuple(r) for r in forest.collect()} <= {(a, b) for a, b, _ in want}
    roots = {r.id: r.root for r in similar.components(forest.withColumnsRenamed({"a": "id", "b": "other"})).collect()}
    assert len(set(roots.values())) == len({r.root for r in similar.components(rows([(a, b) for a, b, _ in want], "id bigint, other bigint")).collect()}) and set(roots) == {x for a, b, _ in want for x in (a, b)}


def test_dense_cluster_gives_a_forest(rows):
    base = 0x0123456789ABCDEF
    values = [base ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)]
    t = rows([(v - 2**64 if v >= 2**63 else v, -1, -1, 1) for v in values], "bits bigint, pid bigint, page bigint, plain bigint")
    links = similar.near_forest(t, 8)
    # all two million pairs are near; buckets give back their rows less one
    assert links.count() < 12 * len(values) and len({r.root for r in similar.components(links.withColumnsRenamed({"a": "id", "b": "other"})).collect()}) == 1


def test_upsert(files, got):
    old = files({"id": 7, "path": "a", "size": 1024, "mtime": 100, "content_hash": "h", "phash": "p", "gray_score": 3.0, "status": "quarantined"}, {"id": 8, "path": "b", "size": 5, "mtime": 5, "status": "quarantined"}, {"id": 9, "path": "c"})
    new = files({"id": 101, "path": "a", "size": 2048, "mtime": 200, "decode_error": "bad"}, {"id": 102, "path": "b", "size": 5, "mtime": 5}, {"id": 103, "path": "d", "status": "", "decode_error": "bad", "width": 3, "height": 2}, {"id": 104, "path": "e", "size": None})
    d = catalogue.scan_difference(new, filters.known_files(old))
    assert {r.path: r.change for r in d.collect()} == {"a": "updated", "b": "skipped", "d": "inserted", "e": "failed"}
    assert tuple(catalogue.scan_stats(d).head()) == (4, 1, 1, 1, 1, False)
    out = {r.path: r for r in catalogue.upsert(old, new, 55).collect()}
    assert sorted(out) == ["a", "b", "c", "d"]
    a = out["a"]
    assert (a.id, a.status, a.size, a.content_hash, a.phash, a.gray_score, a.decode_error, a.scanned_at) == (7, "normal", 2048, None, None, None, None, 55)
    assert out["b"].status == "quarantined" and out["c"].id == 9
    assert (out["d"].status, out["d"].decode_error, out["d"].short_side) == ("normal", "bad", 2)
    assert {r.path: r.decode_error for r in catalogue.upsert(old, new, 55, keep_decode_error=True).collect()}["a"] == "bad"
    assert catalogue.upsert(old.where("false"), new.where("false"), 1).count() == 0


def test_updates(files, rows):
    t = files({"phash": None}, {"phash": "x"})
    u = rows([(1, "p", 2.0, None), (9, "q", 1.0, None)], "id bigint, phash string, gray_score double, decode_error string")
    assert [(r.id, r.phash, r.fingerprinted_at) for r in catalogue.set_fingerprints(t, u, 77).orderBy("id").collect()] == [(1, "p", 77), (2, "x", None)]
    assert {r.id: r.status for r in catalogue.set_status(t, rows([(2,)], "id bigint"), "gone").collect()} == {1: "normal", 2: "gone"}
    assert [r.id for r in catalogue.delete_rows(t, rows([(1,)], "id bigint"), "id").collect()] == [2]
    m = rows([(1, 1, 5), (1, 2, 6)], "g bigint, f bigint, d bigint")
    assert sorted(tuple(r) for r in catalogue.replace_rows(m, rows([(1, 2, 9), (2, 2, 0)], "g bigint, f bigint, d bigint"), ["g", "f"]).collect()) == [(1, 1, 5), (1, 2, 9), (2, 2, 0)]


LEDGER = "id bigint, file_id bigint, original_path string, moved_path string, batch_id string, moved_at bigint, restored_at bigint"


def test_ledger(files, rows, got):
    t = files({"id": 1, "size": 10, "status": "quarantined"}, {"id": 2, "size": 20, "status": "quarantined"})
    q = rows([(1, 1, "a", "q/a", "b1", 5, None), (1, 1, "a", "q/a", "b1", 5, None), (2, 2, "b", "q/b", "b1", 6, None), (3, 99, "c", "q/c", "b2", 7, None), (4, 1, "a", "q/a", "b0", 1, 2)], LEDGER)
    assert got(ledger.batches(q, t)) == [("b1", 2, 6, 30), ("b2", 1, 7, 0)]
    assert len(got(ledger.batch_files(q, t))) == 2
    after_q, after_f = ledger.restore_effect(q, t, rows([(1,), (2,)], "id bigint"), 50)
    assert {r.id: r.status for r in after_f.collect()} == {1: "normal", 2: "normal"}
    assert {r.id: r.restored_at for r in after_q.collect()} == {1: 50, 2: 50, 3: None, 4: 2}
    rest, log, report = ledger.purge_effect(q, t, F.col("batch_id") == "b1", 60)
    assert got(rest.select("id")) == [(3,)]  # restored history of file 1 is gone as well
    assert got(log.select("path", "size", "purged_at")) == [("q/a", 10, 60), ("q/b", 20, 60)] and got(report) == [("b1", 2, 30)]
    f, ids = files({"id": 1, "path": "x/n.jpg", "size": 3}, {"id": 2, "path": "y/n.jpg", "size": 4}, {"id": 4, "path": "z/n.jpg", "size": 5}), rows([(1,), (2,), (3,), (4,), (4,)], "id bigint")
    plan = ledger.plan_moves(f, ids, "b9", "/q/", rows([("n__1.jpg",)], "name string"), 70)
    assert got(plan.select("file_id", "moved_path")) == [(1, "/q/n.jpg"), (2, "/q/n__2.jpg"), (4, "/q/n__3.jpg")]
    cat, new, done = ledger.move_effect(f, ids, plan.withColumn("error", F.when(F.col("file_id") == 2, "gone")))
    assert tuple(done.head()) == (2, 2, 8) and {r.id: r.status for r in cat.collect()} == {1: "quarantined", 2: "normal", 4: "quarantined"}
    assert {r.file_id for r in new.collect()} == {1, 4} and new.columns == [c.split()[0] for c in LEDGER.split(", ")]
    assert ledger.dropped_by_association(10, 7, 2) == 1 and ledger.dropped_by_association(1, 7, 2) == 0


def _walked(moves, taken):
    """Names one after the other, as a single process would give them."""
    used, out = set(taken), {}
    for i, p in sorted(moves):
        name = p.replace("\\", "/").rsplit("/", 1)[-1]
        stem, dot, ext = name.rpartition(".")
        if not stem:
            stem, dot, ext = name, "", ""
        dest, n = name, 0
        while dest in used:
            n += 1
            dest = f"{stem}__{n}" + (f".{ext}" if ext else "")
        used.add(dest)
        out[i] = dest
    return out


@pytest.mark.parametrize("seed", range(2))
def test_unique_names(rows, seed):
    rnd = random.Random(seed)
    kin = ["x.jpg", "x__1.jpg", "x__1__1.jpg", "x__3.jpg"]
    moves = [(i, rnd.choice("abc") + rnd.choice("/\\") + rnd.choice([*kin, "y", "z.png", "z.png", "z.png", ".h", "w.", "Y"])) for i in range(120)]
    taken = ["x.jpg", "x__2.jpg", "y", "y__1", "y__3", "z__1.png", "z__2.png", "z__5.png", "z__01.png", "z__7.jpg", "w__1", "zz.png"]
    out = {r.id: r.dest for r in ledger.unique_names(rows(moves, "id bigint, p string"), rows([(t,) for t in taken] + [(None,)], "name string"), "p", "id").collect()}
    assert out == _walked(moves, taken)
    plain = [m for m in moves if m[1][2:] in ("z.png", "y")]
    out = {r.id: r.dest for r in ledger.unique_names(rows(plain, "id bigint, p string"), rows([(t,) for t in taken], "name string"), "p", "id").collect()}
    assert out == _walked(plain, taken)
    assert ledger.unique_names(rows([], "id bigint, p string"), rows([], "name string"), "p", "id").count() == 0
    assert ledger.unique_names(rows([(1, None)], "id bigint, p string"), rows([], "name string"), "p", "id").head().dest is None


def test_cache(rows, got):
    m = rows([(f"{i}", i, 1000) for i in range(4)], "name string, mtime bigint, size bigint")
    assert [r.name for r in cache.evicted(m, 2500).orderBy("name").collect()] == ["0", "1"]
    assert tuple(cache.trim_report(m, 2500).head()) == (2, 2000, 2000)
    assert cache.evicted(m, 10000).count() == cache.evicted(m, 0).count() == cache.evicted(m.where("false"), 5).count() == 0
    # the target is a whole tenth times eight
    assert [r.name for r in cache.evicted(m, 3999).collect()] == ["0"]


def test_ranks(rows, got):
    t = rows([(g, float(v), i) for i, (g, v) in enumerate([("a", x) for x in range(21)] + [("b", 5), ("b", 7), (None, 1)])], "g string, v double, i bigint")
    assert got(ordering.nearest_rank(t, "g", "v", "i", 95)) == [("a", 21, 19.0), ("b", 2, 7.0), (None, 1, 1.0)]
    assert got(ordering.median(t, "g", "v", "i")) == [("a", 21, 10.0), ("b", 2, 6.0), (None, 1, 1.0)]
    assert got(ordering.numbered(t.where("false"), [F.col("i")], "n")) == []
    n = ordering.numbered(t, [F.col("i").desc()], "n").collect()
    assert {r.i: r.n for r in n} == {i: 24 - i for i in range(24)}
