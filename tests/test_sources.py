"""Pictures on disk: listing, headers, fingerprints, relocation, settings, and scans as a stream."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.functions import jpeg, pixels
from shelfmark.library import Library
from shelfmark.operators.filters import Filter
from shelfmark.sources import scan, thumbs
from shelfmark.sources.settings import Settings, load, save
from shelfmark.streaming import ingest


def png(a: np.ndarray) -> bytes:
    h, w, _ = a.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in a.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def busy(h, w, seed=0):
    y, x = np.mgrid[0:h, 0:w] / [[[h]], [[w]]]
    return np.stack([128 + 90 * np.sin(x * 9 + seed), 128 + 90 * np.cos(y * 7 + seed * 2), 128 + 60 * np.sin((x + y) * 11 + seed * 3)], axis=2).clip(0, 255)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("pics")
    (d / "sub").mkdir()
    (d / "sub" / "copy.PNG").write_bytes(png(busy(200, 150)))
    (d / "a.png").write_bytes(png(busy(200, 150)))
    (d / "12345678_p3.png").write_bytes(png(busy(100, 75)))
    (d / "gray.png").write_bytes(png(np.repeat(busy(60, 60)[:, :, :1], 3, axis=2)))
    (d / "broken.jpg").write_bytes(b"\xff\xd8\xff\xe0" + b"junk" * 20)
    (d / "note.txt").write_text("x")
    (d / ".hidden.gif").write_bytes(b"GIF89a" + struct.pack("<HH", 7, 9) + b"\0" * 20)
    (d / ".kept").mkdir()
    (d / ".kept" / "_u.jpg").write_bytes(b"")
    return d


def test_scan(spark, folder):
    out = {r.path.rsplit("/", 1)[1]: r for r in scan.scan(spark, [str(folder), str(folder / "sub")]).collect()}
    assert set(out) == {"copy.PNG", "a.png", "12345678_p3.png", "gray.png", "broken.jpg", ".hidden.gif", "_u.jpg"}
    assert (out[".hidden.gif"].width, out[".hidden.gif"].height, out["_u.jpg"].size) == (7, 9, 0) and out["_u.jpg"].decode_error
    assert (out["a.png"].width, out["a.png"].height, out["a.png"].short_side, out["a.png"].format) == (150, 200, 150, "png")
    assert out["copy.PNG"].root.endswith("sub") and out["copy.PNG"].ext == "png"
    assert out["broken.jpg"].decode_error and out["broken.jpg"].width is None and out["12345678_p3.png"].pid == 12345678
    with pytest.raises(ValueError):
        scan.list_files(spark, [str(folder / "none")])
    assert scan.list_files(spark, []).count() == 0


def test_digests(spark, folder):
    out = {r.path.rsplit("/", 1)[1]: r.content_hash for r in scan.content_hashes(scan.list_files(spark, [str(folder)])).collect()}
    assert out["a.png"] == out["copy.PNG"] != out["gray.png"]
    assert scan.content_hashes(spark.createDataFrame([("/no/such",)], "path string")).head().content_hash is None


def test_fingerprints(spark, folder):
    rows = pixels.fingerprint_images(spark.read.format("image").load(str(folder / "*.*g"))).collect()
    out = {r.path.rsplit("/", 1)[1]: r for r in rows}
    bits = lambda n: int(out[n].phash, 16)
    assert bin(bits("a.png") ^ bits("12345678_p3.png")).count("1") <= 8
    assert bin(bits("a.png") ^ bits("gray.png")).count("1") > 4
    assert out["gray.png"].gray_score <= 1 and out["a.png"].gray_score > 50
    assert out["broken.jpg"].phash is None and out["broken.jpg"].decode_error


def test_gray_and_ranks():
    flat = lambda *c: np.full((40, 50, 3), c, float)
    assert pixels.gray_score(flat(9, 9, 9)) == 0 and pixels.gray_score(flat(255, 0, 0)) > 100 and pixels.gray_score(flat(130, 128, 126)) <= 8
    assert pixels.nearest_rank(np.array([]), 95) == 0 and pixels.nearest_rank(np.arange(11), 95) == 10 and pixels.nearest_rank(np.array([3.0]), 95) == 3
    assert pixels.phash(busy(300, 400)) == pixels.phash(busy(300, 400)) < 2**63


@pytest.mark.parametrize(
    ("head", "want"),
    [
        (b"BM" + b"\0" * 16 + struct.pack("<ii", 5, -6), ("bmp", 5, 6)), (b"GIF87a" + struct.pack("<HH", 3, 4), ("gif", 3, 4)),
        (b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (9).to_bytes(3, "little") + (19).to_bytes(3, "little"), ("webp", 10, 20)),
        (b"RIFF\0\0\0\0WEBPVP8L" + b"\0" * 5 + ((10 - 1) | (20 - 1) << 14).to_bytes(4, "little") + b"\0" * 9, ("webp", 10, 20)),
        (b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 7, 8) + b"\0" * 4, ("jpeg", 8, 7)), (b"", None), (b"\xff\xd8\xff", None), (b"plain text", None),
    ],
)
def test_sniff(head, want):
    assert scan.sniff(head) == want


def test_relocate(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"12345")
    (tmp_path / "b").write_bytes(b"1")
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "taken").write_bytes(b"0")
    moves = spark.createDataFrame([(str(tmp_path / "a"), str(tmp_path / "q" / "a")), (str(tmp_path / "gone"), str(tmp_path / "q" / "c")), (str(tmp_path / "b"), str(tmp_path / "q" / "taken"))], "original_path string, moved_path string")
    out = {r.original_path[-1]: (r.bytes, r.error is None) for r in scan.relocate_all(moves).coalesce(1).collect()}
    assert out == {"a": (5, True), "e": (None, False), "b": (None, False)}
    assert (tmp_path / "q" / "a").read_bytes() == b"12345" and (tmp_path / "b").exists()


def test_settings(tmp_path):
    p = str(tmp_path / "x" / "s.json")
    assert load(p) == Settings()
    save(Settings(roots=["/a"], gray_threshold=3), p)
    assert load(p).roots == ["/a"] and load(p).gray_threshold == 3
    (tmp_path / "x" / "s.json").write_text("{bad")
    assert load(p) == Settings()
    assert Settings(similar_threshold=17, cache_mb=1).problems() == ["similar_threshold", "cache_mb"]


def test_stream(spark, files, tmp_path):
    arrivals, snapshots, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    files({"path": "a", "size": 1}, {"path": "a", "size": 2, "scanned_at": 2}, {"path": "b"}).coalesce(1).write.parquet(arrivals)
    ingest.follow_scans(spark, arrivals, snapshots, state).awaitTermination()
    assert {(r.path, r.size) for r in ingest.newest_snapshot(spark, snapshots).collect()} == {("a", 2), ("b", 1)}
    files({"path": "b", "size": 9, "scanned_at": 5}, {"path": "c", "scanned_at": 5}).coalesce(1).write.mode("append").parquet(arrivals)
    ingest.follow_scans(spark, arrivals, snapshots, state).awaitTermination()
    assert {(r.path, r.size) for r in ingest.newest_snapshot(spark, snapshots).collect()} == {("a", 2), ("b", 9), ("c", 1)}
    stats = spark.read.parquet(f"{snapshots}/stats").agg(F.sum("inserted"), F.sum("updated")).head()
    assert tuple(stats) == (3, 1)


def test_thumbs(spark, folder, tmp_path):
    import io

    t = scan.scan(spark, [str(folder)]).where(F.col("path").endswith("a.png") | F.col("path").endswith("broken.jpg"))
    images = spark.read.format("image").option("recursiveFileLookup", "true").load(str(folder))
    cache = str(tmp_path / "cache")
    done = {r.name: r.error for r in thumbs.make_thumbs(images, t, cache, 64).collect()}
    assert sorted(map(bool, done.values())) == [False, True]
    name = next(n for n, e in done.items() if e is None)
    assert [r.name for r in thumbs.manifest(spark, cache).collect()] == [name]
    # Spark's own reader decodes what was written, near the resized picture
    back = spark.read.format("image").load(f"{cache}/{name}").head().image
    got = pixels.rgb_of(back.height, back.width, back.nChannels, bytes(back.data)).astype(float)
    want = thumbs.shrink(busy(200, 150), 64)
    assert got.shape == want.shape == (64, 48, 3) and np.abs(got - want).mean() < 12
    assert len(thumbs.make_thumbs(images, t, cache, 64).collect()) == 1  # only the broken one is still missing
    assert tuple(thumbs.trim(spark, cache, 10).head())[0] == 1 and thumbs.manifest(spark, cache).count() == 0
    assert thumbs.fitted(1, 900, 300) == (1, 300) and io.BytesIO(jpeg.encode(np.zeros((3, 5, 3)))).read(2) == b"\xff\xd8"


def test_library(spark, folder, tmp_path):
    import shutil

    pics = tmp_path / "pics"
    shutil.copytree(folder, pics)
    lib = Library(spark, str(tmp_path / "home"))
    with pytest.raises(ValueError):
        lib.save_settings(Settings(roots=[str(pics)], quarantine_dir=str(pics / "q")))
    lib.save_settings(Settings(roots=[str(pics)], quarantine_dir=str(tmp_path / "q"), thumb_edge=32))
    assert tuple(lib.start_scan(now=100).head()) == (7, 7, 0, 0, 0, False)
    assert tuple(lib.start_scan(now=101).head())[3] == 7
    run = lib.start_fingerprint(now=102).head()
    assert run.hashed >= 2 and run.done >= 4 and run.total >= run.done and lib.library_stats().head().total == 7
    assert lib.start_fingerprint(now=103).head().total == 0
    assert lib.count_files(Filter(only_duplicated=True)) == 2 and lib.format_stats().head().n >= 3
    first = lib.query_files(Filter(limit=2)).collect()
    rest = lib.query_files(Filter(), {"size": first[-1].size, "id": first[-1].id}).collect()
    assert len(first) + len(rest) == 7 and lib.histogram("size").head().max >= 1
    assert lib.sql("SELECT count(*) AS n FROM files WHERE ext = :ext", ext="png").head().n == 4
    assert lib.rebuild_groups("exact", now=5) == 1 and lib.rebuild_groups("exact", now=6) == 1
    assert lib.rebuild_groups("similar", now=6) >= 1 and lib.count_dup_groups("exact") == 1
    shown = lib.list_dup_groups("exact").collect()
    spare = next(r.file_id for r in shown if not r.keep)
    lib.set_keeper(shown[0].group_id, spare)
    assert {r.file_id for r in lib.list_dup_groups("exact").collect() if r.keep} == {spare}
    ids = spark.createDataFrame([(spare,), (1,)], "id bigint")
    assert tuple(lib.move_to_quarantine(ids, "b1", now=7).head())[:2] == (1, 1) and lib.count_files() == 6
    assert lib.list_quarantine_batches().head().n == 1 and lib.quarantine_batch_files("b1").head().file_id == spare
    assert tuple(lib.restore_batch("b1", now=8).head()) == (1, 0) and lib.count_files() == 7
    assert lib.list_quarantine_batches().count() == 0
    lib.move_to_quarantine(ids, "b2", now=9)
    assert lib.purge_all_quarantine(now=10).head().purged == 1 and lib.count_files() == 6 and not any((tmp_path / "q").iterdir())
    assert lib.store.read("delete_log").head().batch_id == "b2" and lib.store.read("quarantine").count() == 0
    assert lib.make_thumbs().where("error is null").count() >= 3 and lib.thumb_cache_stats() > 0
    one = lib.query_files(Filter(search="gray")).head()
    assert lib.thumb(one.id)[:2] == b"\xff\xd8" and lib.preview(one.id) is None and lib.thumb(-1) is None
    lib.make_previews(spark.createDataFrame([(one.id,)], "id bigint"))
    assert lib.preview(one.id) and lib.trim_thumb_cache().head().removed == 0
