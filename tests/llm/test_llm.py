"""Operators for training data against brute force, with the edge cases each defines."""

import itertools
import random
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import components, increments, leaks, queries, spans, survivors, tokenizer, vectors
from shelfmark.runtime import shared_dir
from tests.conftest import DATA
from tests.oracle import both


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    ours, theirs = both(spark, name, queries.queries()[name], queries.oracle_sql()[name], DATA)
    assert ours == theirs


def _roots(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted((x, find(x)) for x in root)


@pytest.mark.parametrize("seed", range(3))
def test_components(rows, got, seed):
    rnd = random.Random(seed)
    chain = [(i, i + 1) for i in range(60)] if seed == 0 else []
    back = [(200 - i, 201 - i) for i in range(60)] if seed == 1 else []
    edges = chain + back + [(rnd.randrange(300, 420), rnd.randrange(300, 420)) for _ in range(70)] + [(7, 7), (900, 900), (None, 3), (3, None), (5, 6), (5, 6)]
    assert got(components.connected_components(rows(edges, "a bigint, b bigint"))) == sorted(_roots(edges), key=repr)


def test_components_of_nothing(rows):
    assert components.connected_components(rows([], "x bigint, y bigint")).count() == 0
    assert components.connected_components(rows([(4, 4), (None, 1)], "x bigint, y bigint")).count() == 0


def test_match_groups(rows, files, got):
    members = rows([(1, 10, 0), (1, 11, None), (1, 11, 3), (None, 12, 0), (None, 13, 0), (-1, 14, 0), (-1, 15, 0), (2, None, 0), (2, 11, 0), (3, 77, 0), (9, 77, 1), (9, 78, 1)], "group_id bigint, file_id bigint, distance bigint")
    t = files({"id": 11, "phash": "00000000000000ff"}, {"id": 20, "phash": "0x00000000-000000FF"}, {"id": 21, "phash": "0" * 16}, {"id": 22, "phash": "0" * 16}, {"id": 20, "scanned_at": None, "phash": "1" * 16}, {"id": 23, "phash": "1" * 16})
    assert got(components.match_groups(members, t)) == [(10, 10), (11, 10), (20, 10), (77, 77), (78, 77)]


def _nearest(items, k, radius):
    out = set()
    for i, (a, x) in enumerate(items):
        near = sorted((bin(x ^ y).count("1"), b) for j, (b, y) in enumerate(items) if i != j and bin(x ^ y).count("1") <= radius)
        out |= {(a, b, d) for d, b in near[:k]}
    return out


@pytest.mark.parametrize(("parts", "limit"), [(None, 100_000), (9, 100_000), (8, 40), (9, 25)])
def test_nearest_files(files, parts, limit):
    rnd = random.Random(5)
    centres = [rnd.getrandbits(64) for _ in range(12)] + [0xFFFF, 2**64 - 1]
    values = [c for c in centres for _ in range(9)]
    values = [v ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(5))) for v in values] + [centres[0]] * 40 + [rnd.getrandbits(64) for _ in range(100)]
    values = [v or 1 for v in values]
    items = list(enumerate(values, 1))
    t = files(*({"phash": f"{v:016x}"} for v in values), {"phash": "0" * 16}, {"phash": None}, {"phash": "12"})
    out = {tuple(r) for r in vectors.nearest_files(t, parts=parts, limit=limit).collect()}
    assert out == _nearest(items, 5, 6)
    pairs = {tuple(r) for r in vectors.neighbour_pairs(vectors.nearest_files(t)).collect()}
    assert pairs == {(min(a, b), max(a, b)) for a, b, _ in out}


def test_nearest_files_of_nothing(files):
    assert vectors.nearest_files(files({"phash": None})).count() == 0
    assert vectors.nearest_files(files()).count() == 0


def test_long_runs_go_tile_by_tile():
    rnd = np.random.default_rng(1)
    bits = rnd.integers(-(2**63), 2**63, 1500)
    bits[700] = bits[3] ^ 5
    codes, scale, lost = vectors.quantise(vectors.sign_vectors(bits))
    assert lost.max() < 1e-6
    pairs = {(a, b) for p, q in vectors.tile_pairs(codes, np.arange(1500), np.array([0]), np.array([1500]), 52 * 127**2) for a, b in zip(p.tolist(), q.tolist())}
    assert pairs == {(3, 700), (700, 3)}


def test_heaps():
    rnd = np.random.default_rng(4)
    rows, others, d = rnd.integers(0, 40, 6000), rnd.integers(0, 300, 6000), rnd.integers(0, 7, 300)
    heaps = vectors.Heaps(40, 5)
    for part in np.array_split(np.arange(6000), 17):
        heaps.push(rows[part], others[part], d[others[part]].astype(np.int32), others[part] * 10)
    want = {(r, o) for r in range(40) for o in sorted(set(others[rows == r].tolist()), key=lambda o: (d[o], o))[:5]}
    row, at, dist, tie = heaps.rows()
    assert set(zip(row.tolist(), at.tolist())) == want and (d[at] == dist).all() and (tie == at * 10).all()


def test_dense_cluster_of_fingerprints(rows):
    # 20,000 distinct fingerprints within 6 bits of each other
    base = 0x0123456789ABCDEF
    picks = [sum(1 << b for b in c) for n in (1, 2, 3) for c in itertools.combinations(range(50), n)][:20_000]
    t = rows([(base ^ m, i) for i, m in enumerate(picks)], "bits bigint, least bigint")
    out = vectors.nearest_fingerprints(t, 6, 3).where(F.col("bits") == base ^ 1).orderBy("distance", "other").collect()
    near = sorted((bin(m ^ 1).count("1"), i) for i, m in enumerate(picks) if m != 1)[:3]
    assert [(r.distance, r.other) for r in out] == sorted((d, base ^ picks[i]) for d, i in near)


@pytest.mark.parametrize("block", [4096, 37])
def test_most_similar(rows, block):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(150, 12))
    x[20:40] = x[0] + rnd.normal(size=(20, 12)) * 1e-3
    x[50] = x[51]
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, [0.0] * 12), (902, [float("nan")] * 12), (903, [1.0]), (904, [None] * 12), (None, [1.0] * 12), (3, data[3][1])]
    t = rows(data + odd, "id bigint, v array<double>")
    out = {(r.query_id, r.other_id) for r in vectors.most_similar(t, "id", "v", 4, t.where("id % 20 = 0"), block).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = set()
    for q in range(0, 150, 20):
        s = u @ u[q]
        want |= {(q, j) for j in sorted((j for j in range(150) if j != q), key=lambda j: (-s[j], j))[:4]}
    assert len(out & want) >= len(want) - 1 and len(out) == len(want)  # equal up to the last bit of a tie
    assert vectors.most_similar(t.where("false"), "id", "v", 4, t.where("id = 1")).count() == 0


def test_disputed_keepers(rows, files, got):
    groups = rows([(1, " Exact", None, 0), (2, "exact", 3, 0), (3, "similar", None, 0), (4, "EXACT", 99, 0), (5, "exact", 1, 0), (1, " Exact", None, 0), (6, None, None, 0)], "id bigint, kind string, keep_file_id bigint, created_at bigint")
    members = rows([(1, 1, 0), (1, 2, 0), (2, 3, 0), (2, 4, 0), (3, 1, 0), (4, 77, 0), (5, 1, 0), (5, 5, 0), (None, 1, 0), (1, None, 0), (6, 1, 0)], "group_id bigint, file_id bigint, distance bigint")
    t = files({"path": "long/path"}, {"path": "色", "pid": None}, {"path": "aa", "mtime": 5}, {"path": "bb", "mtime": 4}, {"path": "much/longer/path", "pid": 7})
    assert got(survivors.disputed_keepers(groups, members, t).select("group_id", "file_id")) == [(1, 2), (2, 4), (5, 5)]
    assert survivors.disputed_keepers(groups, members, t.where("false")).count() == 0


def test_consensus(rows):
    values = [(1, f"/lib/a/pic {i}.jpg", 1) for i in range(9)] + [(1, "/lib/a/pic.jpg", 5), (1, "/else/q/z/pic.png", 1), (1, None, 9), (None, "x", 1), (2, "only", None), (3, "", 1), (4, "b a", 1), (4, "a b", 1)]
    out = {r.group_id: (r.consensus, r.value) for r in survivors.consensus_values(rows(values, "group_id bigint, value string, weight bigint")).collect()}
    # columns vote on their own: the blank has 9 of 15 votes against 6 gaps, each number one against them
    assert out[1] == ("/lib/a/pic .jpg", "/lib/a/pic.jpg") and out[2] == ("only", "only") and out[3] == ("", "") and out[4][1] == "a b"
    again = {r.group_id: r.value for r in survivors.consensus_values(rows(values, "group_id bigint, value string, weight bigint"), chunk=4).collect()}
    assert again[1] == "/lib/a/pic.jpg" and set(again) == {1, 2, 3, 4}


def test_small_and_large_groups_settle_alike(rows):
    rnd = random.Random(2)
    groups = {g: {f"/{rnd.choice('ab')}/p{rnd.randrange(4)} {rnd.choice(['x', 'y', ''])}.jpg": rnd.randrange(1, 4) for _ in range(12)} for g in range(6)} | {9: {"": 1}, 10: {"": 2, "a": 1}}
    t = rows([(g, v, w) for g, x in groups.items() for v, w in x.items()], "group_id bigint, value string, weight bigint")
    want = {g: _consensus(x) for g, x in groups.items()}
    assert {r.group_id: (r.consensus, r.value) for r in survivors.consensus_values(t).collect()} == want
    alone = survivors.consensus_values(t.where("group_id = 3"), chunk=4)
    assert alone.head().value in groups[3] and alone.count() == 1
    assert survivors.consensus_values(t.where("false")).count() == 0


def test_consensus_records(rows):
    rnd = random.Random(6)
    data = [(rnd.choice([1, 1, 1, 2, 3, None]), i, rnd.choice([None, 7]), rnd.choice(["a", "bb", "色", None]), rnd.choice([None, 0, 5])) for i in range(60)]
    t = rows(data, "group_id bigint, file_id bigint, pid bigint, path string, mtime bigint")
    far = 2**70
    key = lambda r: (r[2] is None, len(r[3].encode()) if r[3] is not None else far, r[4] if r[4] is not None else far, r[1])
    out = {r.group_id: r for r in survivors.consensus_records(t, survivors.keeper_trust()).collect()}
    assert {g: r.record.file_id for g, r in out.items()} == {g: min((r for r in data if r[0] == g), key=key)[1] for g in (1, 2, 3)}
    # the consensus takes each field from whoever has the best one
    assert out[1].consensus.low_id == -min(r[1] for r in data if r[0] == 1) and out[1].consensus.has_pid
    assert survivors.consensus_records(t.where("false"), survivors.keeper_trust()).count() == 0


def test_alignment():
    p = survivors.progressive([[{t: 1.0} for t in survivors.tokens_of(v)] for v in ("a/b/c.jpg", "a/b/x/c.jpg", "a/b/c.jpg")])
    assert [max(c, key=c.get) for c in p if sum(c.values()) > 1] == ["a", "/", "b", "/", "c", ".", "jpg"]
    assert survivors.token_distance(list("abc"), list("axc")) == 1 and survivors.token_distance([], list("ab")) == 2


def test_alignment_to_nothing():
    assert survivors.align([{"a": 1.0}] * 9, []) == [(i, None) for i in range(9)]
    assert survivors.align([], [{"a": 1.0}] * 9) == [(None, j) for j in range(9)]


def test_columns_keep_every_token():
    p = survivors.progressive([[{t: 1.0} for t in ("a", "/", f"t{i}")] for i in range(100)])
    assert [len(c) for c in p] == [1, 1, 100]


def _consensus(weights):
    """The algorithm over one chunk with whole profiles carried to every value; weights by value."""
    cut = {v: survivors.tokens_of(v) for v in weights}
    profiles = sorted(([{t: weights[v] + 1e-9} for t in cut[v]] for v in weights), key=lambda p: (-max((sum(c.values()) for c in p), default=0.0), len(p), repr(p)))
    guide = profiles[0]
    for p in profiles[1:]:
        sums = []
        for i, j in survivors.align(guide, p):
            a, b = guide[i] if i is not None else {}, p[j] if j is not None else {}
            sums.append({t: a.get(t, 0.0) + b.get(t, 0.0) for t in [*a, *(t for t in b if t not in a)]})
        guide = sums
    votes = [{} for _ in guide]
    for v, w in weights.items():
        for i, j in survivors.align(guide, [{t: 1.0} for t in cut[v]]):
            if i is not None:
                t = cut[v][j] if j is not None else ""
                votes[i][t] = votes[i].get(t, 0) + w
    said = "".join(min(c, key=lambda t: (-c[t], t)) for c in votes)
    return said, min(weights, key=lambda v: (survivors.token_distance(cut[v], survivors.tokens_of(said)), -weights[v], v))


def test_consensus_of_wide_columns(rows):
    rnd = random.Random(8)
    groups = {}
    for g in range(8):
        word = lambda k: f"w{rnd.randrange(k)}"
        make = lambda: "/".join([rnd.choice(["lib", "srv"]), *(word(90) for _ in range(rnd.randrange(1, 4)))]) + rnd.choice([f" {word(120)}", f" - {word(60)} {word(120)}", ""]) + rnd.choice([".jpg", ".png"])
        groups[g] = {make(): rnd.randrange(1, 3) for _ in range(200)} | ({"": 1} if g == 0 else {})
    t = rows([(g, v, w) for g, x in groups.items() for v, w in x.items()], "group_id bigint, value string, weight bigint")
    out = {r.group_id: (r.consensus, r.value) for r in survivors.consensus_values(t, chunk=1000).collect()}
    assert out == {g: _consensus(x) for g, x in groups.items()}


BATCHES = [(0, 0, 100), (1, 100, 200), (2, 200, 300)]


def _repeats(records, radius):
    """By the definition: records are (id, batch, hash, bits)."""
    return {i for i, b, h, x in records if b and any(c < b and ((h and h == g) or (x and y and bin(x ^ y).count("1") <= radius)) for _, c, g, y in records)}


@pytest.mark.parametrize("limit", [100_000, 30])
def test_repeated_files(spark, rows, files, limit):
    rnd = random.Random(3)
    centres = [rnd.getrandbits(64) for _ in range(30)]
    records = []
    for i in range(1, 400):
        bits = rnd.choice(centres) ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(8))) if rnd.random() < 0.3 else rnd.getrandbits(64)
        records.append((i, rnd.choice([0, 0, 0, 1, 2]), rnd.choice([None, "a" * 64, f"{rnd.randrange(200):064x}"]) if rnd.random() < 0.3 else None, bits if rnd.random() < 0.8 else None))
    t = files(*({"id": i, "scanned_at": b * 100 + i % 100, "content_hash": h and f" {h.upper()} ", "phash": x and f"{x:016x}"} for i, b, h, x in records), {"id": 900, "scanned_at": None, "phash": f"{centres[0]:016x}"})
    batches = rows(BATCHES, "batch_no int, batch_start bigint, batch_end bigint")
    r = increments.batch_files(t, batches)
    index = increments.PrefixIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", 6, limit)
    want = _repeats(records, 6)
    assert {x.file_id for x in increments.repeats_of_earlier(r, index).collect()} == want
    # batch by batch, each probed before it is appended
    one = increments.PrefixIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", 6, limit)
    prints = r.where("bits is not null").groupBy("bits").agg(F.min("batch").cast("bigint").alias("stamp"))
    old = prints.where("stamp = 0")
    one.found(old, old.count())
    one.append(old)
    near = {}
    for k in (1, 2):
        asking = r.where(F.col("batch") == k).where("bits is not null").select("bits", F.lit(k).cast("bigint").alias("stamp")).distinct()
        near |= {(x.bits, k): x.first for x in one.probe(asking).collect()}
        one.append(prints.where(F.col("stamp") == k))
    by_print = {i for i, b, h, x in records if b and x and ((x - 2**64 if x >= 2**63 else x), b) in near}
    by_hash = {i for i, b, h, _ in records if b and h and any(c < b and g == h for _, c, g, _ in records)}
    assert by_print | by_hash == want


@pytest.mark.parametrize("counts", [(240, 15), (15, 240), (150, 130)])
def test_probes_meet_every_posting_of_a_large_bucket(spark, rows, counts):
    rnd = random.Random(11)
    stored, asked = counts
    common = lambda k: [rnd.getrandbits(48) << 16 | 0xABCD for _ in range(k)]
    twins = [rnd.getrandbits(48) << 16 | 0xABCD for _ in range(min(counts))]
    # six flipped bits in six parts: the pair of equal parts is all that the two share
    far = [x ^ sum(1 << (8 * k + rnd.randrange(8)) for k in range(2, 8)) for x in twins]
    old = twins + common(stored - len(twins)) + [rnd.getrandbits(64) for _ in range(2 * stored)]
    new = far + common(asked - len(far))
    signed = lambda xs, stamp: rows([(x - 2**64 if x >= 2**63 else x, stamp) for x in xs], "bits bigint, stamp bigint")
    index = increments.PrefixIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", 6, 20).found(signed(old, 0), len(old))
    for k in range(0, len(old), 200):  # in several appends of unequal sizes
        index.append(signed(old[k : k + 200], 0))
    near = {x.bits % 2**64 for x in index.probe(signed(new, 1)).collect()}
    assert near == {x for x in new if any(bin(x ^ y).count("1") <= 6 for y in old)} and set(far) <= near


def test_batches_are_probed_and_appended_one_by_one(spark, rows):
    calls = []

    class Recorded(increments.PrefixIndex):
        def append(self, fingerprints):
            calls.append(("append", sorted(r.bits for r in fingerprints.select("bits").collect())))
            super().append(fingerprints)

        def probe(self, fingerprints):
            calls.append(("probe", sorted(r.bits for r in fingerprints.select("bits").collect())))
            return super().probe(fingerprints)

    a, b, c = 0x0123456789ABCDEF, 0x7EDCBA9876543210, 0x00FF00FF00FF00FF
    t = rows([(1, 0, None, a), (2, 0, b"x", b), (3, 1, b"y", a), (4, 1, None, c), (5, 2, b"y", c ^ 3), (6, 2, b"x", None)], "id bigint, batch int, hash binary, bits bigint")
    index = Recorded(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    assert {r.file_id for r in increments.repeats_of_earlier(t, index).collect()} == {3, 5, 6}
    # a of batch 1 is in the index already
    assert calls == [("append", [a, b]), ("probe", sorted([a, c])), ("append", [c]), ("probe", [c ^ 3]), ("append", [c ^ 3])]
    assert sorted(bytes(r.hash) for r in index._named("hashes", increments._HASHES, "hash", rows([(b"x",), (b"y",)], "hash binary")).collect()) == [b"x", b"y"]
    probes = index.routed_probes(rows([(c, 3)], "bits bigint, stamp bigint"))
    met = {r.bucket for r in index.postings_for(probes).collect()}
    assert met and met <= {r.bucket for r in probes.collect()}
    index.compact()
    assert len(index.generations("postings")) == len(index.generations("hashes")) == 1
    assert {r.bits for r in index.probe(rows([(c ^ 7, 3)], "bits bigint, stamp bigint")).collect()} == {c ^ 7}
    index.drop()
    assert index.generations("postings") == []


def test_index_of_buckets_that_outgrow_the_limit(spark, rows, monkeypatch):
    # all share their two lowest parts; a probe differs from its one old neighbour in the other six
    monkeypatch.setattr(increments, "SLOT_ROWS", 200)
    monkeypatch.setattr(increments, "MOST_GENERATIONS", 4)
    rnd = random.Random(1)
    old = [rnd.getrandbits(48) << 16 | 0xABCD for _ in range(600)]
    new = [x ^ sum(1 << (8 * k + rnd.randrange(8)) for k in range(2, 8)) for x in old[::6]]
    signed = lambda xs, stamp: rows([(x - 2**64 if x >= 2**63 else x, stamp) for x in xs], "bits bigint, stamp bigint")
    want = {x for x in new if any(bin(x ^ y).count("1") <= 6 for y in old)}
    assert want == set(new)
    for steps in ([600], [5, 95, 250, 50, 40, 60, 100]):
        index = increments.PrefixIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", 6, 40).found(signed(old[: steps[0]], 0), steps[0])
        at = 0
        for n in steps:
            index.append(signed(old[at : at + n], 0))
            at += n
        assert {x.bits % 2**64 for x in index.probe(signed(new, 1)).collect()} == want
        assert len(index.generations("postings")) <= 4 and max(s for _, s in index.generations("postings")) > 1
        index.compact()
        assert {x.bits % 2**64 for x in index.probe(signed(new, 1)).collect()} == want


def test_repeated_files_of_nothing(rows, files):
    batches = rows(BATCHES, "batch_no int, batch_start bigint, batch_end bigint")
    assert increments.repeated_files(files(), batches).count() == 0
    assert increments.repeated_files(files({"scanned_at": 150, "phash": None, "content_hash": "x"}), batches).count() == 0


TEXTS = [None, "", " \t\n", "don't we'll I'M", "日本語 и русский naïve", "<|endoftext|> a <|startoftext|>", "x" * 5000 + " " * 3000 + "\n" * 50, "a\u0000b﻿ ▁ é 🙂‍", "1234567 12,5 --> \r\n\r\n", "　　  "]


def test_tokenizer(rows):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizer.DEFAULT_VOCABULARY, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=tokenizer.PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
    t = rows([(i, x) for i, x in enumerate(TEXTS)] + [(None, "a"), (3, "again")], "doc_id bigint, text string")
    out = tokenizer.encode_corpus(t)
    seen = {(r.doc_id, tuple(r.ids)) for r in out.collect()}
    assert seen == {(i, tuple(plain.encode_ordinary(x)) if x else ()) for i, x in [*enumerate(TEXTS), (None, "a"), (3, "again")]}
    assert {(r.doc_id, r.text) for r in tokenizer.decode_corpus(out).collect()} == {(i, x or "") for i, x in [*enumerate(TEXTS), (None, "a"), (3, "again")]}
    assert out.where("ids is null").count() == 0 and tokenizer.encode_corpus(t.where("false")).count() == 0


def test_tokenizer_over_a_table(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizer.DEFAULT_VOCABULARY, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=tokenizer.PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    out = {r.doc_id: r.ids for r in queries.p7_ids(spark, str(DATA)).collect()}
    assert out == {d: plain.encode_ordinary(t) if t else [] for d, t in texts.items()}


def test_dialogue_words():
    text = "﻿1\r\n00:00:01,000 --> 00:00:02,500\r\n<i>Hello</i> [door\r\nslams] WORLD\r\n\r\n2\r\n00:00:03.000 -> 00:00:04.000 x:1\r\n(sighs) {\\an8}l'été 3 of_4\r\n 55 \r\n99 bottles"
    assert leaks.dialogue_words(text) == ["hello", "world", "l", "été", "3", "of", "4", "99", "bottles"]
    assert leaks.dialogue_words(None) == leaks.dialogue_words("") == []


def test_leaks(rows, got):
    w = [f"w{i}" for i in range(40)]
    items = rows([(1, "s", " ".join(w[:20])), (2, "s", " ".join(w[8:30])), (3, "t", "too short"), (4, "t", None), (None, "t", " ".join(w)), (5, "t", " ".join(["na"] * 15)), (1, "s", " ".join(w[:20]))], "item_id bigint, suite string, passage string")
    cue = lambda ws: "\n\n".join(f"{i}\n00:00:0{i % 10},000 --> 00:00:09,000\n{' '.join(ws[i : i + 4])}" for i in range(0, len(ws), 4))
    docs = [(1, cue(["x"] * 9 + w[3:15] + ["y"] * 9)), (2, cue(w[9:20] + ["z"])), (3, cue(w[8:20])), (4, None), (5, ""), (None, cue(w)), (6, " ".join(["NA"] * 12)), (7, " ".join(["na"] * 11 + ["no"] + ["na"] * 11)), (8, " ".join(w[:11]) + " <b>" + w[11] + "</b>"), (8, "again")]
    t = rows(docs, "doc_id bigint, text string")
    want = [(1, 1), (3, 1), (3, 2), (6, 5), (8, 1)]
    assert got(leaks.leaked_items(t, items)) == want
    assert got(leaks.leaked_items(t, items, filter_bits=64)) == want  # a filter that lets all through
    assert leaks.leaked_items(t.where("false"), items).count() == leaks.leaked_items(t, items.where("false")).count() == 0
    assert got(leaks.leak_report(leaks.leaked_items(t, items), items)) == [("s", 2, 3), ("t", 1, 1)]


def test_leaks_over_a_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    windows = {}
    for r in spark.read.parquet(f"{DATA}/eval_items.parquet").collect():
        w = leaks.words_of(r.passage)
        for i in range(len(w) - 11):
            windows.setdefault(tuple(w[i : i + 12]), set()).add(r.item_id)
    want = set()
    for r in docs:
        w = leaks.dialogue_words(r.text)
        want |= {(r.doc_id, x) for i in range(len(w) - 11) for x in windows.get(tuple(w[i : i + 12]), ())}
    assert {tuple(r) for r in queries.p8_found(spark, str(DATA)).collect()} == want


def _covered(docs, n):
    owner, out = {}, {}
    for d, t in docs:
        for i in range(len(t or "") - n + 1):
            owner.setdefault(t[i : i + n], set()).add(d)
    for d, t in docs:
        marks = set()
        for i in range(len(t or "") - n + 1):
            if len(owner[t[i : i + n]]) > 1:
                marks |= set(range(i, i + n))
        if marks:
            out[d] = len(marks)
    return out


def _shares(df, n):
    return {r.doc_id: r.n for r in spans.shared_spans(df, n).groupBy("doc_id").agg(F.sum(F.col("last") - F.col("first")).alias("n")).collect()}


@pytest.mark.parametrize("n", [40, 100])
def test_shared_spans(rows, n):
    rnd = random.Random(n)
    word = lambda k: "".join(rnd.choice("abcdefgh é日\r\n🙂") for _ in range(k))
    docs = []
    for i in range(40):
        piece = word(n + rnd.randrange(-2, 60))
        docs += [(2 * i, word(rnd.randrange(90)) + piece + word(rnd.randrange(90))), (2 * i + 1, word(rnd.randrange(200)) + piece + word(rnd.randrange(50)))]
    docs += [(200, "-" * 300), (201, "x" + "-" * n), (202, "-" * (n - 1)), (203, word(n) * 3), (204, None), (205, ""), (206, docs[0][1]), (207, word(30_000))]
    t = rows(docs, "doc_id bigint, text string")
    want = _covered(docs, n)
    assert {r.doc_id for r in spans.documents_with_shared_spans(t, n).collect()} == set(want)
    assert _shares(t, n) == want


def test_shared_spans_of_nothing(rows):
    t = rows([(1, "a" * 500), (2, None), (None, "a" * 500)], "doc_id bigint, text string")
    assert spans.documents_with_shared_spans(t).count() == 0
    assert spans.documents_with_shared_spans(t.where("false")).count() == 0
    twice = rows([(1, "b" * 300), (1, "b" * 300)], "doc_id bigint, text string")
    assert spans.documents_with_shared_spans(twice).count() == 0


def test_texts_decide_where_hashes_meet(rows, monkeypatch):
    with pytest.raises(ValueError):
        spans.documents_with_shared_spans(rows([(1, "a")], "doc_id bigint, text string"), 50)
    t = rows([(7, 1, "a"), (7, 2, "b"), (7, 3, "b"), (8, 1, "c"), (8, 2, "c"), (9, 1, "d"), (9, 1, "d"), (10, 1, "e"), (10, 2, "f")], "h bigint, doc_id bigint, text string")
    assert sorted(tuple(r) for r in spans._verbatim(t).collect()) == [(7, 2), (7, 3), (8, 1), (8, 2)]
    monkeypatch.setattr(spans, "BROADCAST_IDS", 0)
    docs = rows([(1, "x" * 9 + "the same words in both of them" + "q" * 20), (2, "the same words in both of them!"), (3, "other words" * 4)], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in spans.documents_with_shared_spans(docs, 28).collect()) == [1, 2]


def test_every_problem_has_its_query():
    assert {re.match(r"p\d+", n)[0] for n in queries.queries()} == {"p1", "p2", "p5", "p6", "p7", "p8", "p9"}
