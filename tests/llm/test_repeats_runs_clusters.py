"""Repeated passages, periodic runs and clusters against plain versions of their contracts."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from tests.compare import database, differences
from tests.llm.test_operators import CLASHING, DDL, ODD
from tradelens.llm import drake, periodic, repeats
from tradelens.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_repeats", "op13_clusters"])
def test_sql(spark, name):
    assert differences(QUERIES[name](spark, FOLDER), database(FOLDER), ORACLE_SQL[name]) == ""


# --- repeated passages


def plain_spans(texts: list[bytes], length: int) -> list[list[int]]:
    count = collections.Counter(x[i : i + length] for x in texts for i in range(len(x) - length + 1))
    out = []
    for x in texts:
        gone = np.zeros(len(x) + 2, bool)
        for i in range(len(x) - length + 1):
            if count[x[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        out.append((np.flatnonzero(np.diff(gone.astype(int)))).tolist())
    return out


def test_merge_finds_every_window_whatever_the_shards():
    rng = random.Random(3)
    for _ in range(25):
        length = rng.choice([8, 9, 12, 16, 20, 24, 27])
        letters = rng.choice([b"ab", b"abcdefgh", bytes(range(256))])
        strings = [bytes(rng.choice(letters) for _ in range(rng.randint(length, 90))) for _ in range(rng.randint(1, 30))]
        for _ in range(20):
            x, i = rng.choice(strings), rng.randrange(len(strings))
            a, k = rng.randint(0, len(x) - 1), rng.randint(0, len(strings[i]))
            strings[i] = strings[i][:k] + x[a : a + rng.randint(1, 60)] + strings[i][k:]
        count = collections.Counter(x[i : i + length] for x in strings for i in range(len(x) - length + 1))
        want = [[count[x[i : i + length]] > 1 for i in range(len(x) - length + 1)] for x in strings]
        for shard in (1, 50, 300, 1 << 20):
            assert [h.tolist() for h in repeats.repeated_windows(strings, length, shard)] == want


def test_equal_windows_have_equal_anchors():
    rng = random.Random(4)
    same = bytes(rng.choice(b"abcd ") for _ in range(500))
    texts = [bytes(rng.choice(b"abcd ") for _ in range(k)) + same + b"z" * k for k in (0, 7, 300)]
    ends = np.cumsum([len(x) for x in texts])
    lo, n, m = repeats.anchored(b"".join(texts), ends, 200)
    gram = {i: h for a, k, h in zip(lo.tolist(), n.tolist(), m.tolist(), strict=True) for i in range(a, a + k)}
    assert sorted(gram) == [i for e, x in zip(ends.tolist(), texts, strict=True) for i in range(e - len(x), e - 199)]
    begins = [e - len(x) + k for e, x, k in zip(ends.tolist(), texts, (0, 7, 300), strict=True)]
    assert all(gram[begins[0] + i] == gram[b + i] for b in begins for i in range(301))


def made_texts() -> list[str | None]:
    rng = random.Random(5)
    word = ["".join(rng.choice("abcdefgäöüß") for _ in range(rng.randint(1, 8))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choice(word) for _ in range(n))

    shared = [prose(n) for n in (30, 60, 200)]
    out = [prose(rng.randint(0, 150)) for _ in range(40)]
    out += [prose(20) + rng.choice(shared) + prose(rng.randint(0, 30)) for _ in range(30)]
    out += [out[3], out[3], out[41], "ab" * 400, "xyz" * 90 + prose(5), "a" * 199, "b" * 200, "c" * 201, "", None, shared[2][5:-5]]
    return out


@pytest.mark.parametrize("most", [2048, 3, 0])
@pytest.mark.parametrize("length", [200, 61])
def test_repeated_spans(spark, length, most):
    texts = made_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.repeated_spans or [] for r in repeats.with_spans(docs, length, most=most, shard=2000).collect()}
    assert [got[i] for i in range(len(texts))] == plain_spans([(x or "").encode() for x in texts], length)


def test_repeats_of_a_text_longer_than_a_piece(spark, monkeypatch):
    rng = random.Random(6)
    long = "".join(rng.choice("abcdef ") for _ in range(2_300_000))
    docs = spark.createDataFrame([(1, long), (2, long[1_048_000:1_049_400]), (3, "q" + long[2_299_000:])], "doc_id long, text string")
    got = {r.doc_id: r.repeated_spans for r in repeats.with_spans(docs).collect()}
    assert got == {1: [1_048_000, 1_049_400, 2_299_000, 2_300_000], 2: [0, 1400], 3: [1, 1001]}
    assert repeats.kept_bytes(b"q" + long[2_299_000:].encode(), got[3]) == b"q"


def test_repeats_of_odd_rows(spark):
    odd = spark.createDataFrame(ODD, DDL)
    out = repeats.with_spans(odd, 40)
    texts = [(r[1] or "").encode() for r in ODD]
    want = collections.Counter((r[0], r[1], tuple(s)) for r, s in zip(ODD, plain_spans(texts, 40), strict=True))
    assert collections.Counter((r.doc_id, r.text, tuple(r.repeated_spans or ())) for r in out.collect()) == want
    assert repeats.with_spans(odd.where("false")).collect() == []
    docs = spark.createDataFrame([(*r[:5], i, i + 1, i + 2, "s", "t", "k", "r", "p", i, "c", i) for i, r in enumerate(ODD)], CLASHING)
    assert collections.Counter(r.doc_id for r in repeats.with_spans(docs.withColumnRenamed("_id", "repeated_spans")).select("doc_id").collect()) == collections.Counter(r[0] for r in ODD)


# --- runs


def plain_runs(w: list) -> list[tuple[int, int, int]]:
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            a = i
            while i < n - q and w[i] == w[i + q]:
                i += 1
            length = i - a + q
            if length >= max(12, 2 * q) and not any(all(w[k] == w[k + p] for k in range(a, a + length - p)) for p in range(1, q)):
                out[a, q] = length
    return [(a, length, q) for (a, q), length in sorted(out.items())]


def test_runs_of_small_texts():
    rng = random.Random(7)
    for _ in range(300):
        w = [bytes([97 + rng.randrange(rng.choice([1, 2, 3, 9]))]) for _ in range(rng.randint(0, 70))]
        for _ in range(rng.randint(0, 3)):
            a, p, k = rng.randint(0, len(w)), rng.randint(1, 9), rng.randint(1, 6)
            w = w[:a] + w[a : a + p] * k + w[a + p :]
        found = periodic.runs(w)
        assert found == plain_runs(w)
        drop = {i for s, length, q in found for i in range(s + q, s + length)}
        assert periodic.collapsed(w, found) == [x for i, x in enumerate(w) if i not in drop]


def test_runs_query(spark):
    import pyarrow.parquet as pq

    got = {r.doc_id: r for r in QUERIES["op12_runs"](spark, FOLDER).collect()}
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()}
    assert sorted(got) == sorted(texts)
    some = 0
    for d, text in texts.items():
        w = (text or "").encode().split()
        h = zlib.crc32(str(d).encode())
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        if len(w) > 600 and h % 10:
            continue  # the plain version takes long
        found = plain_runs(w)
        some += bool(found)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        want = (len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest())
        r = got[d]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256) == want
        drop = {i for s, length, q in found for i in range(s + q, s + length)}
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in drop)).hexdigest()
    assert some > 5


def test_runs_of_odd_rows(spark):
    odd = spark.createDataFrame(ODD, DDL)
    got = periodic.periodic_runs(odd).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in ODD)
    long = next(r for r in got if r.doc_id == 10)
    assert [tuple(x) for x in long.runs] == [(0, 30_000, 1)] and long.collapsed_text == "word"
    assert periodic.periodic_runs(odd.where("false")).collect() == []
    docs = spark.createDataFrame([(*r[:5], i, i + 1, i + 2, "s", "t", "k", "r", "p", i, "c", i) for i, r in enumerate(ODD)], CLASHING)
    assert periodic.periodic_runs(docs.withColumnRenamed("row", "Text")).count() == len(ODD)


# --- clusters


def plain_clusters(v: np.ndarray, c: np.ndarray, rounds: int):
    def near():
        return ((v[:, None] - c[None]) ** 2).sum(2).argmin(1)

    for _ in range(rounds):
        a = near()
        c = np.array([v[a == k].sum(0) // (a == k).sum() if (a == k).any() else c[k] for k in range(len(c))])
    return near(), c


@pytest.mark.parametrize("spread", [3, 40, 1 << 20])
@pytest.mark.parametrize("listed", [0, 1, 4, 30])
def test_bounds_never_change_a_cluster(spread, listed):
    rng = np.random.default_rng(8)
    v = rng.integers(0, 12, 40)[:, None, None] * spread + rng.integers(-spread, spread + 1, (40, 30, 5))
    v = v.reshape(-1, 5)
    c, kept = v[:16].copy(), min(listed, 15)
    state = drake._ranked(v, c, kept)
    read = []
    for _ in range(6):
        a = state[0]
        after = np.array([v[a == k].sum(0) // (a == k).sum() if (a == k).any() else c[k] for k in range(len(c))])
        moved = np.sqrt(drake.squared(after, c).astype(float)) * (1 + 1e-12)
        c = after
        *state, r = drake.reassigned(v, *state, c, moved)
        read.append(r)
        d = ((v[:, None] - c[None]) ** 2).sum(2)
        assert (state[0] == d.argmin(1)).all()
    if listed == 4:
        assert np.mean(read[-1]) < 10  # of 16


def test_clusters_of_odd_rows(spark):
    rng = np.random.default_rng(9)
    good = rng.normal(size=(60, 64)).astype(np.float32)
    rows = [(i, x.tolist(), i) for i, x in enumerate(good)]
    rows += [(3, good[3].tolist(), 0), (3, good[5].tolist(), 0), (None, good[7].tolist(), 0)]
    bad = [(100, None, 0), (101, [], 0), (102, [1.0] * 63, 0), (103, [None] * 64, 0), (104, [float("nan")] * 64, 0), (105, [float("inf")] * 64, 0), (106, [1e30] * 64, 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, V int").withColumnRenamed("V", "v")
    got = drake.clusters(df).collect()
    v = np.floor(64 * np.array([r[1] for r in rows], np.float32).astype(float)).astype(np.int64)
    key = [(hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), x.tolist()) for r, x in zip(rows, v, strict=True)]
    first = sorted(range(len(v)), key=lambda i: key[i])[:16]
    a, c = plain_clusters(v, v[first], 3)
    d = ((v - c[a]) ** 2).sum(1)
    want = collections.Counter((r[0], int(k), int(x), int(d[a == k].sum()), int(d.sum()), tuple(c[k].tolist())) for r, k, x in zip(rows, a, d, strict=True))
    assert collections.Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in got) == want
    few = drake.clusters(df.where("vec_id in (1, 2)")).collect()
    assert sorted((r.vec_id, r.distance) for r in few) == [(1, 0), (2, 0)]
    assert drake.clusters(df.where("false")).collect() == []
