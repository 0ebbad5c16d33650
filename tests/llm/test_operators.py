"""The corpus operators against plain versions of their contracts, on real rows and on odd ones."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import database, differences
from tradelens.llm import gru_lm, hnsw, language_id, line_dedup, near_dup, packing, pii, quality, sentencepieces, token_output
from tradelens.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

FOLDER = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}
DDL = "doc_id long, text string, lang string, source string, n_chars long, row long, label string"
LINE = "a line of more than forty code points that many documents hold"
ODD = [
    (1, None, "en", "s", None, 7, "x"),
    (2, "", None, "s", 0, 7, "x"),
    (None, "the the and of a.b@example.com", "en", None, 5, 7, "x"),
    (3, f"{LINE}\n\nshort", "en", "s", 1, 7, "x"),
    (3, f"{LINE}\n\nshort", "en", "s", 1, 7, "x"),
    *((i, f"  {LINE.upper()} \nnumber {i} of those", "en", "s", 1, 7, "x") for i in range(4, 9)),
    (9, "1 2 3", "de", "s", 1, 7, "x"),
    (10, "word " * 30_000, "fr", "s", 1, 7, "x"),
    (11, "the quick brown fox jumps over it all again and again", "fr", "s", 1, 7, "x"),
    (12, "the quick brown fox jumps over it all again and again", "fr", "s", 1, 7, "x"),
]


@pytest.fixture(scope="module")
def documents():
    import pyarrow.parquet as pq

    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()}


@pytest.fixture(scope="module")
def ids(documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return {d: t.encode(x, add_special_tokens=False).ids for d, x in documents.items()}


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def tokens(text: str | None, lower: bool = True) -> list[str]:
    return [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER if lower else {})) if w]


def run(spark, name):
    return {r.doc_id: r for r in QUERIES[name](spark, FOLDER).collect()}


def test_token_files(spark, documents, ids):
    got, start = run(spark, "op4_token_output"), 0
    for d in sorted(documents):
        want = [*ids[d], 2]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(want), crc(want))
        start += len(want)


def test_token_blocks_round_trip():
    import io
    import struct

    for x in ([], [5, 5, 7, 2**31, 0], list(range(70_000))):
        b = io.BytesIO(token_output.encode_block(np.array(x, np.uint32)))
        n, k, size = struct.unpack("<III", b.read(12))
        table, control = np.frombuffer(b.read(4 * k), "<u4"), np.frombuffer(b.read(-(-n // 4)), np.uint8)
        assert token_output.decode_block(n, table, control, np.frombuffer(b.read(size), np.uint8)).tolist() == x


def test_packing(spark, documents, ids):
    rows = QUERIES["op10_packing"](spark, FOLDER).collect()
    by = collections.defaultdict(list)
    for r in rows:
        want = [*ids[r.doc_id], 0][r.start : r.start + r.length]
        assert r.start == 2048 * r.piece and len(want) == r.length and crc(want) == r.ids_crc32
        by[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(len(x) + 1 for x in ids.values())
    for x in by.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048


def used(fillings, capacity) -> collections.Counter:
    out = collections.Counter()
    for f, times in fillings:
        assert sum(n * k for n, k in f.items()) <= capacity
        for n, k in f.items():
            out[n] += k * times
    return out


def fewest(pieces: list[int], capacity: int) -> int:
    """The least number of sequences, by trying every place for every piece."""
    pieces, best = sorted(pieces, reverse=True), len(pieces)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(pieces):
            best = len(rooms)
            return
        for r in {r for r in rooms if r >= pieces[i]}:
            j = rooms.index(r)
            put(i + 1, [*rooms[:j], r - pieces[i], *rooms[j + 1 :]])
        put(i + 1, [*rooms, capacity - pieces[i]])

    put(0, [])
    return best


def test_plan_takes_the_fewest_sequences_of_small_cases():
    rng, above = np.random.default_rng(5), 0
    for trial in range(200):
        capacity = int(rng.integers(20, 60))
        pieces = rng.integers(1, capacity + 1 if trial % 2 else capacity // 2, rng.integers(1, 12)).tolist()
        histogram = collections.Counter(pieces)
        fillings, least = packing.plan(histogram, capacity), fewest(pieces, capacity)
        assert used(fillings, capacity) == histogram and sum(t for _, t in fillings) == least
        assert packing.lower_bound(histogram, capacity) <= least
        above += sum(t for _, t in packing._greedy(histogram, capacity)) > least
    assert above  # where best fit alone takes more


def test_plan_of_many_pieces():
    rng = np.random.default_rng(3)
    for lo, hi, capacity in ((1, 100, 100), (600, 800, 2048), (300, 1100, 2048)):
        histogram = collections.Counter(rng.integers(lo, hi, 1000).tolist())
        fillings = packing.plan(histogram, capacity)
        assert used(fillings, capacity) == histogram
        assert packing.lower_bound(histogram, capacity) <= sum(t for _, t in fillings) <= sum(t for _, t in packing._greedy(histogram, capacity))
    # One large piece with eight small ones, and two of half the capacity: no sequence wastes anything.
    assert sum(t for _, t in packing.plan({1024: 3000, 1000: 3000, 131: 24_000}, 2048)) == 4500
    assert packing.plan({}, 2048) == []


def dedup_lines(docs):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = collections.defaultdict(set)
    for d, t in docs.items():
        for line in (t or "").split("\n"):
            holders[key(line)].add(d)
    drop = lambda d, line: len(key(line)) >= 40 and len(holders[key(line)]) >= 5 and max(holders[key(line)]) != d
    return {d: [x for x in (t or "").split("\n") if not drop(d, x)] for d, t in docs.items()}


def test_line_dedup(spark, documents):
    got = run(spark, "op5_line_dedup")
    for d, lines in dedup_lines(documents).items():
        assert got[d].n_lines == documents[d].count("\n") + 1
        assert got[d].n_dropped == got[d].n_lines - len(lines)
        assert got[d].kept_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    assert differences(QUERIES[name](spark, folder), database(folder), ORACLE_SQL[name]) == ""


def test_line_groups_across_ranges(spark):
    docs = {i: "\n".join([LINE, f"{i} own line", LINE]) for i in range(400)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(6)
    got = {r.doc_id: line_dedup.kept_lines(r.text, r.keep_bitmap) for r in line_dedup.with_bitmaps(df).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == dedup_lines(docs)


def components(docs, width, percent):
    sets = {}
    for d, t in docs.items():
        w = tokens(t)
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d in docs}
    order = sorted(docs)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    return root, sets


def test_near_duplicates(spark, documents):
    got = run(spark, "op7_near_dup")
    root, sets = components(documents, 4, 80)
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in got.items()} == {d: (len(sets[d]), root[d], root[d] == d) for d in documents}


def test_near_duplicate_family_of_many_components(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(150)]
    docs = {}
    for i in range(150):
        w = list(base)
        for j in rng.choice(150, rng.integers(2, 9), replace=False):
            w[j] = f"x{i}{j}"
        docs[i] = " ".join(w)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, 4, 80).collect()} == components(docs, 4, 80)[0]


def base_pii(text):
    kinds = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    out = []
    for k, pattern in enumerate(kinds):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if (True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(d) <= 19 and pii.luhn(d), 10 <= len(d) <= 15)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_base(spark, documents):
    got = run(spark, "op1_pii")
    for d, t in documents.items():
        spans = base_pii(t)
        assert got[d].base_sha256 == hashlib.sha256(pii.span_text(spans).encode()).hexdigest()
        assert (got[d].n_email, got[d].n_ip, got[d].n_card, got[d].n_phone) == tuple(sum(k == i for _, k, _ in spans) for i in range(4))


@pytest.mark.parametrize("text", ["a@b a@b.c@d.e x@y.z.", "1.2.3.4.5 256.1.1.1 0001.02.3.4", "+1 (555) 123-4567 +49", "4111 1111 1111 1111-4111111111111111", "@@a@b.co@c.de"])
def test_pii_spans(text):
    assert pii.base_spans(text) == base_pii(text)


def test_pii_terms_that_give_a_value_away(spark):
    rows = [(i, f"tell Zorgwin{'!' * (i % 2)} case {i} that joe@example.com waits {i}") for i in range(6)]
    rows += [(10 + i, f"plain line {i} that waits and tells the case") for i in range(200)]
    got = {r.doc_id: r for r in pii.pii_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "term:5:12" in got[0].spans and "term" not in got[10].spans
    clean = {r.doc_id: r.text for r in pii.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "joe@" not in clean[0] and "Zorgwin" not in clean[0] and clean[10] == rows[6][1]


def test_pii_terms_away_from_their_value(spark):
    rows = [(i, f"tell Zorgwin case {i} that joe@example.com waits {i}\nplain line") for i in range(6)]
    rows += [(10 + i, f"plain line {i} that waits and tells the case") for i in range(200)]
    rows += [(300, "no value here, but (ZORGWIN) is\nand Zorgwin, again\u00a0é Zorgwins"), (300, "other text Zorgwin"), (None, "Zorgwin"), (301, f"line\n{'far ' * 40}Zorgwin a.Zorgwin@example.org")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in pii.pii_digest(df).collect():
        got[r.doc_id].append(r.spans)
    assert sorted(got[300]) == ["term:11:18", "term:20:27,term:36:43"] and got[None] == ["term:0:7"]
    assert got[301][0] == "term:165:172,email:173:194" and got[10] == [""]
    clean = [r.text for r in pii.sanitised(df).collect()]
    assert len(clean) == len(rows) and sum("zorgwin" in t.lower() for t in clean) == 1  # Zorgwins is another word
    assert sum("[TERM]" in t for t in clean) == 10


def test_pii_of_a_value_in_every_line(spark):
    df = spark.createDataFrame([(i, "write to joe@example.com about it") for i in range(6)], "doc_id long, text string")
    assert {r.spans for r in pii.pii_digest(df).collect()} == {"email:9:24"}
    assert {r.text for r in pii.sanitised(df).collect()} == {"write to [EMAIL] about it"}


@pytest.mark.parametrize("text", ["7" * 1_000_000, "a" * 1_000_000 + "@" + "b" * 1_000_000, "a@" * 300_000, "1.2." * 250_000, "+1 " * 300_000, "a.b@c.d " * 60_000])
def test_pii_takes_linear_time(text):
    import time

    began = time.time()
    spans = pii.base_spans(text)
    pii.contexts(text, spans, 20)
    assert time.time() - began < 8 and (text[0] == "7" or len(spans) > 1 or "b" * 9 in text or text[1] in "@.1")


def test_pii_disclosure_by_its_formula(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(60):
        who = f"p{i % 4}@example.com"
        rows.append((i, f"note {i} Zor{i % 4}win {'seen' if i % 2 else 'kept'} by {who} x{i}\u00a0y"))
        rows.append((100 + i, f"plain Zor{i % 4}win line {i}" if i % 15 == 0 else f"other seen line {rng.integers(9)}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lines = [t for _, t in rows]
    has = collections.Counter(w for t in lines for w in {pii.term_of(x)[0] for x in re.split("[ ]+", t)} if w)
    want = {}
    for k in range(4):
        own = [t for t in lines if f"p{k}@example.com" in t]
        for w in {pii.term_of(x)[0] for t in own for x in re.split("[ ]+", t) if "@" not in x} - {""}:
            both = [t for t in own if w in [pii.term_of(x)[0] for x in re.split("[ ]+", t)]]
            if len(both) >= 3:
                want[f"email:p{k}@example.com", w] = np.log(len(both) * len(lines) / (has[w] * len(own))) / np.log(len(lines) / len(own))
    src = df.selectExpr("doc_id", "text")
    base = pii.found(src, 20)
    near, held = base.selectExpr("explode(near) x").select("x.*"), base.selectExpr("explode(held) x").select("x.*")
    got = {(r.e, r.t): r.disclosure for r in pii.disclosures(near, held, src, len(lines), 3, -99.0).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_language_id(spark, documents):
    got = run(spark, "op6_language_id")
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    held = [d for d in got if got[d].held_out]
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d in got)
    assert sum(got[d].lang_pred == lang[d] for d in held) >= 0.95 * len(held)


def test_words_of_both_languages_across_a_switch(spark, documents):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs)
    some = {lang: [r.text for r in docs.where(f"lang = '{lang}' and doc_id % 3 = 0 and length(text) between 400 and 2000").limit(8).collect()] for lang in ("en", "fr")}
    right = total = 0
    for a, b in zip(some["en"], some["fr"], strict=False):
        predictor = language_id.Predictor(model)
        both = [x.split()[:60] for x in (a, b)]
        predictor.learn(list(set().union(*both)))
        ids = [np.array([i for i in map(predictor.at.__getitem__, ws) if i >= 0]) for ws in both]
        m, _ = model.marginals(predictor.scores[np.concatenate(ids)], np.array([sum(map(len, ids))]))
        told = m.argmax(1)
        truth = np.repeat([model.langs.index("en"), model.langs.index("fr")], list(map(len, ids)))
        right, total = right + (told == truth).sum(), total + len(truth)
    assert right >= 0.97 * total


def test_forward_backward_is_exact_across_segments():
    model = language_id.Chain(["a", "b", "c"])
    rng = np.random.default_rng(0)
    model.moves = rng.normal(size=(3, 3)).astype(np.float32)
    size, emission = np.array([1, 130, 64]), rng.normal(size=(195, 3)).astype(np.float32)
    got, first = model.marginals(emission, size)
    for f, n in zip(first, size, strict=True):
        e, a, v, al = np.exp(emission[f : f + n].astype(float)), np.exp(model.moves.astype(float)), np.full(3, 1 / 3), []
        for t in range(n):
            v = (v @ a) * e[t]
            v /= v.sum()
            al.append(v)
        u, be = np.ones(3), [None] * n
        for t in range(n - 1, -1, -1):
            be[t] = u
            u = a @ (e[t] * u)
            u /= u.sum()
        want = np.array(al) * np.array(be)
        assert np.allclose(got[f : f + n], want / want.sum(1, keepdims=True), atol=1e-6)


def test_lm_scores(spark, documents):
    got = run(spark, "op8_lm_scoring")
    ws = {d: [*tokens(t), None] for d, t in documents.items()}
    out = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in documents}
    c = collections.Counter(w for d in ws if not out[d] for w in ws[d])
    total = sum(c.values())
    for d, w in ws.items():
        base = sum(np.log10((c[x] + 0.1) / (total + 0.1 * (len(c) + 1))) for x in w)
        assert (got[d].held_out, got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (out[d], len(w), sum(c[x] > 0 for x in w), total)
        assert got[d].base_score == pytest.approx(base, rel=1e-9)
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)


def small_gru():
    model = gru_lm.Gru([9, 5, 3, 2, 2], 4, np.ones(gru_lm.TAILS), 4, 6)
    rng = np.random.default_rng(0)
    for k in ("out", "in"):
        model.w[k] += rng.normal(size=model.w[k].shape).astype(np.float32) * 0.5
    return model, rng


def test_gru_is_a_distribution():
    model, rng = small_gru()
    states = rng.normal(size=(1, 6)).astype(np.float32)
    sym = np.arange(5 + 1 + gru_lm.TAILS)
    logp = model.outputs(np.repeat(states, len(sym), 0), sym, False)[0]
    assert np.exp(logp).sum() == pytest.approx(1, abs=1e-5)
    docs = [rng.integers(0, 22, 40).astype(np.int32) for _ in range(30)]
    before = gru_lm.score_docs(model, docs).sum()
    for _ in range(5):
        gru_lm.train_on(model, docs, 0.05)
    assert gru_lm.score_docs(model, docs).sum() > before


@pytest.mark.parametrize("scale", [1, 1000])
def test_gru_outputs_by_plain_softmax_and_gates_told_once(scale):
    model = gru_lm.Gru([9, 7, 5, 3, 2, 1], 4, np.ones(gru_lm.TAILS), 4, 8)
    rng = np.random.default_rng(3)
    for k in ("out", "in"):
        model.w[k] = (rng.normal(size=model.w[k].shape) * scale).astype(np.float32)
    sym = rng.integers(0, model.v + 1 + gru_lm.TAILS, (6, 5))
    fresh, h = np.zeros(sym.shape, bool), np.zeros((8, 5), np.float32)
    states = model.window(sym, fresh, h, model.gates())[0]
    assert np.array_equal(states, model.window(sym, fresh, h)[0])
    s, y = states.reshape(-1, 8), sym.reshape(-1)
    told = lambda z, at: np.minimum(z, gru_lm.TOP)[at] - np.log(np.exp(np.minimum(z, gru_lm.TOP).astype(float)).sum())
    cls = model.classes_of(y)
    want = [told(v @ model.w["out"] + model.w["ob"], c) + (told(v @ model.w["in"][c] + model.w["ib"][c], i - c * 4) if i < model.v else 0) for v, c, i in zip(s, cls.tolist(), y.tolist(), strict=True)]
    assert model.outputs(s, y, False)[0] == pytest.approx(want, rel=1e-4, abs=1e-2 if scale > 1 else 1e-4)


def test_gru_gradient_by_finite_differences():
    model, rng = small_gru()
    x, y = rng.integers(0, 22, (7, 3)).astype(np.int32), rng.integers(0, 22, (7, 3)).astype(np.int32)
    fresh, mask = np.zeros((7, 3), bool), np.ones((7, 3), bool)
    fresh[0], fresh[4, 1], mask[6, 2] = True, True, False
    start = np.zeros((6, 3), np.float32)

    def loss() -> float:
        states, _, _ = model.window(x, fresh, start)
        flat = np.flatnonzero(mask.reshape(-1))
        return -model.outputs(states.reshape(-1, 6)[flat], y.reshape(-1)[flat], False)[0].sum()

    grads, (rows, gemb), _ = model.gradients(x, y, fresh, mask, start)
    grads["emb"] = np.zeros_like(model.w["emb"])
    grads["emb"][rows] = gemb
    for k, g in grads.items():
        size = np.abs(g).reshape(-1)
        for i in np.argsort(-size)[:6].tolist():
            flat, at = model.w[k].reshape(-1), i
            own, h = flat[at], np.float32(2e-2)
            flat[at] = own + h
            up = loss()
            flat[at] = own - h
            down = loss()
            flat[at] = own
            assert (up - down) / (2 * h) == pytest.approx(g.reshape(-1)[at], rel=0.02, abs=2e-3), (k, i)


def test_lm_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    one, eight = ({r.doc_id: r.score for r in gru_lm.score(docs.repartition(n), shard_tokens=20_000).collect()} for n in (1, 8))
    assert one == pytest.approx(eight, rel=1e-5)


def test_lm_counts_of_rare_words_meet_in_a_join(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = docs.unionByName(docs.limit(5))
    every, few = (sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in gru_lm.score(docs, head=64, known=k).collect()) for k in (131_072, 100))
    assert [x[:4] for x in few] == [x[:4] for x in every] and [x[4] for x in few] == pytest.approx([x[4] for x in every], rel=1e-9)


def test_lm_learns_weights_of_4096_words(spark, monkeypatch):
    class Seen(Exception):
        pass

    def stop(coded, start, shards, rounds, rate):
        raise Seen(start.w["ib"].ravel()[: start.v].size, start.v, start.classes - start.inner - 1, shards)

    monkeypatch.setattr(gru_lm, "train", stop)
    df = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(5000))) for i in range(3)], "doc_id long, text string")
    with pytest.raises(Seen) as seen:
        gru_lm.score(df, shard_tokens=5000)
    assert seen.value.args == (4096, 4096, 32, 4)


def test_quality_rules(spark, documents):
    got = run(spark, "op9_quality")
    for d, t in documents.items():
        w = tokens(t, lower=False)
        at = collections.defaultdict(list)
        for i in range(len(w) - 4):
            at[tuple(w[i : i + 5])].append(i)
        repeat = {i + j for x in at.values() if len(x) > 1 for i in x for j in range(5)}
        lines = [x for x in t.split("\n") if tokens(x)]
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeat))
        assert r.base_failed == (len(w) < 10 or 100 * len(repeat) > 20 * len(w)) and (r.kept <= (not r.base_failed))


QUALITY_TEXTS = [("en", "the cat sat on the mat and that was that"), ("en", "a dog, a cat. A dog!"), ("el", "ο λόγος και ο λόγος"), ("en", ""), ("el", "και εγώ")]


def plain_kneser_ney(texts: list[str], least: int):
    """P(c | the four characters before), by the recursion as it is written."""
    order, level = quality.ORDER, collections.Counter()
    for t in texts:
        s = "\n" * (order - 1) + t + "\n"
        level.update(s[i : i + order] for i in range(len(s) - order + 1))
    counts = {order: level}
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])

    def discount(k, n):
        have = [sum(x == i for x in counts[k].values()) for i in range(1, 5)]
        if 0 in have:
            return (0.5, 0.75, 0.9)[min(n, 3) - 1]
        i = min(n, 3)
        y = have[0] / (have[0] + 2 * have[1])
        return max(quality.LEAST, min(i - 0.01, i - (i + 1) * y * have[i] / have[i - 1]))

    def prob(k, context, c):
        if k == 0:
            return 1 / (len(counts[1]) + 1)
        own = {g: n for g, n in counts[k].items() if g[:-1] == context}
        if not own:
            return prob(k - 1, context[1:], c)
        total = sum(own.values())
        told = {g: (n - discount(k, n)) / total for g, n in own.items() if k <= 2 or n >= least}
        return told.get(context + c, 0) + (1 - sum(told.values())) * prob(k - 1, context[1:], c)

    return prob


@pytest.mark.parametrize("least", [1, 2])
def test_log_perplexity_by_brute_force(spark, least):
    rows = [(i, lang, t) for i, (lang, t) in enumerate(QUALITY_TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {r.doc_id: r.log_ppl for r in quality.quality(df, least=least).collect()}
    for i, lang, t in rows:
        prob, s = plain_kneser_ney([x for o, x in QUALITY_TEXTS if o == lang], least), "\n" * 4 + t + "\n"
        want = -np.mean([np.log(prob(5, s[j - 4 : j], s[j])) for j in range(4, len(s))])
        assert got[i] == pytest.approx(want, rel=1e-5)


@pytest.mark.parametrize("most", [25, 3, 0])
def test_log_perplexity_counts_every_ngram_whatever_travels(spark, most):
    rows = [(i, lang, t) for i, (lang, t) in enumerate([*QUALITY_TEXTS, *QUALITY_TEXTS])]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    every, few = ({r.doc_id: r.log_ppl for r in quality.quality(df, most=m).collect()} for m in (400_000, most))
    assert len(every) == len(rows) and few == every


@pytest.mark.parametrize("most", [400_000, 25])
def test_kneser_ney_sums_to_one(spark, most):
    df = spark.createDataFrame(QUALITY_TEXTS, "lang string, text string")
    model = quality.KneserNey.of(quality.entries(df, most, 2))
    letters = sorted(set("\n".join(t for o, t in QUALITY_TEXTS if o == "en")))
    for context in ("at t", "zzzz", "the "):
        # The text's last place but one tells the letter after the context; one more share is that of unseen letters.
        score = lambda t: -model.log_prob("en", [t])[0] * (len(t) + 1)
        end = [score(context + c) - _tail(model, context + c) for c in [*letters, "\x00"]]
        assert sum(np.exp(-x) for x in end) == pytest.approx(1, abs=1e-4)


def _tail(model, t: str) -> float:
    """What the characters but the last tell, and the end: minus the log-probability of all else than the last letter."""
    whole = -model.log_prob("en", [t])[0] * (len(t) + 1)
    only = _last(model, t)
    return whole - only


def _last(model, t: str) -> float:
    text, real, _ = quality.joined([t])
    points, key = quality.code_points(text), quality.lang_key("en")
    at = real[len(t) - 1 : len(t)]
    p = model.look(0, quality.hashed(np.zeros(1, np.uint64), key, 0), 1.0)[0]
    for k in range(1, quality.ORDER + 1):
        p = model.look(k, quality.hashed(quality.sums(points, k)[at], key, k), 0.0) + model.look(-k, quality.hashed(quality.sums(points, k - 1)[at - 1], key, -k), 1.0) * p
    return -float(np.log(p[0]))


def test_quality_tells_scrambled_and_foreign_texts(spark):
    import random

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    rng, odd = random.Random(1), []
    for r in docs.where("doc_id % 40 = 0 and length(text) > 300").collect():
        letters = list(r.text)
        rng.shuffle(letters)
        odd.append((10_000 + r.doc_id, r.lang, "".join(letters)))
        if r.lang != "en":
            odd.append((20_000 + r.doc_id, "en", r.text))
        odd.append((30_000 + r.doc_id, r.lang, "".join(rng.choice("αβγδεζηθικλμνξοπρστυφχψω ") for _ in r.text)))
    got = quality.quality(docs.unionByName(spark.createDataFrame(odd, "doc_id long, lang string, text string"))).where("not base_failed").collect()
    kept = lambda k: np.mean([r.kept for r in got if r.doc_id // 10_000 == k])
    assert kept(0) > 0.97 and kept(1) < 0.1 and kept(2) < 0.2 and kept(3) < 0.1


def test_nearest_recall(spark):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{FOLDER}/embeddings.parquet").to_pandas()
    x, ids = np.stack(t.embedding).astype(float), t.vec_id.to_numpy()
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    got = collections.defaultdict(list)
    for r in QUERIES["op2_nearest"](spark, FOLDER).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert recall(x, ids, got) >= 0.9
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    several = collections.defaultdict(list)
    for r in hnsw.neighbours(df, F.col("vec_id") % 50 == 0, shard_rows=64, block=3).orderBy("query_id", "rank").collect():
        several[r.query_id].append(r.vec_id)
    assert recall(x, ids, several) >= 0.9


def recall(x, ids, got) -> float:
    hit = 0
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        s[i] = -2
        hit += len(set(got[ids[i]]) & set(ids[np.argsort(-s)[:5]]))
    return hit / (5 * (ids % 50 == 0).sum())


def test_nearest_ties_and_repeats_across_shards(spark):
    rows = [(i, [1.0, 1.0] if i % 3 else [0.0, 1.0]) for i in range(300)] + [(7, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in hnsw.neighbours(df, F.col("vec_id") % 50 == 0, shard_rows=32).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got[50] == [1, 2, 4, 5, 7] and got[0] == [3, 6, 9, 12, 15] and len(got) == 6


def test_nearest_has_a_task_a_shard(spark, monkeypatch):
    kept = {}
    own = hnsw.saved
    monkeypatch.setattr(hnsw, "saved", lambda df, tag, *a: tasks(df, tag) if tag == "graphs" else own(df, tag, *a))

    def tasks(df, tag):
        out = own(df.withColumn("task", F.spark_partition_id()), tag)
        kept["tasks"] = sorted((r.shard, r.task) for r in out.select("shard", "task").collect())
        return out.drop("task")

    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(400, 8)))], "vec_id long, embedding array<double>")
    hnsw.neighbours(rows, F.col("vec_id") % 50 == 0, shard_rows=50).count()
    assert kept["tasks"] == [(i, i) for i in range(8)]


def test_nearest_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0, None]), (8, [1.0, 1.0, 1.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id, round(r.score, 6)) for r in hnsw.neighbours(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert got == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 0.0)]
    assert hnsw.neighbours(df.where("false"), F.col("vec_id") == 0).collect() == []


def test_sentencepiece(documents):
    import sentencepiece
    from tokenizers import Tokenizer, models

    library, own = sentencepiece.SentencePieceProcessor(model_file=piece_path()), sentencepieces.Pieces(piece_path())
    texts = [*list(documents.values())[:60], "hello world", " a  b\n c\t", "", "ﬁ é １", " ", "\n", "x" * 300 + "the and" * 40, "日本語 😀 梦", None]
    merged, best = own.encode(texts)
    assert [np.frombuffer(c, "<u4").tolist() for c in merged] == [library.encode(t or "") for t in texts]
    assert own.decode(merged) == own.decode(best) == [(t or "").encode() for t in texts]
    # The same pieces and scores as a unigram model of the tokenizers library.
    unigram = Tokenizer(models.Unigram([(library.id_to_piece(i), library.get_score(i)) for i in range(library.piece_size())], 0, True))
    for chunk, (_, ids) in own.known.items():
        assert np.frombuffer(ids, "<u4").tolist() == unigram.encode(chunk.replace(" ", "\u2581"), add_special_tokens=False).ids


def test_sentencepiece_keeps_frequent_chunks_beyond_its_bound(monkeypatch):
    own, learned = sentencepieces.Pieces(piece_path()), []
    learn = own.learn
    monkeypatch.setattr(sentencepieces, "KNOWN", 2)
    monkeypatch.setattr(own, "learn", lambda chunks: (learned.append(sorted(chunks)), learn(chunks)))
    first = own.encode(["one two three"])
    assert own.encode(["three four"]) == sentencepieces.Pieces(piece_path()).encode(["three four"])
    assert own.encode(["one two three"]) == first
    assert learned == [[" one", " three", " two"], [" four"], [" one", " two"]]


def test_sentencepiece_probe_finds_each_piece_and_no_other():
    own = sentencepieces.Pieces(piece_path())
    assert (own.probe(own.keys[:-1]) == np.arange(own.none)).all() and (np.diff(own.slots) > 1).any()
    assert (own.probe(np.setdiff1d(own.keys[:-1] + np.uint64(1), own.keys)) == own.none).all()


def test_sentencepiece_query(spark, documents):
    import sentencepiece
    import xxhash

    library = sentencepiece.SentencePieceProcessor(model_file=piece_path())
    got = run(spark, "op3_sentencepiece")
    for d, t in documents.items():
        want = library.encode(t)
        assert (got[d].n_pieces, got[d].ids_crc32, got[d].round_trip, got[d].viterbi_round_trip) == (len(want), crc(want), True, True)
        assert got[d].decoded_xxh64 == xxhash.xxh64_hexdigest(t.encode())


OPERATORS = {
    "pii": lambda d: pii.pii_digest(d),
    "tokens": lambda d: token_output.token_output(d, tokenizer_path()),
    "lines": lambda d: line_dedup.with_bitmaps(d),
    "pieces": lambda d: sentencepieces.encode_decode(d, piece_path()),
    "language": lambda d: language_id.identify(d, language_id.train(d)),
    "near": lambda d: near_dup.near_duplicates(d),
    "lm": lambda d: gru_lm.score(d),
    "quality": lambda d: quality.quality(d),
    "packing": lambda d: packing.pack(d, tokenizer_path()).where("piece = 0"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(spark, name):
    odd = spark.createDataFrame(ODD, DDL)
    got = collections.Counter(r.doc_id for r in OPERATORS[name](odd).collect())
    assert got == collections.Counter(r[0] for r in ODD)
    assert OPERATORS[name](odd.where("false")).collect() == []


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, _id long, _row long, _n long, _spans string, _terms string, keep_bitmap string, row string, spans string, component long, c0 string, shard int"


def test_columns_of_any_name_pass_through(spark):
    docs = spark.createDataFrame([(*r[:5], i, i + 1, i + 2, "s", "t", "k", "r", "p", i, "c", i) for i, r in enumerate(ODD)], CLASHING)
    rows = {(r.doc_id, r.text): r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.dtypes == docs.dtypes, name
        for r in out.collect():
            assert any(r[5:] == o[5:] and r.doc_id == o.doc_id for o in rows.values()) or r.doc_id == 3
    for name, f in OPERATORS.items():
        got = collections.Counter(r.doc_id for r in f(docs).select("doc_id").collect())
        assert got == collections.Counter(r[0] for r in ODD), name
    twice = docs.select("doc_id", "text", "row", "row")
    assert line_dedup.with_bitmaps(twice).columns == ["doc_id", "text", "row", "row", "keep_bitmap"]


def test_pipeline_of_an_empty_table(spark):
    docs = spark.createDataFrame([], DDL)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0 and docs.dtypes == spark.createDataFrame([], DDL).dtypes
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == 0


def test_very_long_text_without_spaces(spark):
    long = "x1" * 300_000
    docs = spark.createDataFrame([(1, long, "en", "s", 1, 7, "x"), (2, "some words of a short text", "en", "s", 1, 7, "x")], DDL)
    for name, f in OPERATORS.items():
        assert sorted(r.doc_id for r in f(docs).select("doc_id").collect()) == [1, 2], name


def test_settings_and_folders_are_left_as_they_were(spark):
    import os

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "777")
    docs = spark.createDataFrame(ODD, DDL)
    quality.quality(docs).count()
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(base))
    near_dup.near_duplicates(docs).count()
    with pytest.raises(ValueError):
        pii.find_pii(docs.drop("text"))
    assert spark.conf.get(key) == "777" and [x.split("-")[0] for x in set(os.listdir(base)) - before] == ["near_duplicates"]
    spark.conf.unset(key)


def test_pipeline_stages(spark):
    docs = spark.createDataFrame(ODD, DDL)
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.dtypes == docs.dtypes
        docs = spark.createDataFrame(out.collect(), docs.schema)
        left.append(sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect()))
    assert (False, 9) not in left[0] and (False, 1) not in left[0] and left[1] == left[0]
    assert (False, 12) not in left[2] and (False, 11) in left[2] and left[2].count((False, 3)) == 1
    assert not docs.where("text like '%@example%'").count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() >= docs.count()


def test_near_dedup_keeps_one_row_a_group_whatever_the_ids(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(30))
    near = text("a") + " more"
    rows = [(None, text("a")), (None, near), (None, text("b")), (None, text("b")), (None, text("c")), (5, text("d")), (5, text("e")), (5, text("e")), (6, text("e")), (7, text("c")), (8, None), (None, " "), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1, 7, "x") for d, t in rows], DDL)
    got = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER).collect())
    ours = [(d, t) for d, t in got if d is None and t in (text("a"), near)]
    assert len(ours) == 1 and set(got.values()) == {1}
    assert set(got) - set(ours) == {(None, text("b")), (None, text("c")), (5, text("d")), (5, text("e")), (8, None), (None, " "), (None, None)}


def test_language_stage_without_a_model_keeps_texts_with_letters(spark):
    docs = spark.createDataFrame([(*r[:2], None, *r[3:]) for r in ODD], DDL)
    got = corpus_pipeline.identify_language(spark, docs, FOLDER)
    want = collections.Counter((r[0], r[1]) for r in ODD if r[1] and any(map(str.isalpha, r[1])))
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == want and got.dtypes == docs.dtypes
