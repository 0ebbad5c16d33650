"""Repeated passages: every byte string of a given length that starts at more than one place of the corpus.

Windows (strings of `length` bytes at each start) are dealt to groups by content: a window's anchor is the 64-byte gram
of the smallest hash in it, so equal windows have equal anchors. Consecutive windows of one anchor make one string.
Grams that stand once in the corpus are done with; a string that stands twice as a whole repeats as a whole. What is
left, different strings around the same gram, is settled byte by byte: each group's strings form shards, each shard has
its Burrows-Wheeler transform (here with symbols of eight bytes), and the shards' transforms are merged by refining
their interleave step by step. After step h the suffixes of a block share their first 8 h bytes, which is the common
prefix of neighbours; blocks of a single shard need no more steps, since its own order tells what repeats in it, and
blocks that remain after `length` bytes are the repeated intervals. No suffix is compared or sorted again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, blocks, id_text, mix64, operator, place, row_key, saved, shielded

#: Bytes of a gram, at most; shorter windows have shorter ones.
GRAM = 64
#: Bytes that a task looks at together when it looks for anchors, and low bits of a position among them.
PIECE, BITS = 1 << 20, 20
#: Bytes of a shard, and of the strings that one merge takes together.
SHARD, MERGE = 256 << 10, 1 << 20

_ODD = 0x9E3779B97F4A7C15
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_UP = np.cumprod(np.full(PIECE, _ODD, np.uint64))
_DOWN = np.cumprod(np.full(PIECE, pow(_ODD, -1, 2**64), np.uint64))


def gram_of(length: int) -> int:
    return max(4, min(GRAM, length // 3))


def anchored(raw: bytes, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, windows and gram hash of each run of windows with one anchor; raw: texts one after another, which
    end at `ends`; windows across an end don't count. At most PIECE bytes."""
    gram = gram_of(length)
    width, n = length - gram + 1, len(raw)
    if n < length:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    b = np.frombuffer(raw, np.uint8)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[b] * _UP[:n], out=sums[1:])
    h = mix64((sums[gram:] - sums[:-gram]) * _DOWN[: n - gram + 1])
    # The smallest hash of `width` neighbours, the first of equal ones: minima from both ends of blocks.
    low = np.uint64((1 << BITS) - 1)
    keys = np.full(-(-len(h) // width) * width, ~np.uint64(0))
    keys[: len(h)] = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    rows = keys.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    windows = n - length + 1
    least = np.minimum(back[:windows], ahead[width - 1 : width - 1 + windows])

    begin = np.append(0, ends[:-1])
    inside = np.zeros(n + 1, np.int32)
    whole = ends - begin >= length
    np.add.at(inside, begin[whole], 1)
    np.add.at(inside, (ends - length + 1)[whole], -1)
    at = np.flatnonzero(np.cumsum(inside[:windows]))
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    m = least[at]
    starts = np.concatenate([[0], np.flatnonzero((m[1:] != m[:-1]) | (at[1:] != at[:-1] + 1)) + 1])
    return at[starts], np.diff(np.append(starts, len(at))), h[(m[starts] & low).astype(np.int64)]


def _parts(texts: list[bytes], length: int):
    """Texts as (text's number, first byte, bytes), long ones in parts that share length - 1 bytes."""
    step = PIECE - length + 1
    for i, x in enumerate(texts):
        for a in range(0, max(1, len(x) - length + 1), step):
            yield i, a, x[a : a + PIECE] if len(x) > PIECE else x


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, row, lo (the first window's start), n (windows), m (the gram's hash), s (the string's hash) of each anchor."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("lo", pa.int64()), ("n", pa.int32()), ("m", pa.int64()), ("s", pa.int64())])

    def found(batches):
        for b in blocks(batches):
            texts = [x or b"" for x in b.column(1).cast(pa.large_binary()).to_pylist()]
            ids, rows = b.column(0).to_numpy(), b.column(2).to_numpy()
            held, size = [], 0

            def out():
                raw, lens = b"".join(p[2] for p in held), np.array([len(p[2]) for p in held], np.int64)
                ends = np.cumsum(lens)
                lo, n, m = anchored(raw, ends, length)
                own = np.searchsorted(ends, lo, "right")
                view = memoryview(raw)
                s = np.fromiter((xxhash.xxh3_64_intdigest(view[i:j]) for i, j in zip(lo.tolist(), (lo + n + length - 1).tolist(), strict=True)), np.uint64, len(lo))
                text = np.array([p[0] for p in held], np.int64)[own]
                at = lo - (ends - lens)[own] + np.array([p[1] for p in held], np.int64)[own]
                return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[text], rows[text], at, n.astype(np.int32), m.view(np.int64), s.view(np.int64))], schema=schema)

            for part in _parts(texts, length):
                if len(part[2]) < length:
                    continue
                if held and size + len(part[2]) > PIECE:
                    yield out()
                    held, size = [], 0
                held.append(part)
                size += len(part[2])
            if held:
                yield out()

    return docs.withColumn("row", row_key()).mapInArrow(found, "doc_id long, row long, lo long, n int, m long, s long")


class Transform:
    """A shard's strings in suffix order to `length` bytes, with the eight bytes before each suffix as its symbol.

    at: text position of each suffix; back: the place in this order of the suffix eight bytes before, or -1; symbol: its
    first eight bytes' rank; twice: suffixes that share `length` bytes with a neighbour of the same shard."""

    def __init__(self, rank8: np.ndarray, begin: np.ndarray, left: np.ndarray, length: int):
        n = len(left)
        rank, h = rank8.astype(np.uint64), 8
        while h < length:
            step = min(h, length - h)
            ahead = np.zeros(n, np.uint64)
            ahead[: n - step] = rank[step:]
            keys = rank << np.uint64(32) | ahead
            order = np.argsort(keys)
            keys = keys[order]
            rank = np.empty(n, np.uint64)
            rank[order] = np.cumsum(np.append(True, keys[1:] != keys[:-1])[:n]).astype(np.uint64)
            h += step
        order = np.argsort(rank, kind="stable")
        self.at = order
        place_of = np.empty(n, np.int64)
        place_of[order] = np.arange(n)
        before = order - 8
        inside = before >= begin[order]
        self.back = np.where(inside, place_of[np.maximum(before, 0)], -1)
        self.symbol = np.where(inside, rank8[np.maximum(before, 0)], 0)
        whole = order[left[order] >= length]
        same = rank[whole][1:] == rank[whole][:-1]
        self.twice = whole[np.append(False, same) | np.append(same, False)] if len(whole) else whole


def repeated_windows(strings: list[bytes], length: int, shard: int = SHARD) -> list[np.ndarray]:
    """For each string, which of its windows start elsewhere too, in it or in another one."""
    lens = np.array([len(x) for x in strings], np.int64)
    ends = np.cumsum(lens)
    n = int(ends[-1]) if len(ends) else 0
    raw = b"".join(strings) + bytes(16)
    words = np.empty(n + 8, ">u8")
    for j in range(8):
        part = np.frombuffer(raw[j : j + (n + 8 - j) // 8 * 8 + 8], ">u8", count=len(words[j::8]))
        words[j::8] = part
    words = words[:n].astype(np.uint64)
    rank8 = np.unique(words, return_inverse=True)[1].astype(np.int64).reshape(-1)
    own = np.repeat(np.arange(len(lens)), lens)
    begin, left = (ends - lens)[own], ends[own] - np.arange(n)
    hit = np.zeros(n, bool)

    # Shards are whole strings; `offset` numbers all suffixes, shard after shard, each in its own order.
    cuts = [0]
    for e in ends.tolist():
        if e - cuts[-1] >= shard:
            cuts.append(e)
    if cuts[-1] < n:
        cuts.append(n)
    at, back, symbol = (np.empty(n, np.int64) for _ in range(3))
    for a, z in zip(cuts, cuts[1:], strict=False):
        t = Transform(rank8[a:z], begin[a:z] - a, left[a:z], length)
        at[a:z], symbol[a:z] = t.at + a, t.symbol
        back[a:z] = np.where(t.back < 0, -1, t.back + a)
        hit[t.twice + a] = True
    shard_of = np.searchsorted(cuts, np.arange(n), "right").astype(np.int32)

    # The interleave at depth `depth`: suffixes by their first bytes, equal ones in the order of shards and in a shard's own.
    depth = length % 8 or 8
    first = rank8 if depth == 8 else np.unique(words >> np.uint64(64 - 8 * depth), return_inverse=True)[1].reshape(-1)
    merged = np.flatnonzero(left[at] >= depth)
    keys = first[at[merged]].astype(np.uint64) << np.uint64(32) | merged.astype(np.uint64)
    keys.sort()
    merged = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(keys), bool)
    if len(keys):
        new[1:] = (keys >> np.uint64(32))[1:] != (keys >> np.uint64(32))[:-1]
    while True:
        # A block of one shard (or suffix) takes no further part.
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(new)))
        both = shard_of[merged[starts]] != shard_of[merged[starts + sizes - 1]] if len(starts) else np.empty(0, bool)
        keep = np.repeat(both, sizes)
        block = np.repeat(np.arange(len(starts)), sizes)[keep]
        merged = merged[keep]
        if depth == length or not len(merged):
            break
        # One step: what stands eight bytes before each suffix, by its symbol; the order of equal symbols stays.
        prior = back[merged]
        on = np.flatnonzero(prior >= 0)
        keys = symbol[merged[on]].astype(np.uint64) << np.uint64(32) | on.astype(np.uint64)
        keys.sort()
        slot = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        sym, block = keys >> np.uint64(32), block[slot]
        merged = prior[slot]
        new = np.ones(len(slot), bool)
        if len(slot):
            new[1:] = (sym[1:] != sym[:-1]) | (block[1:] != block[:-1])
        depth += 8
    hit[at[merged]] = True
    return [hit[e - k : e - length + 1] for e, k in zip(ends.tolist(), lens.tolist(), strict=True)]


FOUND = "m long, s long, bits binary"
_FOUND = pa.schema([("m", pa.int64()), ("s", pa.int64()), ("bits", pa.binary())])


def _merged(length: int, shard: int):
    """Strings that come ordered by m: the windows of each that repeat, as bits; strings without any are left out."""

    def settle(held: list[tuple]) -> pa.RecordBatch:
        rows = list({(m, s): x for m, s, x in held}.items())
        found = [(m, s, np.packbits(hit).tobytes()) for ((m, s), _), hit in zip(rows, repeated_windows([x for _, x in rows], length, shard), strict=True) if hit.any()]
        return pa.RecordBatch.from_pylist([dict(zip(("m", "s", "bits"), r, strict=True)) for r in found], schema=_FOUND)

    def task(batches):
        held, size, last = [], 0, None
        for b in batches:
            for m, s, x in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if m != last and size >= MERGE:
                    yield settle(held)
                    held, size = [], 0
                held.append((m, s, x))
                size += len(x)
                last = m
        if held:
            yield settle(held)

    return task


def _counted(strings: DataFrame, length: int) -> DataFrame:
    """The same for grams with very many different strings, where one task must not have them all: windows by their hash."""
    schema = pa.schema([("m", pa.int64()), ("s", pa.int64()), ("i", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def hashed(batches):
        for b in blocks(batches, 64 << 10):
            m, s, i, h = [], [], [], []
            for x, y, raw in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                n = len(raw) - length + 1
                m += [x] * n
                s += [y] * n
                i += range(n)
                h += [xxhash.xxh3_128_digest(raw[k : k + length]) for k in range(n)]
            both = np.frombuffer(b"".join(h), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(s, pa.int64()), pa.array(i, pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1])], schema=schema)

    def bits(batches):
        for b in batches:
            maps = []
            for ks in b.column(2).to_pylist():
                hit = np.zeros(max(ks) + 1, np.uint8)
                hit[ks] = 1
                maps.append(np.packbits(hit).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(maps, pa.binary())], schema=_FOUND)

    windows = saved(strings.mapInArrow(hashed, "m long, s long, i int, a long, b long").distinct(), "windows")
    twice = windows.groupBy("a", "b").agg(F.count("*").alias("k")).where("k > 1").drop("k")
    return windows.join(saved(twice, "windows-twice"), ["a", "b"]).groupBy("m", "s").agg(F.collect_list("i")).mapInArrow(bits, FOUND)


def _spans(length: int):
    """Windows' bits of a document to the spans they cover: start, end, start, end, ..."""

    def task(batches):
        for b in batches:
            out = []
            for found in b.column(2).to_pylist():
                starts, ends = [], []
                for r in found:
                    if r["bits"] is None:
                        starts.append(np.array([r["lo"]]))
                        ends.append(np.array([r["lo"] + r["n"] - 1 + length]))
                    else:
                        at = np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8))[: r["n"]]) + r["lo"]
                        starts.append(at)
                        ends.append(at + length)
                starts, ends = np.concatenate(starts), np.concatenate(ends)
                order = np.argsort(starts, kind="stable")
                starts, ends = starts[order], np.maximum.accumulate(ends[order])
                cut = np.flatnonzero(starts[1:] > ends[:-1]) + 1
                pairs = np.stack([starts[np.append(0, cut)], ends[np.append(cut, len(ends)) - 1]], 1)
                out.append(pairs.ravel().tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "row", "spans"])

    return task


@operator
def repeated_spans(docs: DataFrame, length: int = 200, most: int = 2048, shard: int = SHARD) -> DataFrame:
    """doc_id, row, spans of every document that holds a string of `length` bytes (8 at least) that starts elsewhere too.

    spans: byte offsets start, end, start, end, ... in the text's UTF-8, maximal and in order. Matches never cross
    documents; rows that repeat each other repeat wholly. most: different strings that one gram's group may have to be
    merged in one task; windows of larger groups are counted by 128-bit hashes, with the same result.
    Null texts are empty; empty tables and texts shorter than `length` give no rows; long texts are read in parts.
    """
    if length < 8:
        raise ValueError("length must be 8 at least")
    texts = id_text(docs)
    all_ = saved(anchors(texts, length), "anchors")
    grams = all_.groupBy("m").agg(F.count("*").alias("k"), F.min("s").alias("s0"), F.max("s").alias("s1")).where("k > 1").select("m", (F.col("s0") != F.col("s1")).alias("mixed"))
    # Grams as a table of their own: a plain exchange on both sides lets a gram that many documents hold be split.
    again = saved(all_.join(saved(grams, "grams"), "m"), "anchors-again")
    first = F.min(F.struct("doc_id", "row", "lo", "n")).alias("at")
    kinds = saved(again.groupBy("m", "s", "mixed").agg(F.count("*").alias("k"), first), "anchor-kinds")
    whole = kinds.where("k > 1").select("m", "s", F.lit(None).cast("binary").alias("bits"))

    mixed = kinds.where("mixed")
    crowded = mixed.groupBy("m").agg(F.count("*").alias("kinds")).where(F.col("kinds") > most).select("m", F.lit(True).alias("crowded"))
    asked = mixed.join(crowded, "m", "left").select("at.doc_id", "at.row", F.struct("m", "s", "at.lo", "at.n", F.coalesce("crowded", F.lit(False)).alias("crowded")).alias("a"))
    asked = asked.groupBy("doc_id", "row").agg(F.collect_list("a").alias("asked"))
    wanted = texts.withColumn("row", row_key()).join(asked, ["doc_id", "row"]).select("text", "asked")

    def cut(batches):
        schema = pa.schema([("m", pa.int64()), ("s", pa.int64()), ("string", pa.binary()), ("crowded", pa.bool_())])
        for b in blocks(batches):
            rows = [(a["m"], a["s"], x[a["lo"] : a["lo"] + a["n"] + length - 1], a["crowded"]) for x, asks in zip(b.column(0).cast(pa.large_binary()).to_pylist(), b.column(1).to_pylist(), strict=True) for a in asks]
            for i in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 20_000], strict=True), schema, strict=True)], schema=schema)

    strings = saved(wanted.mapInArrow(cut, "m long, s long, string binary, crowded boolean"), "anchor-strings", rows=20_000)
    size, hot = strings.agg(F.sum(F.when(~F.col("crowded"), F.length("string"))), F.bool_or("crowded")).first()
    plain = strings.where("not crowded").select("m", "s", "string").repartition(max(1, -(-(size or 0) // (2 << 20))), "m").sortWithinPartitions("m")
    found = whole.unionAll(plain.mapInArrow(_merged(length, shard), FOUND))
    if hot:
        found = found.unionAll(_counted(strings.where("crowded").select("m", "s", "string"), length))
    # A string that stands more than once is whole already.
    found = found.groupBy("m", "s").agg(F.bool_or(F.col("bits").isNull()).alias("whole"), F.max("bits").alias("bits")).select("m", "s", F.when(~F.col("whole"), F.col("bits")).alias("bits"))
    hits = again.join(saved(found, "anchors-found"), ["m", "s"]).groupBy("doc_id", "row").agg(F.collect_set(F.struct("lo", "n", "bits")).alias("found"))
    return hits.mapInArrow(_spans(length), "doc_id long, row long, spans array<long>")


def with_spans(docs: DataFrame, length: int = 200, **options) -> DataFrame:
    """docs with one more column, `repeated_spans` (null: nothing repeats), last; see repeated_spans.

    Columns of docs may have any names, also twice; a column of this name that docs has stays.
    """
    spans = repeated_spans(docs, length, **options)
    own = shielded(docs)
    ids = F.coalesce(F.col(place(docs, "doc_id")).cast("long"), F.lit(NO_ID)) == F.col("doc_id")
    return own.join(spans, ids & (row_key(place(docs, "text")) == F.col("row")), "left").drop("doc_id", "row").toDF(*docs.columns, "repeated_spans")


def kept_bytes(text: bytes, spans: list[int] | None) -> bytes:
    """The text's bytes outside of the spans."""
    if not spans:
        return text
    edges = [0, *spans, len(text)]
    return b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
