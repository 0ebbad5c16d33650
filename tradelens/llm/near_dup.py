"""Near-duplicate documents: MinHash by one-permutation hashing, banded buckets, star-shaped candidates.

1. Texts with equal shingle sets form a class; from there one node stands for each class.
2. One hash of each shingle fills 256 bins with minima; an empty bin takes the value of the first full bin in an order
   of its own (optimal densification). 42 bands of 6 bins name buckets: a pair at similarity 0.8 shares none with a
   probability of 3e-6, a pair at 0.9 of 1e-14.
3. A bucket's smallest node is linked to the others as a star, so candidates grow with the rows, not their square.
4. A candidate passes a screen of set sizes and of one byte a bin (eight standard deviations wide; sets of up to 64
   shingles pass anyhow), then its full sets are compared.
5. Where a bucket of more than two still holds several components, every pair across components is compared in blocks
   of about 512 by 512 nodes, whatever the bucket's size (by whole sets of up to 512 shingles, which is the confirming
   comparison itself, so only confirmed pairs merge components there; else by the bytes), and what passes is confirmed
   on full sets. No cap drops a candidate. This step's work grows with the square of a split bucket.
6. Components: smallest label by joins with pointer jumping, a written table each round.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, WordHash, blocks, id_or_none, id_text, mix64, operator, row_key, saved, text_key, words

BINS, BANDS, ROWS = 256, 42, 6
_RNG = np.random.default_rng(20240607)
_ORDER = np.argsort(_RNG.random((BINS, BINS)), axis=1).astype(np.uint8)
_ODD = _RNG.integers(0, 2**63, 16, np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _RNG.integers(0, 2**63, BANDS, np.uint64)
#: Bytes of 256 that must agree: eight standard deviations below what similarity 0.8 gives.
SCREEN, SMALL = int(256 * 0.8 - 8 * (256 * 0.8 * 0.2) ** 0.5), 64
BLOCK = 512
#: Shingles up to which a digest holds the whole set.
FEW = 512
_hashes = WordHash()


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of the text's word shingles; of the whole sequence if it is shorter."""
    ws = words(text)
    if len(ws) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(ws), seed=1)] if ws else [], np.uint64)
    h = _hashes.of(ws)
    n = len(h) - width + 1
    total = h[:n] * _ODD[0]
    for j in range(1, width):
        total += h[j : j + n] * _ODD[j]
    return np.unique(mix64(total))


def minima(s: np.ndarray) -> np.ndarray:
    """One-permutation minima with optimal densification; s: sorted, not empty."""
    bins = (s >> np.uint64(56)).astype(np.int64)
    at = np.flatnonzero(np.diff(bins, prepend=-1))
    full = bins[at]
    out = np.zeros(BINS, np.uint64)
    out[full] = s[at]
    if len(full) < BINS:
        empty = np.ones(BINS, bool)
        empty[full] = False
        empty = np.flatnonzero(empty)
        out[empty] = out[full[_ORDER[np.ix_(empty, full)].argmin(1)]]
    return out


def bands(m: np.ndarray) -> np.ndarray:
    folded = (m[: BANDS * ROWS].reshape(BANDS, ROWS) * _ODD[:ROWS]).sum(1, dtype=np.uint64)
    return mix64(folded + _BAND)


_SKETCH = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bytes", pa.binary()), ("buckets", pa.list_(pa.int64()))])


def sketches(src: DataFrame, width: int) -> DataFrame:
    def task(batches):
        for b in blocks(batches):
            out = [[] for _ in _SKETCH]
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingles(text, width)
                k = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8").tolist()
                row = [doc_id, text_key(text), len(s), *k, None, None]
                if len(s):
                    m = minima(s)
                    row[5:] = [(mix64(m) & np.uint64(255)).astype(np.uint8).tobytes(), bands(m).view(np.int64)]
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _SKETCH, strict=True)], schema=_SKETCH)

    return src.mapInArrow(task, "doc_id long, row long, n long, k1 long, k2 long, bytes binary, buckets array<long>")


def _alike(n1, n2, b1, b2, percent: int):
    """Screen of pairs, by arrays: set sizes (exact) and agreeing bytes."""
    sizes = 100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)
    return sizes & (((b1 == b2).sum(-1) >= SCREEN) | (np.minimum(n1, n2) <= SMALL))


def _bytes(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def screened(edges: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    def task(batches):
        for b in batches:
            n1, n2 = b.column("n1").to_numpy(), b.column("n2").to_numpy()
            if b.num_rows:
                yield b.select(["a", "b"]).filter(pa.array(_alike(n1, n2, _bytes(b.column("b1")), _bytes(b.column("b2")), percent)))

    side = lambda end, k: nodes.select(F.col("nid").alias(end), F.col("n").alias(f"n{k}"), F.col("bytes").alias(f"b{k}"))
    return edges.join(side("b", 2), "b").join(side("a", 1), "a").select("a", "b", "n1", "n2", "b1", "b2").mapInArrow(task, "a long, b long")


def confirmed(edges: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges whose full sets are similar. Rows come sorted by a, so a star's centre is cut into shingles once."""

    def task(batches):
        at, centre = None, None
        for b in blocks(batches):
            keep = []
            for x, t1, t2 in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if x != at:
                    at, centre = x, shingles(t1, width)
                s = shingles(t2, width)
                both = len(np.intersect1d(centre, s, assume_unique=True))
                keep.append(100 * both >= percent * (len(centre) + len(s) - both))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    t = lambda end, k: texts.select(F.col("nid").alias(end), F.col("text").alias(f"t{k}"))
    return edges.join(t("b", 2), "b").join(t("a", 1), "a").select("a", "b", "t1", "t2").mapInArrow(task, "a long, b long")


def digests(texts: DataFrame, width: int) -> DataFrame:
    """nid, n, few (up to FEW shingles: all of them, in eight bytes each), bytes (else one byte a bin)."""

    def task(batches):
        for b in blocks(batches):
            cols = [[], [], []]
            for text in b.column(1).to_pylist():
                s = shingles(text, width)
                cols[0].append(len(s))
                cols[1].append(s.tobytes() if len(s) <= FEW else b"")
                cols[2].append((mix64(minima(s)) & np.uint64(255)).astype(np.uint8).tobytes() if 100 * len(s) > 50 * FEW else bytes(BINS))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["nid", "n", "few", "bytes"])

    return texts.select("nid", "text").mapInArrow(task, "nid long, n long, few binary, bytes binary")


def block_pairs(rows: list[tuple], same: bool, percent: int) -> list[tuple[int, int]]:
    """Pairs of rows (n, c, nid, i, few, bytes) of different components that may be similar.

    For sets of up to FEW shingles the comparison is that of the full sets, so a pair that connects two components makes
    further pairs between these superfluous; pairs that only pass the screen merge nothing.
    """
    n, c, nid, i = (np.array([r[k] for r in rows]) for k in range(4))
    byte = np.frombuffer(b"".join(r[5] for r in rows), np.uint8).reshape(-1, BINS)
    sets = [np.frombuffer(r[4], np.uint64) for r in rows]
    size = np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate([*sets, np.zeros(1, np.uint64)]), return_inverse=True)[1][:-1]
    ends = np.cumsum(size)
    mark = np.zeros(len(flat) + 1, np.int32)
    comp = np.unique(c, return_inverse=True)[1]
    got = []
    for x in range(len(rows)):
        ok = (comp != comp[x]) & (nid > nid[x]) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x]))
        if not same:
            ok &= i != i[x]
        if not ok.any():
            continue
        small = ok & (size > 0) & (size[x] > 0)
        if small.any():
            own = flat[ends[x] - size[x] : ends[x]]
            mark[own] = 1
            total = np.append(0, np.cumsum(mark[flat]))
            mark[own] = 0
            both = total[ends] - total[ends - size]
            for y in np.flatnonzero(small & (100 * both >= percent * (n + n[x] - both))).tolist():
                if comp[y] != comp[x]:
                    got.append((int(nid[x]), int(nid[y])))
                    comp[comp == comp[y]] = comp[x]
        large = np.flatnonzero(ok & ~((size > 0) & (size[x] > 0)) & (comp != comp[x]))
        if len(large):
            got += [(int(nid[x]), y) for y in nid[large[(byte[large] == byte[x]).sum(1) >= SCREEN]].tolist()]
    return got


def across(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs of different components in one bucket that may be similar; members: bucket, nid, c."""
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    dealt = members.join(saved(sizes, "bucket-sizes"), "bucket").withColumn("k", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("i", F.pmod(F.xxhash64("nid"), F.col("k")).cast("int"))
    # A member of block i meets every block j, once as the row and once as the column of a pair of blocks (i <= j).
    spread = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("bucket", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "i", "nid", "c")
    need = members.select("nid").distinct()
    known = saved(digests(texts.join(need, "nid"), width), "digests")
    full = spread.join(known, "nid").repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")

    def task(batches):
        own, held, got = None, [], []

        def out():
            return pa.RecordBatch.from_pydict({"a": [x for x, _ in got], "b": [y for _, y in got]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

        for b in batches:
            cols = [b.column(k).to_pylist() for k in ("bucket", "p", "q", "n", "c", "nid", "i", "few", "bytes")]
            for row in zip(*cols, strict=True):
                if row[:3] != own:
                    if len(held) > 1:
                        got += block_pairs(held, own[1] == own[2], percent)
                    own, held = row[:3], []
                    if len(got) > 10_000:
                        yield out()
                        got = []
                held.append(row[3:])
        if len(held) > 1:
            got += block_pairs(held, own[1] == own[2], percent)
        yield out()

    return full.select("bucket", "p", "q", "n", "c", "nid", "i", "few", "bytes").mapInArrow(task, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """nid, c: the smallest node reachable, for every node of a link."""
    both = saved(links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b"), "links")
    comp = saved(both.groupBy(F.col("a").alias("nid")).agg(F.least(F.min("b"), F.col("nid")).alias("c")), "components")
    while True:
        near = both.join(comp.select(F.col("nid").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("m"))
        lower = comp.join(near, comp.nid == near.a).select("nid", F.least("c", "m").alias("c"), F.col("c").alias("old"))
        jump = comp.select(F.col("nid").alias("c"), F.col("c").alias("cc"))
        step = saved(lower.join(jump, "c").select("nid", F.least("c", "cc").alias("c"), "old"), "components")
        comp = step.select("nid", "c")
        if step.where("c <> old").isEmpty():
            return comp


@operator
def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, row, component of every row of docs.

    Null or blank texts have no shingles and are their own component; a null doc_id sorts below all ids and comes back
    null (its component is then null, and it is kept as that component's smallest); rows that repeat a doc_id are
    nodes of their own by text (row is the text's key). As null and repeated ids make component_id and kept ambiguous,
    component tells components apart for sure (their smallest node; null without shingles).
    """
    src = id_text(docs)
    sketch = saved(sketches(src, width), "sketches")
    some = sketch.where("n > 0")
    classes = saved(some.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "row")).alias("s")).select("k1", "k2", F.col("s.doc_id").alias("label"), F.col("s.row").alias("lrow"), F.monotonically_increasing_id().alias("nid")), "classes")
    first = some.join(classes, ["k1", "k2"]).where("doc_id = label and row = lrow")
    nodes = saved(first.select("nid", "doc_id", "row", "n", "bytes", "buckets"), "nodes")
    member = nodes.select(F.explode("buckets").alias("bucket"), "nid").distinct()
    stars = saved(member.groupBy("bucket").agg(F.min("nid").alias("a"), F.max("nid").alias("z")).where("a <> z").select("bucket", "a"), "stars")
    members = saved(member.join(stars, "bucket"), "members")
    edges = members.where("nid <> a").select("a", F.col("nid").alias("b")).distinct()
    plain = saved(screened(edges, nodes, percent), "screened").distinct()
    need = members.select("nid").distinct().join(nodes.select("nid", "doc_id", "row"), "nid")

    texts = saved(src.withColumn("row", row_key()).join(need, ["doc_id", "row"]).select("nid", "text").dropDuplicates(["nid"]), "texts")
    links = saved(confirmed(plain, texts, width, percent), "confirmed")
    comp = components(links)
    known = members.join(comp, "nid", "left").select("bucket", "nid", F.coalesce("c", "nid").alias("c"))
    known = saved(known, "bucket-components")
    split = known.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi and n > 2").select("bucket")
    split = saved(split, "split-buckets")
    if not split.isEmpty():
        rest = saved(across(saved(known.join(split, "bucket"), "split-members"), texts, width, percent), "across")
        more = saved(confirmed(rest, texts, width, percent), "confirmed")
        if not more.isEmpty():
            comp = components(links.unionAll(more))
    labelled = saved(classes.join(comp, "nid", "left").select("k1", "k2", "label", F.coalesce("c", "nid").alias("c")), "labelled")
    least = saved(labelled.groupBy("c").agg(F.min("label").alias("component_id")), "labels")
    final = saved(labelled.join(least, "c").select("k1", "k2", "component_id", F.col("c").alias("component")), "class-components")
    out = sketch.select("doc_id", "row", "n", "k1", "k2").join(final, ["k1", "k2"], "left")
    whole = F.coalesce("component_id", "doc_id")
    return out.select(id_or_none().alias("doc_id"), F.col("n").alias("n_shingles"), F.when(whole != NO_ID, whole).alias("component_id"), (F.col("doc_id") == whole).alias("kept"), "row", "component")
