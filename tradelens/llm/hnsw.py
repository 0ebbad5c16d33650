"""Approximate nearest neighbours by cosine: a hierarchical navigable small-world graph a shard, results merged.

Rows are dealt evenly to shards of about `shard_rows`; equal vectors of a shard are one node with its smallest ids (as
many as an answer can use). A graph is flat arrays: for each layer its nodes and one row of neighbour numbers each.
Insertion and search handle many vectors side by side in numpy. Queries meet every shard: graphs and blocks of queries
are dealt by shard and sorted so that a task reads a shard's graph once and streams the blocks past it. What travels is
each graph once, and each query once a shard. Candidates found are scored again in double precision on the original
vectors, and a task keeps the best of each query of each shard.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import operator, pick, saved

M, EF_BUILD, EF_SEARCH, BATCH, EXPAND = 16, 96, 224, 512, 4


def beam(vectors: np.ndarray, table: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Node numbers and similarities (best first, -1 and -inf where there are fewer) of the ef best met from entry.

    table: neighbour numbers of each vector, -1 for none; entry: (queries, entries).
    """
    n_q = len(q)
    seen = np.zeros((n_q, len(vectors) + 1), bool)
    seen[:, -1] = True  # node -1
    rows = np.arange(n_q)[:, None]
    ids = np.full((n_q, ef), -1, np.int32)
    sim = np.full((n_q, ef), -np.inf, np.float32)
    done = np.ones((n_q, ef), bool)
    k = min(ef, entry.shape[1])
    ids[:, :k] = entry[:, :k]
    seen[rows, ids[:, :k]] = True
    sim[:, :k] = np.where(ids[:, :k] >= 0, np.einsum("qkd,qd->qk", vectors[ids[:, :k]], q), -np.inf)
    done[:, :k] = ids[:, :k] < 0
    live = np.arange(n_q)
    while len(live):
        s = np.where(done[live], -np.inf, sim[live])
        pick = np.argsort(-s, axis=1)[:, :EXPAND]
        r = np.arange(len(live))[:, None]
        good = s[r, pick] > -np.inf
        some = good[:, 0]
        live, pick, good = live[some], pick[some], good[some]
        if not len(live):
            break
        node = np.where(good, ids[live[:, None], pick], -1)
        done[live[:, None], pick] |= good
        near = table[node].reshape(len(live), -1)
        near = np.where(np.repeat(good, table.shape[1], axis=1), near, -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near = np.where(seen[live[:, None], near], -1, near)
        seen[live[:, None], near] = True
        new = np.where(near >= 0, np.einsum("qkd,qd->qk", vectors[near], q[live]), -np.inf)
        all_s = np.concatenate([sim[live], new], 1)
        top = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
        r = np.arange(len(live))[:, None]
        ids[live] = np.concatenate([ids[live], near], 1)[r, top]
        done[live] = np.concatenate([done[live], near < 0], 1)[r, top]
        sim[live] = all_s[r, top]
    order = np.argsort(-sim, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)


def diverse(vectors: np.ndarray, cand: np.ndarray, sim: np.ndarray, m: int) -> np.ndarray:
    """Up to m of each row's candidates (best first): those nearer to the row's vector than to one taken before;
    places left go to the best of the rest."""
    n, k = cand.shape
    taken = np.zeros((n, k), bool)
    open_ = cand >= 0
    rows = np.arange(n)
    v = vectors[cand]
    for _ in range(m):
        at = open_.argmax(1)
        has = open_[rows, at]
        if not has.any():
            break
        taken[rows[has], at[has]] = True
        cross = np.einsum("nkd,nd->nk", v, v[rows, at])
        open_ &= ~(has[:, None] & (cross > sim))
        open_[rows[has], at[has]] = False
    score = np.where(cand < 0, -np.inf, np.where(taken, sim + 4, sim))
    best = np.argsort(-score, axis=1, kind="stable")[:, :m]
    return np.where(np.take_along_axis(score, best, 1) > -np.inf, np.take_along_axis(cand, best, 1), -1)


class Graph:
    """layers: from the top, (nodes, neighbour table over all nodes' numbers)."""

    def __init__(self, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.vectors, self.layers = vectors, layers

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 5) -> Graph:
        n = len(vectors)
        level = (-np.log(np.random.default_rng(seed).random(n)) / np.log(M)).astype(int)
        graph = cls(vectors, [])
        for lev in range(int(level.max(initial=0)), -1, -1):
            nodes = np.flatnonzero(level >= lev)
            graph.layers.append((nodes, graph.layer(nodes, 2 * M if lev == 0 else M)))
        return graph

    def layer(self, nodes: np.ndarray, m: int) -> np.ndarray:
        v = self.vectors
        table = np.full((len(v) + 1, m), -1, np.int32)
        above = self.layers[-1][0] if self.layers else nodes[:1]
        rest = nodes[~np.isin(nodes, above)]
        for i in range(0, len(above), BATCH):  # nodes of the layer above start the layer, linked among themselves
            part = above[i : i + BATCH]
            self.link(table, part, np.broadcast_to(above, (len(part), len(above))), v[part] @ v[above].T, m, False)
        for i in range(0, len(rest), BATCH):
            part = rest[i : i + BATCH]
            q = v[part]
            ids, sim = beam(v, table, q, self.descend(q, above), EF_BUILD)
            self.link(table, part, np.concatenate([ids, np.broadcast_to(part, (len(part), len(part)))], 1), np.concatenate([sim, q @ q.T], 1), m, True)
        return table

    def descend(self, q: np.ndarray, above: np.ndarray) -> np.ndarray:
        """Entries to the layer below those built: greedy from the top with a small beam."""
        if not self.layers:
            return np.repeat(above[:1, None], len(q), 0)
        entry = np.repeat(self.layers[0][0][:1, None], len(q), 0)
        for _, table in self.layers:
            entry = beam(self.vectors, table, q, entry, 8)[0]
        return entry

    def link(self, table, part, cand, sim, m, back) -> None:
        own = cand == part[:, None]
        sim = np.where(own | (cand < 0), -np.inf, sim)
        k = min(sim.shape[1], EF_BUILD)
        top = np.argsort(-sim, axis=1, kind="stable")[:, :k]
        sim, cand = np.take_along_axis(sim, top, 1), np.take_along_axis(np.where(own, -1, cand), top, 1)
        cand = np.where(sim > -np.inf, cand, -1)
        chosen = diverse(self.vectors, cand, sim, min(m, M) if back else m)
        table[part, : chosen.shape[1]] = np.where(chosen >= 0, chosen, table[part, : chosen.shape[1]])
        # Links back: each target chooses anew among its own and the new ones.
        src = np.repeat(part, chosen.shape[1])
        dst = chosen.reshape(-1)
        src, dst = src[dst >= 0], dst[dst >= 0]
        if not len(dst):
            return
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        targets, first, n = np.unique(dst, return_index=True, return_counts=True)
        for width in sorted({int(2 ** np.ceil(np.log2(x))) for x in n.tolist()}):
            at = np.flatnonzero((n <= width) & (n > width // 2))
            if not len(at):
                continue
            grid = first[at][:, None] + np.arange(width)
            new = np.where(np.arange(width) < n[at][:, None], src[np.minimum(grid, len(src) - 1)], -1)
            old = table[targets[at]]
            both = np.sort(np.concatenate([old, new], 1), axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            s = np.where(both >= 0, np.einsum("nkd,nd->nk", self.vectors[both], self.vectors[targets[at]]), -np.inf)
            top = np.argsort(-s, axis=1, kind="stable")
            table[targets[at]] = -1
            got = diverse(self.vectors, np.take_along_axis(both, top, 1), np.take_along_axis(s, top, 1), m)
            table[targets[at], : got.shape[1]] = got

    def search(self, q: np.ndarray, k: int, ef: int = EF_SEARCH) -> np.ndarray:
        """Numbers of about the k nearest nodes of each vector, best first; -1 where there are fewer."""
        entry = np.repeat(self.layers[0][0][:1, None], len(q), 0)
        for _, table in self.layers[:-1]:
            entry = beam(self.vectors, table, q, entry, 8)[0]
        return beam(self.vectors, self.layers[-1][1], q, entry, max(ef, k))[0][:, :k]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in single precision, for the graph."""
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of each row of x with the row of q, in double precision (scaled first, so that squares stay finite)."""
    x, q = x / np.abs(x).max(-1, keepdims=True), q / np.abs(q).max(-1, keepdims=True)
    return (x * q).sum(-1) / np.sqrt((x * x).sum(-1) * (q * q).sum(-1))


def pack_arrays(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def build_shard(ids: np.ndarray, vectors: np.ndarray, keep: int) -> bytes:
    """vectors: double, of one length. Equal vectors become one node with its `keep` smallest ids."""
    order = np.lexsort((ids,))
    ids, vectors = ids[order], vectors[order]
    _, first, inverse = np.unique(np.ascontiguousarray(vectors).view(f"V{vectors.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
    inverse = inverse.ravel()
    by = np.argsort(inverse, kind="stable")
    starts = np.searchsorted(inverse[by], np.arange(len(first)))
    nth = np.arange(len(by)) - starts[inverse[by]]
    own = np.full((len(first), keep), -1, np.int64)
    held = np.zeros((len(first), keep), bool)
    some = nth < keep
    own[inverse[by][some], nth[some]] = ids[by][some]
    held[inverse[by][some], nth[some]] = True
    nodes = vectors[first]
    graph = Graph.build(unit(nodes))
    layers = {f"n{i}": nodes_ for i, (nodes_, _) in enumerate(graph.layers)} | {f"t{i}": t for i, (_, t) in enumerate(graph.layers)}
    return pack_arrays(vectors=nodes, ids=own, held=held, depth=np.array(len(graph.layers)), **layers)


def open_shard(blob: bytes) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    a = np.load(io.BytesIO(blob))
    vectors = a["vectors"]
    return Graph(unit(vectors), [(a[f"n{i}"], a[f"t{i}"]) for i in range(int(a["depth"]))]), vectors, a["ids"], a["held"]


def search_shard(shard, q_ids: np.ndarray, q: np.ndarray, k: int):
    """(row of q, vec_id, score) of each query's k nearest of the shard, its own id left out."""
    graph, vectors, ids, held = shard
    out = []
    for i in range(0, len(q), BATCH):
        part = slice(i, i + BATCH)
        found = graph.search(unit(q[part]), 4 * (k + 1))
        score = cosines(vectors[found], q[part][:, None, :])
        score = np.where(found >= 0, score, -np.inf)
        of, ok = ids[found], held[found] & (found >= 0)[..., None] & (ids[found] != q_ids[part][:, None, None])
        flat_s, flat_i = np.repeat(score, ids.shape[1], axis=1), of.reshape(len(of), -1)
        flat_s = np.where(ok.reshape(len(of), -1), flat_s, -np.inf)
        best = np.lexsort((flat_i, -flat_s), axis=1)[:, :k]
        s, v = np.take_along_axis(flat_s, best, 1), np.take_along_axis(flat_i, best, 1)
        r, c = np.nonzero(s > -np.inf)
        out.append((r + i, v[r, c], s[r, c]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


@operator
def neighbours(vectors: DataFrame, is_query, k: int = 5, shard_rows: int = 16384, block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row of vectors (vec_id, embedding) that is_query names.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do vectors of another length
    than the most frequent (of equals the longest), nor null ids. Rows that share a query's vec_id are its own. Rows
    that repeat a query's id and vector are asked once; with other vectors, the id is asked once for each.
    """
    spark = vectors.sparkSession
    x = pick(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    x = x.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0.0))
    x = saved(x, "vectors")
    sizes = x.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n = sizes[0].d, sizes[0].n
    shards = max(1, -(-n // shard_rows))
    x = x.where(F.size("v") == d)
    dealt = saved(x.withColumn("shard", F.pmod(F.hash(F.monotonically_increasing_id()), F.lit(shards))), "dealt")

    def matrix(column) -> np.ndarray:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)

    def build(batches):
        # A task has one shard: its rows are a matrix of `shard_rows` vectors, about.
        rows = [b for b in batches if b.num_rows]
        if rows:
            t = pa.Table.from_batches(rows)
            blob = build_shard(t["vec_id"].to_numpy(), matrix(t["v"]), k + 1)
            yield pa.RecordBatch.from_arrays([pa.array([t["shard"][0].as_py()], pa.int32()), pa.array([blob], pa.binary())], names=["shard", "graph"])

    graphs = saved(dealt.select("shard", "vec_id", "v").repartitionById(shards, F.col("shard")).mapInArrow(build, "shard int, graph binary"), "graphs")
    asked = saved(dealt.where(is_query).select("vec_id", "v").distinct().withColumn("block", F.monotonically_increasing_id()), "asked")
    blocks_n = max(1, -(-asked.count() // block))
    asked = asked.withColumn("block", F.pmod(F.hash("block"), F.lit(blocks_n)))

    def gather(t: pa.Table) -> pa.Table:
        blob = pack_arrays(ids=t["vec_id"].to_numpy(), q=matrix(t["v"]))
        return pa.table({"block": pa.array([t["block"][0].as_py()], pa.int32()), "asked": pa.array([blob], pa.binary())})

    gathered = saved(asked.select("block", "vec_id", "v").groupBy("block").applyInArrow(gather, "block int, asked binary"), "asked-blocks")
    # A graph sorts before the blocks of its shard.
    met = graphs.select("shard", F.lit(-1).alias("block"), F.col("graph").alias("data")).unionByName(gathered.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "block", F.col("asked").alias("data")))

    def search(batches):
        schema = pa.schema([("query_id", pa.int64()), ("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        own, shard = None, None
        for b in batches:
            for i in range(b.num_rows):
                number, block, data = (b.column(c)[i].as_py() for c in range(3))
                if block < 0:
                    own, shard = number, open_shard(data)
                    continue
                if own != number:  # a shard that no row was dealt to
                    continue
                a = np.load(io.BytesIO(data))
                r, v, s = search_shard(shard, a["ids"], a["q"], k)
                yield pa.RecordBatch.from_arrays([pa.array(a["ids"][r]), pa.array((r + (block << 32)).astype(np.int64)), pa.array(v), pa.array(s)], schema=schema)

    # One row is a shard's graph or a block of queries; a batch is to hold few of them.
    dealt = met.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "block")
    found = saved(dealt.mapInArrow(search, "query_id long, q long, vec_id long, score double"), "found", 4)
    best = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
