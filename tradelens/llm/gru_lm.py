"""Scores whole documents with a gated recurrent language model trained on the whole corpus.

Words: A-Z lower-cased, white space between; a document ends with an end token. Spark counts every word of the training
documents. The `head` most frequent words get embeddings and, in classes by frequency, weights of their own; every
other word belongs to one of `TAILS` classes by its last two bytes and shares its class by smoothed count (unseen words
of a class together count as one), so that

    P(word | history) = P(class | state) * P(word | class, state),

where for tail classes the second factor is (c + 0.1) / (N_class + 0.1 (V_class + 1)).

Training: truncated backpropagation in numpy. Every training document is read once. Documents are dealt by hash to
shards of about `shard_tokens` tokens and to `rounds`: in a round each shard trains a copy of the model on its documents
of the round, in the order of their hashes, many documents side by side with the state carried from window to window;
the copies' mean by tokens (of the weights and of the learning rates' sums) is where the next round begins. So a copy
never strays for longer than a round of one shard, however many shards there are, and neither shards nor rounds depend
on how the input is partitioned. Class and word biases start at the logarithms of the counts. Scoring carries the state
over the complete document.

The counts of the `known` most frequent words travel with the tasks (a bound on what is broadcast); rarer words of each
document meet their counts in a join, whatever their number. Texts are read twice: to count words, and to write each
document's symbols (two bytes a token), which training and scoring read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, coded_words, id_or_none, id_text, operator, release, saved, text_key

TAILS = 32
LANES, WINDOW = 384, 16
#: Lanes and window of training, and tokens of a document that it carries the state through.
TRAIN_LANES, TRAIN_WINDOW, SEGMENT = 384, 32, 1024
#: Tokens read side by side: bounds a task's memory, and lets short documents fill the lanes beside long ones.
CHUNK = 3_000_000
PART = 4096
#: Tokens whose class probabilities are told at once, so that they stay in a core's cache.
SLAB = 1024
#: No logit is above it.
TOP = np.float32(60)


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAILS


class Gru:
    """Symbols: 0..head-1 words, head the end, then tail classes. Classes: words by `width`, the end, tail classes."""

    def __init__(self, words_counts: list[int], end: float, tails: np.ndarray, width: int, state: int):
        v = len(words_counts)
        self.v, self.width, self.state = v, width, state
        self.inner = -(-v // width)
        self.classes, symbols = self.inner + 1 + TAILS, v + 1 + TAILS
        rng = np.random.default_rng(11)
        make = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        n = state
        counts = np.full(self.inner * width, 0.0)
        counts[:v] = np.asarray(words_counts) + 0.1
        grid = counts.reshape(self.inner, width)
        mass = np.concatenate([grid.sum(1), [end + 0.1], tails + 0.1])
        with np.errstate(divide="ignore"):
            inner_bias = np.where(grid > 0, np.log(np.maximum(grid, 1e-9) / np.maximum(grid.sum(1, keepdims=True), 1e-9)), -1e4)
        self.w = {
            "emb": (rng.normal(size=(symbols, n)) * 0.3).astype(np.float32),
            "wx": make(n, 3 * n),
            "wh": make(n, 3 * n),
            "b": np.zeros(3 * n, np.float32),
            "out": np.zeros((n, self.classes), np.float32),
            "ob": np.log(mass / mass.sum()).astype(np.float32),
            "in": np.zeros((self.inner, n, width), np.float32),
            "ib": inner_bias.astype(np.float32),
        }
        self.sq: dict[str, np.ndarray] = {}

    def classes_of(self, sym: np.ndarray) -> np.ndarray:
        return np.where(sym < self.v, sym // self.width, sym - self.v + self.inner).astype(np.int32)

    def gates(self) -> np.ndarray:
        """What each symbol adds to the gates."""
        return self.w["emb"] @ self.w["wx"] + self.w["b"]

    def window(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, gates: np.ndarray | None = None):
        """States (T, lanes, state) after each symbol of x (T, lanes); fresh resets a lane. gates: as gates() has them. h and what is kept for
        learning lie as (state, lanes), so that gates are contiguous."""
        n, w = self.state, self.w
        wh = np.ascontiguousarray(w["wh"].T)
        ax = np.ascontiguousarray((self.gates() if gates is None else gates)[x].transpose(0, 2, 1))
        out, cache = np.empty((len(x), n, x.shape[1]), np.float32), []
        for t in range(len(x)):
            if fresh[t].any():
                h = h.copy()
                h[:, fresh[t]] = 0
            g = wh @ h
            zr = ax[t, : 2 * n] + g[: 2 * n]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[:n], zr[n:]
            c = r * g[2 * n :]
            c += ax[t, 2 * n :]
            np.tanh(c, out=c)
            cache.append((h, z, r, c, g[2 * n :]))
            h = np.subtract(c, h, out=out[t]) * z + h
            out[t] = h
        return out.transpose(0, 2, 1), cache, h

    def outputs(self, states: np.ndarray, sym: np.ndarray, learn: bool):
        """Log-probability of each symbol (tail symbols: of their class); gradients if asked for."""
        n, w = self.state, self.w
        cls = self.classes_of(sym)
        # Biases are the weights of a state that is always 1. No logit passes its weights' sum times the largest state.
        ones = np.ones((len(states), n + 1), np.float32)
        ones[:, :n] = states
        outer, inner = np.concatenate([w["out"], w["ob"][None]]), np.concatenate([w["in"], w["ib"][:, None]], 1)
        high = max(states.max(initial=0), -states.min(initial=0))
        cut_outer, cut_inner = ((np.abs(a[..., :n, :]).sum(-2) * high + a[..., n, :]).max(initial=0) > TOP - 1 for a in (outer, inner))
        logp, grads, dh = np.empty(len(sym)), {}, None
        if learn:
            dh = np.empty_like(states)
            outer_grad, inner_grad = np.zeros_like(outer), np.zeros_like(inner)
            grads = {"out": outer_grad[:n], "ob": outer_grad[n], "in": inner_grad[:, :n], "ib": inner_grad[:, n]}
        for a in range(0, len(sym), SLAB):
            at = slice(a, a + SLAB)
            p = ones[at] @ outer
            if cut_outer:
                np.minimum(p, TOP, out=p)  # keeps exp finite without the maxima
            rows = np.arange(len(p))
            own = p[rows, cls[at]]
            np.exp(p, out=p)
            z = p @ np.ones(p.shape[1], np.float32)
            logp[at] = own - np.log(z)
            if learn:
                p *= (1 / z)[:, None]
                p[rows, cls[at]] -= 1
                outer_grad += ones[at].T @ p
                np.matmul(p, w["out"].T, out=dh[at])
        head = np.flatnonzero(sym < self.v)
        if len(head):
            order = head[np.argsort(cls[head].astype(np.uint16), kind="stable")]  # 16 bits: a radix sort
            own, s = cls[order], ones[order]
            cuts = np.flatnonzero(np.diff(own, prepend=-1)).tolist() + [len(own)]
            parts = [(int(own[a]), a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
            told = np.empty(len(order), np.float32)
            back = np.empty((len(s), n), np.float32) if learn else None
            pick = sym[order] - own * self.width
            while parts:
                first = parts[0][1]
                some = [x for x in parts if x[1] - first < SLAB]  # whole classes
                parts = parts[len(some) :]
                at = slice(first, some[-1][2])
                q = np.empty((at.stop - first, self.width), np.float32)
                for k, a, b in some:
                    np.matmul(s[a:b], inner[k], out=q[a - first : b - first])
                if cut_inner:
                    np.minimum(q, TOP, out=q)
                r = np.arange(len(q))
                top = q[r, pick[at]]
                np.exp(q, out=q)
                ez = q @ np.ones(self.width, np.float32)
                told[at] = top - np.log(ez)
                if learn:
                    q *= (1 / ez)[:, None]
                    q[r, pick[at]] -= 1
                    for k, a, b in some:
                        mine = q[a - first : b - first]
                        np.matmul(s[a:b].T, mine, out=inner_grad[k])
                        np.matmul(mine, w["in"][k].T, out=back[a:b])
            logp[order] += told
            if learn:
                dh[order] += back
        return logp, grads, dh

    def gradients(self, x, y, fresh, mask, h):
        """Of minus the window's log-probability: by weight, those of the embeddings as (rows, gradient); and the state."""
        n, w = self.state, self.w
        states, cache, h = self.window(x, fresh, h)
        t_n, lanes, _ = states.shape
        flat = np.flatnonzero(mask.reshape(-1))
        _, grads, dflat = self.outputs(states.reshape(-1, n)[flat], y.reshape(-1)[flat], True)
        dh_all = dflat
        if len(flat) < t_n * lanes:
            dh_all = np.zeros((t_n * lanes, n), np.float32)
            dh_all[flat] = dflat
        dh_all = np.ascontiguousarray(dh_all.reshape(t_n, lanes, n).transpose(0, 2, 1))
        dh, dax = np.zeros((n, lanes), np.float32), np.empty((3 * n, lanes), np.float32)
        gwh, gwx, gb = np.zeros((3 * n, n), np.float32), np.zeros((3 * n, n), np.float32), np.zeros(3 * n, np.float32)
        wh, wx, emb, one = w["wh"], w["wx"].T, w["emb"][x], np.ones(lanes, np.float32)
        demb = np.empty((t_n, lanes, n), np.float32)
        for t in range(t_n - 1, -1, -1):
            prev, z, r, c, gc = cache[t]
            d = dh + dh_all[t]
            dz = d * z
            dc = dz * (1 - c * c)
            dax[2 * n :] = dc
            dh = d - dz
            dz *= c - prev
            dz *= 1 - z
            dax[:n] = dz
            dg = np.empty((3 * n, lanes), np.float32)
            dg[:n] = dz
            np.multiply(dc, r, out=dg[2 * n :])
            gc = gc * dg[2 * n :]
            gc *= 1 - r
            dax[n : 2 * n] = dg[n : 2 * n] = gc
            gwh += dg @ prev.T
            gwx += dax @ emb[t]
            gb += dax @ one
            np.matmul(dax.T, wx, out=demb[t])
            dh += wh @ dg
            if fresh[t].any():
                dh[:, fresh[t]] = 0
        grads["wh"], grads["wx"], grads["b"] = gwh.T, gwx.T, gb
        demb = demb.reshape(-1, n)
        order = np.argsort(x.reshape(-1).astype(np.uint16), kind="stable")  # symbols have 16 bits
        own = x.reshape(-1)[order]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        return grads, (own[starts], np.add.reduceat(demb[order], starts, axis=0)), h

    def learn(self, x, y, fresh, mask, h, rate):
        """A step of truncated backpropagation over one window; returns the state to carry on."""
        grads, (rows, gemb), h = self.gradients(x, y, fresh, mask, h)
        for k, g in grads.items():
            self.step(k, slice(None), g, rate)
        self.step("emb", rows, gemb, rate)
        return h

    def flat(self) -> np.ndarray:
        """All weights, then the sums of squares that set their rates."""
        names = sorted(self.w)
        ones = {k: self.sq.get(k, np.ones(self.w[k].shape, np.float32)) for k in names}
        return np.concatenate([x[k].reshape(-1) for x in (self.w, ones) for k in names]).astype(np.float32)

    def load(self, flat: np.ndarray) -> None:
        names = sorted(self.w)
        cuts = np.cumsum([self.w[k].size for _ in range(2) for k in names])[:-1]
        parts = np.split(flat, cuts)
        self.w = {k: p.reshape(self.w[k].shape).copy() for k, p in zip(names, parts, strict=False)}
        self.sq = {k: p.reshape(self.w[k].shape).copy() for k, p in zip(names, parts[len(names) :], strict=True)}

    def step(self, key, at, g, rate):
        """AdaGrad on sums over a window's tokens; the start of 1 keeps weights that few tokens touch near theirs."""
        if key not in self.sq:
            self.sq[key] = np.ones(self.w[key].shape, np.float32)
        sq = self.sq[key]
        sq[at] += g * g
        self.w[key][at] -= rate * g / np.sqrt(sq[at])


def lanes(docs: list[np.ndarray], most: int) -> list[list[int]]:
    """Documents dealt to lanes so that lanes are about as long: longest first, to the shortest lane."""
    import heapq

    out: list[list[int]] = [[] for _ in range(min(most, len(docs)))]
    heap = [(0, i) for i in range(len(out))]
    for d in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        n, i = heap[0]
        out[i].append(d)
        heapq.heapreplace(heap, (n + len(docs[d]), i))
    return out


def streams(docs: list[np.ndarray], end: int, most: int):
    """Arrays (steps, lanes): symbol read, symbol to tell, whether a document begins, the document (-1: nothing)."""
    dealt = lanes(docs, most)
    seqs = [np.concatenate([docs[d] for d in lane]) for lane in dealt]
    dealt = [dealt[i] for i in np.argsort([-len(s) for s in seqs], kind="stable")]
    seqs.sort(key=lambda s: -len(s))
    steps, n = len(seqs[0]), len(seqs)
    x, y = np.full((steps, n), end, np.int32), np.full((steps, n), end, np.int32)
    doc, fresh = np.full((steps, n), -1, np.int32), np.zeros((steps, n), bool)
    for i, (lane, s) in enumerate(zip(dealt, seqs, strict=True)):
        y[: len(s), i] = s
        x[1 : len(s), i] = s[:-1]
        size = [len(docs[d]) for d in lane]
        doc[: len(s), i] = np.repeat(lane, size)
        fresh[np.cumsum([0, *size[:-1]]), i] = True
    x[fresh] = end
    return x, y, fresh, doc


class Vocabulary:
    """Rows of words: known words by frequency, then one row for each tail class of the words beyond, then the end.

    symbols maps rows to the model's symbols.
    """

    def __init__(self, known: list[bytes], head: int):
        self.known, self.end = dict(zip(known, range(len(known)), strict=True)), len(known) + TAILS
        k = min(head, len(known))
        tails = [k + 1 + tail_class(w) for w in known[k:]]
        self.symbols = np.array([*range(k), *tails, *range(k + 1, k + 1 + TAILS), k], np.int32)

    def own_rows(self, own: list[bytes]) -> np.ndarray:
        """Each word's row (one 0 where there is none)."""
        n = len(self.known)
        return np.array([i if (i := self.known.get(w)) is not None else n + tail_class(w) for w in own] or [0], np.int32)

    def rows(self, of: np.ndarray, at: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Each text's rows, the end included; of what own_rows() and coded_words() return."""
        texts = len(offsets) - 1
        ends = offsets[1:] + np.arange(texts)
        out = np.empty(len(at) + texts, np.int32)
        inner = np.ones(len(out), bool)
        inner[ends] = False
        out[inner], out[ends] = of[at], self.end
        return np.split(out, ends[:-1] + 1) if texts else []


def segments(docs: list[np.ndarray]) -> list[np.ndarray]:
    """Documents cut to at most SEGMENT tokens: training carries the state through each, so that a long document doesn't
    hold up the lanes beside it."""
    return [d[i : i + SEGMENT] for d in docs for i in range(0, len(d), SEGMENT)]


def train_on(model: Gru, docs: list[np.ndarray], rate: float) -> None:
    x, y, fresh, doc = streams(segments(docs), model.v, TRAIN_LANES)
    h = np.zeros((model.state, x.shape[1]), np.float32)
    for t in range(0, len(x), TRAIN_WINDOW):
        part = slice(t, t + TRAIN_WINDOW)
        live = int((doc[t] >= 0).sum())
        h = model.learn(x[part, :live], y[part, :live], fresh[part, :live], doc[part, :live] >= 0, h[:, :live], rate)


def score_docs(model: Gru, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log-probability of each document's symbols, the state carried from its start to its end."""
    x, y, fresh, doc = streams(docs, model.v, LANES)
    h, out, gates = np.zeros((model.state, x.shape[1]), np.float32), np.zeros(len(docs)), model.gates()
    t = 0
    while t < len(x):
        live = int((doc[t] >= 0).sum())
        part = slice(t, t + max(WINDOW, LANES * WINDOW // live))  # the fewer documents go on, the longer the window
        t = part.stop
        states, _, h = model.window(x[part, :live], fresh[part, :live], h[:, :live], gates)
        flat = np.flatnonzero(doc[part, :live].reshape(-1) >= 0)
        logp, _, _ = model.outputs(states.reshape(-1, model.state)[flat], y[part, :live].reshape(-1)[flat], False)
        out += np.bincount(doc[part, :live].reshape(-1)[flat], logp, len(docs))
    return out


def count_words(src: DataFrame) -> DataFrame:
    """w, c of every word of src (text); a task holds at most about 300,000 words at a time."""

    def task(batches):
        total: dict[bytes, int] = {}

        def rows():
            got = pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["w", "c"])
            total.clear()
            return got

        for b in blocks(batches):
            own, at, _ = coded_words(b.column(0).to_pylist())
            get = total.get
            for w, n in zip(own, np.bincount(at, minlength=len(own)).tolist(), strict=True):
                if n:
                    total[w] = get(w, 0) + n
            if len(total) > 300_000:
                yield rows()
        yield rows()

    return src.mapInArrow(task, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


def most_frequent(vocab: DataFrame, most: int) -> DataFrame:
    """The words above a count, as many as `most` allows; words of (almost) one count all are in or all out.

    Counts are cut to 16 steps a doubling, so the driver sees a thousand rows at most, and then the words alone.
    """
    step = F.floor(F.log2("c") * 16)
    seen = {r.s: r.n for r in vocab.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, total = None, 0
    for s in sorted(seen, reverse=True):
        total += seen[s]
        if total > most:
            break
        least = s
    return vocab.where(F.lit(False) if least is None else step >= least).select("w", "c")


def train(coded: DataFrame, model: Gru, shards: int, rounds: int, rate: float) -> Gru:
    """Rounds over coded (h, ids): each shard's copy from where the last round's mean left off (see the module)."""
    at = F.shiftrightunsigned("h", 1)
    dealt = coded.select((at % shards).cast("int").alias("shard"), F.expr(f"int(shiftrightunsigned(h, 1) div {shards} % {rounds})").alias("round"), "h", "ids")

    def one_round(part: DataFrame) -> list:
        def task(batches):
            import copy

            def copies(shard, own, tokens):
                flat = own.flat()
                parts = [flat[i : i + PART].tobytes() for i in range(0, len(flat), PART)]
                return pa.RecordBatch.from_pydict({"i": list(range(len(parts))), "n": [tokens] * len(parts), "v": parts}, schema=pa.schema([("i", pa.int64()), ("n", pa.int64()), ("v", pa.binary())]))

            at, own, tokens, held, n = None, None, 0, [], 0
            for b in batches:
                for shard, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if n and (shard != at or n > CHUNK):
                        train_on(own, held, rate)
                        tokens, held, n = tokens + n, [], 0
                    if shard != at:
                        if at is not None:
                            yield copies(at, own, tokens)
                        at, own, tokens = shard, copy.deepcopy(model), 0
                    held.append(np.frombuffer(ids, "<u2").astype(np.int32))
                    n += len(held[-1])
            if at is not None:
                train_on(own, held, rate)
                yield copies(at, own, tokens + n)
            release()

        def mean(batches):
            sums: dict[int, tuple[float, np.ndarray]] = {}
            for b in batches:
                for i, n, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    m, x = sums.get(i, (0.0, 0.0))
                    sums[i] = (m + n, x + n * np.frombuffer(v, np.float32).astype(np.float64))
            yield pa.RecordBatch.from_pydict({"i": list(sums), "v": [(x / m).astype(np.float32).tobytes() for m, x in sums.values()]}, schema=pa.schema([("i", pa.int64()), ("v", pa.binary())]))

        ordered = part.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "h").select("shard", "ids")
        trained = saved(ordered.mapInArrow(task, "i long, n long, v binary"), "copies")
        return trained.repartition("i").mapInArrow(mean, "i long, v binary").collect()  # as many bytes as the model has

    for r in range(rounds):
        rows = one_round(dealt.where(F.col("round") == r))
        if rows:
            model.load(np.frombuffer(b"".join(x.v for x in sorted(rows)), np.float32))
    model.sq = {}
    return model


@operator
def score(docs: DataFrame, head: int = 4096, known: int = 131_072, width: int = 64, state: int = 16, rate: float = 0.2, fold: int = 10, shard_tokens: int = 2_000_000, rounds: int = 4) -> DataFrame:
    """One row a document: held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null texts are empty (the end token alone); a null doc_id counts as the empty text in the fold and comes back null;
    rows that repeat a doc_id are scored each; an empty table gives no rows; other columns play no part. Without training
    documents every word is unknown.
    """
    src = id_text(docs).select(F.monotonically_increasing_id().alias("number"), "doc_id", "text", held_out_of(fold).alias("held_out"))
    training = src.where("not held_out").select("text")
    n_docs = training.select(F.lit(1).alias("x")).count()
    vocab = saved(count_words(training), "vocabulary")
    tail = F.crc32(F.expr("substring(w, -2, 2)")) % TAILS
    top = sorted(most_frequent(vocab, known).collect(), key=lambda r: (-r.c, r.w))
    sums = vocab.groupBy(tail.cast("int").alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    tail_n, tail_v = np.zeros(TAILS), np.zeros(TAILS)
    for r in sums:
        tail_n[r.k], tail_v[r.k] = r.n, r.v
    n_all, v_all = int(tail_n.sum()) + n_docs, int(tail_v.sum()) + (n_docs > 0)
    names_known = [bytes(r.w) for r in top]
    for w, r in zip(names_known[:head], top, strict=False):
        tail_n[tail_class(w)] -= r.c
        tail_v[tail_class(w)] -= 1
    # For each row of the vocabulary: log10(c + 0.1) (0 where a join tells), and what a tail word adds to its class.
    log_tail = np.log10(tail_n + 0.1 * (tail_v + 1))
    base_log = np.concatenate([np.log10(np.array([r.c for r in top], np.float64) + 0.1), np.zeros(TAILS), [np.log10(n_docs + 0.1)]])
    share = np.concatenate([base_log[:head] * 0, [base_log[i] - log_tail[tail_class(w)] for i, w in enumerate(names_known[head:], head)], -log_tail, [0.0]])
    is_known = np.concatenate([np.ones(len(top), np.int64), np.zeros(TAILS, np.int64), [int(n_docs > 0)]])
    # One pass tells each document's row and its rare words (columns of the other are null).
    kinds = pa.schema([("kind", pa.string()), ("number", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("share", pa.float64()), ("ids", pa.binary()), ("w", pa.binary()), ("n", pa.int64())])
    ddl = "kind string, number long, doc_id long, row long, held_out boolean, n_tokens long, n_known long, base double, share double, ids binary, w binary, n long"

    def code(batches):
        table = Vocabulary(names_known, head)

        def batch(kind, **got):
            size = len(got["number"])
            got["kind"] = pa.repeat(kind, size)
            return pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) if f.name in got else pa.nulls(size, f.type) for f in kinds], schema=kinds)

        def rare(numbers, own, of, at, offsets):
            is_rare = of >= len(table.known) if own else np.zeros(1, bool)
            doc = np.repeat(np.arange(len(numbers)), np.diff(offsets))
            some = is_rare[at]
            key, times = np.unique(doc[some] * len(own) + at[some], return_counts=True)
            doc, word = key // max(1, len(own)), key % max(1, len(own))
            return batch("rare", number=numbers[doc], w=pa.array(own, pa.binary()).take(pa.array(word)), n=times)

        for b in blocks(batches):
            texts, numbers = b.column(2).to_pylist(), b.column(0).to_numpy()
            own, at, offsets = coded_words(texts)
            of = table.own_rows(own)
            yield rare(numbers, own, of, at, offsets)
            rows = table.rows(of, at, offsets)
            size = np.array([len(r) for r in rows])
            every, starts = np.concatenate(rows), np.cumsum(size) - size
            total = lambda of: np.add.reduceat(of[every], starts)
            symbols = [table.symbols[r].astype("<u2").tobytes() for r in rows]
            yield batch("document", number=numbers, doc_id=b.column(1), row=list(map(text_key, texts)), held_out=b.column(3), n_tokens=size, n_known=total(is_known), base=total(base_log), share=total(share), ids=symbols)

    coded = saved(src.mapInArrow(code, ddl), "coded", by="kind")
    rows = coded.where("kind = 'document'")
    start = Gru([r.c for r in top[:head]], n_docs, tail_n, width, state)
    shards = max(1, -(-n_all // shard_tokens))
    model = train(rows.where("not held_out").select(F.xxhash64("doc_id", "row").alias("h"), "ids"), start, shards, rounds, rate)

    def tell(batches):
        held, docs, n = [], [], 0
        names = ["number", "doc_id", "held_out", "n_tokens", "n_known", "base", "model"]

        def told():
            got = pa.Table.from_batches(held).combine_chunks()
            total = score_docs(model, docs) / np.log(10) + got["share"].to_numpy()
            out = pa.RecordBatch.from_arrays([*(got[c].combine_chunks() for c in names[:-1]), pa.array(total)], names=names)
            held.clear()
            docs.clear()
            return out

        for b in blocks(batches):
            held.append(b.drop_columns(["ids"]))
            docs += [np.frombuffer(x, "<u2").astype(np.int32) for x in b.column("ids").to_pylist()]
            n += sum(map(len, docs[-b.num_rows :]))
            if n > CHUNK:
                yield told()
                n = 0
        if held:
            yield told()

    main = saved(rows.select("number", "doc_id", "held_out", "n_tokens", "n_known", "base", "share", "ids").mapInArrow(tell, "number long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double"), "told")
    pairs = coded.where("kind = 'rare'").select("number", "w", "n")
    one = F.col("n") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(0.1))
    # A word has one row in vocab: a task hashes its share of them, and the pairs need no sorting.
    met = pairs.join(vocab.hint("shuffle_hash"), "w", "left").groupBy("number").agg(F.sum(one).alias("rare"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    z = float(np.log10(n_all + 0.1 * (v_all + 1)))
    out = main.join(met, "number", "left")
    rare_sum = F.coalesce("rare", F.lit(0.0))
    return out.select(id_or_none().alias("doc_id"), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") + rare_sum - F.col("n_tokens") * F.lit(z)).alias("base_score"), (F.col("model") + rare_sum).alias("score"))


def held_out_of(fold: int):
    """held_out() of the inner doc_id, in which a stand-in is a null."""
    text = F.coalesce(id_or_none().cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % fold == 0
