"""Language identification by a linear-chain conditional random field over words.

Each word is labelled; affixes, character n-grams and the word itself (lexicon) are hashed features with a weight for
each language, and learned transitions tie neighbours, so a code-switched text gets switching labels. Forward-backward
gives each word's marginals; a document takes the language with the largest mean marginal, and that mean is its score.

Fitting takes a bounded sample: the `train_docs` labelled training documents of the smallest hashes among those of at
most `train_chars` characters. Words take their document's language as label. Prediction covers every whole text.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, operator, pick

BUCKETS = 1 << 17
#: Words of a segment; segments of all a block's documents advance together.
SEGMENT = 64
_NOT_LETTERS = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def stem(word: str) -> str:
    """The word in lower case without marks and digits at its ends; empty without letters."""
    return (word if word.isalpha() else _NOT_LETTERS.sub("", word)).lower()


def features(w: str) -> list[int]:
    """Hash buckets of a stem: the word itself, affixes of three letters, trigrams (in bytes) with its ends marked."""
    h = xxhash.xxh32_intdigest
    mark = f"^{w}$".encode("utf-8", "surrogatepass")
    names = {mark, mark[:4], mark[-4:], *map(bytes, zip(mark, mark[1:], mark[2:], strict=False))}
    return [h(n) % BUCKETS for n in names]


class Chain:
    """Weights (BUCKETS, L), transitions (L, L) and the languages' names."""

    def __init__(self, langs: list[str]):
        self.langs, n = langs, len(langs)
        self.weights, self.moves = np.zeros((BUCKETS, n), np.float32), np.zeros((n, n), np.float32)

    def marginals(self, emission: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of each word, and expected counts of transitions within segments' words.

        emission: scores of all documents' words one after another; size: words of each document (one at least).
        Exact over whole documents: products of each segment's step matrices give the vectors at segments' borders.
        """
        n = emission.shape[1]
        e = np.exp(emission - emission.max(1, keepdims=True)).astype(np.float64) + 1e-30
        a = np.exp(self.moves.astype(np.float64))
        first = np.cumsum(size) - size
        segs = -(-size // SEGMENT)
        doc = np.repeat(np.arange(len(size)), segs)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(segs) - segs, segs)
        start = first[doc] + nth * SEGMENT
        length = np.minimum(SEGMENT, size[doc] - nth * SEGMENT)
        order = np.argsort(-length, kind="stable")
        live = [int((length > t).sum()) for t in range(SEGMENT)]
        so = start[order]
        # Transfer matrix of each segment: entering vector (before the move into its first word) to leaving vector.
        prod = np.broadcast_to(np.eye(n), (len(doc), n, n)).copy()
        for t in range(SEGMENT):
            k = live[t]
            if not k:
                break
            p = (prod[:k].reshape(-1, n) @ a).reshape(k, n, n) * e[so[:k] + t][:, None, :]
            prod[:k] = p / p.sum((1, 2), keepdims=True)
        enter, leave = np.empty((len(doc), n)), np.empty((len(doc), n))
        inv = np.empty(len(doc), np.int64)
        inv[order] = np.arange(len(doc))
        seg0 = np.cumsum(segs) - segs
        by_len = np.argsort(-segs, kind="stable")
        many = [int((segs > j).sum()) for j in range(int(segs.max()))]
        v = np.full((len(size), n), 1.0 / n)
        for j, k in enumerate(many):
            at = inv[seg0[by_len[:k]] + j]
            enter[at] = v[:k]
            x = np.einsum("ki,kij->kj", v[:k], prod[at])
            v[:k] = x / x.sum(1, keepdims=True)
        u = np.ones((len(size), n))
        for j in range(len(many) - 1, -1, -1):
            k = many[j]
            at = inv[seg0[by_len[:k]] + j]
            leave[at] = u[:k]
            x = np.einsum("kij,kj->ki", prod[at], u[:k])
            u[:k] = x / x.sum(1, keepdims=True)
        alpha, beta = np.empty_like(e), np.empty_like(e)
        v = enter
        for t in range(SEGMENT):
            k = live[t]
            if not k:
                break
            x = (v[:k] @ a) * e[so[:k] + t]
            v[:k] = alpha[so[:k] + t] = x / x.sum(1, keepdims=True)
        u = leave
        for t in range(SEGMENT - 1, -1, -1):
            k = live[t]
            if not k:
                continue
            beta[so[:k] + t] = u[:k]
            x = (e[so[:k] + t] * u[:k]) @ a.T
            u[:k] = x / x.sum(1, keepdims=True)
        m = alpha * beta
        m /= m.sum(1, keepdims=True)
        self._last = (alpha, beta, e, a, first)
        return m, first

    def pair_counts(self) -> np.ndarray:
        """Expected transitions of the last marginals() call."""
        alpha, beta, e, a, first = self._last
        ok = np.ones(len(alpha), bool)
        ok[first] = False
        at = np.flatnonzero(ok)
        left, right = alpha[at - 1], e[at] * beta[at]
        z = ((left @ a) * right).sum(1, keepdims=True)
        return a * (left.T @ (right / z))


def fit(texts: list[str], labels: list[str], epochs: int = 2, batch: int = 48, rate: float = 0.2) -> Chain | None:
    """Maximum likelihood by AdaGrad; None without labelled words."""
    langs = sorted(set(labels))
    if not langs:
        return None
    model = Chain(langs)
    known: dict[str, int] = {}
    flat: list[int] = []
    bounds = [0]
    docs = []
    for text, label in zip(texts, labels, strict=True):
        ids = []
        for w in text.split():
            i = known.get(w)
            if i is None:
                s = stem(w)
                i = known.get(s) if s else -1
                if i is None:
                    i = known[s] = len(bounds) - 1
                    flat += features(s)
                    bounds.append(len(flat))
                known[w] = i
            if i >= 0:
                ids.append(i)
        if ids:
            docs.append((np.array(ids), langs.index(label)))
    flat_a, bounds_a = np.array(flat, np.int64), np.array(bounds, np.int64)
    n = len(langs)
    sq_w, sq_m = np.full((BUCKETS, n), 1e-6, np.float32), np.full((n, n), 1e-6)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for i in range(0, len(order), batch):
            part = [docs[j] for j in order[i : i + batch]]
            ids = np.concatenate([d for d, _ in part])
            size = np.array([len(d) for d, _ in part])
            own, inverse = np.unique(ids, return_inverse=True)
            spans = [flat_a[bounds_a[w] : bounds_a[w + 1]] for w in own.tolist()]
            feats, of = np.concatenate(spans), np.repeat(np.arange(len(own)), [len(s) for s in spans])
            score = np.zeros((len(own), n))
            for lab in range(n):
                score[:, lab] = np.bincount(of, model.weights[feats, lab], len(own))
            m, first = model.marginals(score[inverse].astype(np.float32), size)
            y = np.repeat([lab for _, lab in part], size)
            m = -m
            m[np.arange(len(y)), y] += 1
            # Each document counts alike, whatever its length.
            m /= np.repeat(size, size)[:, None]
            g_words = np.stack([np.bincount(inverse, m[:, lab], len(own)) for lab in range(n)], 1)
            at, back = np.unique(feats, return_inverse=True)
            g = np.stack([np.bincount(back, g_words[of, lab], len(at)) for lab in range(n)], 1)
            sq_w[at] += g * g
            model.weights[at] += rate * g / np.sqrt(sq_w[at])
            pairs = -model.pair_counts()
            pairs[np.arange(n), np.arange(n)] += np.bincount([lab for _, lab in part], size - 1, n)
            pairs /= max(1, len(ids))
            sq_m += pairs * pairs
            model.moves += (rate * pairs / np.sqrt(sq_m)).astype(np.float32)
            model.moves = np.clip(model.moves, -4, 4)  # neighbours sway a word, they never overrule clear ones
    return model


class Predictor:
    limit = 300_000

    def __init__(self, model: Chain):
        self.model, self.rows, self.at = model, {}, {}
        self.scores = np.zeros((0, len(model.langs)), np.float32)

    def learn(self, new: list[str]) -> None:
        stems = list(map(stem, new))
        some = list(set(stems) - self.rows.keys() - {""})
        if some:
            lists = list(map(features, some))
            feats = np.fromiter(chain.from_iterable(lists), np.int64)
            starts = np.cumsum([0, *map(len, lists[:-1])])
            got = np.add.reduceat(self.model.weights[feats], starts, axis=0)
            self.rows.update(zip(some, range(len(self.scores), len(self.scores) + len(some)), strict=True))
            self.scores = np.concatenate([self.scores, got])
        self.rows[""] = -1
        self.at.update(zip(new, map(self.rows.__getitem__, stems), strict=True))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        split = [(t or "").split() for t in texts]
        new = set().union(*split) - self.at.keys()
        if len(self.at) + len(new) > self.limit:
            self.at, self.rows, self.scores = {}, {}, self.scores[:0]
            new = set().union(*split)
        if new:
            self.learn(list(new))
        ids = [np.array([i for i in map(self.at.__getitem__, ws) if i >= 0], np.int64) for ws in split]
        size = np.array([len(x) for x in ids])
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        some = np.flatnonzero(size)
        if len(some):
            m, first = self.model.marginals(self.scores[np.concatenate([ids[i] for i in some])], size[some])
            mean = np.add.reduceat(m, first, axis=0) / size[some][:, None]
            for i, row in zip(some.tolist(), mean, strict=True):
                k = int(row.argmax())
                lang[i], score[i] = self.model.langs[k], float(min(1.0, row[k]))
        return lang, score


def train(docs: DataFrame, train_docs: int = 2000, train_chars: int = 8000, fold: int = 3, skip: int = 1) -> Chain | None:
    """Fits on the bounded sample (see the module); fold and skip name the held-out documents, skip None holds out none."""
    ids = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    some = pick(docs, "doc_id", "text", "lang").where("lang is not null and text is not null").where(F.length("text") <= train_chars)
    if skip is not None:
        some = some.where(F.crc32(ids) % fold != skip)
    some = some.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("h"))
    # Hashes first: eight bytes a row for train_docs rows a task reach the driver, then only the chosen texts.
    last = some.select("h").orderBy("h").limit(train_docs).agg(F.max("h")).first()[0]
    # Rows that tie at the last hash (repeated rows, perhaps with another language) are taken in order of their values.
    rows = [] if last is None else some.where(F.col("h") <= last).orderBy("h", "text", "lang").limit(train_docs).collect()
    rows.sort(key=lambda r: (r.h, r.text, r.lang))
    return fit([r.text for r in rows], [r.lang for r in rows])


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@operator
def identify(docs: DataFrame, model: Chain | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` with lang_pred and score.

    A null text, and one without a letter, is `und` with score 0; so is every text where no labelled word was there to
    learn from. Rows stay as they are, null or repeated ids included.
    """
    names = [*keep, "lang_pred", "score"]

    def task(batches):
        predictor = model and Predictor(model)
        for b in blocks(batches):
            texts = b.column(b.num_columns - 1).to_pylist()
            if predictor is None:
                lang, score = ["und"] * len(texts), [0.0] * len(texts)
            else:
                lang, score = predictor.predict(texts)
                # Letters that stand only within marks still make a text one with letters.
                for i, (one, t) in enumerate(zip(lang, texts, strict=True)):
                    if one == "und" and _has_letter(t):
                        lang[i], score[i] = predictor.model.langs[0], 1.0 / len(predictor.model.langs)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=names)

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*keep, F.col("text").cast("string").alias("_text")).mapInArrow(task, schema)
