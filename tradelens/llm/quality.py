"""Quality rules and n-gram perplexity bands.

A model of characters with modified Kneser-Ney smoothing for each language: Spark counts every n-gram of five
characters (as they are, of any script, case and marks included) of all texts, from there the different characters
before each shorter n-gram, the discounts and the contexts' totals, so no step holds a language's n-grams in one place.

An n-gram has (count - discount) / total, and the shorter n-gram's probability by its context's weight, which is 1 less
the context's sum of these. From three characters up, n-grams counted less than `least` times are left out: a text is
among those that were counted, and what it alone holds must not speak for it. What is left out falls to the context's
weight, which grows by its share, so that probabilities still sum to one.

Every text scored was counted, so joins from order to order tell the log-probability of each n-gram there is. Those of the
`most` frequent travel with the scoring tasks, as a sorted hash array (a bound on what is broadcast); a document's other
n-grams meet theirs in a join, whatever their number, so scores do not depend on `most`.

A document's log-perplexity is held against its language's band: quartiles of all its documents that pass the rules,
widened by `reach` times their distance, more for texts shorter than `usual` characters, whose mean varies more. Both
ends reject: above are scrambled words, other languages and scripts, noise; below are texts that say one thing again
and again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHash, blocks, mix64, operator, pick, saved

ORDER = 5
_PAD = "\n" * (ORDER - 1)
_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_ODD = np.random.default_rng(77).integers(0, 2**63, ORDER, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: No discount is below it, so that what was never seen keeps a share.
LEAST = 0.05
#: Log-probabilities are whole multiples of it, so that they add up to the same in any order, and as 32-bit floats.
GRAIN = 2.0**-19
#: Bits of the slots by which equal values of a block find each other.
SLOTS = 20
#: Different n-grams that a counting task holds before it passes them on.
HELD = 400_000


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)


def joined(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts one after another, each padded before and ended by a line end; the places of their characters (ends
    included) and, among these, where each text starts."""
    size = np.array([len(t) + ORDER for t in texts], np.int64)
    starts = np.cumsum(size) - size
    real = np.ones(int(size.sum()), bool)
    for j in range(ORDER - 1):
        real[starts + j] = False
    return "".join(f"{_PAD}{t}\n" for t in texts), np.flatnonzero(real), starts - np.arange(len(texts)) * (ORDER - 1)


def sums(points: np.ndarray, k: int) -> np.ndarray:
    """Of the k characters that end at each place."""
    out = np.zeros(len(points), np.uint64)
    for j in range(k):
        out[j:] += points[: len(points) - j] * _ODD[j]
    return out


def lang_key(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")))


def hashed(total: np.ndarray, lang: np.uint64, kind: int) -> np.ndarray:
    """kind: the n-gram's order, or minus the order whose context it is."""
    with np.errstate(over="ignore"):
        return mix64(total + lang + _STEP * np.uint64(kind % 64))


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A place of each different value, their counts, and each place's number among them.

    Values take slots by their first bits; those that find another value in their slot are few and get sorted.
    """
    slot = (h >> np.uint64(64 - SLOTS)).astype(np.int32)
    own = np.zeros(1 << SLOTS, np.uint64)
    own[slot] = h
    plain = own[slot] == h
    at = np.flatnonzero(plain)
    taken = slot[at]
    count = np.bincount(taken, minlength=1 << SLOTS)
    used = np.flatnonzero(count)
    where, number = np.zeros(1 << SLOTS, np.int64), np.zeros(1 << SLOTS, np.int32)
    where[taken], number[used] = at, np.arange(len(used), dtype=np.int32)
    inverse = np.empty(len(h), np.int32)
    inverse[at] = number[taken]
    rest = np.flatnonzero(~plain)
    if not len(rest):
        return where[used], count[used], inverse
    _, first, others, n = np.unique(h[rest], return_index=True, return_inverse=True, return_counts=True)
    inverse[rest] = others + len(used)
    return np.concatenate([where[used], rest[first]]), np.concatenate([count[used], n]), inverse


def by_language(batch: pa.RecordBatch, lang: int, text: int):
    """(language, row numbers, texts) of a batch; a null text is empty."""
    langs, texts = batch.column(lang).to_pylist(), batch.column(text).to_pylist()
    rows: dict[str, list[int]] = {}
    for i, one in enumerate(langs):
        rows.setdefault(one, []).append(i)
    for one, at in rows.items():
        yield one, at, [texts[i] or "" for i in at]


def count_ngrams(src: DataFrame) -> DataFrame:
    """lang, g, n of every n-gram of ORDER characters of src (lang, text)."""
    schema = pa.schema([("lang", pa.string()), ("g", pa.string()), ("n", pa.int64())])

    def task(batches):
        held: dict[str, dict[str, int]] = {}

        def rows():
            for lang, own in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array(list(own)), pa.array(list(own.values()), pa.int64())], schema=schema)
            held.clear()

        for b in blocks(batches):
            for lang, _, texts in by_language(b, 0, 1):
                text, real, _ = joined(texts)
                at, n, _ = distinct(sums(code_points(text), ORDER)[real])
                own = held.setdefault(lang, {})
                get = own.get
                for i, c in zip((real[at] + 1).tolist(), n.tolist(), strict=True):
                    g = text[i - ORDER : i]
                    own[g] = get(g, 0) + c
            if sum(map(len, held.values())) > HELD:
                yield from rows()
        yield from rows()

    return src.select("lang", "text").mapInArrow(task, "lang string, g string, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))


def levels(grams: DataFrame) -> DataFrame:
    """lang, k, g, n of every order: a shorter n-gram counts the different characters before it."""
    level = grams.select("lang", F.lit(ORDER).alias("k"), "g", "n")
    out = level
    for k in range(ORDER - 1, 0, -1):
        level = level.groupBy("lang", F.lit(k).alias("k"), F.substring("g", 2, k).alias("g")).agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(level)
    return out


def discounts(every: DataFrame) -> DataFrame:
    """lang, k, d: what is taken off counts of 1, 2, and 3 or more; plain values where counts are too few to tell."""
    have = every.groupBy("lang", "k").agg(*(F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5)))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    told = [F.greatest(F.lit(LEAST), F.least(F.lit(i - 0.01), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"))) for i in (1, 2, 3)]
    few = F.least("n1", "n2", "n3", "n4") == 0
    return have.select("lang", "k", F.when(few, F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9))).otherwise(F.array(*told)).alias("d"))


def frequent(every: DataFrame, most: int) -> DataFrame:
    """Of each order the n-grams above a count, as many as `most` allows; counts are cut to 16 steps a doubling, so the
    driver sees a thousand rows an order at most, and n-grams of (almost) one count all are in or all out."""
    step = F.floor(F.log2("n") * 16)
    seen: dict[int, dict[int, int]] = {}
    for r in every.groupBy("k", step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect():
        seen.setdefault(r.k, {})[r.s] = r.n
    keep = F.lit(True)
    for k, sizes in seen.items():
        least, total = None, 0
        for s in sorted(sizes, reverse=True):
            total += sizes[s]
            if total > most:
                break
            least = s
        if total > most:
            keep &= (F.col("k") != k) | (F.lit(False) if least is None else step >= least)
    return every.where(keep)


def weighted(every: DataFrame, least: int) -> DataFrame:
    """every with its n-grams' contexts and values (0 of what `least` leaves out) and the contexts' weights (rest)."""
    context = Window.partitionBy("lang", "k", "context")
    d = F.get("d", F.least("n", F.lit(3)).cast("int") - 1)
    alpha = F.when(F.expr(f"k <= 2 or n >= {least}"), (F.col("n") - d) / F.sum("n").over(context)).otherwise(0.0)
    out = every.join(F.broadcast(discounts(every)), ["lang", "k"]).withColumn("context", F.expr("substring(g, 1, k - 1)")).withColumn("value", alpha)
    return out.withColumn("rest", 1 - F.sum("value").over(context)).select("lang", "k", "context", "g", "n", "value", "rest")


def uniform(every: DataFrame) -> DataFrame:
    """lang, p: the share of each of a language's characters, and of one more that was never seen."""
    return every.where("k = 1").groupBy("lang").agg((1 / (F.count(F.lit(1)) + 1)).alias("p"))


def probabilities(src: DataFrame, least: int) -> DataFrame:
    """lang, k, g, n, log_p of every n-gram of ORDER characters of src: the last one's natural log-probability."""
    every = saved(levels(saved(count_ngrams(src), "grams")), "levels")
    orders = saved(weighted(every, least), "weighted", by="k")
    p = F.col("value") + F.col("rest") * F.col("p")
    told = orders.where("k = 1").join(F.broadcast(uniform(every)), "lang").select("lang", "g", p.alias("p"))
    for k in range(2, ORDER + 1):
        shorter = told.select("lang", F.col("g").alias("shorter"), "p")
        told = orders.where(f"k = {k}").withColumn("shorter", F.expr("substring(g, 2)")).join(shorter, ["lang", "shorter"]).select("lang", "g", "n", p.alias("p"))
    # What was left of a context's sum by rounding may be a hair below nothing.
    log_p = F.rint(F.log(F.greatest("p", F.lit(1e-12))) / GRAIN) * GRAIN
    return saved(told.select("lang", F.lit(ORDER).alias("k"), "g", "n", log_p.alias("log_p")), "log_p")


def entries(src: DataFrame, most: int, least: int) -> DataFrame:
    """lang, kind, g, value: n-grams (kind: order), contexts (minus the order) and the uniform share (0) of a model that
    scores texts which src doesn't hold. Of each order it has the `most` frequent; quality() has no use for it."""
    every = saved(levels(saved(count_ngrams(src), "grams")), "levels")
    kept = saved(frequent(weighted(every, least).where("value > 0"), most), "alpha")
    own = kept.select("lang", F.col("k").alias("kind"), "g", "value")
    rest = kept.groupBy("lang", "k", "context").agg((1 - F.sum("value")).alias("value")).select("lang", (-F.col("k")).alias("kind"), F.col("context").alias("g"), "value")
    return own.unionByName(rest).unionByName(uniform(every).select("lang", F.lit(0).alias("kind"), F.lit("").alias("g"), F.col("p").alias("value")))


class KneserNey:
    """Sorted hash arrays by kind (see entries), of all languages; with log-probabilities of n-grams of ORDER characters
    alone (see probabilities), what the scoring tasks carry."""

    def __init__(self, kinds: np.ndarray, hashes: np.ndarray, values: np.ndarray):
        self.arrays = {}
        for kind in range(-ORDER, ORDER + 1):
            own = kinds == kind
            order = np.argsort(hashes[own])
            self.arrays[kind] = hashes[own][order], values[own][order].astype(np.float32)

    @classmethod
    def of(cls, rows: DataFrame) -> KneserNey:
        """Hashes the entries in tasks; the driver gets 13 bytes an entry."""

        def task(batches):
            for b in batches:
                kinds, out = b.column(1).to_numpy(), np.empty(b.num_rows, np.uint64)
                langs, grams = b.column(0).to_pylist(), b.column(2).to_pylist()
                keys = {x: lang_key(x) for x in set(langs)}
                own = np.array([keys[x] for x in langs], np.uint64)
                length = np.array([len(g) for g in grams])
                for n in np.unique(length).tolist():
                    at = np.flatnonzero(length == n)
                    points = code_points("".join(grams[i] for i in at)).reshape(len(at), n)
                    total = np.zeros(len(at), np.uint64)
                    for j in range(n):
                        total += points[:, n - 1 - j] * _ODD[j]
                    out[at] = mix64(total + own[at] + _STEP * (kinds[at] % 64).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int8)), pa.array(out.view(np.int64)), b.column(3).cast(pa.float32())], names=["kind", "h", "value"])

        t = rows.select("lang", "kind", "g", "value").mapInArrow(task, "kind byte, h long, value float").toArrow()
        return cls(t["kind"].to_numpy(), t["h"].to_numpy().view(np.uint64), t["value"].to_numpy())

    def look(self, kind: int, h: np.ndarray, missing: float) -> np.ndarray:
        keys, values = self.arrays[kind]
        if not len(keys):
            return np.full(len(h), missing)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, values[at], np.float32(missing)).astype(np.float64)

    def log_prob(self, lang: str, texts: list[str]) -> np.ndarray:
        """The mean natural log-probability of each text's characters, its end included."""
        key = lang_key(lang)
        text, real, starts = joined(texts)
        points = code_points(text)
        total = [sums(points, k) for k in range(ORDER + 1)]
        first, _, inverse = distinct(total[ORDER][real])
        at = real[first]
        p = self.look(0, hashed(np.zeros(1, np.uint64), key, 0), 1.0)[0]
        for k in range(1, ORDER + 1):
            p = self.look(k, hashed(total[k][at], key, k), 0.0) + self.look(-k, hashed(total[k - 1][at - 1], key, -k), 1.0) * p
        # What was left of a context's sum by rounding may be a hair below nothing.
        log_p = np.log(np.maximum(p, 1e-12))
        return np.add.reduceat(log_p[inverse], starts) / np.diff(np.append(starts, len(real)))


def rules(text: str | None, hashes: WordHash) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    ws = raw.split()
    chars = len(text) - (len(raw) - len(raw.translate(None, _SPACE)))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeat = 0
    if len(ws) > 5:
        h = hashes.of(ws)
        n = len(h) - 4
        w = mix64(h[:n])
        for j in range(1, 5):
            w = mix64(w + h[j : j + n])
        _, inverse, counts = np.unique(w, return_inverse=True, return_counts=True)
        twice = counts[inverse] > 1
        if twice.any():
            edge = np.zeros(len(h) + 1, np.int32)
            at = np.flatnonzero(twice)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + 5, -1)
            repeat = int((np.cumsum(edge) > 0).sum())
    return len(ws), chars, symbols, len(lines) - len(set(lines)), repeat


_hashes = WordHash()
_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def split(known: KneserNey, lang: str, texts: list[str]):
    """Each text's sum of the log-probabilities that are known, its characters (the end included), and of the n-grams that
    are not known: text, n-gram, times."""
    text, real, starts = joined(texts)
    total = sums(code_points(text), ORDER)[real]
    first, _, inverse = distinct(total)
    log_p = known.look(ORDER, hashed(total[first], lang_key(lang), ORDER), np.nan)
    rare = np.isnan(log_p)
    log_p[rare] = 0
    place = np.flatnonzero(rare[inverse])
    key, times = np.unique((np.searchsorted(starts, place, "right") - 1) * len(first) + inverse[place], return_counts=True)
    grams = [text[i - ORDER : i] for i in (real[first[key % len(first)]] + 1).tolist()]
    return np.add.reduceat(log_p[inverse], starts), np.diff(np.append(starts, len(real))), key // len(first), grams, times


def measured(src: DataFrame, known: KneserNey) -> DataFrame:
    """Of src (row, doc_id, lang, text) the documents, with the rules' counts, the characters (size) and the sum of their
    known log-probabilities, and the rare n-grams of each (kind tells; columns of the other are null)."""
    ddl = f"kind string, row long, doc_id long, lang string, {_STATS}, size long, known double, g string, times long"
    types = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
    schema = pa.schema([(name, types[kind]) for name, kind in (x.split() for x in ddl.split(", "))])

    def batch(rows, **got):
        return pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) if f.name in got else pa.nulls(rows, f.type) for f in schema], schema=schema)

    def task(batches):
        for b in blocks(batches):
            total, size = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
            ids = b.column(0).to_numpy()
            for lang, at, texts in by_language(b, 2, 3):
                total[at], size[at], doc, grams, times = split(known, lang, texts)
                yield batch(len(grams), kind=["rare"] * len(grams), row=ids[at][doc], lang=[lang] * len(grams), g=grams, times=times)
            stats = zip(*(rules(t, _hashes) for t in b.column(3).to_pylist()), strict=True)
            counts = dict(zip((x.split()[0] for x in _STATS.split(", ")), stats, strict=True))
            yield batch(b.num_rows, kind=["document"] * b.num_rows, row=ids, doc_id=b.column(1), lang=b.column(2), size=size, known=total, **counts)

    return src.mapInArrow(task, ddl)


@operator
def quality(docs: DataFrame, reach: float = 3.0, usual: int = 1000, most: int = 400_000, least: int = 2) -> DataFrame:
    """One row a document: rules' counts, log_ppl, its language's band (low, high), base_failed, kept.

    Null texts are empty, a null lang is a language of its own (the empty one), null doc_ids and repeated rows stay as
    they are, an empty table gives no rows, other columns play no part. Documents that fail the rules don't shape the
    bands, but their n-grams count.
    """
    src = pick(docs, "doc_id", "lang", "text").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"))
    log_p = probabilities(src, least)
    known = KneserNey.of(frequent(log_p, most).select("lang", F.col("k").alias("kind"), "g", F.col("log_p").alias("value")))
    base = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    parts = saved(measured(src, known), "measured", by="kind")
    pairs = parts.where("kind = 'rare'").select("row", "lang", "g", "times").join(log_p, ["lang", "g"])
    rare = pairs.groupBy("row").agg(F.sum(F.col("times") * F.col("log_p")).alias("rare"))
    ppl = -(F.col("known") + F.coalesce("rare", F.lit(0.0))) / F.col("size")
    names = ["doc_id", "lang", *(x.split()[0] for x in _STATS.split(", "))]
    scored = parts.where("kind = 'document'").join(rare, "row", "left").select(*names, ppl.alias("log_ppl"))
    seen = saved(scored.withColumn("base_failed", base), "quality")
    q = F.percentile_approx("log_ppl", F.array(F.lit(0.25), F.lit(0.75)), F.lit(10_000))
    bands = saved(seen.where("not base_failed").groupBy("lang").agg(q.alias("q")), "bands")
    wide = (F.col("q")[1] - F.col("q")[0]) * reach * F.sqrt(F.greatest(F.lit(1.0), F.lit(float(usual)) / (F.col("word_chars") + F.col("n_words") + 1)))
    out = seen.join(bands, "lang", "left").withColumn("low", F.col("q")[0] - wide).withColumn("high", F.col("q")[1] + wide).drop("q")
    return out.withColumn("kept", ~F.col("base_failed") & F.col("log_ppl").between(F.col("low"), F.col("high")))
