"""Personal data by patterns, and words that give protected values away, by corpus co-occurrence.

Patterns find e-mail addresses, IP addresses, card and phone numbers. For every value found, the words around it
(`window` words on either side in its line, whole ones within 40 characters a word) are its context. Over the whole
corpus, with T lines, n(e) of them with the value, n(t) with the word and n(t, e) with the word in the value's context,

    IC(e) = log(T / n(e)),  PMI(t; e) = log(n(t, e) T / (n(t) n(e))),  disclosure = PMI / IC

says which part of the value's information the word gives away; a value that stands in every line has none to give
(disclosure 0). Words of at least `support` different contexts and a disclosure of `generalise_at` (for any value) are
spans of kind `term` wherever they stand, also in lines and documents without the value; at `remove_at` they are
removed, below it generalised.

All searches take time in proportion to the text, whatever it holds: an e-mail address is looked for once an @, an
address of numbers once a run of digits, and words meet spans by bisection.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, NO_ID, blocks, coded_words, id_or_none, id_text, operator, place, row_key, saved, shielded, text_key

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that doesn't begin a match holds none, so runs are tried from their first digit alone.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_WHITE = " \t\n\x0b\x0c\r"
_GAP = re.compile(r"[\x20\x09-\x0D]")
_EDGES = ".,;:!?()[]{}\"'|#*$%&<>="
#: Bits of the filter that tells the counting pass which words matter; fixed, so it never grows with the corpus.
FILTER_BITS = 1 << 23


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0




def emails(text: str) -> list[tuple[int, int]]:
    """Each @ with the characters that may stand before it, from the match before on, and the domain after it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        first = done + len(text[done:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if first < at else None
        if m:
            out.append((first, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of pattern matches that pass, by start and kind."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in _IP.finditer(text) if "." in text else ():
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def term_of(word: str) -> tuple[str, int]:
    """The word without marks at its ends, A-Z lower-cased, and how many marks came before; empty without a letter."""
    w = word.lstrip(_EDGES)
    lead = len(word) - len(w)
    w = w.rstrip(_EDGES)
    if not any(c.isalpha() for c in w):
        return "", lead
    return w.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass"), lead


class Cover:
    """What the spans cover, as intervals apart from each other: whether one of them meets a stretch, by bisection."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.first, self.end = [], []
        for a, _, b in sorted(spans):
            if self.end and a <= self.end[-1]:
                self.end[-1] = max(self.end[-1], b)
            else:
                self.first.append(a)
                self.end.append(b)

    def meets(self, a: int, b: int) -> bool:
        i = bisect_right(self.end, a)
        return i < len(self.first) and self.first[i] < b


def whole_words(text: str, lo: int, hi: int, line: tuple[int, int]) -> tuple[int, int]:
    """lo and hi moved inwards to the borders of words where they cut one of the line's words."""
    if line[0] < lo < hi and text[lo - 1] not in _WHITE:
        m = _GAP.search(text, lo, hi)
        lo = m.start() if m else hi
    if lo < hi < line[1] and text[hi] not in _WHITE:
        hi = max(lo, *(text.rfind(c, lo, hi) for c in _WHITE))
    return lo, hi


def contexts(text: str, spans: list[tuple[int, int, int]], window: int) -> tuple[list[tuple], dict[str, int]]:
    """(value, context's hash, term, start, end, 1 where it is the term's first in a context of the value in its line) of
    the words around each span, within its line; and in how many lines each value is."""
    out, lines, told, cover = [], {}, set(), Cover(spans)
    ends = [m.start() for m in re.finditer("\n", text)]
    for a, kind, b in spans:
        entity = f"{KINDS[kind]}:{text[a:b].lower()}"
        at, after = bisect_left(ends, a), bisect_left(ends, b)
        lo = ends[at - 1] + 1 if at else 0
        line = (lo, ends[after] if after < len(ends) else len(text))
        lines.setdefault(entity, set()).add(lo)
        lo, _ = whole_words(text, max(lo, a - 40 * window), a, line)
        _, hi = whole_words(text, b, min(line[1], b + 40 * window), line)
        near = [m for m in _WORD.finditer(text, lo, a)][-window:] + [m for m in _WORD.finditer(text, b, hi)][:window]
        if not near:
            continue
        where = xxhash.xxh3_64_intdigest(text[near[0].start() : near[-1].end()].encode("utf-8", "surrogatepass")) - 2**63
        for m in near:
            if cover.meets(m.start(), m.end()):
                continue
            t, lead = term_of(m[0])
            if t:
                key = (entity, t, line[0])
                out.append((entity, where, t, m.start() + lead, m.start() + lead + len(t), int(key not in told)))
                told.add(key)
    return out, {e: len(x) for e, x in lines.items()}


_FOUND_DDL = "doc_id long, row long, lines long, counts array<long>, spans array<struct<a:int,k:int,b:int>>, near array<struct<e:string,w:long,t:string,a:int,b:int,f:int>>, held array<struct<e:string,n:long>>"


def found(src: DataFrame, window: int) -> DataFrame:
    spans_t = pa.list_(pa.struct([("a", pa.int32()), ("k", pa.int32()), ("b", pa.int32())]))
    near_t = pa.list_(pa.struct([("e", pa.string()), ("w", pa.int64()), ("t", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("f", pa.int32())]))
    held_t = pa.list_(pa.struct([("e", pa.string()), ("n", pa.int64())]))
    names = ["doc_id", "row", "lines", "counts", "spans", "near", "held"]

    def task(batches):
        for batch in blocks(batches):
            cols = [[] for _ in names]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = text or ""
                spans = base_spans(t)
                counts = [0] * 4
                for _, k, _ in spans:
                    counts[k] += 1
                near, held = contexts(t, spans, window) if spans else ([], {})
                row = (doc_id, text_key(text), t.count("\n") + 1, counts, [{"a": a, "k": k, "b": b} for a, k, b in spans], [dict(zip("ewtabf", x, strict=True)) for x in near], [{"e": e, "n": n} for e, n in held.items()])
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), spans_t, near_t, held_t)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return src.mapInArrow(task, _FOUND_DDL)


def _bits(terms: DataFrame) -> np.ndarray:
    """A bit for each term's hash: at most FILTER_BITS / 64 rows reach the driver, however many terms there are."""
    at = F.pmod(F.crc32(F.col("t").cast("binary")), F.lit(FILTER_BITS))
    rows = terms.select(at.alias("at")).groupBy(F.floor(F.col("at") / 64).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("v")).collect()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for r in rows:
        out[r.i] = r.v
    return out


def line_counts(src: DataFrame, terms: DataFrame) -> DataFrame:
    """t, n_t: in how many of all lines each term is."""
    import zlib

    bits = _bits(terms)

    def task(batches):
        wanted: dict[bytes, str] = {}
        total: dict[str, int] = {}

        def rows():
            got = pa.RecordBatch.from_pydict({"t": list(total), "n_t": list(total.values())}, schema=pa.schema([("t", pa.string()), ("n_t", pa.int64())]))
            total.clear()
            return got

        for batch in blocks(batches):
            for text in batch.column(0).to_pylist():
                for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
                    terms_here = set()
                    for w in line.split():  # of bytes: the white space of _WORD
                        t = wanted.get(w)
                        if t is None:
                            t = term_of(w.decode("utf-8", "surrogatepass"))[0]
                            if t:
                                h = zlib.crc32(t.encode("utf-8", "surrogatepass")) % FILTER_BITS
                                if not int(bits[h >> 6]) >> (h & 63) & 1:
                                    t = ""
                            if len(wanted) > 400_000:
                                wanted.clear()
                            wanted[w] = t
                        if t:
                            terms_here.add(t)
                    for t in terms_here:
                        total[t] = total.get(t, 0) + 1
            if len(total) > 300_000:
                yield rows()
        yield rows()

    counted = src.select("text").mapInArrow(task, "t string, n_t long").groupBy("t").agg(F.sum("n_t").alias("n_t"))
    return terms.join(counted, "t", "left").select("t", F.coalesce("n_t", F.lit(0)).alias("n_t"))


def disclosures(near: DataFrame, held: DataFrame, src: DataFrame, lines: int, support: int, least: float) -> DataFrame:
    """e, t, disclosure of the pairs at or above the threshold; near: e, w, t, f; held: e, n (see contexts)."""
    seen = near.groupBy("e", "t", "w").agg(F.sum("f").alias("n"))
    pairs = saved(seen.groupBy("e", "t").agg(F.count(F.lit(1)).alias("support"), F.sum("n").alias("n_te")).where(F.col("support") >= support), "pairs")
    values = held.groupBy("e").agg(F.sum("n").alias("n_e"))
    terms = saved(pairs.select("t").distinct(), "terms")
    n_t = saved(line_counts(src, terms), "term-lines")
    scored = pairs.join(n_t, "t").join(saved(values, "values"), "e")
    # A part of a word that a value cuts may be in no line as a word; it is in n_te at least.
    pmi = F.log(F.col("n_te") * F.lit(float(lines)) / (F.greatest("n_t", "n_te") * F.col("n_e")))
    content = F.log(F.lit(float(lines)) / F.col("n_e"))
    return scored.select("e", "t", F.when(content > 0, pmi / content).otherwise(0.0).alias("disclosure")).where(F.col("disclosure") >= least)


def occurrences(src: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, row, t, a, b of the words of whole texts that may be among the terms (a join tells), those that touch a pattern's value left out."""
    import zlib

    bits = _bits(terms)

    def task(batches):
        wanted: dict[bytes, str] = {}

        def maybe(w: bytes) -> str:
            t = wanted.get(w)
            if t is None:
                t = term_of(w.decode("utf-8", "surrogatepass"))[0]
                if t:
                    h = zlib.crc32(t.encode("utf-8", "surrogatepass")) % FILTER_BITS
                    if not int(bits[h >> 6]) >> (h & 63) & 1:
                        t = ""
                if len(wanted) > 400_000:
                    wanted.clear()
                wanted[w] = t
            return t

        for batch in blocks(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            own, at, offsets = coded_words(texts)
            told = [maybe(w) for w in own]
            hits = np.array([t != "" for t in told] or [False])[at]
            cols = [[] for _ in range(5)]
            for i in np.unique(np.searchsorted(offsets, np.flatnonzero(hits), "right") - 1).tolist():
                first, text = int(offsets[i]), texts[i]
                cover, key = Cover(base_spans(text)), text_key(text)
                for k, m in enumerate(_WORD.finditer(text), first):
                    if hits[k] and not cover.meets(m.start(), m.end()):
                        t, lead = told[at[k]], term_of(m[0])[1]
                        for c, v in zip(cols, (ids[i], key, t, m.start() + lead, m.start() + lead + len(t)), strict=True):
                            c.append(v)
            types = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "row", "t", "a", "b"])

    return src.mapInArrow(task, "doc_id long, row long, t string, a int, b int")


@operator
def find_pii(docs: DataFrame, window: int = 20, support: int = 3, generalise_at: float = 0.8) -> DataFrame:
    """doc_id, row, counts, spans (array of a, k, b) and terms (array of a, b, disclosure) of every row of docs.

    Null texts are empty; a null doc_id is NO_ID; rows that repeat a doc_id are told apart by text (row), and equal
    rows each come back. An empty table gives no rows. Other columns of docs, whatever their names, play no part.
    """
    src = id_text(docs)
    base = saved(found(src, window), "pii")
    near = base.where(F.size("near") > 0).select("doc_id", "row", F.explode("near").alias("x")).select("doc_id", "row", "x.*")
    held = base.where(F.size("held") > 0).select(F.explode("held").alias("x")).select("x.*")
    lines = base.agg(F.sum("lines")).first()[0] or 1
    told = saved(disclosures(near, held, src, lines, support, generalise_at), "disclosures")
    most = saved(told.groupBy("t").agg(F.max("disclosure").alias("disclosure")), "told-terms")
    # The words around values are in again: one that a value cuts is a term of its own.
    places = occurrences(src, most.select("t")).unionByName(near.select("doc_id", "row", "t", "a", "b"))
    terms = places.join(most, "t").groupBy("doc_id", "row", "a", "b").agg(F.max("disclosure").alias("d"))
    terms = terms.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("a", "b", "d"))).alias("terms"))
    return base.select("doc_id", "row", "counts", "spans").join(saved(terms, "term-spans"), ["doc_id", "row"], "left")


def span_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def pii_digest(docs: DataFrame, **options) -> DataFrame:
    """One row a document: counts of each kind, the digest of the pattern spans, and all spans as text."""

    def task(batches):
        for b in batches:
            counts = b.column("counts").to_pylist()
            base = [[(s["a"], s["k"], s["b"]) for s in x] for x in b.column("spans").to_pylist()]
            terms = [[(s["a"], 4, s["b"]) for s in x or ()] for x in b.column("terms").to_pylist()]
            sha = [hashlib.sha256(span_text(x).encode()).hexdigest() for x in base]
            both = [span_text(x + y) for x, y in zip(base, terms, strict=True)]
            n = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *n, pa.array(sha, pa.string()), pa.array(both, pa.string())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return find_pii(docs, **options).mapInArrow(task, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string").withColumn("doc_id", id_or_none())


def redact(text: str | None, spans: list[tuple[int, int, int]], terms: list[tuple[int, int, float]], remove_at: float = 0.95) -> str | None:
    """The text with values named by kind, and terms generalised to [TERM] or removed; where spans overlap, the first wins."""
    if text is None:
        return None
    marks = sorted([(a, b, f"[{KINDS[k].upper()}]") for a, k, b in spans] + [(a, b, "" if d >= remove_at else "[TERM]") for a, b, d in terms])
    out, at = [], 0
    for a, b, new in marks:
        if a >= at:
            out += [text[at:a], new]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame, remove_at: float = 0.95, **options) -> DataFrame:
    """docs with personal data and revealing terms replaced in `text`; rows and other columns stay, whatever their names."""
    plan = find_pii(docs, **options).where("size(spans) > 0 or terms is not null").select("doc_id", "row", "spans", "terms").dropDuplicates(["doc_id", "row"])

    @F.pandas_udf("string")
    def clean(text, spans, terms):
        import pandas as pd

        out = []
        for t, s, m in zip(text, spans, terms, strict=True):
            if s is None:
                out.append(t)
            else:
                out.append(redact(t, [(x["a"], x["k"], x["b"]) for x in s], [(x["a"], x["b"], x["d"]) for x in m] if m is not None else [], remove_at))
        return pd.Series(out, dtype=object)

    text = place(docs, "text")
    ids = F.coalesce(F.col(place(docs, "doc_id")).cast("long"), F.lit(NO_ID)) == F.col("doc_id")
    joined = shielded(docs).join(plan, ids & (row_key(text) == F.col("row")), "left")
    return joined.withColumn(text, clean(F.col(text).cast("string"), "spans", "terms")).drop("doc_id", "row", "spans", "terms").toDF(*docs.columns)
