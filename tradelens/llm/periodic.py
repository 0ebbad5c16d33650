"""Runs: stretches of words that repeat with a period, found by bit-parallel lags.

A text's word ids are held as bit planes, one big integer a bit of the id. For a lag, every plane is XORed with itself
shifted by that many words; the OR of these has a zero where words so far apart are identical. Zeros that go on for at
least `need` words are isolated by shift-doubling ANDs of the complement: after k steps a bit tells of 2^k zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, operator, pick

#: Words of the shortest run.
LEAST = 12


def word_list(text: str | bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ in UTF-8."""
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).split() if text else []


def bit_planes(ids: np.ndarray) -> list[int]:
    """Big integers; bit i of the k-th one is bit k of ids[i]."""
    width = max(1, int(ids.max()).bit_length())
    return [int.from_bytes(np.packbits((ids >> k) & 1 == 1, bitorder="little").tobytes(), "little") for k in range(width)]


def _stretches(bits: int) -> Iterator[tuple[int, int]]:
    """First and last place of each stretch of ones."""
    raw = np.unpackbits(np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8 + 1, "little"), np.uint8), bitorder="little")
    edges = np.flatnonzero(np.diff(raw.astype(np.int8), prepend=0))
    yield from zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True)


def lag_stretches(planes: list[int], n: int, lag: int, need: int) -> list[tuple[int, int]]:
    """(start, words) of each maximal stretch of `need` or more places i with word i = word i + lag."""
    places = (1 << (n - lag)) - 1
    differ = 0
    same = places
    for k, plane in enumerate(planes):
        differ |= plane ^ (plane >> lag)
        same = ~differ & places
        if k & 1 == 0 or k == len(planes) - 1:
            # A place must have its neighbour on one side; few do once some planes have been read.
            if not same or not (need == 1 or same & (same >> 1)):
                return []
    # shift-doubling: bit i of `same` tells that the places from i on, `reach` of them, agree.
    reach = 1
    while reach < need and same:
        step = min(reach, need - reach)
        same &= same >> step
        reach += step
    return [(a, z - a + need) for a, z in _stretches(same)] if same else []


def segment_runs(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ids."""
    n, found = len(ids), {}
    planes = bit_planes(ids)
    for lag in range(1, n // 2 + 1):
        for start, same in lag_stretches(planes, n, lag, max(least - lag, lag)):
            # With a smaller period the same stretch was found before.
            found.setdefault((start, same + lag), lag)
    return [(start, length, lag) for (start, length), lag in found.items()]


def runs(words: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period: a stretch of words with that smallest period, at least
    `least` words and two periods long, that no neighbouring word extends."""
    if len(words) < least:
        return []
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    # A run's words stand twice in it: words that stand once cut the text.
    once = np.bincount(ids)[ids] == 1
    edges = np.flatnonzero(np.diff(np.concatenate([[True], once, [True]]).astype(np.int8)))
    out = []
    for a, z in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if z - a >= least:
            own = np.unique(ids[a:z], return_inverse=True)[1]
            out += [(a + s, length, q) for s, length, q in segment_runs(own, least)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """Words without those that some run holds after its first period."""
    drop = np.zeros(len(words) + 1, np.int32)
    for start, length, q in found:
        drop[start + q] += 1
        drop[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(drop)[:-1].tolist(), strict=True) if not d]


@operator
def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed_text of every row of docs.

    Nulls in text are empty, other columns are left out whatever their names, repeated rows stay as many, an empty table
    has an empty result. Time grows with the square of a stretch of words of which each stands twice in its text, in
    units of machine words; memory with the text.
    """
    one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(one)), ("collapsed_text", pa.string())])

    def task(batches):
        for b in blocks(batches):
            n, all_, texts = [], [], []
            for text in b.column(1).cast(pa.large_binary()).to_pylist():
                words = word_list(text)
                found = runs(words, least)
                n.append(len(words))
                all_.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                texts.append(b" ".join(collapsed(words, found) if found else words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(all_, pa.list_(one)), pa.array(texts, pa.string())], schema=schema)

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(task, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed_text string")
