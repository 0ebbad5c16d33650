"""Drops lines that many documents hold, all but those in one document.

Lines' hashes are dealt by ranges of (hash, doc_id descending) and sorted so within a range; a task streams its range
and decides at the fifth document of a hash, so it holds a few rows. A hash that more ranges than one share (a hot
line is spread over as many as it needs) is open at a range's ends: the task writes those rows as open, with a summary
of each end, and the summaries (two a range) settle them. What comes back for a document is a compressed bitmap of
the lines to keep; no text travels.
"""

from __future__ import annotations

import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, NO_ID, blocks, id_text, operator, place, row_key, saved, shielded, text_key

_WHITE = " \t\n\x0b\x0c\r"
_LINES = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("down", pa.int64()), ("row", pa.int64()), ("at", pa.binary())])
_OUT = pa.schema([("part", pa.int64()), ("kind", pa.string()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("at", pa.binary()), ("docs", pa.int64())])


def line_key(line: str) -> str:
    return line.strip(_WHITE).encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")


def keys(text: str | None, least: int) -> dict[bytes, list[int]]:
    """The text's keys of at least so many code points, hashed to 128 bits, with their line numbers."""
    out: dict[bytes, list[int]] = {}
    for i, line in enumerate((text or "").split("\n")):
        if len(line) >= least and len(line := line.strip(_WHITE)) >= least:
            out.setdefault(xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass").translate(_LOWER)), []).append(i)
    return out


def hashed_lines(docs: DataFrame, least: int) -> DataFrame:
    def task(batches):
        for b in blocks(batches):
            digests, down, row, at = [], [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if found := keys(text, least):
                    k = text_key(text)
                    digests += found
                    down += [~doc_id] * len(found)
                    row += [k] * len(found)
                    at += [np.array(x, "<u4").tobytes() for x in found.values()]
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(down, pa.int64()), pa.array(row, pa.int64()), pa.array(at, pa.binary())], schema=_LINES)

    return docs.mapInArrow(task, "h1 long, h2 long, down long, row long, at binary")


def _stream(least_docs: int):
    """Reads sorted (h1, h2, ~doc_id) and yields dropped rows, open rows and the summaries of a range's two ends."""

    def task(batches):
        part = TaskContext.get().partitionId()
        # The group in hand: its hash, documents so far, the first and the last document, undecided rows, and
        # whether it began the range (and so may go on from the range before).
        group, docs, top, last, held, first = None, 0, None, None, [], True
        out: list[tuple] = []

        def end(closing: bool) -> None:
            if group is None:
                return
            if first or closing:
                out.extend((part, "open", *group, ~d, r, a, 0) for d, r, a in held)
                out.append((part, "first" if first else "last", *group, ~top, 0, b"", docs))
            held.clear()

        def batch():
            nonlocal out
            got = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _OUT, strict=True)], schema=_OUT)
            out = []
            return got

        for b in batches:
            h1, h2, down, row = (b.column(i).to_numpy() for i in range(4))
            n, at = len(h1), b.column(4)
            if not n:
                continue
            new = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
            bounds = [0, *new.tolist(), n]
            for i, j in pairwise(bounds):
                own = (int(h1[i]), int(h2[i]))
                if own != group:
                    end(False)
                    first = group is None
                    group, docs, top, last = own, 0, int(down[i]), None
                if j - i == 1 and j < n and docs == 0 and not first:  # a hash of one row is whole
                    last, docs = top, 1
                    continue
                for x in range(i, j):
                    d = int(down[x])
                    docs += d != last
                    last = d
                    if first:
                        out.append((part, "open", *own, ~d, int(row[x]), at[x].as_py(), 0))
                    elif docs < least_docs:
                        held.append((d, int(row[x]), at[x].as_py()))
                    else:
                        for d0, r0, a0 in held:
                            if d0 != top:
                                out.append((part, "drop", *own, ~d0, r0, a0, 0))
                        held.clear()
                        if d != top:
                            out.append((part, "drop", *own, ~d, int(row[x]), at[x].as_py(), 0))
                    if len(out) >= 20_000:
                        yield batch()
        end(True)
        if out:
            yield batch()

    return task


def settle_ends(ends: list[tuple]) -> dict[tuple[int, int], tuple[int, int]]:
    """Documents and largest doc_id of each hash that begins or ends a range; ends: (h1, h2, its largest doc_id and its documents in a range)."""
    out: dict[tuple[int, int], tuple[int, int]] = {}
    for h1, h2, top, docs in ends:
        n, most = out.get((h1, h2), (0, NO_ID))
        out[h1, h2] = (n + docs, max(most, top))
    return out


def dropped_lines(docs: DataFrame, least: int, least_docs: int) -> DataFrame:
    """doc_id, row, at: the line numbers (little-endian unsigned 32-bit) that go."""
    lines = hashed_lines(docs, least)
    # Rows of one document that repeat a doc_id sort together, and no document straddles two ranges.
    sorted_ = lines.repartitionByRange("h1", "h2", "down").sortWithinPartitions("h1", "h2", "down", "row")
    streamed = saved(sorted_.mapInArrow(_stream(least_docs), "part long, kind string, h1 long, h2 long, doc_id long, row long, at binary, docs long"), "line-stream")
    ends = settle_ends([tuple(r) for r in streamed.where("kind in ('first', 'last')").select("h1", "h2", "doc_id", "docs").collect()])
    rules = {k: top for k, (n, top) in ends.items() if n >= least_docs}

    def opened(batches):
        for b in batches:
            h1, h2, d = (b.column(i).to_pylist() for i in range(3))
            go = [rules.get((x, y), doc) != doc for x, y, doc in zip(h1, h2, d, strict=True)]
            yield b.filter(pa.array(go, pa.bool_())).select([2, 3, 4])

    settled = streamed.where("kind = 'open'").select("h1", "h2", "doc_id", "row", "at").mapInArrow(opened, "doc_id long, row long, at binary")
    return streamed.where("kind = 'drop'").select("doc_id", "row", "at").unionAll(settled)


@operator
def keep_bitmaps(docs: DataFrame, least: int = 40, least_docs: int = 5) -> DataFrame:
    """doc_id, row, dropped, bitmap of every document that loses lines.

    bitmap: zlib over bits, highest first, up to the last dropped line; 1 keeps, and lines beyond it stay.
    A null doc_id counts as a document with an id below all others. Rows that repeat a doc_id count as one document
    (row tells them apart by their text).
    """

    def bitmap(batches):
        for b in batches:
            counts, maps = [], []
            for ats in b.column(2).to_pylist():
                at = np.unique(np.frombuffer(b"".join(ats), "<u4"))
                bits = np.ones(int(at[-1]) + 1, np.uint8)
                bits[at] = 0
                counts.append(len(at))
                maps.append(zlib.compress(np.packbits(bits).tobytes() + (-len(bits) % 8).to_bytes(1, "little")))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(maps, pa.binary())], names=["doc_id", "row", "dropped", "bitmap"])

    grouped = dropped_lines(id_text(docs), least, least_docs).groupBy("doc_id", "row").agg(F.collect_list("at").alias("ats"))
    return grouped.mapInArrow(bitmap, "doc_id long, row long, dropped long, bitmap binary")


def kept_lines(text: str | None, bitmap: bytes | None) -> list[str]:
    lines = (text or "").split("\n")
    if bitmap is None:
        return lines
    raw = zlib.decompress(bitmap)
    bits = np.unpackbits(np.frombuffer(raw[:-1], np.uint8))
    bits = bits[: len(bits) - raw[-1]].tolist()
    return [x for x, keep in zip(lines, bits, strict=False) if keep] + lines[len(bits) :]


def with_bitmaps(docs: DataFrame, least: int = 40, least_docs: int = 5) -> DataFrame:
    """docs with one more column, `keep_bitmap` (null: all lines stay), last; a column of this name that docs has stays.

    Columns of docs may have any names, also twice.
    """
    maps = keep_bitmaps(docs, least, least_docs).select("doc_id", "row", "bitmap")

    # Documents that lose lines are few rows of (id, key, bitmap); texts meet them in one equi-join.
    own = shielded(docs)
    ids = F.coalesce(F.col(place(docs, "doc_id")).cast("long"), F.lit(NO_ID)) == F.col("doc_id")
    return own.join(maps, ids & (row_key(place(docs, "text")) == F.col("row")), "left").drop("doc_id", "row").toDF(*docs.columns, "keep_bitmap")
