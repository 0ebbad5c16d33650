"""Token ids as binary files: frequency-ranked ids in byte-aligned variable-length coding.

A file holds blocks and, last, an index of documents. A block ranks the ids that it holds by how often they come, and
writes ranks: two bits a rank in separate control bytes say how many bytes (1 to 4) the rank takes in the data bytes,
so the 256 most frequent ids take one byte. Readers look control bytes up in a table and gather by numpy.

Documents are dealt by ranges of doc_id, so file after file holds ascending ids; a task streams its range block by
block, and a file gets its final name when it is whole, so a task may run twice.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import arrow_batches, blocks, id_or_none, id_text, operator, work_path
from .word_bpe import encoder

MAGIC = b"RVBF0001"
#: Ids in a block: bounds a task's memory.
BLOCK = 1 << 20
_WIDTHS = np.array([[(c >> 2 * j & 3) + 1 for j in range(4)] for c in range(256)], np.uint8)


def encode_block(ids: np.ndarray) -> bytes:
    """A block of ids (unsigned 32-bit); no ids make an empty block."""
    ids = ids.astype("<u4")
    if len(ids) and int(ids.max()) < 1 << 22:  # a vocabulary: count by direct address
        every = np.bincount(ids)
        used = np.flatnonzero(every).astype("<u4")
        counts, at = every[used], ids
    else:
        used, at, counts = np.unique(ids, return_inverse=True, return_counts=True)
        every = used
    order = np.lexsort((used, -counts))
    rank = np.empty(len(every), np.uint32)
    rank[used[order] if at is ids else order] = np.arange(len(used), dtype=np.uint32)
    ranks = rank[at]
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ids) // 4) * 4, np.uint8)
    padded[: len(ids)] = extra
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = raw[np.arange(4) <= extra[:, None]]
    return struct.pack("<III", len(ids), len(used), len(data)) + used[order].tobytes() + control.tobytes() + data.tobytes()


def decode_block(n: int, table: np.ndarray, control: np.ndarray, data: np.ndarray) -> np.ndarray:
    width = _WIDTHS[control].reshape(-1)[:n]
    at = np.cumsum(width, dtype=np.int64) - width
    ranks = data[at].astype(np.uint32)
    for j in (1, 2, 3):
        more = np.flatnonzero(width > j)
        if not len(more):
            break
        ranks[more] |= data[at[more] + j].astype(np.uint32) << np.uint32(8 * j)
    return table[ranks]


class Writer:
    """Takes documents in order; keeps one block in memory, and twelve bytes a document."""

    def __init__(self, out):
        self.out, self.parts, self.held, self.docs, self.total, self.nblocks = out, [], 0, [], 0, 0
        out.write(MAGIC)

    def add(self, doc_id: int, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 4))
        self.parts.append(ids)
        self.held += len(ids) // 4
        self.total += len(ids) // 4
        if self.held >= BLOCK:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.parts), "<u4")
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for i in range(0, whole, BLOCK):
            self.out.write(b"B" + encode_block(ids[i : min(i + BLOCK, whole)]))
        self.parts, self.held = [ids[whole:].tobytes()], len(ids) - whole

    def close(self) -> None:
        self.flush(True)
        index = np.array(self.docs, "<i8").reshape(-1, 2)
        self.out.write(b"I" + struct.pack("<Q", len(index)) + index.tobytes())


def read_file(stream) -> Iterator[tuple[int, int, np.ndarray]]:
    """(doc_id, start in the file, ids) of each document; the index is read first, then block after block."""
    assert stream.read(8) == MAGIC
    marks = []
    while (kind := stream.read(1)) == b"B":
        n, k, size = struct.unpack("<III", stream.read(12))
        marks.append((stream.tell(), n, k, size))
        stream.seek(4 * k + -(-n // 4) + size, 1)
    assert kind == b"I"
    (docs,) = struct.unpack("<Q", stream.read(8))
    index = np.frombuffer(stream.read(16 * docs), "<i8").reshape(-1, 2)
    ids, todo, start = np.empty(0, np.uint32), iter(marks), 0
    for doc_id, n in index.tolist():
        got = [ids]
        have = len(ids)
        while have < n:
            at, m, k, size = next(todo)
            stream.seek(at)
            table = np.frombuffer(stream.read(4 * k), "<u4")
            control = np.frombuffer(stream.read(-(-m // 4)), np.uint8)
            got.append(decode_block(m, table, control, np.frombuffer(stream.read(size), np.uint8)))
            have += m
        ids = np.concatenate(got) if len(got) > 1 else ids
        yield doc_id, start, ids[:n]
        ids, start = ids[n:], start + n


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 2) -> list[tuple[str, int, int]]:
    """Writes doc_id, text as files under folder; (file, documents, ids) of each in ascending doc_id order.

    Null texts are empty documents, null doc_ids come first, rows that repeat a doc_id all stay (ordered by text).
    The driver gets one row a file.
    """
    end = struct.pack("<I", end_id)

    def task(batches):
        part = TaskContext.get().partitionId()
        store, root = _filesystem(folder)
        name, writer, out = f"{root}/part-{part:06d}.rvb", None, None
        trial = f"{root}/.{part:06d}-{uuid.uuid4().hex}"
        enc = encoder(tokenizer_path, 750_000)
        for b in blocks(batches, 8 << 20):
            if writer is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(trial)
                writer = Writer(out)
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                writer.add(doc_id, ids + end)
        if writer is not None:
            writer.close()
            out.close()
            store.move(trial, name)
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [f"part-{part:06d}.rvb"], "docs": [len(writer.docs)], "ids": [writer.total]}, schema=pa.schema([("part", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    dealt = id_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    with arrow_batches(docs.sparkSession):
        rows = dealt.mapInArrow(task, "part long, file string, docs long, ids long").collect()
    return [(r.file, r.docs, r.ids) for r in sorted(rows)]


def read_tokens(spark, folder: str, files: list[tuple[str, int, int]], digest: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone; a task reads one file."""
    starts, before = [], 0
    for name, _, ids in files:
        starts.append((name, before))
        before += ids
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def task(batches):
        store, root = _filesystem(folder)
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as f:
                    rows = []
                    for doc_id, start, ids in read_file(f):
                        rows.append((doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(rows) == 50_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    listed = spark.createDataFrame(starts, "file string, base long").repartition(max(1, len(starts)), "file")
    return listed.mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long").withColumn("doc_id", id_or_none())


@operator
def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Writes the documents' ids and reads them back (see write_tokens, read_tokens). An empty table gives no rows."""
    spark = docs.sparkSession
    folder = work_path(spark, "tokens")
    return read_tokens(spark, folder, write_tokens(docs, tokenizer_path, folder, end_id))
