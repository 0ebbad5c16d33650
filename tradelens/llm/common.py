"""What the corpus operators share: table access, the shared work folder, hashing, batching."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside the operators; it sorts below every other id.
NO_ID = -(2**63)

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one where that is unset, in local mode alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tradelens-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base if "://" in base else f"file://{base}"


#: Folders that the operator at work has written, and those that live until the process ends (results).
_scope: ContextVar[list[str] | None] = ContextVar("written", default=None)
_results: list[tuple[SparkSession, str]] = []


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _remove_results() -> None:
    for spark, path in _results:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001, PERF203 - the session may be gone by now
            return


def work_path(spark: SparkSession, tag: str) -> str:
    """A new folder's name; what is put there goes when the operator at work is done, or else when the process ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    scope = _scope.get()
    if scope is not None:
        scope.append(path)
    else:
        if not _results:
            atexit.register(_remove_results)
        _results.append((spark, path))
    return path


@contextmanager
def settings(spark: SparkSession, **values):
    """The session's settings with these ones (two underscores for a dot); its own come back at the end."""
    keys = {k.replace("__", "."): str(v) for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def arrow_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20):
    """Arrow batches of at most so many rows and bytes, so that very long texts don't multiply by the row limit."""
    return settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=rows, spark__sql__execution__arrow__maxBytesPerBatch=size)


def saved(df: DataFrame, tag: str, rows: int = 2000, by: str | None = None) -> DataFrame:
    """Cuts lineage: writes df to the shared folder and reads it back, so lost executors cost no recomputation of it.

    rows: of an Arrow batch, see arrow_batches. by: a column of a few values, each a part that is read by itself."""
    spark = df.sparkSession
    path = work_path(spark, tag)
    with arrow_batches(spark, rows), settings(spark, spark__sql__maxConcurrentOutputFileWriters=8):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def operator(f):
    """An operator over a DataFrame: its result is written as a table, what it wrote on the way is deleted, and the
    session's settings are those from before."""

    @wraps(f)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        spark, own = docs.sparkSession, []
        mark = _scope.set(own)
        try:
            with arrow_batches(spark):
                out = f(docs, *args, **options)
                _scope.reset(mark)
                mark = None
                return saved(out, f.__name__)
        finally:
            if mark is not None:
                _scope.reset(mark)
            for path in own:
                remove(spark, path)

    return run


def shielded(docs: DataFrame) -> DataFrame:
    """docs with its columns named c0, c1, ... so that no name can clash with an operator's; docs.columns in
    DataFrame.toDF brings them back."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def place(docs: DataFrame, name: str) -> str:
    """The name in shielded(docs) of the column of this very name, or else of the first one whose case alone differs."""
    for same in (name.__eq__, lambda c: c.lower() == name.lower()):
        for i, c in enumerate(docs.columns):
            if same(c):
                return f"c{i}"
    raise ValueError(f"no column {name} among {docs.columns}")


def pick(docs: DataFrame, *names: str) -> DataFrame:
    """These columns of docs alone, whatever else it holds."""
    return shielded(docs).select(*(F.col(place(docs, n)).alias(n) for n in names))


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id (long, NO_ID for null) and text (string)."""
    return pick(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))


def blocks(batches: Iterable[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches of about `most` bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n = max(1, -(-batch.nbytes // most))
        step = -(-batch.num_rows // n)
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)
    release()


_FOLD = bytes(32 if 9 <= c <= 13 else _LOWER[c] for c in range(256))


def coded_words(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """words() of many texts at once: the different words, each word's number among them, and each text's first word
    (with the end of the last)."""
    raw = [t.encode("utf-8", "surrogatepass").translate(_FOLD) if t else b"" for t in texts]
    split = pc.split_pattern(pa.array(raw, pa.large_binary()), b" ")
    coded = split.values.dictionary_encode()
    at, offsets, own = coded.indices.to_numpy(), split.offsets.to_numpy(), coded.dictionary.to_pylist()
    if b"" in own:  # more than one space at a place
        keep = at != own.index(b"")
        at, offsets = at[keep], np.append(0, np.cumsum(keep))[offsets]
    return own, at, offsets


def release() -> None:
    """Gives memory that a task has freed back to the system; Python workers outlive tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ in UTF-8, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalizer of 64-bit integers: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class WordHash(dict):
    """Word bytes to a 64-bit hash; forgets all when full."""

    limit = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def text_key(text: str | None) -> int:
    """A signed 64-bit key that tells apart rows that repeat a doc_id; the same as Spark's xxhash64 (see row_key)."""
    if text is None:
        return 42
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)
    return h - 2**64 if h >= 2**63 else h


def row_key(col: str = "text"):
    """text_key() as a column."""
    return F.xxhash64(F.col(col).cast("string"))


def id_or_none(col: str = "doc_id"):
    return F.when(F.col(col) != F.lit(NO_ID), F.col(col))


def held_out(doc_id: str, mod: int, rest: int):
    """crc32 of doc_id as text, modulo mod, is rest (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod == rest
