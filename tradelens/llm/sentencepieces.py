"""SentencePiece encoding and decoding in batched numpy.

Different chunks (a run of spaces with what follows) of one length advance together; prefix hashes give the hash of
every substring of up to the longest piece's length, and one probe of the pieces' hashes, sorted and in slots by their first bits, tells its score.
Two segmentations read these scores:

* Viterbi: vectorised maxima over the piece that ends at each character store backpointers; of equal paths the one with
  the longest last piece counts. Its result is that of a unigram model with these pieces and scores.
* Pair merging: the public model at hand is a BPE model, whose own result is not the best-scoring path but that of merging
  the best adjacent pair first; one vectorised maximum over all pairs a step, so all chunks of one length lose one symbol
  a step.

Characters that no piece covers become byte pieces.
"""

from __future__ import annotations

import heapq
import re
import zlib
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, mix64, operator, pick

_BASE = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = re.compile(r"\n| +[^ \n]*|[^ \n]+")
_SPACE = "▁"
#: Chunks of more characters are merged one by one with a heap.
LONG = 64
#: Substrings probed at a time: bounds a task's memory.
CELLS = 1_000_000
#: Bits of the slots by which substrings find pieces.
SLOTS = 18
#: Different chunks whose ids are kept; beyond, those that the texts at hand hold again stay.
KNOWN = 400_000
_FIRST, _SECOND = itemgetter(0), itemgetter(1)


def _powers(n: int) -> np.ndarray:
    """_BASE to the powers 0 to n."""
    return np.cumprod(np.append(np.uint64(1), np.full(n, _BASE)), dtype=np.uint64)


class Pieces:
    """A model's pieces: hashes sorted for probing, and the bytes that each id decodes to."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        hashes = np.array([int(self.prefix(self.points([names[i]]))[0, -1]) for i in plain], np.uint64)
        hashes = mix64(hashes)
        order = np.argsort(hashes)
        # The last row, of no substring, stands for those that are no piece.
        self.keys, self.ids = np.append(hashes[order], ~np.uint64(0)), np.append(np.array(plain, np.int32)[order], np.int32(-1))
        self.scores = np.append(np.array([sp.get_score(i) for i in plain], np.float64)[order], -np.inf)
        self.none, self.lowest = len(plain), self.scores[:-1].min()
        self.slots = np.searchsorted(self.keys, np.arange(1 << SLOTS, dtype=np.uint64) << np.uint64(64 - SLOTS)).astype(np.int32)
        assert (self.keys[1:] != self.keys[:-1]).all() and not any(_SPACE in names[i].lstrip(_SPACE) for i in plain)
        self.longest = max(len(names[i]) for i in plain)
        self.byte = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        own = set(plain)
        back = {i: bytes([b]) for b, i in self.byte.items()}
        self.text = [names[i].replace(_SPACE, " ").encode() if i in own else back.get(i, b"") for i in range(n)]
        self.known: dict[str, tuple[bytes, bytes]] = {}

    @staticmethod
    def points(chunks: list[str]) -> np.ndarray:
        return np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(chunks), -1)

    @staticmethod
    def prefix(points: np.ndarray) -> np.ndarray:
        h = np.zeros((len(points), points.shape[1] + 1), np.uint64)
        for j in range(points.shape[1]):
            h[:, j + 1] = h[:, j] * _BASE + mix64(points[:, j] + np.uint64(1))
        return h

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each substring's piece, or none: from the first row of the hash's slot on."""
        at = self.slots[hashes >> np.uint64(64 - SLOTS)]
        key = self.keys[at]
        low = np.nonzero(key < hashes)
        while len(low[0]):
            at[low] += 1
            key[low] = self.keys[at[low]]
            less = key[low] < hashes[low]
            low = tuple(x[less] for x in low)
        at[key != hashes] = self.none
        return at

    def substrings(self, h: np.ndarray) -> np.ndarray:
        """By chunk, start and length less 1: the piece's row."""
        n, width = h.shape
        most = min(self.longest, width - 1)
        rows = np.full((n, width, most), self.none, np.int32)
        power = _powers(most)
        for k in range(1, most + 1):
            rows[:, : width - k, k - 1] = self.probe(mix64(h[:, k:] - h[:, : width - k] * power[k]))
        return rows

    @staticmethod
    def merged(scores: np.ndarray) -> np.ndarray:
        """Whether each place is a symbol's border in each chunk, after merging the best pair (the leftmost of equals) until none is a piece."""
        n, width, most = scores.shape
        out = np.zeros((n, width), bool)
        row, b = np.arange(n), np.tile(np.arange(width), (n, 1))
        while len(row):
            if b.shape[1] < 3:
                out[row[:, None], b] = True
                break
            lo, size = b[:, :-2], b[:, 2:] - b[:, :-2]
            score = np.where(size <= most, scores[row[:, None], lo, np.minimum(size, most) - 1], -np.inf)
            best = score.argmax(1)
            live = score[np.arange(len(row)), best] > -np.inf
            out[row[~live, None], b[~live]] = True
            row, b, best = row[live], b[live], best[live]
            keep = np.ones(b.shape, bool)
            keep[np.arange(len(b)), best + 1] = False
            b = b[keep].reshape(len(b), b.shape[1] - 1)
        return out

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """Whether each place is a symbol's border on each chunk's best-scoring path; a character without a piece scores ten less than any piece."""
        n, width, most = scores.shape
        one = scores[:, :, 0]
        one[one == -np.inf] = self.lowest - 10
        best, back = np.zeros((n, width)), np.zeros((n, width), np.int32)
        rows = np.arange(n)
        for j in range(1, width):
            k = np.arange(min(j, most), 0, -1)  # of equals the first, which is the longest
            s = best[:, j - k] + scores[:, j - k, k - 1]
            at = s.argmax(1)
            best[:, j], back[:, j] = s[rows, at], j - k[at]
        # All chunks walk back together, a piece a step; each ends at its start.
        out = np.zeros((n, width), bool)
        at, row = np.full(n, width - 1), rows
        while len(row):
            out[row, at] = True
            more = at > 0
            row, at = row[more], at[more]
            at = back[row, at]
        return out

    def merged_long(self, chunk: str) -> list[int]:
        """As merged(), for one long chunk: a heap of pairs over a linked list."""
        h = self.prefix(self.points([chunk]))[0]
        n = len(chunk)
        power = _powers(self.longest)
        nxt, prv, end, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        cache: dict[str, float | None] = {}

        def score(i, j):
            if j - i > self.longest:
                return None
            s = chunk[i:j]
            if s not in cache:
                at = int(self.probe(mix64(h[j : j + 1] - h[i : i + 1] * power[j - i]))[0])
                cache[s] = float(self.scores[at]) if at != self.none else None
            return cache[s]

        heap = []

        def push(i):
            if nxt[i] < n and (s := score(i, end[nxt[i]])) is not None:
                heapq.heappush(heap, (-s, i, end[nxt[i]]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, j = heapq.heappop(heap)
            if not alive[i] or nxt[i] >= n or end[nxt[i]] != j:
                continue
            k = nxt[i]
            alive[k] = False
            end[i], nxt[i] = end[k], nxt[k]
            if nxt[i] < n:
                prv[nxt[i]] = i
            push(i)
            if prv[i] >= 0:
                push(prv[i])
        return [i for i in range(n) if alive[i]] + [n]

    def coded(self, rows: np.ndarray, cuts: np.ndarray, part: list[str]) -> list[bytes]:
        """The chunks' ids as little-endian unsigned 32-bit integers, from their symbols' borders."""
        own, flat = np.nonzero(cuts)
        same = own[1:] == own[:-1]
        lo, hi, own = flat[:-1][same], flat[1:][same], own[1:][same]
        size = hi - lo
        got = np.where(size <= rows.shape[2], self.ids[rows[own, lo, np.minimum(size, rows.shape[2]) - 1]], -1)
        bounds = np.searchsorted(own, np.arange(len(part) + 1)).tolist()
        raw, bare = got.astype("<u4").tobytes(), np.add.reduceat(got < 0, bounds[:-1]) > 0
        out = [raw[4 * i : 4 * j] for i, j in zip(bounds, bounds[1:], strict=False)]
        for r in np.flatnonzero(bare).tolist():
            one: list[int] = []
            for k in range(bounds[r], bounds[r + 1]):
                one += [int(got[k])] if got[k] >= 0 else [self.byte[x] for x in part[r][lo[k] : hi[k]].encode("utf-8", "surrogatepass")]
            out[r] = np.array(one, "<u4").tobytes()
        return out

    def learn(self, chunks: list[str]) -> None:
        """Keeps the new chunks' ids, by pair merging and by Viterbi."""
        by_length: dict[int, list[str]] = {}
        for c in chunks:
            by_length.setdefault(len(c), []).append(c)
        for length, group in by_length.items():
            step = max(1, CELLS // ((length + 1) * min(length, self.longest)))
            for i in range(0, len(group), step):
                part = [c.replace(" ", _SPACE) for c in group[i : i + step]]
                rows = self.substrings(self.prefix(self.points(part)))
                scores = self.scores[rows]
                if length <= LONG:
                    pairs = self.merged(scores)
                else:
                    pairs = np.zeros((len(part), length + 1), bool)
                    for j, c in enumerate(part):
                        pairs[j, self.merged_long(c)] = True
                merged = self.coded(rows, pairs, part)
                self.known.update(zip(group[i : i + step], zip(merged, self.coded(rows, self.viterbi(scores), part), strict=True), strict=True))

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
        """Ids of each text as little-endian unsigned 32-bit integers, by pair merging and by Viterbi; a null or empty text
        has none."""
        lists = [_CHUNK.findall(f" {t}") if t else [] for t in texts]
        every = set().union(*lists)
        if len(self.known) > KNOWN:
            self.known = {c: self.known[c] for c in every & self.known.keys()}
        if new := every - self.known.keys():
            self.learn(list(new))
        get = self.known.__getitem__
        both = [list(map(get, x)) for x in lists]
        return [b"".join(map(_FIRST, x)) for x in both], [b"".join(map(_SECOND, x)) for x in both]

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        """The texts' bytes: their pieces joined, space marks made spaces, the first one dropped."""
        get = self.text.__getitem__
        return [b"".join(map(get, np.frombuffer(e, "<u4").tolist()))[1:] for e in encoded]


_models: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


@operator
def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, decoded_xxh64 and round_trip of every row by the model's own pair merging, and
    viterbi_pieces, viterbi_crc32, viterbi_round_trip by the best-scoring path.

    A null text counts as empty; ids stay as they are, null and repeated ones too; an empty table gives no rows; other
    columns play no part. A text that holds the space mark itself decodes to spaces there, so its round trips are false.
    A very long text is handled whole; a word of more than LONG characters is merged by a heap, in time n log n, and by
    Viterbi in time n.
    """
    names = ["doc_id", "n_pieces", "ids_crc32", "decoded_xxh64", "round_trip", "viterbi_pieces", "viterbi_crc32", "viterbi_round_trip"]

    def task(batches):
        model = pieces(path)
        for b in blocks(batches):
            texts = b.column(1).to_pylist()
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
            cols = []
            for ids in model.encode(texts):
                back = model.decode(ids)
                n, crc = pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())
                cols.append([n, crc, pa.array([xxhash.xxh64_hexdigest(x) for x in back], pa.string()), pa.array([x == y for x, y in zip(back, raw, strict=True)], pa.bool_())])
            merged, best = cols
            yield pa.RecordBatch.from_arrays([b.column(0), *merged, best[0], best[1], best[3]], names=names)

    src = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(task, "doc_id long, n_pieces long, ids_crc32 long, decoded_xxh64 string, round_trip boolean, viterbi_pieces long, viterbi_crc32 long, viterbi_round_trip boolean")
