"""Best-fit packing of token documents into sequences of a fixed length, by bin completion.

Lengths are whole numbers from 1 to the capacity, so a histogram of at most `capacity` rows holds all that the search
needs, whatever the corpus: the driver searches over it, and what it decides is a list of fillings with how many
sequences take each. Pieces then find their places by their rank among pieces of their length.

Search: take the largest length left and enumerate fillings of the room beside it, as counts of lengths from the
largest down: whole ones only (no piece left fits into what remains), none that wastes more than the incumbent packing
leaves, none that another one dominates (its pieces, grouped, fit into the other's pieces one group each: what the
other leaves over is then never harder to pack). The least wasteful is taken first, as often as its pieces last, then
once; where the waste passes the bound the search goes back and takes the next, bin after bin. The best-fit packing is
the first incumbent, each better packing the next, and a packing that meets the lower bound (of total length, and of
pieces that can't share a sequence) ends the search.

The search is cut off after `steps` fillings tried (each from at most `width` enumerated ones, within `effort` steps);
beyond that the result is the incumbent, which may be more sequences than the fewest possible.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, id_or_none, id_text, operator, saved
from .word_bpe import encoder

Filling = dict[int, int]


def best_fit(lengths: list[int], left: dict[int, int], room: int) -> list[int]:
    """Largest piece that fits, again and again. lengths ascend and may hold lengths that are used up."""
    got, taken = [], {}
    i = bisect_right(lengths, room) - 1
    while i >= 0 and room:
        n = lengths[i]
        k = min(left.get(n, 0) - taken.get(n, 0), room // n)
        if k > 0:
            got += [n] * k
            taken[n] = k
            room -= n * k
        i = min(i - 1, bisect_right(lengths, room) - 1)
    return got


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Sequences that any packing takes: by total length, and for each length k by the pieces above capacity - k (which
    share with none from k up), those above half (which share with no other such) and what of the others finds no room
    beside these."""
    n = np.array(sorted(histogram), np.int64)
    c = np.array([histogram[x] for x in n.tolist()], np.int64)
    count, total = np.append(0, np.cumsum(c)), np.append(0, np.cumsum(n * c))
    best, half = -(-int(total[-1]) // capacity), int(np.searchsorted(n, capacity // 2, "right"))
    for k in [0, *n[:half].tolist()]:
        lo, hi = int(np.searchsorted(n, k)), int(np.searchsorted(n, capacity - k, "right"))
        pairless, middle = int(count[-1] - count[hi]), int(count[hi] - count[half])
        rest = int(total[half] - total[lo]) - (middle * capacity - int(total[hi] - total[half]))
        best = max(best, pairless + middle + max(0, -(-rest // capacity)))
    return best


def fits_into(pieces: list[int], bins: list[int]) -> bool:
    """Whether pieces (largest first) can be grouped into the bins, a sum of at most its size in each."""
    if not pieces:
        return True
    seen = set()
    for i, room in enumerate(bins):
        if room >= pieces[0] and room not in seen:
            seen.add(room)
            if fits_into(pieces[1:], [*bins[:i], room - pieces[0], *bins[i + 1 :]]):
                return True
    return False


def fillings(lengths: list[int], left: dict[int, int], room: int, waste: int, width: int, effort: int) -> list[tuple[int, ...]]:
    """Undominated whole fillings of the room that leave at most `waste`, least waste and fewest pieces first.

    lengths ascend. The best-fit filling is among them if it leaves no more; at most `width`, within `effort` steps.
    """
    own = [n for n in lengths if left[n] and n <= room]
    if not own:
        return [()] if room <= waste else []
    # reach[i]: what the lengths up to the i-th sum up to in all, so that branches that can't fill the room end early.
    reach, sum_ = [], 0
    for n in own:
        sum_ += n * left[n]
        reach.append(sum_)
    least, found, spent = own[0], {}, 0
    first = best_fit(lengths, left, room)
    if room - sum(first) <= waste:
        found[tuple(first)] = room - sum(first)
    # Each entry: the next length's number, the room, the pieces so far, and the smallest length passed over with pieces left.
    stack = [(len(own) - 1, room, (), room + 1)]
    while stack and spent < effort and len(found) < width:
        i, free, got, passed = stack.pop()
        spent += 1
        if i < 0 or free < least:
            if free <= waste and free < passed and not (i >= 0 and own[0] <= free):
                found.setdefault(got, free)
            continue
        if free - min(reach[i], free) > waste:
            continue
        n = own[i]
        if n > free:
            j = bisect_right(own, free, 0, i) - 1
            stack.append((j, free, got, passed))
            continue
        most = min(left[n], free // n)
        for k in range(most + 1):  # the most of a length is tried first
            stack.append((i - 1, free - k * n, got + (n,) * k, min(passed, n) if k < left[n] else passed))
    out: list[tuple[int, ...]] = []
    for got in sorted(found, key=lambda g: (found[g], len(g))):
        if not any(len(got) <= 12 and len(other) <= 12 and fits_into(list(got), list(other)) for other in out):
            out.append(got)
    return out


def _greedy(histogram: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """The best-fit packing: the largest piece left, then the largest that fits, again and again."""
    left, out = dict(histogram), []
    lengths = sorted(left)
    while lengths:
        top = lengths[-1]
        left[top] -= 1
        filling = Counter([top, *best_fit(lengths, left, capacity - top)])
        left[top] += 1
        times = min(left[n] // k for n, k in filling.items())
        for n, k in filling.items():
            left[n] -= k * times
        out.append((dict(filling), times))
        lengths = [n for n in lengths if left[n]]
    return out


def plan(histogram: dict[int, int], capacity: int, steps: int = 5_000, width: int = 64, effort: int = 3000) -> list[tuple[Filling, int]]:
    """Fillings with multiplicities that use every piece of the histogram once; see the module for the search."""
    histogram = {n: k for n, k in histogram.items() if k}
    assert all(1 <= n <= capacity for n in histogram)
    best, bound, total = _greedy(histogram, capacity), lower_bound(histogram, capacity) if histogram else 0, sum(n * k for n, k in histogram.items())
    bins = sum(t for _, t in best)
    left, taken, used = dict(histogram), [], 0

    def choices(spare: int):
        """The ways to fill the next sequence, none if no piece is left."""
        lengths = [n for n in sorted(left) if left[n]]
        top = lengths[-1]
        left[top] -= 1
        got = fillings(lengths, left, capacity - top, min(spare, capacity), width, effort)
        left[top] += 1
        for one in got:
            filling = Counter((top, *one))
            most = min(left[n] // k for n, k in filling.items())
            for times in (most, 1) if most > 1 else (1,):
                yield dict(filling), times, times * (capacity - top - sum(one))

    def spare() -> int:
        """What may still be wasted by a packing of fewer sequences than the incumbent's."""
        return (bins - 1) * capacity - total - sum(w for _, _, w in taken)

    stack, spent = [choices(spare())] if bins > bound else [], 0
    while stack and spent < steps:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if taken:
                filling, times, _ = taken.pop()
                used -= times
                for n, k in filling.items():
                    left[n] += k * times
            continue
        filling, times, waste = step
        spent += 1
        if waste > spare():
            continue
        for n, k in filling.items():
            left[n] -= k * times
        taken.append((filling, times, waste))
        used += times
        if any(left.values()):
            stack.append(choices(spare()))
            continue
        if used < bins:
            best, bins = [(f, t) for f, t, _ in taken], used
            if bins <= bound:
                break
        filling, times, _ = taken.pop()
        used -= times
        for n, k in filling.items():
            left[n] += k * times
    return best


def places(fillings: list[tuple[Filling, int]]) -> np.ndarray:
    """Rows (length, first rank, copies a sequence, first sequence, offset) by length and rank, for place_of()."""
    rows, used, base = [], {}, 0
    for filling, times in fillings:
        offset = 0
        for n, k in sorted(filling.items(), reverse=True):
            rows.append((n, used.get(n, 0), k, base, offset))
            used[n] = used.get(n, 0) + k * times
            offset += n * k
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place_of(table: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """sequence_id and offset of pieces by their length and rank among pieces of this length."""
    out_s, out_o = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    for n in np.unique(length):
        at, own = np.flatnonzero(length == n), table[table[:, 0] == n]
        row = own[np.searchsorted(own[:, 1], rank[at], "right") - 1]
        past = rank[at] - row[:, 1]
        out_s[at], out_o[at] = row[:, 3] + past // row[:, 2], row[:, 4] + past % row[:, 2] * n
    return out_s, out_o


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("chunk", pa.int64()), ("nth", pa.int64())])


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """The documents' pieces with `nth`, each one's number among pieces of its length in its chunk (a task's rows)."""
    end = np.array([end_id], "<u4").tobytes()

    def task(batches):
        chunk, seen, enc = TaskContext.get().partitionId(), {}, encoder(tokenizer_path)
        for b in blocks(batches, 8 << 20):
            rows = []
            for doc_id, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    rows.append((doc_id, piece, at // 4, n, zlib.crc32(part), chunk, seen.get(n, 0)))
                    seen[n] = seen.get(n, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return saved(id_text(docs).mapInArrow(task, "doc_id long, piece int, start long, length long, ids_crc32 long, chunk long, nth long"), "pieces")


@operator
def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Every piece with its sequence and offset.

    Null texts are empty documents (the end id alone), null doc_ids come back null, repeated rows are packed each,
    an empty table gives no rows. Only documents longer than the capacity are cut. The driver gets the histogram
    (at most `capacity` rows); the list of places is bounded by capacity as well and goes to the executors.
    """
    found = pieces(docs, tokenizer_path, capacity, end_id)
    counts = saved(found.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = places(plan(histogram, capacity))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("chunk")) - F.col("n")).drop("n")

    def settle(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("nth").to_numpy() + b.column("before").to_numpy()
            s, o = place_of(table, length, rank)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(s), pa.array(o)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = found.join(before.hint("merge"), ["length", "chunk"])
    placed = ranked.mapInArrow(settle, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumn("doc_id", id_or_none())
