"""Whole-text encoding with a file of the tokenizers library, one library call for each new word.

The vocabulary's pre-tokenizer never joins characters across white space, so a text's ids are its words' ids one
after another. Words repeat, so their ids are kept; new words of plain letters go to the library many at a time.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Marks that may follow a word of letters: each run of them is one pre-token. No apostrophe (contractions) and no
#: angle brackets (special tokens).
_MARKS = ".,;:!?|*#$%&()[]{}\"/=_~"


def folded(text: str | None) -> str:
    """The text with the same ids and fewer different words between spaces: in lower case, as the library does it,
    where each character has one of its own and no special token can arise."""
    text = (text or "").replace("\n", " ")
    if "<|" not in text:
        try:
            text.isascii() or text.encode("latin-1")
            return text.lower()
        except UnicodeEncodeError:
            pass
    return text


class WordEncoder:
    """encode() returns each text's ids as little-endian unsigned 32-bit integers.

    A null text counts as empty. The first `limit` different words met are kept (about 200 bytes each), which are the
    frequent ones; later ones last for a call. When most words of a call are unknown, keeping starts anew.
    """

    def __init__(self, path: str, limit: int = 350_000):
        from tokenizers import Tokenizer

        self.library, self.limit = Tokenizer.from_file(path), limit
        self.known: dict[str, bytes] = {"": b""}
        self.marks: dict[str, bytes] = {}

    def one(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def letters(self, new: list[str]) -> dict[str, bytes]:
        """Words of letters alone, each exactly one pre-token: encoded together and told apart by word number."""
        out: dict[str, bytes] = {}
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            got = self.library.encode(" ".join(part), add_special_tokens=False)
            ids, at = np.array(got.ids, "<u4"), np.array(got.word_ids)
            starts = np.flatnonzero(np.diff(at, prepend=-1))
            if len(starts) != len(part):  # never seen; exact all the same
                out.update((w, self.one(w)) for w in part)
                continue
            raw, cuts = ids.tobytes(), (starts * 4).tolist()
            out.update(zip(part, map(raw.__getitem__, map(slice, cuts, [*cuts[1:], len(raw)])), strict=True))
        return out

    def learn(self, missing: set[str]) -> dict[str, bytes]:
        out, marks, plain = {}, self.marks, []
        for w in missing:
            body = w.rstrip(_MARKS)
            if body.isalpha() and (body.isascii() or max(body) < "Ā"):  # one-to-one lower case, nothing to compose
                plain.append((w, body.lower(), w[len(body) :]))
            else:
                out[w] = self.one(w)
        if len(marks) > 10_000:
            marks.clear()
        marks.update((m, self.one(m)) for m in {m for _, _, m in plain} - marks.keys())
        known = self.known
        out.update(self.letters(list({b for _, b, _ in plain} - known.keys())))
        out.update([(w, (known.get(b) or out[b]) + marks[m]) for w, b, m in plain if m or w != b])
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        collecting = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and each collection would walk all kept words
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        if not texts:
            return []
        split = pc.split_pattern(pa.array(map(folded, texts), pa.large_string()), " ")
        coded = split.values.dictionary_encode()
        every = coded.dictionary.to_pylist()
        known = self.known
        missing, new = set(every) - known.keys(), {}
        if len(known) + len(missing) > self.limit and 2 * len(missing) > len(every):
            known = self.known = {"": b""}
            missing = set(every) - {""}
        if missing:
            new = self.learn(missing)
            known.update(new)
        own = list(map(known.__getitem__, every))
        if len(known) > self.limit:
            for w in new:
                del known[w]
        # Gather the words' ids, which lie one after another in flat.
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        flat, first = np.frombuffer(b"".join(own), "<u4"), np.cumsum(size) - size
        at = coded.indices.to_numpy()
        n = size[at]
        ends = np.cumsum(n)
        raw = flat[np.repeat(first[at] - ends + n, n) + np.arange(ends[-1])].tobytes()
        cuts = (4 * np.append(0, ends)[split.offsets.to_numpy()]).tolist()
        return [raw[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str, limit: int = 350_000) -> WordEncoder:
    """One encoder a process: its words outlive the task. limit: see WordEncoder; the task at hand sets it."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    _encoders[path].limit = limit
    return _encoders[path]
