"""Sum-of-squares online packing of documents into windows of a fixed number of tokens.

A document's token ids (with an end id) are cut at full windows; what remains goes, as one piece, to the open window whose
level makes the sum over levels h of N(h)^2 smallest, N(h) being the number of windows filled to h: a level array of `window`
counters is all the state, however many documents pass.  Placing a piece of r tokens on level h changes the sum by
2 N(h+r) + 1 (nothing if the window becomes full) and 1 - 2 N(h) (nothing for a new window); of equal levels the fullest wins.
Each input partition packs on its own and, at its end, cuts the pieces of its emptiest open windows to fill the others, so
that at most one window of a partition is not full; that one becomes sequences of lengths that are powers of two.  The same
is done to half of the open windows whenever more than OPEN are open (pieces just over half a window fit with nothing), so
what a task holds is bounded.  Pieces of words are known by 128 bits of hash.

Tokenisation looks up a cache of word pieces: text is cut only where every tokenizer of this kind cuts too (white space, and
between an ASCII letter or digit and an ASCII sign other than the apostrophe), so the ids are those of the whole text.
Texts that could hold a special token are encoded whole.

Defined results: a null or empty text has the end id alone; repeated rows are packed each for itself; null ids are kept;
an empty table gives no rows; a document longer than a window becomes full windows and a rest.  Sequence ids are unique;
those of a partition are consecutive.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import arrow_map, id_text, pieces, strong_hashes

OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: 0 white space, 1 ASCII letters and digits, 2 ASCII signs without the apostrophe, 3 everything else.
_CLASS = np.array(
    [0 if b in (9, 10, 13, 32) else 1 if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 2 if 33 <= b <= 126 and b != 39 else 3 for b in range(256)], np.int8
)
#: Most windows that a partition holds open (about 8 kB each at 2048 tokens).
OPEN = 4096


class Tokens:
    """Token ids of texts, by a cache of word pieces."""

    def __init__(self, path: str, cap: int = 1 << 20) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cap = Tokenizer.from_file(path), cap
        self.keys, self.checks, self.at, self.n, self.flat = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def _encode(self, words: list[bytes]) -> list[list[int]]:
        model, out, rest = self.tokenizer.model, [], []
        for k, w in enumerate(words):
            if w.isalpha():  # ASCII letters only, for bytes
                out.append([t.id for t in model.tokenize(w.decode())])
            else:
                out.append([])
                rest.append(k)
        if rest:
            for k, e in zip(rest, self.tokenizer.encode_batch([words[k].decode("utf-8", "replace") for k in rest], add_special_tokens=False), strict=True):
                out[k] = e.ids
        return out

    def _learn(self, keys: np.ndarray, checks: np.ndarray, words: list[bytes]) -> None:
        ids = self._encode(words)
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((t for x in ids for t in x), np.uint32, int(n.sum()))
        at = len(self.flat) + np.cumsum(n) - n
        order = np.argsort(all_keys := np.concatenate([self.keys, keys]))
        self.keys, self.checks = all_keys[order], np.concatenate([self.checks, checks])[order]
        self.at, self.n, self.flat = np.concatenate([self.at, at])[order], np.concatenate([self.n, n])[order], np.concatenate([self.flat, flat])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's begin (one more entry than texts)."""
        odd = {k: np.array(self.tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32) for k, t in enumerate(texts) if b"<|" in t}
        plain = [b"" if k in odd else t for k, t in enumerate(texts)]
        buf = b"\n".join(plain).translate(_LOWER)
        ends_of = np.cumsum(np.fromiter((len(t) + 1 for t in plain), np.int64, len(plain)))
        flat, starts = self._encode_buffer(buf)
        bounds = np.concatenate([[0], np.searchsorted(starts[0], ends_of)])
        edges = np.concatenate([[0], np.cumsum(starts[1])])[bounds]
        if not odd:
            return flat, edges
        parts = [odd.get(k, flat[edges[k] : edges[k + 1]]) for k in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _encode_buffer(self, buf: bytes) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        arr = np.frombuffer(buf, np.uint8)
        cls = _CLASS[arr]
        cut = np.empty(len(arr) + 1, bool)
        cut[[0, -1]] = True
        a, b = cls[:-1], cls[1:]
        cut[1:-1] = (a == 0) | (b == 0) | (a + b == 3) & (a != 0) & (b != 0)
        starts = np.flatnonzero(cut[:-1] & (cls != 0))
        ends = np.flatnonzero(cut[1:] & (cls != 0)) + 1
        if not len(starts):
            return np.empty(0, np.uint32), (starts, np.empty(0, np.int64))
        # a piece is known by two hashes of 64 bits each; where two pieces share the first only, nothing is looked up
        first_hash, second_hash = (strong_hashes(buf, starts, ends, seed) for seed in (0, 1))
        keys, first, inverse = np.unique(first_hash, return_index=True, return_inverse=True)
        checks = second_hash[first]
        if (checks[inverse] != second_hash).any():
            return self._one_by_one([buf[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], starts)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        same = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        new = np.flatnonzero(~same)
        if len(new) + len(self.keys) > self.cap or (same & (self.checks[at] != checks) if len(self.keys) else same).any():  # start afresh from what this buffer holds
            self.keys, self.checks, self.at, self.n, self.flat = self.keys[:0], self.checks[:0], self.at[:0], self.n[:0], self.flat[:0]
            new = np.arange(len(keys))
        if len(new):
            self._learn(keys[new], checks[new], [buf[s:e] for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            at = np.searchsorted(self.keys, keys)
        slot = at[inverse]
        n = self.n[slot]
        before = np.cumsum(n) - n
        flat = self.flat[np.repeat(self.at[slot] - before, n) + np.arange(int(n.sum()))]
        return flat, (starts, n)

    def _one_by_one(self, words: list[bytes], starts: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        ids = self._encode(words)
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((t for x in ids for t in x), np.uint32, int(n.sum())), (starts, n)


class Window:
    __slots__ = ("fill", "parts", "seq")

    def __init__(self, seq: int) -> None:
        self.seq, self.fill, self.parts = seq, 0, []

    def add(self, doc: tuple, start: int, ids: np.ndarray) -> None:
        self.parts.append((doc, start, ids))
        self.fill += len(ids)


class Packer:
    """The windows of one partition."""

    def __init__(self, window: int, first: int, most: int = OPEN) -> None:
        self.window, self.seq, self.most = window, first, most
        self.levels = np.zeros(window + 1, np.int64)
        self.open: list[list[Window]] = [[] for _ in range(window + 1)]
        self.rows: list[tuple] = []

    def _new(self) -> Window:
        self.seq += 1
        return Window(self.seq - 1)

    def _close(self, w: Window) -> None:
        at = 0
        for (doc_id, total), start, ids in w.parts:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, w.seq, at, ids))
            at += len(ids)

    def _close_last(self, w: Window) -> None:
        """Cut what is left into sequences whose lengths are powers of two, the largest first: these need no padding."""
        parts, left = w.parts[::-1], w.fill
        while left:
            part = self._new()
            room = 1 << (left.bit_length() - 1)
            left -= room
            while room:
                doc, start, ids = parts.pop()
                part.add(doc, start, ids[:room])
                if len(ids) > room:
                    parts.append((doc, start + room, ids[room:]))
                room -= min(room, len(ids))
            self._close(part)

    def level(self, r: int) -> int:
        """The level on which a piece of r tokens keeps the sum of squares smallest; 0 opens a window."""
        n = self.levels
        cost = 2 * n[r:] + 1
        cost[-1] = 0
        under = n[: len(cost)]
        cost += 1 - 2 * under
        cost[1:][under[1:] == 0] = np.iinfo(np.int64).max
        cost[0] = 2 * n[r] + 1
        return len(cost) - 1 - int(np.argmin(cost[::-1]))

    def add(self, doc_id, ids: np.ndarray) -> None:
        doc, full = (doc_id, len(ids)), len(ids) // self.window * self.window
        for a in range(0, full, self.window):
            w = self._new()
            w.add(doc, a, ids[a : a + self.window])
            self._close(w)
        if r := len(ids) - full:
            h = self.level(r)
            if h:
                self.levels[h] -= 1
                w = self.open[h].pop()
            else:
                w = self._new()
            w.add(doc, full, ids[full:].copy())
            if w.fill == self.window:
                self._close(w)
            else:
                self.levels[w.fill] += 1
                self.open[w.fill].append(w)
                if not h and int(self.levels.sum()) > self.most:
                    self.shrink(self.most // 2)

    def shrink(self, most: int) -> None:
        """Fill the fullest windows with tokens of the emptiest, which are cut, until at most so many are open."""
        left = [w for ws in self.open for w in ws]
        low, high = 0, len(left) - 1
        while low < high and high - low >= most:
            gap, w = self.window - left[high].fill, left[low]
            doc, start, ids = w.parts.pop()
            take = ids[-gap:] if len(ids) > gap else ids
            left[high].add(doc, start + len(ids) - len(take), take)
            w.fill -= len(take)
            if len(take) < len(ids):
                w.parts.append((doc, start, ids[: len(ids) - len(take)]))
            if left[high].fill == self.window:
                self._close(left[high])
                high -= 1
            if not w.fill:
                low += 1
        self.open, self.levels = [[] for _ in self.open], np.zeros_like(self.levels)
        for w in left[low : high + 1]:
            self.open[w.fill].append(w)
            self.levels[w.fill] += 1

    def finish(self) -> None:
        """Close all windows; at most one is not full, and it is cut into powers of two."""
        self.shrink(1)
        for w in [w for ws in self.open for w in ws]:
            self._close_last(w)
        self.open, self.levels = [[] for _ in self.open], np.zeros_like(self.levels)


_CACHE: dict[str, Tokens] = {}


def _pack(path: str, window: int, end_id: int, with_ids: bool):
    def emit(p: Packer) -> pa.RecordBatch:
        rows, p.rows = p.rows, []
        names = [c.split()[0] for c in OUT.split(", ")]
        cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(7)]
        if with_ids:
            cols.append(pa.array([r[7].tolist() for r in rows], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(cols, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _CACHE.get(path) or _CACHE.setdefault(path, Tokens(path))
        packer = Packer(window, TaskContext.get().partitionId() << 33)
        for b in pieces(batches, 2 << 20):
            flat, edges = tokens.encode(b.column(1).to_pylist())
            end = np.array([end_id], np.uint32)
            for i, doc_id in enumerate(b.column(0).to_pylist()):
                packer.add(doc_id, np.concatenate([flat[edges[i] : edges[i + 1]], end]))
            if packer.rows:
                yield emit(packer)
        packer.finish()
        if packer.rows:
            yield emit(packer)

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start and length in its document's ids, crc32 of the ids, the document's number of ids,
    sequence_id and the offset there; with_ids adds the ids themselves."""
    return arrow_map(id_text(docs), _pack(tokenizer, window, end_id, with_ids), OUT + ", ids array<int>" * with_ids)
