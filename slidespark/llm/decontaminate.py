"""Benchmark decontamination with a generalised suffix automaton of the test items.

The normalised items (words, see `words_of`) build one suffix automaton over word numbers; every state knows which items
hold the window that it stands for.  Training tokens stream through it: the state and the length of the longest match that
ends at each token are kept, and wherever the length reaches the window, the window's words are hit.  Items shorter than a
window count as a window of their own length.  The automaton is built from at most `chunk_words` words of items (or one item)
and sent to the executors.  A larger test set makes several automata, one after the other: documents pass each in a job of its
own, which keeps the hit words of those with any; the driver and a task hold one automaton at a time.

Defined results: a null or empty text has no words and is not contaminated; items without words never match; repeated
documents are judged each for itself, items that share an id are listed once; an empty benchmark hits nothing; columns other
than ids and texts are not looked at.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, id_text, pieces, staged

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A-Z to a-z; every other ASCII character outside 0-9 and a-z to a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
OUT = "doc_id long, n_words long, n_hit long, items array<string>, starts array<long>, ends array<long>, longest long"


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words of digits, letters and all characters beyond ASCII."""
    return text.translate(_FOLD).split()


class Automaton:
    """A generalised suffix automaton over the word numbers of several items."""

    def __init__(self, window: int) -> None:
        self.window, self.vocab = window, {}
        self.next, self.link, self.len = [{}], [-1], [0]
        self.items: list[str] = []
        self.held: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        self.shortest = window

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, q, c)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return cur

    def _clone(self, p: int, q: int, c: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    @classmethod
    def build(cls, items: list[tuple[str, bytes]], window: int) -> Automaton:
        a = cls(window)
        rows = []
        for name, text in items:
            if ids := [a.vocab.setdefault(w, len(a.vocab)) for w in words_of(text)]:
                rows.append(ids)
                a.items.append(name)
        for ids in rows:
            last = 0
            for c in ids:
                last = a._extend(last, c)
        for k, ids in enumerate(rows):
            state = 0
            for n, c in enumerate(ids, 1):
                state = a.next[state][c]
                if n >= window:
                    a.held.setdefault(a.at(state, window), set()).add(k)
            if len(ids) < window:
                a.short.setdefault(state, []).append((len(ids), k))
                a.shortest = min(a.shortest, len(ids))
        if a.short:  # a state also ends what its suffixes end
            for v in sorted(range(len(a.len)), key=a.len.__getitem__):
                if v and (above := a.short.get(a.link[v])):
                    a.short[v] = a.short.get(v, []) + above
        return a

    def at(self, state: int, length: int) -> int:
        """The state of the suffix of that length of what the state stands for."""
        while self.len[self.link[state]] >= length:
            state = self.link[state]
        return state

    def scan(self, ids: list[int], hit: np.ndarray, base: int, items: set[int]) -> int:
        """Stream one run of known words; marks hits from base on, adds items, returns the longest match."""
        nxt, link, length, window, short = self.next, self.link, self.len, self.window, self.short
        v = n = most = 0
        for i, c in enumerate(ids, base + 1):
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                n += 1
            else:
                v = n = 0
            most = max(most, n)
            if n >= window:
                hit[i - window : i] = True
                items |= self.held[self.at(v, window)]
            if v in short:
                for m, k in short[v]:
                    if n >= m:
                        hit[i - m : i] = True
                        items.add(k)
        return most

    def match(self, words: list[bytes]) -> tuple[np.ndarray | None, set[int], int]:
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate([[False], ids >= 0, [False]]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        hit, items, most = None, set(), 0
        for k in np.flatnonzero(ends - starts >= self.shortest).tolist():
            a, b = int(starts[k]), int(ends[k])
            if hit is None:
                hit = np.zeros(len(words), bool)
            most = max(most, self.scan(ids[a:b].tolist(), hit, a, items))
        return hit, items, most


def _spans(text: bytes, hit: np.ndarray) -> tuple[list[int], list[int]]:
    """Byte ranges of the runs of hit words."""
    at = [m.span() for m in _WORD.finditer(text.lower())]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return [at[a][0] for a in edge[::2]], [at[b - 1][1] for b in edge[1::2]]


def _bytes_of(text: object) -> bytes:
    return b"" if text is None else text if isinstance(text, bytes) else text.encode()


def _row(words: list[bytes], text: bytes, hit: np.ndarray | None, items: list[str], most: int) -> tuple:
    starts, ends = _spans(text, hit) if hit is not None and hit.any() else ([], [])
    return len(words), 0 if hit is None else int(hit.sum()), sorted(set(items)), starts, ends, most


def _rows(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
    return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], [c.split()[0] for c in OUT.split(", ")])


def _match_all(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = held.value
        for b in pieces(batches):
            rows = []
            for text in b.column(1).to_pylist():
                words = words_of(text)
                hit, items, most = automaton.match(words) if automaton else (None, set(), 0)
                rows.append(_row(words, text, hit, sorted(automaton.items[k] for k in items) if automaton else [], most))
            yield _rows(b.column(0), rows)

    return run


HITS = "doc long, name long, first array<int>, last array<int>, items array<string>, longest int"


def _hits(held):
    """Runs of hit words (first, last + 1), of documents with any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = held.value
        for b in pieces(batches):
            rows = []
            for doc, name, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                hit, items, most = automaton.match(words_of(text))
                if most:
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                    rows.append((doc, name, edge[::2], edge[1::2], sorted(automaton.items[k] for k in items), most))
            types = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [c.split()[0] for c in HITS.split(", ")])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text and the hits of all automata to OUT."""
    for b in pieces(batches):
        rows = []
        for text, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            words = words_of(text)
            hit = np.zeros(len(words), bool)
            for h in own or []:
                for a, z in zip(h["first"], h["last"], strict=True):
                    hit[a:z] = True
            rows.append(_row(words, text, hit, sorted(i for h in own or [] for i in h["items"]), max((h["longest"] for h in own or []), default=0)))
        yield _rows(b.column(0), rows)


def automata(benchmark: DataFrame, window: int, chunk_words: int, id_col: str = "item_id", text_col: str = "text") -> Iterator[Automaton]:
    """Automata over the items, each over at most chunk_words words (or one item)."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("t"))
    chunk, size = [], 0
    for r in rows.toLocalIterator():
        n = len(words_of(bytes(r["t"])))
        if chunk and size + n > chunk_words:
            yield Automaton.build(chunk, window)
            chunk, size = [], 0
        chunk.append((r["i"] or "", bytes(r["t"])))
        size += n
    if chunk:
        yield Automaton.build(chunk, window)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, coverage: float = 0.05, chunk_words: int = 200_000) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids of items with a window in the text), spans (byte ranges of hit words), longest (words of
    the longest match), contaminated (a hit, and hits are at least the coverage of the words) for every row of docs.

    chunk_words bounds one automaton (about 0.2 kB a word); a test set is far smaller.
    """
    spark, texts = docs.sparkSession, id_text(docs)
    each = automata(benchmark, window, chunk_words)
    first, second = next(each, None), next(each, None)
    if second is None:
        out = arrow_map(texts, _match_all(spark.sparkContext.broadcast(first)), OUT)
    else:
        named = texts.withColumns({"doc": F.coalesce(F.col("doc_id"), F.lit(-(2**63))).cast("long"), "name": F.xxhash64("text")})
        hits = None
        for a in itertools.chain([first, second], each):
            held = spark.sparkContext.broadcast(a)
            # rows that agree in id and text have the same hits
            own = staged(arrow_map(named.select("doc", "name", "text"), _hits(held), HITS).dropDuplicates(["doc", "name"]), "hits")
            hits = own if hits is None else hits.unionByName(own)
            held.destroy()
        sums = hits.groupBy("doc", "name").agg(F.collect_list(F.struct("first", "last", "items", "longest")).alias("own"))
        out = arrow_map(named.join(sums, ["doc", "name"], "left").select("doc_id", "text", "own"), _merged, OUT)
    limit = round(1 / coverage)
    return out.select(
        "doc_id", "n_words", "n_hit", "items", F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")).alias("spans"), "longest",
        ((F.col("n_hit") > 0) & (F.lit(limit) * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, coverage: float = 0.05, chunk_words: int = 200_000) -> DataFrame:
    """The rows of docs, all columns, that are not contaminated; no row travels unless there are several automata."""
    each = automata(benchmark, window, chunk_words)
    first, second = next(each, None), next(each, None)
    if second is None:
        held = docs.sparkSession.sparkContext.broadcast(first)
        return arrow_map(docs, _clean_only(held, docs.columns.index("text"), round(1 / coverage)), docs.schema)
    # the verdict depends on a text alone, so texts are named by a digest; rows travel whole, whatever their columns are called
    name = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)
    rows = docs.select(name.alias("name"), F.struct("*").alias("row"))
    texts = rows.select(F.xxhash64("name").alias("doc_id"), F.col("row.text").alias("text"))
    gone = staged(decontaminate(texts, benchmark, window, coverage, chunk_words).where("contaminated").select(F.col("doc_id").alias("key")).distinct(), "contaminated")
    return rows.withColumn("key", F.xxhash64("name")).join(gone, "key", "left_anti").select("row.*")


def _clean_only(held, at: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = held.value
        for b in pieces(batches):
            keep = []
            for text in b.column(at).to_pylist():
                words = words_of(_bytes_of(text))
                hit = automaton.match(words)[0] if automaton else None
                n = 0 if hit is None else int(hit.sum())
                keep.append(not (n > 0 and limit * n >= len(words)))
            yield b.filter(pa.array(keep, pa.bool_()))

    return run


def remove_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the byte ranges."""
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])
