"""A hidden Markov language model, trained by Baum-Welch over the whole corpus and scored by the scaled forward recursion.

Latent states emit classes, classes emit words: P(w | z) = P(class of w | z) P(w | class).  The most frequent words are classes
of their own; every other word, seen or not, falls into a class by its ending, so the state tables have a fixed size and the
second factor needs no state: with c the word's count, N and V the class's tokens and distinct words, it is
(c + 1) / (N + V + 1), one unknown word being allowed for in each class.  So the exact log likelihood of a text is the forward
recursion over its classes plus a sum over its words.

Counts cover all training documents.  Words are counted in each task, then by hash.  The classes of all tokens are staged once,
and every Baum-Welch pass runs over those of all training documents; tasks return sums of expected counts, which Spark adds by
cell; only the state tables (their size is fixed) reach the driver.  For the sums over words, counts of the `head`
most frequent words are sent to the executors (a bounded table); the other words of each document are joined with the counts
by hash, so frequent words never meet in one task and a vocabulary of any size will do.

Words are named by strong 64-bit hashes of all their bytes; of V distinct words, some V^2 / 2^65 pairs would share a count.

Defined results: a null or empty text is its end alone; without training documents every word is unknown and the states are
as started; repeated rows are scored each for itself; null ids are training documents; only ids and texts are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, arrow_map, id_text, most_frequent, pieces, staged, strong_hashes

STATES, OWN, ENDINGS, HEAD = 10, 2000, 512, 1 << 17
PASSES = 10
STRETCH = 1024
#: Stands for a text's end among word hashes.
END = 0
FLUSH = 4 << 20


#: White space as the contract has it.
_WHITE = bytes(c in BLANKS for c in range(256))


@dataclass
class Words:
    """The tokens of some texts one after the other, each text's end included: hashes, endings, and where texts begin."""

    keys: np.ndarray
    endings: np.ndarray
    edges: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Words:
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        buf = (b"\n".join(texts) + b"\n").lower() if texts else b""
        chars = np.frombuffer(buf, np.uint8)
        white = np.frombuffer(buf.translate(_WHITE), bool)
        solid = ~white
        starts = np.flatnonzero(solid & np.concatenate([[True], white[:-1]]))
        ends = np.flatnonzero(solid & np.concatenate([white[1:], [True]])) + 1
        code = np.zeros(len(starts), np.int64)
        for k in (1, 2, 3):
            at = ends - k
            code = code * 269 + np.where(at >= starts, chars[np.maximum(at, 0)].astype(np.int64) + 1, 0)
        bounds = np.searchsorted(starts, np.cumsum(sizes))
        keys = np.insert(strong_hashes(buf, starts, ends).view(np.int64), bounds, END)
        return cls(keys, np.insert(code * 40503 % 65521 % ENDINGS, bounds, 0).astype(np.int32), np.concatenate([[0], bounds + np.arange(1, len(texts) + 1)]))

    def classes(self, own: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Class of each token: its own, or that of its ending; own is sorted."""
        if not len(own):
            return OWN + self.endings
        at = np.minimum(np.searchsorted(own, self.keys), len(own) - 1)
        return np.where(own[at] == self.keys, ids[at], OWN + self.endings)

    def split(self, values: np.ndarray) -> list[np.ndarray]:
        return [values[a:b] for a, b in zip(self.edges[:-1].tolist(), self.edges[1:].tolist(), strict=True)]


@dataclass
class States:
    """start[z], step[z, z'], emit[class, z]."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray

    @classmethod
    def begin(cls, shares: np.ndarray, states: int, seed: int = 7) -> States:
        rng = np.random.default_rng(seed)
        emit = shares[:, None] * rng.gamma(2.0, 0.5, (len(shares), states))
        return cls(np.full(states, 1 / states), np.full((states, states), 0.3 / states) + 0.7 * np.eye(states), emit / emit.sum(0))

    def updated(self, cells: dict[int, float], shares: np.ndarray, prior: float = 20.0) -> States:
        k, m = len(self.start), len(shares)
        flat = np.zeros(k + k * k + m * k)
        flat[list(cells)] = list(cells.values())
        start, step, emit = flat[:k] + 1.0, flat[k : k + k * k].reshape(k, k) + 1.0, flat[k + k * k :].reshape(m, k)
        emit = emit + prior * shares[:, None]
        return States(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))


def _steps(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences by falling length: their order, all classes by position, and how many sequences each position has."""
    n = np.array([len(s) for s in seqs])
    order = np.argsort(-n, kind="stable")
    live = len(n) - np.searchsorted(np.sort(n), np.arange(n.max()), "right")
    flat, at = np.empty(int(n.sum()), np.int32), np.concatenate([[0], np.cumsum(live)])
    for rank, i in enumerate(order.tolist()):
        flat[at[: n[i]] + rank] = seqs[i]
    return order, flat, live


class _Tables:
    """The state tables with states first, so that each step runs along the sequences; float32 is enough for expected counts."""

    def __init__(self, model: States, kind: type = np.float64) -> None:
        self.start = model.start.astype(kind)[:, None]
        self.step = np.ascontiguousarray(model.step, kind)
        self.back = np.ascontiguousarray(model.step.T, kind)
        self.emit = np.ascontiguousarray(model.emit.T, kind)
        self.k = len(model.start)


def _heads(seqs: list[np.ndarray], tables: _Tables) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood and last state vector (it sums to 1) of each sequence, position by position over all of them."""
    order, flat, live = _steps(seqs)
    emit = np.take(tables.emit, flat, 1)
    out, last = np.zeros(len(seqs)), np.empty((tables.k, len(seqs)), emit.dtype)
    at, alpha = 0, None
    for a in live.tolist():
        e = emit[:, at : at + a]
        alpha = e * tables.start if alpha is None else (tables.back @ alpha[:, :a]) * e
        scale = alpha.sum(0)
        alpha /= scale
        out[:a] += np.log(scale)
        last[:, :a] = alpha
        at += a
    back, ends = np.empty(len(seqs)), np.empty_like(last)
    back[order], ends[:, order] = out, last
    return back, ends


def _transfers(seqs: list[np.ndarray], tables: _Tables, piece: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """What each stretch does to a state vector: a matrix that sums to 1, and the log of what it was divided by.  Pieces of a
    stretch are run side by side and their matrices multiplied."""
    parts = [s[a : a + piece] for s in seqs for a in range(0, len(s), piece)]
    many = np.array([-(-len(s) // piece) for s in seqs])
    matrices, logs = _pieces(parts, tables)
    at = np.cumsum(many) - many
    out, total = matrices[at], np.add.reduceat(logs, at)
    for k in range(1, int(many.max())):
        own = np.flatnonzero(many > k)
        new = out[own] @ matrices[at[own] + k]
        scale = new.sum((1, 2))
        out[own] = new / scale[:, None, None]
        total[own] += np.log(scale)
    return out, total


def _pieces(seqs: list[np.ndarray], tables: _Tables) -> tuple[np.ndarray, np.ndarray]:
    order, flat, live = _steps(seqs)
    k, emit = tables.k, np.take(tables.emit, flat, 1)
    most = emit.max(0)
    emit /= most
    logs = np.zeros(len(seqs))
    m = np.repeat(np.eye(k, dtype=emit.dtype)[:, :, None], len(seqs), 2)  # state after, state before, stretch
    out, at = np.empty((len(seqs), k, k), emit.dtype), 0
    for t, a in enumerate(live.tolist()):
        if a < m.shape[2]:
            out[a : m.shape[2]] = m[:, :, a:].transpose(2, 1, 0)
            m = np.ascontiguousarray(m[:, :, :a])
        m = (tables.back @ m.reshape(k, k * a)).reshape(k, k, a)
        m *= emit[:, None, at : at + a]
        # emissions are at most 1 here, so a few steps pass without scaling; sequences that end now are scaled now
        if t % 4 == 3 or t + 1 == len(live) or live[t + 1] < a:
            scale = m.reshape(k * k, a).sum(0)
            m /= scale
            logs[:a] += np.log(scale)
        at += a
    out[: m.shape[2]] = m.transpose(2, 1, 0)
    logs += np.bincount(_owners(live), np.log(most), len(seqs))
    back, ordered = np.empty(len(seqs)), np.empty_like(out)
    back[order], ordered[order] = logs, out
    return ordered, back


def _owners(live: np.ndarray) -> np.ndarray:
    """The sequence (by falling length) of each class that _steps() lays out."""
    return np.arange(int(live.sum())) - np.repeat(np.cumsum(live) - live, live)


def forward(seqs: list[np.ndarray], model: States, stretch: int = STRETCH) -> np.ndarray:
    """Exact natural-log likelihood of each sequence of classes (none is empty).

    The recursion runs over all sequences at once; what lies beyond `stretch` in a longer one is cut into stretches whose
    transfer matrices are found side by side and then applied in turn, so that one long text does not make many short steps.
    """
    tables = _Tables(model)
    out, vector = _heads([s[:stretch] for s in seqs], tables)
    rest = [(i, s[a : a + stretch]) for i, s in enumerate(seqs) for a in range(stretch, len(s), stretch)]
    if rest:
        matrices, logs = _transfers([part for _, part in rest], tables)
        for (i, _), m, log in zip(rest, matrices, logs.tolist(), strict=True):
            v = vector[:, i] @ m
            total = v.sum()
            out[i] += log + math.log(total)
            vector[:, i] = v / total
    return out


def _tails(seqs: list[np.ndarray], tables: _Tables) -> np.ndarray:
    """The backward vector (it sums to 1) before each sequence that ends its text."""
    order, flat, live = _steps(seqs)
    emit = np.take(tables.emit, flat, 1)
    beta, at = np.ones((tables.k, 0), emit.dtype), len(flat)
    for a in live[::-1].tolist():
        full = np.ones((tables.k, a), emit.dtype)
        full[:, : beta.shape[1]] = beta
        beta = tables.step @ (emit[:, at - a : at] * full)
        beta /= beta.sum(0)
        at -= a
    back = np.empty_like(beta)
    back[:, order] = beta
    return back


def _carried(seqs: list[np.ndarray], tables: _Tables, stretch: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The stretches of all sequences, whether each is its sequence's first, the state vector (it sums to 1) before each that is
    not, and the backward vector after each, scaled to 1 against the state vector there."""
    many = np.array([max(1, -(-len(s) // stretch)) for s in seqs])
    parts = [s[a : a + stretch] for s in seqs for a in range(0, len(s), stretch)]
    heads = np.concatenate([[0], np.cumsum(many)[:-1]])
    first = np.zeros(len(parts), bool)
    first[heads] = True
    before, after = (f((tables.k, len(parts)), tables.emit.dtype) for f in (np.zeros, np.ones))
    rest = np.flatnonzero(~first)
    if len(rest):
        long = heads[many > 1]
        before[:, long + 1] = _heads([parts[i] for i in long], tables)[1]
        last = np.append(first[1:], True)
        middle, tail = rest[~last[rest]], rest[last[rest]]
        matrices = _transfers([parts[i] for i in middle], tables)[0] if len(middle) else []
        for i, m in zip(middle.tolist(), matrices, strict=True):
            v = before[:, i] @ m
            before[:, i + 1] = v / v.sum()
        w = _tails([parts[i] for i in tail], tables)
        after[:, tail - 1] = w / (before[:, tail] * w).sum(0)
        for i, m in zip(middle[::-1].tolist(), matrices[::-1], strict=True):
            w = m @ after[:, i]
            after[:, i - 1] = w / (before[:, i] @ w)
    return parts, first, before, after


def expected(seqs: list[np.ndarray], model: States, out: np.ndarray, stretch: int = STRETCH, kind: type = np.float32) -> float:
    """Add expected counts (start, steps, emissions, flat) to out; returns the log likelihood.

    Sequences longer than `stretch` are run as stretches side by side, with the forward and backward vectors carried over the
    cuts, so the counts are those of the whole sequences.
    """
    tables = _Tables(model, kind)
    k = tables.k
    parts, first, before, after = _carried(seqs, tables, stretch)
    order, flat, live = _steps(parts)
    first, before, after = first[order], before[:, order], after[:, order]
    at = np.concatenate([[0], np.cumsum(live)]).tolist()
    emit = np.take(tables.emit, flat, 1)
    alphas, scales, live = np.empty_like(emit), np.empty(len(flat), kind), live.tolist()
    alpha = None
    for t, a in enumerate(live):
        e = emit[:, at[t] : at[t + 1]]
        alpha = e * np.where(first, tables.start, tables.back @ before) if alpha is None else (tables.back @ alpha[:, :a]) * e
        scale = alpha.sum(0)
        alpha /= scale
        alphas[:, at[t] : at[t + 1]], scales[at[t] : at[t + 1]] = alpha, scale
    steps, beta = np.zeros((k, k)), after[:, : live[-1]]
    emit /= scales
    for t in range(len(live) - 1, -1, -1):
        here = slice(at[t], at[t + 1])
        weighted = emit[:, here] * beta
        # the vectors before first stretches are 0: no step leads to a text's start
        steps += (alphas[:, at[t - 1] : at[t - 1] + live[t]] if t else before) @ weighted.T
        alphas[:, here] *= beta  # from behind, each position once it is done: expected states
        if t:
            beta = after[:, : live[t - 1]].copy()
            beta[:, : live[t]] = tables.step @ weighted
    m = model.emit.shape[0]
    out[:k] += alphas[:, : live[0]][:, first].sum(1, dtype=np.float64)
    out[k : k + k * k] += (steps * model.step).ravel()
    table = out[k + k * k :].reshape(m, k)
    for z in range(k):
        table[:, z] += np.bincount(flat, alphas[z], m)
    return float(np.log(scales, dtype=np.float64).sum())


def _groups(batches: Iterator[pa.RecordBatch], size: int = 3 << 19) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Batches cut to about so many bytes, and their tokens."""
    for b in pieces(batches, size):
        yield b, Words.of(b.column(1).to_pylist())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def emit(held: list[Words]) -> pa.RecordBatch:
        keys, at, n = np.unique(np.concatenate([w.keys for w in held]), return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n), pa.array(np.concatenate([w.endings for w in held])[at])], ["h", "n", "ending"])

    held, seen = [], 0
    for _, words in _groups(batches):
        held.append(words)
        seen += len(words.keys)
        if seen > FLUSH:
            yield emit(held)
            held, seen = [], 0
    if held:
        yield emit(held)


def _code(held):
    """The classes of each text's tokens, as 16-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids = held.value
        for _, words in _groups(batches):
            seqs = words.split(words.classes(own, ids).astype("<u2"))
            yield pa.RecordBatch.from_arrays([pa.array([s.tobytes() for s in seqs], pa.binary())], ["classes"])

    return run


def _expect(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        k = len(model.start)
        out, likely = np.zeros(k + k * k + model.emit.size), 0.0
        for b in pieces(batches, 1 << 20, "classes"):
            likely += expected([np.frombuffer(c, "<u2") for c in b.column(0).to_pylist()], model, out)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([likely, *out[at].tolist()], pa.float64())], ["cell", "value"])

    return run


DOC = "key long, doc_id long, n_tokens long, known long, logs double, outer double, hmm double, tail array<long>, times array<int>"


def _score(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids, model, head, head_n, outer = held.value
        head_log = np.log10(head_n + 1.0)
        key = TaskContext.get().partitionId() << 33
        for b, words in _groups(batches):
            n = len(words.edges) - 1
            classes = words.classes(own, ids)
            hmm = forward(words.split(classes), model) / math.log(10)
            doc = np.repeat(np.arange(n), np.diff(words.edges))
            at = np.minimum(np.searchsorted(head, words.keys), max(len(head) - 1, 0))
            there = head[at] == words.keys if len(head) else np.zeros(len(doc), bool)
            known = np.bincount(doc[there], minlength=n)
            logs = np.bincount(doc[there], head_log[at[there]] if len(head) else None, minlength=n)
            rare, owner = words.keys[~there], doc[~there]
            order = np.lexsort((rare, owner))
            rare, owner = rare[order], owner[order]
            new = np.flatnonzero(np.concatenate([[True], (rare[1:] != rare[:-1]) | (owner[1:] != owner[:-1])])) if len(rare) else np.empty(0, np.int64)
            times = np.diff(np.concatenate([new, [len(rare)]])).astype(np.int32)
            lists = np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=n))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(key, key + n)), b.column(0).cast(pa.int64()), pa.array(np.diff(words.edges)), pa.array(known.astype(np.int64)), pa.array(logs.astype(np.float64)),
                    pa.array(np.bincount(doc, outer[classes], minlength=n)), pa.array(hmm), pa.ListArray.from_arrays(pa.array(lists), pa.array(rare[new])), pa.ListArray.from_arrays(pa.array(lists), pa.array(times)),
                ],
                [c.split()[0] for c in DOC.split(", ")],
            )
            key += n

    return run


@dataclass
class Model:
    """own, ids: hashes (sorted) of words with classes of their own, and these; head, head_n: hashes (sorted) and counts of
    frequent words; outer[class]: what a token of the class takes off its word's log10(c + 1); passes: log likelihood of the
    training documents before each pass."""

    own: np.ndarray
    ids: np.ndarray
    states: States
    head: np.ndarray
    head_n: np.ndarray
    outer: np.ndarray
    counts: DataFrame
    tokens: int
    distinct: int
    passes: list[float]


def fit(docs: DataFrame, states: int = STATES, head: int = HEAD, passes: int = PASSES, sample_passes: int = 0) -> Model:
    """sample_passes are more passes; they too run over all documents."""
    spark = docs.sparkSession
    texts = id_text(docs)
    counts = staged(arrow_map(texts, _count, "h long, n long, ending int").groupBy("h").agg(F.sum("n").alias("n"), F.min("ending").alias("ending")), "word-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = most_frequent(counts, "n", head).toPandas().sort_values(["n", "h"], ascending=[False, True], ignore_index=True)
    mine = top["h"].head(OWN).to_numpy(np.int64)
    order = np.argsort(mine)
    own, ids = mine[order], order.astype(np.int32)
    by_end = {r["ending"]: (r["n"], r["v"]) for r in counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    n, v = (np.array([by_end.get(e, (0, 0))[k] for e in range(ENDINGS)], float) for k in (0, 1))
    for e, c in zip(top["ending"].head(OWN), top["n"].head(OWN), strict=True):
        n[e] -= c
        v[e] -= 1
    outer = np.concatenate([np.zeros(OWN), -np.log10(n + v + 1)])
    # a word with a class of its own needs no second factor: its log10(c + 1) is taken off again
    outer[: len(own)] = -np.log10(top["n"].head(OWN).to_numpy(float) + 1)
    mass = np.concatenate([np.pad(top["n"].head(OWN).to_numpy(float), (0, OWN - len(own))), n + 1])
    shares = mass / mass.sum()
    model, likely = States.begin(shares, states), []
    coded = staged(arrow_map(texts, _code(spark.sparkContext.broadcast((own, ids))), "classes binary"), "hmm-classes")
    for _ in range(passes + sample_passes if total["n"] else 0):
        sums = arrow_map(coded, _expect(spark.sparkContext.broadcast(model)), "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
        cells = {r["cell"]: r["value"] for r in sums.collect()}
        likely.append(cells.pop(-1, 0.0))
        model = model.updated(cells, shares)
    order = np.argsort(top["h"].to_numpy(np.int64))
    return Model(own, ids, model, top["h"].to_numpy(np.int64)[order], top["n"].to_numpy(float)[order], outer, counts, int(total["n"]), int(total["v"]), likely)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast((model.own, model.ids, model.states, model.head, model.head_n, model.outer))
    rows = staged(arrow_map(id_text(docs), _score(held), DOC), "hmm-scores")
    tail = rows.select("key", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("key", F.col("t.tail").alias("h"), F.col("t.times").alias("times"))
    found = tail.join(model.counts.select("h", "n"), "h")
    sums = found.groupBy("key").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("more_logs"))
    both = rows.drop("tail", "times").join(sums, "key", "left").na.fill(0, ["more"]).na.fill(0.0, ["more_logs"])
    logs = F.col("logs") + F.col("more_logs")
    return both.select(
        "doc_id", "n_tokens", (F.col("known") + F.col("more")).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(math.log10(model.tokens + model.distinct + 1))).alias("base_score"), (F.col("hmm") + logs + F.col("outer")).alias("score"),
    )


def in_training(mod: int = 7, held_out: int = 2) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % F.lit(mod) != held_out
