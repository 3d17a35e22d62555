"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text are few and dense: densities of learned lexicon entries (whole words and word beginnings, after folding
digits and signs that stand for letters), the same near second-person words, capitals, punctuation and obfuscation rates, and
lengths.  The lexicon is counted over the labelled sample in Spark: entries that toxic documents hold far more often than
others, at most `lexicon` of them.  Features for training use the lexicon of the other folds, so that no document is described
by its own label.  Trees are fitted on histograms of the features, and pool-adjacent-violators maps their out-of-fold sums to
probabilities.  Only features of at most `max_rows` labelled documents ever come to the driver; scoring is one pass over all.

Defined results: a null or empty text is scored (by its empty features); repeated rows get equal scores; labels without a
document, null labels and documents without labels are not learned from, of several labels of a document the largest holds;
with no labels, or labels of one kind only, every score is 0 or the share of toxic labels; only ids and texts are read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, crc_bucket, id_text, pieces, staged

#: Most labelled rows that are learnt from; the least share of toxic documents that hold an entry of the lexicon.
MAX_ROWS, SHARE, FOLDS = 20_000, 0.004, 3
#: Fixed list: second-person words of the languages at hand.
SECOND = frozenset("you your yours u ur du dich dir dein deine ihr euch sie ihnen tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros su sus".split())
#: Fixed table: signs and digits that stand for letters.
LEET = str.maketrans("013457@$!|", "oieastasil")
_TOKEN = re.compile(r"[^\s.,;:?\"'()\[\]{}<>]+")
_INNER = re.compile(r"[a-z][^a-z\s]+[a-z]")
FEATURES = (
    "log_words", "word_hits", "word_density", "stem_hits", "stem_density", "top_weight", "sum_weight", "weight_density", "distinct_hits", "near_second",
    "second_density", "capitals", "capital_words", "punctuation", "exclamations", "obfuscation", "folded_hits", "mean_word",
)


def fold(token: str) -> str:
    """Lower case, letters for the signs that stand for them, inner separators dropped; plain words pass unchanged."""
    low = token.lower()
    if low.isalpha():
        return low
    return re.sub(r"[\W\d_]+", "", low.rstrip("!|").translate(LEET))


def entries(token: str) -> tuple[str, ...]:
    """What a folded token can match: itself (=word) and its beginnings (word of 4 to 6 letters)."""
    return ("=" + token, *(token[:n] for n in (4, 5, 6) if len(token) >= n))


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    tokens = _TOKEN.findall(text)
    n = len(tokens)
    word = stem = folded = near = second = caps = odd = 0
    top = total = 0.0
    seen, last_second = set(), -100
    get = lexicon.get
    for k, token in enumerate(tokens):
        low = token if token.isalpha() and token.islower() else fold(token)
        changed = low != token and not token.isalpha() and low != token.lower()
        odd += changed and bool(_INNER.search(token.lower()))
        caps += len(token) > 1 and token.isupper()
        if low in SECOND:
            second += 1
            last_second = k
        weight = get("=" + low, 0.0)
        exact = weight > 0
        if len(low) >= 4:
            weight = max(weight, get(low[:4], 0.0), get(low[:5], 0.0), get(low[:6], 0.0))
        if weight:
            word += exact
            stem += not exact
            folded += changed
            near += k - last_second <= 5
            top, total = max(top, weight), total + weight
            seen.add(low)
    d, chars = max(n, 1), max(len(text), 1)
    solid = len(text) - text.count(" ") - text.count("\n")
    return [
        math.log1p(n), math.log1p(word), word / d, math.log1p(stem), stem / d, top, math.log1p(total), total / d, math.log1p(len(seen)), near / d,
        second / d, sum(map(str.isupper, text)) / chars, caps / d, sum(text.count(c) for c in ".,;:?!") / chars, text.count("!") / chars, odd / d, folded / d, solid / d,
    ]


@dataclass
class Trees:
    """Boosted regression trees for the log odds, each a list of (feature, cut, left, right, value)."""

    base: float = 0.0
    trees: list[list[tuple[int, float, int, int, float]]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            f, cut, left, right, value = (np.array(c) for c in zip(*tree, strict=True))
            node = np.zeros(len(x), np.int64)
            while len(rows := np.flatnonzero(f[node] >= 0)):
                at = node[rows]
                node[rows] = np.where(x[rows, f[at]] <= cut[at], left[at], right[at])
            out += value[node]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss on quantile bins."""
    model = Trees(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1)
    margin = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        tree: list[list] = []

        def grow(rows: np.ndarray, level: int) -> int:
            at = len(tree)
            gs, hs = g[rows].sum(), h[rows].sum()
            tree.append([-1, 0.0, -1, -1, float(-rate * gs / (hs + l2))])
            best = (1e-6, -1, 0)
            if level < depth and hs >= 2 * least:
                for k, e in enumerate(edges):
                    if len(e):
                        gl = np.cumsum(np.bincount(binned[rows, k], g[rows], len(e) + 1))[:-1]
                        hl = np.cumsum(np.bincount(binned[rows, k], h[rows], len(e) + 1))[:-1]
                        gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                        gain[(hl < least) | (hs - hl < least)] = 0
                        if gain[c := int(gain.argmax())] > best[0]:
                            best = (float(gain[c]), k, c)
            if best[1] >= 0:
                under = binned[rows, best[1]] <= best[2]
                left, right = grow(rows[under], level + 1), grow(rows[~under], level + 1)
                tree[at] = [best[1], float(edges[best[1]][best[2]]), left, right, 0.0]
            return at

        grow(np.arange(len(y)), 0)
        if len(tree) == 1:
            break
        model.trees.append([tuple(n) for n in tree])
        margin = margin + Trees(0.0, model.trees[-1:]).margin(x)
    return model


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (margin, probability), both growing; each block is smoothed by a hundredth of a vote."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # votes, rows, least and largest margin
    for m, v in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        if blocks and blocks[-1][3] == m:
            blocks[-1][0] += v
            blocks[-1][1] += 1
        else:
            blocks.append([v, 1, m, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2], b[3]]
    knots, values = [], []
    for votes, rows, low, high in blocks:
        p = (votes + 0.01) / (rows + 0.02)
        knots += [low, high] if high > low else [low]
        values += [p, p] if high > low else [p]
    return np.array(knots), np.maximum.accumulate(np.array(values)) if values else np.array(values)


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees
    knots: np.ndarray
    values: np.ndarray

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(texts), float(self.values[0]) if len(self.values) else 0.0)
        x = np.array([features(t.decode("utf-8", "replace"), self.lexicon) for t in texts]).reshape(-1, len(FEATURES))
        return np.clip(np.interp(self.trees.margin(x), self.knots, self.values), 0, 1)


def _fold_of(doc_id: object) -> int:
    return zlib.crc32(f"fold {doc_id}".encode()) % FOLDS


def _entries_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        out: dict[str, list] = {"entry": [], "fold": [], "toxic": []}
        for doc_id, text, toxic in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            found = {e for t in {fold(t) for t in _TOKEN.findall(text.decode("utf-8", "replace"))} if len(t) >= 2 for e in entries(t)}
            out["entry"] += found
            out["fold"] += [_fold_of(doc_id)] * len(found)
            out["toxic"] += [toxic] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(out["entry"], pa.string()), pa.array(out["fold"], pa.int32()), pa.array(out["toxic"], pa.int32())], list(out))


def _features_all(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicons = held.value
        for b in pieces(batches):
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            rows = [features(t.decode("utf-8", "replace"), lexicons[_fold_of(i)]) for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([_fold_of(i) for i in ids], pa.int32()), b.column(2).cast(pa.int32()), pa.array(rows, pa.list_(pa.float64()))], ["fold", "toxic", "x"])

    return run


def _score_all(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(held.value.score(b.column(1).to_pylist()))], ["doc_id", "score"])

    return run


def _filter_all(held, at: int, limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts = [b"" if t is None else t.encode() for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(held.value.score(texts) < limit))

    return run


def _least(pos: int) -> int:
    """In how many toxic documents of pos an entry of the lexicon is at least: so a lexicon grows with what documents hold, not
    with their number."""
    return max(2, round(SHARE * pos))


def _lexicon(counts: dict[str, tuple[int, int]], pos: int, neg: int) -> dict[str, float]:
    """Entries by the log of the ratio of their shares among toxic and other documents (half a document added to each)."""
    least, out = _least(pos), {}
    for e, (p, n) in counts.items():
        if p >= least:
            w = math.log((p + 0.5) / (pos + 1)) - math.log((n + 0.5) / (neg + 1))
            if w > 2.0 and p > n * 0.2:
                out[e] = w
    return out


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, max_rows: int = MAX_ROWS) -> Model:
    """Learn from the labelled documents for which `learn` (over doc_id) holds; at most about max_rows of them, picked by a hash of the id."""
    spark = docs.sparkSession
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (F.lit(True) if learn is None else learn))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = usable.count()
    if total > max_rows:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / total))
    # at most about max_rows pairs of numbers: small enough to send to every executor
    sample = staged(id_text(docs).join(F.broadcast(usable), "doc_id").select("doc_id", "text", "toxic"), "toxic-sample").coalesce(64)
    sizes = {(r["fold"], r["toxic"]): r["n"] for r in arrow_map(sample, _sizes_all, "fold int, toxic int").groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = ([sizes.get((f, v), 0) for f in range(FOLDS)] for v in (1, 0))
    if not sum(pos) or not sum(neg):
        share = sum(pos) / max(1, sum(pos) + sum(neg))
        return Model({}, Trees(), np.empty(0), np.array([share]))
    counted = arrow_map(sample, _entries_all, "entry string, fold int, toxic int").groupBy("entry")
    aggs = [F.count(F.when((F.col("fold") == f) & (F.col("toxic") == v), 1)).alias(f"c{v}{f}") for v in (0, 1) for f in range(FOLDS)]
    # what no lexicon, of all folds or of all but one, can hold stays where it is
    usable_by = F.lit(False)
    for own in (range(FOLDS), *([g for g in range(FOLDS) if g != f] for f in range(FOLDS))):
        p, n = (sum((F.col(f"c{v}{g}") for g in own), F.lit(0)) for v in (1, 0))
        usable_by = usable_by | ((p >= _least(sum(pos[g] for g in own))) & (n < 5 * p))
    rows = counted.agg(*aggs).where(usable_by).collect()
    full = _lexicon({r["entry"]: (sum(r[f"c1{f}"] for f in range(FOLDS)), sum(r[f"c0{f}"] for f in range(FOLDS))) for r in rows}, sum(pos), sum(neg))
    others = []
    for f in range(FOLDS):
        rest = [g for g in range(FOLDS) if g != f]
        others.append(_lexicon({r["entry"]: (sum(r[f"c1{g}"] for g in rest), sum(r[f"c0{g}"] for g in rest)) for r in rows}, sum(pos[g] for g in rest), sum(neg[g] for g in rest)))
    got = arrow_map(sample, _features_all(spark.sparkContext.broadcast(others)), "fold int, toxic int, x array<double>").toPandas()
    x, y, folds = np.array(got["x"].tolist()).reshape(-1, len(FEATURES)), got["toxic"].to_numpy(float), got["fold"].to_numpy()
    order = np.lexsort((*x.T[::-1], y))
    x, y, folds = x[order], y[order], folds[order]
    margin = np.zeros(len(y))
    for f in range(FOLDS):
        own = folds == f
        if own.any() and 0 < y[~own].sum() < (~own).sum():
            margin[own] = boost(x[~own], y[~own]).margin(x[own])
    knots, values = isotonic(margin, y)
    return Model(full, boost(x, y), knots, values)


def _sizes_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([_fold_of(i) for i in b.column(0).to_pylist()], pa.int32()), b.column(2).cast(pa.int32())], ["fold", "toxic"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for every row of docs."""
    return arrow_map(id_text(docs), _score_all(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model, limit: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, whose text scores below the limit; no row travels."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return arrow_map(docs, _filter_all(held, docs.columns.index("text"), limit), docs.schema)


def held_out(mod: int = 3, remainder: int = 1) -> Column:
    return crc_bucket("doc_id", mod) == remainder
