"""Quality rules as weak supervision.

Each rule votes keep (1), drop (-1) or abstains (0) on a document.  Documents with equal votes are alike to the model, so one
aggregation counts the vote patterns (at most 3 to the number of rules, whatever the corpus), and expectation-maximisation over
these counts estimates how often documents are good and how accurately each rule votes on good and on bad ones, with no label.
A document is kept if the posterior probability that it is good reaches the threshold; it need not pass every rule.

Defined results: null and empty texts have no words; a document without words fails the base; equal texts get equal verdicts;
an empty table gives no rows (the prior stays as it started); only ids and texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, id_text, pieces, staged

_SYMBOLS = bytes(range(256)).translate(None, b"#*$%&|<>")
OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_distinct long, n_upper long, n_alpha long, n_end long, n_short_lines long"
NGRAM = 8
_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_ALPHA = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122 or b >= 192))
_TAIL = bytes(b for b in range(256) if 128 <= b < 192)


def repeat_words(words: list[bytes], n: int = NGRAM) -> int:
    """Words in windows of n words that occur twice or more, first occurrences included."""
    if len(words) < n + 1:
        return 0
    with np.errstate(over="ignore"):
        h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
        w = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            w = w * np.uint64(0x9E3779B97F4A7C15) + (h[k : len(words) - n + 1 + k] ^ (h[k : len(words) - n + 1 + k] >> np.uint64(29)))
    order = np.argsort(w, kind="stable")
    same = np.concatenate([[False], w[order][1:] == w[order][:-1], [False]])
    if not same.any():
        return 0
    suspects = order[same[1:] | same[:-1]].tolist()
    seen: dict[tuple, int] = {}
    for i in suspects:  # equal hashes are compared word by word
        key = tuple(words[i : i + n])
        seen[key] = seen.get(key, 0) + 1
    edge = np.zeros(len(words) + 1, np.int64)
    for i in suspects:
        if seen[tuple(words[i : i + n])] > 1:
            edge[i] += 1
            edge[i + n] -= 1
    return int((np.cumsum(edge) > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The figures of OUT, without the id."""
    words = text.split()
    lines = text.split(b"\n")
    filled = [x for x in lines if x.strip()]
    solid = b"".join(words)
    alpha = solid.translate(None, _ALPHA)
    return (
        len(words),
        len(solid.translate(None, _TAIL)),
        len(text.translate(None, _SYMBOLS)),
        len(filled),
        len(filled) - len(set(filled)),
        repeat_words(words),
        len(set(words)),
        len(alpha.translate(None, _UPPER)),
        len(alpha),
        sum(x.rstrip().endswith((b".", b"!", b"?", b'"', b":")) for x in filled),
        sum(len(x) < 30 for x in filled),
    )


def _measure_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in OUT.split(", ")][1:]
    for b in pieces(batches):
        rows = np.array([measure(t) for t in b.column(1).to_pylist()], np.int64).reshape(-1, len(names))
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(rows[:, k]) for k in range(len(names)))], ["doc_id", *names])


def signals(docs: DataFrame) -> DataFrame:
    return arrow_map(id_text(docs), _measure_all, OUT)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes by name.  Ratios are compared as products, so no word or line gives an abstention or a clear vote, never a null."""
    c = F.col
    return {
        "length": _vote(c("n_words") >= 60, c("n_words") < 20),
        "mean_word": _vote(c("word_chars").between(3 * c("n_words"), 10 * c("n_words")) & (c("n_words") > 0), (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 14 * c("n_words"))),
        "symbols": _vote(200 * c("n_symbols") < c("n_words"), 10 * c("n_symbols") > c("n_words")),
        "dup_lines": _vote((c("n_dup_lines") == 0) & (c("n_lines") >= 3), 100 * c("n_dup_lines") > 30 * c("n_lines")),
        "repeats": _vote((c("n_repeat_words") == 0) & (c("n_words") >= 30), 100 * c("n_repeat_words") > 20 * c("n_words")),
        "variety": _vote((10 * c("n_distinct") >= 3 * c("n_words")) & (c("n_words") >= 30), (100 * c("n_distinct") < 15 * c("n_words")) & (c("n_words") >= 50)),
        "capitals": _vote((100 * c("n_upper") < 15 * c("n_alpha")), 100 * c("n_upper") > 40 * c("n_alpha")),
        "letters": _vote(100 * c("n_alpha") > 92 * c("word_chars"), 100 * c("n_alpha") < 88 * c("word_chars")),
        "line_ends": _vote(100 * c("n_end") >= 60 * c("n_lines"), (100 * c("n_end") < 10 * c("n_lines")) & (c("n_lines") >= 3)),
        "short_lines": _vote(100 * c("n_short_lines") <= 40 * c("n_lines"), (100 * c("n_short_lines") > 90 * c("n_lines")) & (c("n_lines") >= 5)),
    }


def fit(patterns: np.ndarray, counts: np.ndarray, steps: int = 80, prior: float = 0.85) -> tuple[float, np.ndarray]:
    """The share of good documents and p[class, rule], how often a rule that votes says drop, by expectation-maximisation.

    Abstaining says nothing about a document.  The start, rules that rarely drop good documents and drop two in five bad ones,
    fixes which class is the good one; it counts as 10 votes of each rule, so a rule that nearly never votes keeps it.
    """
    start = np.stack([np.full(patterns.shape[1], 0.4), np.full(patterns.shape[1], 0.02)])
    table, share = start.copy(), prior
    drop, voted = (patterns == -1).astype(float), (patterns != 0).astype(float)
    if (total := counts.sum()) <= 0:
        return share, table
    for _ in range(steps):
        good = posterior(patterns, share, table) * counts
        share = float(np.clip((good.sum() + 10 * prior) / (total + 10), 0.02, 0.98))
        for cls, weight in ((1, good), (0, counts - good)):
            table[cls] = (weight @ drop + 10 * start[cls]) / (weight @ voted + 10)
    return share, table


def gains(table: np.ndarray) -> np.ndarray:
    """What a vote to drop, an abstention and a vote to keep add to the log odds of being good, by rule."""
    keep = np.log(1 - table[1]) - np.log(1 - table[0])
    return np.stack([np.log(table[1]) - np.log(table[0]), np.zeros_like(keep), keep], 1)


def posterior(patterns: np.ndarray, share: float, table: np.ndarray) -> np.ndarray:
    odds = np.log(share) - np.log(1 - share) + gains(table)[np.arange(patterns.shape[1]), patterns + 1].sum(1)
    return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def quality_rules(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The measured figures, the votes, base_failed, quality (posterior) and kept for every row of docs."""
    votes = rules()
    figures = staged(signals(docs), "signals").select("*", *(v.alias(f"v_{k}") for k, v in votes.items()))
    names = [f"v_{k}" for k in votes]
    # the base has its own verdict: what it fails would only teach the model to see the same again
    seen = figures.where(~base_failed()).groupBy(*names).count().collect()
    patterns = np.array([[r[n] for n in names] for r in seen], np.int64).reshape(-1, len(names))
    share, table = fit(patterns, np.array([r["count"] for r in seen], float))
    odds = F.lit(float(np.log(share) - np.log(1 - share)))
    for n, gain in zip(names, gains(table), strict=True):
        odds = odds + F.when(F.col(n) == -1, float(gain[0])).when(F.col(n) == 0, float(gain[1])).otherwise(float(gain[2]))
    out = figures.withColumn("base_failed", base_failed()).withColumn("quality", 1 / (1 + F.exp(-odds)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
