"""How filters of documents interact: what each removes in every order they can be applied in, and their Shapley shares.

Each document is reduced to a mask, one bit for each filter that it fails, and the documents to counts by part, mask and label
(the cells): at most 2^filters cells a part.  All orders are then visited by adjacent transpositions, each order differing
from the one before in two neighbours.  A swap of a before b moves the documents that fail both and nothing earlier from what
one removes to what the other removes; all other steps stay as they are, so a swap takes one look at the cells.  The Shapley
value of a filter is the sum, along the walk, of what it removes.

Copies: a document fails E if a smaller doc_id has the same text (by SHA-256), wherever.  The first documents of all texts are
found by a minimum for each text and a join on text and id together, so no group of copies meets in one task; texts do not
move.

Defined results: null text is as empty text, null source as empty string; a document without an id neither fails E nor makes
another fail it; rows that share id and text are no copies of each other and each counts; a label that is missing counts as
not good and not toxic, and if there are several of one id, any will do; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, pieces, staged

#: Filters by letter; each is given the text and its words and says whether the text fails.  E, copies, is found by a join.
FILTERS: dict[str, Callable[[bytes, list[bytes]], bool]] = {
    "A": lambda text, words: len(words) < 50,
    "B": lambda text, words: 100 * len(set(words)) < 65 * len(words),
    "C": lambda text, words: 100 * (len(text) - len(text.translate(None, _CAPITALS))) > 5 * len(text.translate(None, _INNER)),
    "D": lambda text, words: len(text.translate(None, _SIGNS)) < len(text),
}
COPIES = "E"
_CAPITALS = bytes(range(65, 91))
#: Bytes that are not the first of a character.
_INNER = bytes(range(0x80, 0xC0))
_SIGNS = b"#$%&*|"
OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        masks, names = [], []
        for text in b.column(b.schema.get_field_index("text")).to_pylist():
            words = text.split()  # of bytes: by the same blanks as the contracts'
            masks.append(sum(fails(text, words) << k for k, fails in enumerate(FILTERS.values())))
            names.append(hashlib.sha256(text).digest())
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(masks, pa.int32()), pa.array(names, pa.binary())], ["doc_id", "part", "mask", "name"])


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask for every row of docs; bit k of mask says that filter k of FILTERS, or after those COPIES, fails."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = staged(arrow_map(rows, _masks, "doc_id long, part string, mask int, name binary"), "masks")
    first = rows.where(F.col("doc_id").isNotNull()).groupBy("name").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    rows = rows.join(first, ["name", "doc_id"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.select("doc_id", "part", (F.col("mask") + copy.cast("int") * (1 << len(FILTERS))).alias("mask"))


def cells(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """part, cells: for each part the counts of documents by mask, as structs of mask, n, good, toxic."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = marked.join(known, "doc_id", "left")
    counted = rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))


def transpositions(n: int) -> Iterator[int]:
    """The places j whose neighbours j and j + 1 change places, from one order of n things to the next, through all orders.

    The last thing sweeps from end to end; at each end the others make one step of their own walk.
    """
    if n < 2:
        return
    down = True
    for other in (*transpositions(n - 1), None):
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        if other is not None:
            # a thing that waits at the left end pushes the places of the others one to the right
            yield other + 1 if down else other
        down = not down


def audit(counts: np.ndarray, n: int) -> Iterator[tuple[list[int], np.ndarray]]:
    """Every order of n filters (numbers) with what each step removes, as an array of steps by columns of counts.

    counts has a row for each mask of 2^n.  The array is the walk's own: copy what is to be kept.
    """
    masks = np.arange(1 << n)
    order, removed = list(range(n)), np.empty((n, counts.shape[1]), counts.dtype)

    def fails_first(all_of: int, none_of: int) -> np.ndarray:
        return counts[(masks & all_of == all_of) & (masks & none_of == 0)].sum(axis=0)

    before = 0
    for step, f in enumerate(order):
        removed[step] = fails_first(1 << f, before)
        before |= 1 << f
    yield order, removed
    for j in transpositions(n):
        a, b = order[j], order[j + 1]
        both = fails_first(1 << a | 1 << b, sum(1 << f for f in order[:j]))
        order[j], order[j + 1] = b, a
        # b now comes first and takes what both remove; a is left with the rest of its own
        removed[[j, j + 1]] = removed[[j + 1, j]]
        removed[j] += both
        removed[j + 1] -= both
        yield order, removed


def _walk(letters: str):
    n = len(letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts = np.zeros((1 << n, 3), np.int64)
                for c in found:
                    counts[c["mask"]] += (c["n"], c["good"], c["toxic"])
                masks = np.arange(1 << n)
                fails = [int(counts[masks >> f & 1 == 1, 0].sum()) for f in range(n)]
                unique = [int(counts[1 << f, 0]) for f in range(n)]
                shapley, rows = np.zeros(n, np.int64), []
                for order, removed in audit(counts, n):
                    left = int(counts[:, 0].sum())
                    name = "".join(letters[f] for f in order)
                    for step, f in enumerate(order):
                        gone, good, toxic = removed[step].tolist()
                        left -= gone
                        shapley[f] += gone
                        rows.append([name, step + 1, left, gone, fails[f] - gone, unique[f], good, toxic, f])
                columns = list(zip(*rows, strict=True))
                shares = [int(shapley[f]) for f in columns.pop()]
                types = (pa.string(), pa.int32(), *[pa.int64()] * 6)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(rows), pa.string()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True)), pa.array(shares, pa.int64())],
                    ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"],
                )

    return run


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (source), order of the filters and step (module docstring)."""
    return arrow_map(cells(masks(docs), labels), _walk("".join(FILTERS) + COPIES), OUT)
