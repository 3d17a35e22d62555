"""Exact n-gram Jaccard join with set relations: index lists, skipping, and answers derived from similar sets.

A document is the set of its distinct word shingles (64-bit hashes).  Documents with equal sets are one class and only its
representative takes part.  Sets of similarity t or more share l of their first |x| - ceil(t |x|) + l shingles in any common
order; the order here puts shingles that many documents hold last (counts are gathered in the tasks, the `hot` most frequent
are sent to all), so the index lists of these prefixes are short.  With l = shared(|x|), a set in fewer lists than that has no
partner: it is skipped before its lists are looked at, which leaves little but near copies.  Short shingles meet by chance the
more often the larger the corpus is, so prefixes go deeper for them.

No list is expanded into pairs.  The smallest set of a list is its pivot, and every other set of the list is compared with it
once: the overlap, which of the pivot's shingles are missing (a bit map) and which shingles are added.  From these relations
the answers of a set follow from those of the pivot without looking at the sets again: |x & y| = |p| - |missing of x or y| +
|added of x and y|.  Sets already in one component need no answer; only sets outside their pivot's component are compared
with the others of its frame, in blocks of at most `block` by `block`, and a block returns a forest, not pairs.  Sets too far
from the pivot for these relations (below FAR) stay in their lists; these are scanned in order of size, blocks of the list
whose sizes and positions allow no link being skipped, and what is left is compared directly.  Links are lost nowhere.

Before whole sets are compared, sketches are: counts of a set's shingles by range of hash.  Two sets differ in at least as many
shingles as their counts do, so a pair whose sketches are too far apart is no link, and chance pairs cost some bytes each.

Defined results: null and empty texts have no set, link with nothing and are components of their own; a text of fewer words
than a shingle is one shingle; rows that share an id are one document, with the set of the largest hash where texts differ (each
row has its own n_shingles); rows without an id keep a null component and link nothing; an empty table gives no rows; only
ids and texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SMALL, arrow_map, id_text, is_empty, most_frequent, partitions, pieces, release, small, staged
from .components import components

HOT, HOT_LEAST = 1 << 18, 2
#: Shingles counted at once in a task.
FLUSH = 1 << 20
#: From so many counted documents on, a shingle's list is summed up and joined instead of lying in one task.
LONG = 4096
BLOCK = 512
#: Similarity to the pivot below which a set stays in its lists, in hundredths.
FAR = 50


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles (A-Z lower-cased); of all words if there are fewer."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        if len(words) < n:
            out = np.array([len(words)], np.uint64)
            for k in range(len(words)):
                out = (out ^ h[k]) * np.uint64(0x9E3779B97F4A7C15)
        else:
            out = np.full(len(words) - n + 1, n, np.uint64)
            for k in range(n):
                out = ((out >> np.uint64(29)) ^ out ^ h[k : len(words) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def shared(n: int, num: int, den: int, depth: int) -> int:
    """How many shingles of their prefixes a set of n and a partner no smaller share at least; grows with n and with depth."""
    overlap = -(-num * n // den)
    return min(overlap, max(8, (n - overlap) * depth // 2 + 1))


def prefix_size(n: int, num: int, den: int, depth: int) -> int:
    return n - -(-num * n // den) + shared(n, num, den, depth)


def linked(both, nx, ny, num: int, den: int):
    return den * both >= num * (nx + ny - both)


def _common(n: int):
    """Shingles that several documents of a task hold, with how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def emit():
            u, c = np.unique(np.concatenate(held), return_counts=True)
            often = c >= HOT_LEAST
            return pa.RecordBatch.from_arrays([pa.array(u[often].view(np.int64)), pa.array(c[often])], ["tok", "n"])

        for b in pieces(batches):
            for text in b.column(1).to_pylist():
                held.append(shingles(text, n))
                size += len(held[-1])
            if size > FLUSH:
                yield emit()
                held, size = [], 0
        if held:
            yield emit()

    return run


SETS = "doc_id long, n int, set_hash binary, sketch binary, brief binary, prefix array<long>, short int"
#: Buckets of a brief sketch.
BRIEF = 64


def sketch(s: np.ndarray) -> np.ndarray:
    """How many shingles fall into each of about |s| / 8 buckets (a power of two, BRIEF at least), modulo 256."""
    bits = max(BRIEF.bit_length() - 1, (len(s) - 1).bit_length() - 3) if len(s) else BRIEF.bit_length() - 1
    return np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint8)


def folded(k: np.ndarray, size: int) -> np.ndarray:
    """A sketch with fewer buckets."""
    return k.reshape(size, -1).sum(1, dtype=np.uint8)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """No more than the number of shingles that only one of two sets has (rows of sketches with equally many buckets)."""
    return np.abs((a - b).view(np.int8).astype(np.int32)).sum(-1)


def _prefixes(n: int, num: int, den: int, depth: int, held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, rank = held.value
        for b in pieces(batches):
            sizes, names, sketches, briefs, prefixes, short = [], [], [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingles(text, n)
                sizes.append(len(s))
                names.append(xxhash.xxh3_128_digest(s.tobytes()))
                k = sketch(s)
                sketches.append(k.tobytes())
                briefs.append(folded(k, BRIEF).tobytes())
                # sets of fewer than 1 / (1 - t) - 1 shingles link with nothing but their equals
                if (len(s) + 1) * (den - num) < den:
                    prefixes.append([])
                    short.append(0)
                    continue
                at = np.minimum(np.searchsorted(hot, s), max(len(hot) - 1, 0))
                often = np.where(hot[at] == s, rank[at], 0) if len(hot) else np.zeros(len(s), np.int64)
                order = np.lexsort((s, often))[: prefix_size(len(s), num, den, depth)]
                prefixes.append(s[order].view(np.int64))
                short.append(int((often[order] < LONG).sum()))
            columns = [b.column(0).cast(pa.int64()), pa.array(sizes, pa.int32()), *(pa.array(v, pa.binary()) for v in (names, sketches, briefs)), pa.array(prefixes, pa.list_(pa.int64())), pa.array(short, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SETS.split(", ")])

    return run


PAIR = "pivot long, node long, n_pivot int, n int, most int"


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The largest overlap that the sketches of two sets allow."""
    for b in batches:
        most = []
        for x, y, nx, ny in zip(*(b.column(k).to_pylist() for k in (4, 5, 2, 3)), strict=True):
            x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            size = min(len(x), len(y))
            most.append((nx + ny - int(distance(folded(x, size), folded(y, size)))) // 2)
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(most, pa.int32())], [c.split()[0] for c in PAIR.split(", ")])


FULL = "pivot long, node long, set_hash binary, s binary"


def _sets(n: int, most: int = 8 << 20):
    """Each document's set, once for each pivot that it is compared with (about `most` bytes at once)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [c.split()[0] for c in FULL.split(", ")])

        for b in pieces(batches, most):
            rows, size = [], 0
            for node, text, pivots in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                s = shingles(text, n).tobytes()
                name = xxhash.xxh3_128_digest(s)
                for pivot in pivots:
                    rows.append((pivot, node, name, s))
                    size += len(s)
                    if size > most:
                        yield emit()
                        rows, size = [], 0
            if rows:
                yield emit()

    return run


RELATION = "pivot long, node long, both int, n_pivot int, n int, missing binary, added binary"


def _relate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlap of each set with its pivot; if it is near, the pivot's shingles that it lacks as bits and its own that the pivot lacks."""
    for b in pieces(batches, column="s"):
        out: dict[str, list] = {k: [] for k in ("both", "n_pivot", "n", "missing", "added")}
        for p, s in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            p, s = np.frombuffer(p, np.uint64), np.frombuffer(s, np.uint64)
            lacks = ~np.isin(p, s, assume_unique=True)
            out["both"].append(len(p) - int(lacks.sum()))
            out["n_pivot"].append(len(p))
            out["n"].append(len(s))
            both = out["both"][-1]
            near = 100 * both >= FAR * (len(p) + len(s) - both)
            out["missing"].append(np.packbits(lacks).tobytes() if near else b"")
            out["added"].append(s[~np.isin(s, p, assume_unique=True)].tobytes() if near else b"")
        types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True))], ["pivot", "node", *out])


class Forest:
    """Union-find over numbers."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _bits(blobs, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in blobs), np.uint8).reshape(len(blobs), width).copy()


def _added_bits(own: list[np.ndarray], toks: np.ndarray) -> np.ndarray:
    """A bit map over toks (sorted) for each array of shingles."""
    out = np.zeros((len(own), -(-max(len(toks), 1) // 64) * 8), np.uint8)
    for k, x in enumerate(own):
        at = np.searchsorted(toks, x)
        at = at[toks[np.minimum(at, len(toks) - 1)] == x] if len(toks) else at[:0]
        np.bitwise_or.at(out[k], at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    return out.view(np.uint64)


def frame_links(loose: pd.DataFrame, every: pd.DataFrame, num: int, den: int) -> list[tuple[int, int]]:
    """A forest of the links between loose sets and every set of one pivot's frame (or blocks of both), by relations alone."""
    width = -(-max(map(len, [*loose["missing"], *every["missing"]])) // 8) * 8
    a, b = _bits(loose["missing"], width).view(np.uint64), _bits(every["missing"], width).view(np.uint64)
    n_pivot, na, nb = int(every["n_pivot"].iloc[0]), loose["n"].to_numpy(np.int64), every["n"].to_numpy(np.int64)
    ids = {v: k for k, v in enumerate(dict.fromkeys([*loose["node"], *every["node"]]))}
    forest, out = Forest(len(ids)), []
    same = {}
    for node, comp in zip([*loose["node"], *every["node"]], [*loose["component"], *every["component"]], strict=True):
        forest.join(ids[node], same.setdefault(comp, ids[node]))
    own, others = ([np.frombuffer(x, np.uint64) for x in f["added"]] for f in (loose, every))
    toks = np.intersect1d(np.concatenate(own), np.concatenate(others))
    more, extra = _added_bits(own, toks), _added_bits(others, toks)
    rows, columns = loose["node"].tolist(), every["node"].tolist()
    home = np.array([forest.find(ids[y]) for y in columns])
    for i, x in enumerate(rows):
        apart = np.flatnonzero(home != forest.find(ids[x]))
        if not len(apart):
            continue
        both = n_pivot - np.bitwise_count(a[i] | b[apart]).sum(1, dtype=np.int64) + np.bitwise_count(more[i] & extra[apart]).sum(1, dtype=np.int64)
        found = apart[linked(both, na[i], nb[apart], num, den)]
        for k in found.tolist():
            if forest.join(ids[x], ids[columns[k]]):
                out.append((x, columns[k]))
        if len(found):
            home = np.array([forest.find(h) for h in home.tolist()])
    return out


def _frame(num: int, den: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        loose, every = pdf[pdf["loose"]], pdf[~pdf["loose"]]
        out = frame_links(loose, every, num, den) if len(loose) and len(every) else []
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _spread(counts: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers, each counts[row] times, and the number of the time; about `most` of them at once."""
    total = np.cumsum(counts)
    at = 0
    while at < len(counts):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        row = np.repeat(np.arange(at, end), counts[at:end])
        yield row, np.arange(len(row)) - np.repeat(total[at:end] - counts[at:end] - (total[at - 1] if at else 0), counts[at:end])
        at = end


def list_pairs(group: np.ndarray, n: np.ndarray, pos: np.ndarray, near: np.ndarray, brief: np.ndarray, num: int, den: int, block: int = 32, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs in index lists that sizes, positions and sketches allow, at least one of them far from its pivot.

    Rows are sorted by list, size and position.  Of each block of a list the smallest size and the smallest position are known,
    so a block without a possible partner is skipped whole; only the rows of other blocks are looked at one by one.
    """
    rows = np.arange(len(n))
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    end = np.repeat(np.append(first[1:], len(n)), np.diff(np.append(first, len(n))))
    begin = np.repeat(first, np.diff(np.append(first, len(n))))
    heads = np.flatnonzero((rows - begin) % block == 0)
    tails = np.append(heads[1:], len(n))
    own = np.cumsum((rows - begin) % block == 0) - 1
    last = own[end - 1]
    low, high, least = n[heads], n[tails - 1], np.minimum.reduceat(pos, heads)
    xs, ys = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def need(a, b):
        return -(-num * (a + b) // (num + den))

    for x, k in _spread(last - own + 1, most):
        k = own[x] + k
        nx, px = n[x], pos[x]
        fit = den * nx >= num * low[k]
        fit &= np.minimum(px, high[k] - 1) + 1 + np.minimum(nx - px - 1, high[k] - least[k] - 1) >= need(nx, np.maximum(low[k], nx))
        x, k = x[fit], k[fit]
        for at, y in _spread(tails[k] - heads[k], most):
            x_, y = x[at], heads[k[at]] + y
            fit = (y > x_) & (den * n[x_] >= num * n[y]) & ~(near[x_] & near[y])
            x_, y = x_[fit], y[fit]
            wanted = need(n[x_], n[y])
            fit = np.minimum(pos[x_], pos[y]) + 1 + np.minimum(n[x_] - pos[x_] - 1, n[y] - pos[y] - 1) >= wanted
            x_, y, wanted = x_[fit], y[fit], wanted[fit]
            fit = n[x_] + n[y] - distance(brief[x_], brief[y]) >= 2 * wanted
            xs.append(x_[fit])
            ys.append(y[fit])
    return np.concatenate(xs), np.concatenate(ys)


LIST = ("pivot", "i", "j", "tok", "role", "node", "n", "pos", "near", "brief")


def _far_pairs(num: int, den: int):
    """Rows of LIST, sorted by pivot, block pair and list, to pairs.  A block pair is kept together, however batches are cut, so
    sets that meet in many lists of one pivot make one pair."""

    def found(b: pa.Table) -> pa.RecordBatch:
        col = {c: b.column(c).combine_chunks() for c in LIST}
        pivot, i, j, tok, role, node, n, pos, near = (col[c].to_numpy(zero_copy_only=False) for c in LIST[:-1])
        brief = np.frombuffer(b"".join(col["brief"].to_pylist()), np.uint8).reshape(-1, BRIEF)
        group = np.cumsum(np.concatenate([[True], (pivot[1:] != pivot[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (tok[1:] != tok[:-1])]))
        x, y = list_pairs(group, n.astype(np.int64), pos.astype(np.int64), near, brief, num, den)
        # pairs within a block belong to the block with itself
        fit = ((i[x] == j[x]) | (role[x] != role[y])) & (node[x] != node[y])
        a, b_ = node[x[fit]], node[y[fit]]
        pairs = np.unique(np.stack([np.minimum(a, b_), np.maximum(a, b_)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["pivot", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) < 1 << 14:
                continue
            whole = pa.Table.from_batches(held)
            key = [whole.column(c).to_numpy() for c in LIST[:3]]
            other = np.flatnonzero((key[0] != key[0][-1]) | (key[1] != key[1][-1]) | (key[2] != key[2][-1]))
            if len(other):
                cut = int(other[-1]) + 1
                yield found(whole.slice(0, cut))
                held = whole.slice(cut).to_batches()
        if held:
            yield found(pa.Table.from_batches(held))

    return run


def _blocks(rows: DataFrame, count: str, block: int) -> DataFrame:
    """Deal the sets of each pivot's lists to blocks and copy each row to all pairs of blocks (i <= j) that hold it; role 1 is the
    second.  A block is `block` sets, and a set is in no more lists than its prefix is long."""
    parts = F.ceil(F.col(count) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    dealt = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.withColumn("i", F.least("_own", "_other")).withColumn("j", F.greatest("_own", "_other")).withColumn("role", (F.col("_own") > F.col("_other")).cast("int")).drop("_own", "_other")


def _least(n: str, num: int, den: int, depth: int) -> Column:
    """How many lists a set of n shares with a partner at least: shared() of the smallest partner's size."""
    up = f"(({num}L * {n} + {den - 1}) div {den})"
    both = f"(({num}L * {up} + {den - 1}) div {den})"
    return F.expr(f"least({both}, greatest(8L, (({up} - {both}) * {depth}) div 2 + 1))")


def jaccard_join(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id with an equal set), component_id (smallest id reachable by links of similarity
    num / den or more), for every row of docs."""
    spark = docs.sparkSession
    texts, tasks, depth = id_text(docs), partitions(spark), 4 if words < 5 else 1
    seen = staged(arrow_map(texts, _common(words), "tok long, n long").groupBy("tok").agg(F.sum("n").alias("n")), "common")
    often = most_frequent(seen, "n", hot).toPandas()
    release(seen)
    toks = often["tok"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(toks)
    held = spark.sparkContext.broadcast((toks[order], often["n"].to_numpy(np.int64)[order]))
    sets = staged(arrow_map(texts, _prefixes(words, num, den, depth, held), SETS), "sets")
    light = staged(sets.drop("prefix"), "light")

    # one set for each id: repeated rows count once, and of different texts that with the largest hash takes part
    some = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    several = staged(light.where(some).groupBy("doc_id").agg(F.max("set_hash").alias("best"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id", "best"), "several")
    repeats = not is_empty(several)

    def one_each(df: DataFrame) -> DataFrame:
        if not repeats:
            return df
        odd = small(several)
        return df.join(odd, "doc_id", "left_anti").unionByName(df.join(odd, "doc_id").where("set_hash = best").drop("best").dropDuplicates(["doc_id"]))

    mine = one_each(light.where(some))
    classes = staged(mine.groupBy("set_hash").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("size")).where("size > 1").select("set_hash", "class_id"), "classes")
    # which documents repeat another's set is found without their prefixes
    again = staged(mine.select("doc_id", "set_hash").join(classes, "set_hash").where(F.col("doc_id") != F.col("class_id")).select("doc_id"), "again")
    member = one_each(sets.where(some)).join(small(again), "doc_id", "left_anti")

    # one exchange makes the lists; a row is a shingle, a set, and the set's size and the shingle's position in one number
    entries = member.select(F.col("doc_id").alias("node"), "n", "short", F.posexplode("prefix").alias("pos", "tok"))
    entries = entries.select("tok", "node", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos")).alias("at"), (F.col("pos") >= F.col("short")).alias("long"))
    n_of = F.shiftright("at", 32).cast("int")

    def lists(entries: DataFrame) -> DataFrame:
        """The lists of two sets or more, with their size and their smallest set.  Long lists are not gathered in a task."""
        per_list, least = Window.partitionBy("tok"), F.min(F.struct(n_of.alias("n"), "node"))
        short = entries.where("NOT long").withColumn("size", F.count(F.lit(1)).over(per_list)).withColumn("pivot", least.over(per_list)["node"])
        long = entries.where("long")
        sums = long.groupBy("tok").agg(F.count(F.lit(1)).alias("size"), least.alias("p")).select("tok", "size", F.col("p.node").alias("pivot"))
        return short.unionByName(long.join(sums, "tok")).where("size > 1")

    spent = [sets]
    for step in ("entries", "kept-entries"):
        kept = staged(lists(entries).select("tok", "node", "at", "long"), step)
        release(*spent)
        # a set with partners is in enough lists; what is left makes new, shorter lists
        enough = kept.groupBy("node").agg(F.count(F.lit(1)).alias("n_lists"), F.max(n_of).alias("n")).where(F.col("n_lists") >= _least("n", num, den, depth)).select("node")
        spent = [kept, staged(enough, "enough")]
        entries = kept.join(small(spent[1]), "node", "left_semi")
    entries = staged(lists(entries).select("tok", "node", n_of.alias("n"), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("pos"), "size", "pivot"), "lists")
    release(*spent)

    # a pair that meets in lists of two alone meets in as many as partners share; fewer are chance.  Larger lists see their own pairs
    met = entries.where(F.col("node") != F.col("pivot")).groupBy("pivot", "node").agg(F.count(F.lit(1)).alias("met"), F.max("size").alias("largest"), F.max("n").alias("n"))
    pairs = staged(met.where((F.col("largest") > 2) | (F.col("met") >= _least("n", num, den, depth))).select("pivot", "node"), "pairs")
    wanted = staged(pairs.select("node").union(pairs.select("pivot")).distinct(), "wanted")
    sketches = staged(mine.withColumnRenamed("doc_id", "node").join(small(wanted), "node", "left_semi").select("node", "n", "sketch", "brief"), "sketches")

    def related(pairs: DataFrame) -> DataFrame:
        """RELATION for pairs (pivot, node).  Whole sets travel only for those that the sketches do not show to be far."""
        own = sketches.select("node", "n", "sketch")
        both = pairs.join(own, "node").join(own.toDF("pivot", "n_pivot", "other"), "pivot")
        sifted = staged(arrow_map(both.select("pivot", "node", "n_pivot", "n", "other", "sketch"), _sift, PAIR), "sifted")
        far = 100 * F.col("most") < FAR * (F.col("n_pivot") + F.col("n") - F.col("most"))
        close = sifted.where(~far).select("pivot", "node")
        ids = close.union(close.select("pivot", "pivot")).groupBy(F.col("node").alias("doc_id")).agg(F.collect_set("pivot").alias("pivots"))
        ids = staged(ids, "close")
        full = arrow_map(texts.join(small(ids, SMALL >> 2), "doc_id").select("doc_id", "text", "pivots"), _sets(words), FULL)
        if repeats:
            full = full.join(small(several).withColumnRenamed("doc_id", "node"), "node", "left").where("best IS NULL OR best = set_hash").dropDuplicates(["pivot", "node"])
        full = staged(full.select("pivot", "node", "s"), "full-sets")
        met = full.where("pivot <> node").join(full.where("pivot = node").select("pivot", F.col("s").alias("p")), "pivot")
        near = arrow_map(met.select("pivot", "node", "p", "s"), _relate, RELATION)
        none = F.lit(b"").cast("binary")
        out = staged(near.unionByName(sifted.where(far).select("pivot", "node", F.col("most").alias("both"), "n_pivot", "n", none.alias("missing"), none.alias("added"))), "relations")
        release(full, sifted)
        return out

    relations = related(pairs)
    link = linked(F.col("both"), F.col("n_pivot"), F.col("n"), num, den)
    links = relations.where(link).select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    first = components(links)

    # frames: sets that are near their pivot but not in its component, against all that are near it
    near = 100 * F.col("both") >= FAR * (F.col("n_pivot") + F.col("n") - F.col("both"))
    comp = first.select("node", "component")
    frame = relations.where(near).join(comp, "node", "left").join(comp.select(F.col("node").alias("pivot"), F.col("component").alias("home")), "pivot", "left")
    frame = frame.withColumn("component", F.coalesce("component", "node")).withColumn("home", F.coalesce("home", "pivot")).withColumn("loose", F.col("component") != F.col("home"))
    frame = staged(frame, "frames")
    sizes = staged(frame.groupBy("pivot").agg(F.count(F.lit(1)).alias("size"), F.sum(F.col("loose").cast("long")).alias("n_loose")).where("n_loose > 0 and size > 1"), "frame-sizes")
    rows = frame.join(sizes, "pivot")
    loose_parts, all_parts = (F.ceil(F.col(c) / F.lit(block)).cast("int") for c in ("n_loose", "size"))
    name = F.xxhash64("node")
    copies = [
        rows.where("loose").withColumn("i", F.pmod(name, loose_parts).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), all_parts - 1))),
        rows.withColumn("loose", F.lit(False)).withColumn("j", F.pmod(name, all_parts).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), loose_parts - 1))),
    ]
    columns = ("pivot", "i", "j", "node", "component", "loose", "n_pivot", "n", "missing", "added")
    dealt = copies[0].select(*columns).union(copies[1].select(*columns)).repartition(tasks, "pivot", "i", "j")
    derived = dealt.groupBy("pivot", "i", "j").applyInPandas(_frame(num, den), "a long, b long")

    # lists: sets far from their pivot, against those that are not near enough for the frame to have seen the pair
    reach = 100 * FAR + (den - num) * 10_000 // den
    far = relations.where(10_000 * F.col("both") < reach * (F.col("n_pivot") + F.col("n") - F.col("both"))).select("pivot", "node", near.alias("near"))
    far = staged(far, "far")
    counts = staged(far.groupBy("pivot").agg(F.count(F.lit(1)).alias("left"), F.sum((~F.col("near")).cast("long")).alias("n_far")).where("left > 1 and n_far > 0").select("pivot", "left"), "rest-sizes")
    edges = links.unionByName(derived)
    if not is_empty(counts):
        rest = entries.where(F.col("node") != F.col("pivot")).join(far.join(counts, "pivot"), ["pivot", "node"])
        dealt = _blocks(rest.join(sketches.select("node", "brief"), "node"), "left", block).select(*LIST)
        dealt = dealt.repartition(tasks, "pivot", "i", "j").sortWithinPartitions("pivot", "i", "j", "tok", "n", "pos")
        more = staged(arrow_map(dealt, _far_pairs(num, den), "pivot long, node long").distinct(), "far-pairs")
        edges = edges.unionByName(related(more).where(link).select(F.col("pivot").alias("a"), F.col("node").alias("b")))
    groups = components(edges.unionByName(first.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    release(relations, frame, far, entries, sketches)

    out = light.select("doc_id", "set_hash", "n")
    if repeats:
        out = out.join(small(several), "doc_id", "left").withColumn("set_hash", F.coalesce("best", "set_hash")).drop("best")
    out = out.join(classes, "set_hash", "left")
    out = out.withColumn("class_id", F.when(F.col("n") > 0, F.coalesce("class_id", "doc_id")).otherwise(F.col("doc_id")))
    out = out.join(groups.withColumnRenamed("node", "class_id"), "class_id", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).when(F.col("n") > 0, F.coalesce("component", "class_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "class_id", component.alias("component_id"))
