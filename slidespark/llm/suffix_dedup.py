"""Removal of repeated byte strings by hash-compared suffix sorting.

Which windows (strings of `length` bytes) occur twice is asked only where it can be.  A window holds 201 (length / 2 + 1)
substrings of half its length; the one with the smallest hash, the leftmost of equal ones, is its anchor, and equal windows
have equal anchors at equal places.  Windows that share an anchor's position are a segment of their document.

1. Anchors that occur once have no repeated window.  Counting them moves one hash per segment, with partial sums.
2. Segments with equal content, under one anchor, repeat each other whole: counting their names settles them.  A name is the
   anchor's hash and 64 bits of a hash of all bytes of the content (128 bits; bytes are not compared here).
3. What is left are segments that meet other contents under the same anchor.  They travel, with their bytes, to one place per
   anchor, and their windows, which are suffixes of the segments, are sorted there: a merge sort whose comparisons take the
   longest common extension of two suffixes by binary search over prefix polynomial hashes, so a comparison costs a logarithm
   of the length.  Neighbours that agree over a window are repeated; their bytes are compared, so that a collision removes
   nothing.
4. Anchors that more than `crowd` contents share are split by place and by bytes: windows that begin at one of BLOCKS[0]
   neighbouring places before the anchor all hold the bytes between the last of these places and the end of a window at the
   first, so contents are cut to those windows and dealt by these bytes.  Most cut contents are equal then and settled by 2,
   the others are sorted by 3; what is still crowded is split by BLOCKS[1] places, and so on.  Groups of one place hold equal
   windows only, so no group grows with the data.

Defined results: a null or empty text, or one shorter than a window, loses nothing; strings never cross documents; repeated
rows repeat each other; a document may repeat itself, overlaps included; null ids are kept; an empty table gives no rows; only
ids and texts are read; texts of any length are run through in stretches of `STRETCH` windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, id_text, is_empty, pieces, release, staged, strong_hashes

CROWD = 256
#: Places that a crowded anchor's windows are split by, again and again.
BLOCKS = (32, 4, 1)
STRETCH = 1 << 16
_BASE = 0x9E3779B97F4A7C15


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as long as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            self.up, self.down = (np.full(size, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 2**64)))
            for powers in (self.up, self.down):
                powers[0] = 1
                np.cumprod(powers, out=powers)
        return self.up[:n], self.down[:n]


_POWERS = Powers()
_BYTE = np.random.default_rng(4).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)


class PrefixHash:
    """Polynomial hashes modulo 2^64 (bytes named by random odd numbers) of all substrings of a buffer."""

    def __init__(self, buf: bytes) -> None:
        self.bytes = np.frombuffer(buf, np.uint8)
        with np.errstate(over="ignore"):
            up, self.down = _POWERS.to(len(buf) + 1)
            self.sums = np.zeros(len(buf) + 1, np.uint64)
            np.cumsum(_BYTE[self.bytes] * up[:-1], dtype=np.uint64, out=self.sums[1:])

    def of(self, start, end):
        """Hash of [start, end), the same wherever it occurs."""
        with np.errstate(over="ignore"):
            x = (self.sums[end] - self.sums[start]) * self.down[start]
            return (x ^ (x >> np.uint64(32))) * _MIX

    def all(self, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n]
            return (x ^ (x >> np.uint64(32))) * _MIX


#: Two primes below 2^31 and a base for each.
_PRIMES = ((2147483647, 1234567891), (2147483629, 987654323))


class PrimeHash:
    """Polynomial hashes of all substrings of a buffer modulo two primes, in one number: unlike those modulo 2^64 they have no
    text that collides whatever the base."""

    def __init__(self, buf: bytes) -> None:
        self.bytes = np.frombuffer(buf, np.uint8)
        n = len(buf) + 1
        self.parts = []
        for p, base in _PRIMES:
            up, down = (self._powers(b, p, n) for b in (base, pow(base, -1, p)))
            sums = np.zeros(n, np.uint64)
            np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * up[:-1] % np.uint64(p), out=sums[1:])
            self.parts.append((np.uint64(p), sums % np.uint64(p), down))

    @staticmethod
    def _powers(base: int, p: int, n: int) -> np.ndarray:
        out = np.ones(1, np.uint64)
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), p)) % np.uint64(p)])
        return out[:n]

    def of(self, start, end):
        """Hash of [start, end), the same wherever it occurs."""
        (p, s, down), (q, t, low) = self.parts
        return ((s[end] + p - s[start]) % p * down[start] % p << np.uint64(32)) | ((t[end] + q - t[start]) % q * low[start] % q)


def slide(v: np.ndarray, w: int, least: bool = True) -> np.ndarray:
    """Minimum (or maximum) of every w neighbours."""
    op = np.minimum if least else np.maximum
    fill = np.uint64(0xFFFFFFFFFFFFFFFF) if least else np.uint64(0)
    rows = -(-len(v) // w)
    padded = np.full(rows * w, fill)
    padded[: len(v)] = v
    padded = padded.reshape(rows, w)
    ahead = op.accumulate(padded, axis=1).ravel()
    behind = op.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[: len(v) - w + 1], ahead[w - 1 : len(v)])


def stretches(docs: list, names: list, texts: list[bytes], length: int, most: int = STRETCH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """Ids, names, where each stretch begins in its text, and the stretches' bytes; about `most` bytes at once.  A text of more
    than `most` windows comes as several stretches that overlap by length - 1 bytes, so each window is in one of them."""
    held: list[tuple] = []
    size = 0
    for doc, name, text in zip(docs, names, texts, strict=True):
        if len(text) < length:
            continue
        for at in range(0, len(text) - length + 1, most):
            held.append((doc, name, at, text[at : at + most + length - 1] if len(text) > most else text))
            size += len(held[-1][3])
            if size >= most:
                yield (*(np.array([h[k] for h in held], np.int64) for k in range(3)), [h[3] for h in held])
                held, size = [], 0
    if held:
        yield (*(np.array([h[k] for h in held], np.int64) for k in range(3)), [h[3] for h in held])


def segments(texts: list[bytes], length: int):
    """Text number, anchor hash, first and last window start, anchor position, of each segment of texts (none is shorter than a
    window); positions are those in all texts joined, which is returned last."""
    buf = b"".join(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    half = length // 2
    w = length - half + 1
    ends = np.cumsum(sizes)
    grams = PrefixHash(buf).all(half)
    least = slide(grams, w)
    # windows of one text only
    valid = np.ones(len(least), bool)
    for e in ends[:-1].tolist():
        valid[e - length + 1 : e] = False
    # a position is an anchor if it is the least of a window that holds it
    padded = np.concatenate([np.zeros(w - 1, np.uint64), np.where(valid, least, np.uint64(0)), np.zeros(w - 1, np.uint64)])
    anchors = np.flatnonzero(slide(padded, w, False) == grams)
    mark = np.zeros(len(grams) + 1, np.int64)
    mark[anchors + 1] = 1
    s = np.flatnonzero(valid)
    at = np.cumsum(mark)[s]
    pos, least = anchors[at], least[s]
    while len(bad := np.flatnonzero(grams[pos] != least)):
        at[bad] += 1
        pos[bad] = anchors[at[bad]]
    doc = np.searchsorted(ends, s, "right")
    first = np.concatenate([[0], np.flatnonzero((np.diff(pos) != 0) | (np.diff(doc) != 0)) + 1])
    last = np.concatenate([first[1:] - 1, [len(s) - 1]])
    return doc[first], least[first], s[first], s[last], pos[first], buf


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts = b.column(2).to_pylist()
            for *_, parts in stretches([0] * len(texts), [0] * len(texts), texts, length):
                yield pa.RecordBatch.from_arrays([pa.array(segments(parts, length)[1].view(np.int64))], ["h"])

    return run


SEGMENT = "doc long, name long, h long, g long, first int, last int, pos int, times int"


def _batch(columns: list[np.ndarray], schema: str) -> pa.RecordBatch:
    names = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64 if t == "long" else np.int32)) for v, (_, t) in zip(columns, names, strict=True)], [n for n, _ in names])


def _segments(length: int):
    """One row per document and content, with how often the document holds it (as far as it is read at once).  What a document
    repeats itself is settled at once: it comes as stretches of windows (times 0), so that periodic texts make few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            for docs, names, begins, parts in stretches(*(b.column(k).to_pylist() for k in range(3)), length):
                doc, h, first, last, pos, buf = segments(parts, length)
                base = (np.cumsum([len(p) for p in parts]) - [len(p) for p in parts])[doc]
                g = strong_hashes(buf, first, last + length)
                with np.errstate(over="ignore"):
                    g = g + (pos - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                order = np.lexsort((g, h, doc))
                new = np.ones(len(order), bool)
                new[1:] = (doc[order][1:] != doc[order][:-1]) | (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
                heads = np.flatnonzero(new)
                times = np.diff(np.append(heads, len(order)))
                one = order[heads]  # lexsort is stable: the first of equal ones
                rows = [docs[doc[one]], names[doc[one]], h[one].view(np.int64), g[one].view(np.int64), first[one], last[one], pos[one], times]
                offset = begins[doc] - base  # from joined texts to the document's own bytes
                for k in (4, 5, 6):
                    rows[k] = rows[k] + offset[one]
                again = np.zeros(len(order), bool)
                again[order] = np.repeat(times > 1, times)
                if again.any():
                    i = np.flatnonzero(again)
                    fresh = np.ones(len(i), bool)
                    fresh[1:] = (doc[i[1:]] != doc[i[:-1]]) | (first[i[1:]] > last[i[:-1]] + length)
                    runs = np.flatnonzero(fresh)
                    ends = np.append(runs[1:], len(i)) - 1
                    start, stop = first[i[runs]] + offset[i[runs]], last[i[ends]] + offset[i[runs]]
                    own = doc[i[runs]]
                    with np.errstate(over="ignore"):  # spread over all tasks
                        spread = (names[own] ^ start).view(np.uint64) * _MIX
                    more = [docs[own], names[own], spread.view(np.int64), np.zeros(len(runs), np.int64), start, stop, start, np.zeros(len(runs), np.int64)]
                    rows = [np.concatenate(x) for x in zip(rows, more, strict=True)]
                yield _batch(rows, SEGMENT)

    return run


CONTENT = "doc long, name long, h long, first int, pos int, open boolean, content binary"


def _contents(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [c.split()[0] for c in CONTENT.split(", ")])


def _cut(length: int, most: int = 8 << 20):
    """The bytes of the segments in own, from texts that begin at `base` of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows, size = [], 0
            for doc, name, text, base, own in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                for s in own:
                    rows.append((doc, name, s["h"], s["first"], s["pos"], s["open"], text[s["first"] - base : s["last"] - base + length]))
                    size += len(rows[-1][-1])
                    if size > most:
                        yield _contents(rows)
                        rows, size = [], 0
            if rows:
                yield _contents(rows)

    return run


PART = "doc long, name long, up long, at int, h long, g long, first int, last int, pos int, times int, open boolean"


def _split(length: int, width: int):
    """CONTENT of crowded anchors by blocks of `width` places; h names the anchor, the block and the bytes that all its windows
    hold, g the windows' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1 << 20, "content"):
            doc, name, h, first, pos = (b.column(k).to_numpy() for k in range(5))
            contents = b.column(6).to_pylist()
            sizes = np.fromiter(map(len, contents), np.int64, len(contents))
            base = np.cumsum(sizes) - sizes
            low = first.astype(np.int64) - pos + length  # place of the first window, positive
            high = low + sizes - length
            many = high // width - low // width + 1
            i = np.repeat(np.arange(len(contents)), many)
            block = low[i] // width + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
            a, z = np.maximum(block * width, low[i]), np.minimum(block * width + width - 1, high[i])
            buf, shift = b"".join(contents), base[i] - low[i]
            # these bytes are in every window that begins in the block, so they are there even if some of its windows are not
            core = strong_hashes(buf, block * width + width - 1 + shift, block * width + length + shift)
            with np.errstate(over="ignore"):
                key = (h[i].view(np.uint64) ^ block.astype(np.uint64) * _MIX) * np.uint64(0x9E3779B97F4A7C15) + core
                g = strong_hashes(buf, a + shift, z + length + shift) + (a - block * width).astype(np.uint64)
            out = [doc[i], name[i], h[i], first[i], key.view(np.int64), g.view(np.int64), first[i] + a - low[i], first[i] + z - low[i], pos[i], np.ones(len(i))]
            made = _batch(out, PART.rpartition(", ")[0])
            yield pa.RecordBatch.from_arrays([*made.columns, b.column(5).take(pa.array(i))], [*made.schema.names, "open"])

    return run


def common_prefix(ph: PrimeHash, x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Longest common extension, up to most bytes, of the suffixes at x and y, by binary search over prefix hashes."""
    low, high = np.zeros(len(x), np.int64), np.full(len(x), most, np.int64)
    while len(go := np.flatnonzero(low < high)):
        mid = (low[go] + high[go] + 1) >> 1
        same = ph.of(x[go], x[go] + mid) == ph.of(y[go], y[go] + mid)
        low[go] = np.where(same, mid, low[go])
        high[go] = np.where(same, high[go], mid - 1)
    return low


def before(ph: PrimeHash, x: np.ndarray, y: np.ndarray, most: int, ties: np.ndarray) -> np.ndarray:
    """Whether the suffix at y comes before the one at x; equal ones do where ties holds."""
    out = ties.copy()
    differ = np.flatnonzero(ph.of(x, x + most) != ph.of(y, y + most))
    if len(differ):
        u, v = x[differ], y[differ]
        n = np.minimum(common_prefix(ph, u, v, most), most - 1)
        out[differ] = ph.bytes[v + n] < ph.bytes[u + n]
    return out


def suffix_sort(ph: PrimeHash, start: np.ndarray, run: np.ndarray, most: int) -> np.ndarray:
    """Order of the suffixes at start, sorted by their first `most` bytes within runs (run is sorted), by a bottom-up merge sort.

    All pairs of neighbouring sorted stretches of one width are merged at once: each suffix finds its rank in the other
    stretch by binary search.
    """
    order = np.arange(len(start))
    edge = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1], [True]]))
    size = np.diff(edge)
    base = np.repeat(edge[:-1], size)
    total = np.repeat(size, size)
    within = np.arange(len(start)) - base
    width = 1
    while len(size) and width < size.max():
        pair = within // (2 * width) * (2 * width)
        left = within - pair < width
        other_low = base + pair + np.where(left, width, 0)
        other_high = np.minimum(base + total, other_low + width)
        other_low = np.minimum(other_low, other_high)
        low, high = other_low.copy(), other_high.copy()
        mine = start[order]
        while len(go := np.flatnonzero(low < high)):
            mid = (low[go] + high[go]) >> 1
            # of equal suffixes those of the left stretch come first
            less = before(ph, mine[go], mine[mid], most, ~left[go])
            low[go] = np.where(less, mid + 1, low[go])
            high[go] = np.where(less, high[go], mid)
        own = within - pair - np.where(left, 0, width)
        new = np.empty_like(order)
        new[base + pair + own + (low - other_low)] = order
        order = new
        width *= 2
    return order


def equal_bytes(ph: PrimeHash, x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    out = np.ones(len(x), bool)
    span = np.arange(n)
    for k in range(0, len(x), 4096):
        out[k : k + 4096] = (ph.bytes[x[k : k + 4096, None] + span] == ph.bytes[y[k : k + 4096, None] + span]).all(1)
    return out


def repeated_windows(group: np.ndarray, offset: np.ndarray, contents: list[bytes], length: int) -> list[np.ndarray]:
    """For each content the starts of windows that another content of its group has at the same place from the anchor.

    group is sorted; offset is the anchor's place in the content.
    """
    ph = PrimeHash(b"".join(contents))
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    base = np.cumsum(sizes) - sizes
    n = sizes - length + 1
    row = np.repeat(np.arange(len(contents)), n)
    s = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    place = s - offset[row]
    order = np.lexsort((place, group[row]))
    row, s, place = row[order], s[order], place[order]
    fresh = np.concatenate([[True], (group[row[1:]] != group[row[:-1]]) | (place[1:] != place[:-1])]) if len(row) else np.empty(0, bool)
    run = np.cumsum(fresh)
    many = np.bincount(run)[run] > 1 if len(run) else np.empty(0, bool)
    row, s, run = row[many], s[many], run[many]
    start = base[row] + s
    order = suffix_sort(ph, start, run, length)
    row, s, start = row[order], s[order], start[order]
    near = np.flatnonzero((run[1:] == run[:-1]) & (ph.of(start[1:], start[1:] + length) == ph.of(start[:-1], start[:-1] + length)))
    near = near[equal_bytes(ph, start[near], start[near + 1], length)]
    hit = np.zeros(len(row), bool)
    hit[near] = hit[near + 1] = True
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(contents)
    row, s = row[hit], s[hit]
    order = np.lexsort((s, row))
    row, s = row[order], s[order]
    for part in np.split(np.arange(len(row)), np.flatnonzero(np.diff(row)) + 1):
        if len(part):
            out[int(row[part[0]])] = s[part]
    return out


def covered(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by windows at sorted starts."""
    cut = np.flatnonzero(np.diff(starts) > length) + 1
    return [(int(p[0]), int(p[-1]) + length) for p in np.split(starts, cut) if len(p)]


COVER = "doc long, name long, start int, end int"


def _cover_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k < 2 else pa.int32()) for k in range(4)], ["doc", "name", "start", "end"])


def _sort_groups(length: int, at_once: int = 1 << 20):
    """Rows of CONTENT, sorted by anchor, to COVER; about so many bytes are sorted at once, an anchor's rows always together."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        group = np.array([r[2] for r in rows], np.int64)
        offset = np.array([r[4] - r[3] for r in rows], np.int64)
        found = repeated_windows(group, offset, [r[6] for r in rows], length)
        return _cover_batch([(r[0], r[1], r[3] + a, r[3] + b) for r, s in zip(rows, found, strict=True) if r[5] and len(s) for a, b in covered(s, length)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in pieces(batches, 1 << 20, "content"):
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size >= at_once and r[2] != held[-1][2]:
                    yield flush(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[6])
        if held:
            yield flush(held)

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        cols: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept")}
        for text, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            spans: list[list[int]] = []
            for s in sorted((s["start"], s["end"]) for s in own or []):
                if spans and s[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], s[1])
                else:
                    spans.append(list(s))
            kept, at = [], 0
            for a, z in spans:
                kept.append(text[at:a])
                at = z
            cols["n_bytes"].append(len(text))
            cols["n_removed"].append(sum(z - a for a, z in spans))
            cols["n_spans"].append(len(spans))
            cols["kept"].append(b"".join([*kept, text[at:]]))
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(v, pa.binary() if k == "kept" else pa.int64()) for k, v in cols.items())], ["doc_id", *cols])


def _settle(found: DataFrame, length: int, crowd: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc, name, h, g, first, last, pos, times, open and what else identifies them): COVER of what repeats as a whole, the
    rows that meet other contents (with `open`: not known to repeat), and the h of which more than `crowd` contents are left."""
    contents = staged(found.groupBy("h", "g").agg(F.sum("times").alias("n"), F.min(F.struct("doc", "name", "first")).alias("pick"), F.max(F.col("open").cast("int")).alias("may")), "contents")
    single = (F.col("n") == 1) & (F.col("may") == 1)
    kinds = staged(contents.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.sum(single.cast("long")).alias("single")).where("single > 0 and kinds > 1"), "kinds")
    cover = found.join(contents.where("n > 1").select("h", "g"), ["h", "g"], "left_semi").select("doc", "name", F.col("first").alias("start"), (F.col("last") + length).alias("end"))
    # segments that meet other contents, and one copy of each content that repeats as a whole
    some = contents.join(kinds.select("h"), "h").select("h", "g", "pick.*", single.alias("fresh"))
    picked = found.drop("open").join(some, ["h", "g", "doc", "name", "first"]).withColumnRenamed("fresh", "open")
    return cover, picked.where("open").unionByName(picked.where("NOT open").dropDuplicates(["h", "g"])), kinds.where(F.col("kinds") > crowd).select("h")


def suffix_dedup(docs: DataFrame, length: int = 400, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) for every row of docs (module docstring)."""
    texts = id_text(docs)
    # rows that agree in id and text have one verdict, so both name a row
    named = texts.select(F.coalesce("doc_id", F.lit(-(2**63))).cast("long").alias("doc"), F.xxhash64("text").alias("name"), "text")
    twice = staged(arrow_map(named, _anchors(length), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "anchors")
    both = arrow_map(named, _segments(length), SEGMENT)
    # times 0: stretches that their document repeats itself; they have no anchor and pass by the join
    found = staged(both.join(twice.withColumn("known", F.lit(True)), "h", "left").where("known OR times = 0").drop("known"), "segments")
    release(twice)
    covers = [found.where("times = 0").select("doc", "name", F.col("first").alias("start"), (F.col("last") + length).alias("end"))]

    cover, picked, crowded = _settle(found.where("times > 0").withColumn("open", F.lit(True)), length, crowd)
    covers.append(cover)
    own = picked.groupBy("doc", "name").agg(F.collect_list(F.struct("h", "first", "last", "pos", "open")).alias("own"))
    cut = arrow_map(named.join(own, ["doc", "name"]).dropDuplicates(["doc", "name"]).select("doc", "name", "text", F.lit(0).alias("base"), "own"), _cut(length), CONTENT)
    columns = [c.split()[0] for c in CONTENT.split(", ")]
    for width in (*BLOCKS, None):
        cut, crowded = staged(cut, "cut"), staged(crowded, "crowded")
        fair = cut.join(crowded, "h", "left_anti").select(*columns).repartition("h").sortWithinPartitions("h")
        covers.append(staged(arrow_map(fair, _sort_groups(length), COVER), "sorted"))
        if width is None or is_empty(crowded):
            break
        source = cut.join(crowded, "h", "left_semi").select(*columns)
        parts = staged(arrow_map(source, _split(length, width), PART), "parts")
        cover, picked, crowded = _settle(parts, length, crowd)
        covers.append(cover)
        own = picked.groupBy("doc", "name", F.col("up").alias("h"), F.col("at").alias("first")).agg(F.collect_list(F.struct("h", "first", "last", "pos", "open")).alias("own"))
        again = source.select("doc", "name", "h", "first", "content").join(own, ["doc", "name", "h", "first"])
        cut = arrow_map(again.select("doc", "name", F.col("content").alias("text"), F.col("first").alias("base"), "own"), _cut(length), CONTENT)

    cover = covers[0]
    for c in covers[1:]:
        cover = cover.unionByName(c)
    spans = cover.groupBy("doc", "name").agg(F.collect_list(F.struct("start", "end")).alias("own"))
    keyed = texts.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(2**63))).cast("long").alias("doc"), F.xxhash64("text").alias("name"))
    return arrow_map(keyed.join(spans, ["doc", "name"], "left").select("doc_id", "text", "own"), _remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
