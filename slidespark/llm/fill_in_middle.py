"""Fill-in-the-middle: each document is cut into prefix, middle and suffix at seeded token boundaries and put in another order.

Distinct-text index: documents are dealt by a hash of their text, so copies meet, and are grouped there by their bytes (equal
hashes alone prove nothing).  The token boundaries of a text are found once for its group and kept as an Elias-Fano list: low
bits packed, high bits in unary.  Each document of the group then selects the two boundaries that its own seed names; nothing
else of the list is decoded.  A text travels once.  Texts with more than SPLIT copies are dealt to several groups by id, so no
task gets them all; the table of such texts that is sent to the tasks has at most HOT rows, and any text that is not in it has
at most a HOT-th of all documents.

Tokens are blanks with the word after them, or blanks at the end.  Seeds: four 32-bit numbers from SHA-256 of `seed:doc_id`.

Defined results: null text is as empty text; an empty text, or one with a marker in it, is plain and has no cuts (null
prefix_chars and middle_chars); a null id is as an empty one in the seed; repeated rows give equal rows; an empty table gives
none; other columns are not looked at.  Bytes that are not UTF-8 are kept and count as one character each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, arrow_map, id_text, most_frequent, pieces, staged

MARKERS = ("<P>", "<S>", "<M>")
OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"
#: Copies of a text that are dealt to one group, and rows of the table of texts with more.
SPLIT, HOT = 4096, 1 << 17
_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS)] = True
_ONES = np.array([bin(b).count("1") for b in range(256)], np.int64)


class EliasFano:
    """A rising list of numbers in about 2 + log2(largest / count) bits each, with constant-size access to any of them."""

    def __init__(self, values: np.ndarray) -> None:
        self.n = n = len(values)
        self.low_bits = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        values = values.astype(np.int64)
        high = np.zeros((int(values[-1]) >> self.low_bits) + n if n else 0, np.uint8)
        high[(values >> self.low_bits) + np.arange(n)] = 1
        self.high = np.packbits(high, bitorder="little")
        low = values[:, None] >> np.arange(self.low_bits) & 1
        self.low = np.packbits(low.astype(np.uint8).ravel(), bitorder="little")
        self.before = None

    def nbytes(self) -> int:
        return self.high.nbytes + self.low.nbytes

    def select(self, k: int) -> int:
        """Number k of the list, from 0."""
        if self.before is None:
            self.before = np.cumsum(_ONES[self.high])
        byte = int(np.searchsorted(self.before, k, "right"))
        rank = k - (int(self.before[byte - 1]) if byte else 0)
        bits = int(self.high[byte])
        for _ in range(rank):
            bits &= bits - 1
        high = byte * 8 + (bits & -bits).bit_length() - 1 - k
        at, low = k * self.low_bits, 0
        for i in range(self.low_bits):
            low |= int(self.low[(at + i) >> 3] >> (at + i & 7) & 1) << i
        return high << self.low_bits | low


def boundaries(chars: str) -> np.ndarray:
    """Ends of the tokens, in characters."""
    codes = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), "<u4")
    blank = _BLANK[np.minimum(codes, 255)]
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    return np.append(ends, len(codes)) if len(codes) else ends


class Entry:
    """A distinct text: its characters and the list of its token boundaries."""

    def __init__(self, text: bytes) -> None:
        self.chars = text.decode("utf-8", "surrogateescape")
        self.marked = any(m in self.chars for m in MARKERS)
        self.ends = EliasFano(boundaries(self.chars))

    def at(self, units: int) -> int:
        return self.ends.select(units - 1) if units else 0


def _plain_boundaries(chars: str) -> np.ndarray:
    blank = np.array([c in " \t\n\x0b\x0c\r" for c in chars])
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    return np.append(ends, len(chars))


def seeds(doc_id: object, seed: int) -> list[int]:
    """Four numbers of 32 bits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def cut(entry: Entry, doc_id: object, seed: int = 42, rate: int = 50, spm_share: int = 80) -> tuple:
    """n, form, prefix_chars, middle_chars and output of one document."""
    n, text = entry.ends.n, entry.chars
    a, b, draw, order = seeds(doc_id, seed)
    if not text or entry.marked or draw % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((a % (n + 1), b % (n + 1)))
    p, m = entry.at(a), entry.at(b)
    prefix, middle, suffix = text[:p], text[p:m], text[m:]
    first, second, third = MARKERS
    if order % 100 < spm_share:
        return n, "spm", p, m - p, f"{second}{suffix}{first}{prefix}{third}{middle}"
    return n, "psm", p, m - p, f"{first}{prefix}{second}{suffix}{third}{middle}"


def _cut_groups(seed: int, rate: int, spm_share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, index = None, {}
        for b in pieces(batches):
            rows = []
            for doc_id, text, h in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if h != group:  # rows come sorted by h: only the texts of one hash are held
                    group, index = h, {}
                entry = index.get(text)
                if entry is None:
                    entry = index[text] = Entry(text)
                rows.append((doc_id, *cut(entry, doc_id, seed, rate, spm_share)))
            ids, n, form, prefix, middle, output = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array([x.encode("utf-8", "surrogateescape") for x in output], pa.binary())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return run


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm_share: int = 80, split: int = SPLIT, hot: int = HOT) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars, output for every row of docs (module docstring).

    rate: per cent of documents that are cut; spm_share: per cent of those with the suffix first.
    """
    rows = id_text(docs).withColumn("h", F.xxhash64("text"))
    counts = rows.groupBy("h").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > split)
    crowded = most_frequent(staged(counts, "copied-texts"), "copies", hot)
    rows = rows.join(F.broadcast(crowded), "h", "left")
    groups = F.ceil(F.coalesce("copies", F.lit(1)) / split)
    rows = rows.select("doc_id", "text", "h", F.pmod(F.xxhash64("doc_id"), groups).alias("part"))
    return arrow_map(rows.repartition("h", "part").sortWithinPartitions("h", "part").select("doc_id", "text", "h"), _cut_groups(seed, rate, spm_share), OUT)


def restored(form: Column, output: Column) -> Column:
    """The text that an output came from: its three parts lie between the markers, of which they hold none."""
    whole = output.cast("string")
    body, middle = F.substring(whole, len(MARKERS[0]) + 1, 1 << 30), F.substring_index(whole, MARKERS[2], -1)
    ahead = F.substring_index(body, MARKERS[2], 1)

    def parts(second: str) -> tuple[Column, Column]:
        return F.substring_index(ahead, second, 1), F.substring_index(ahead, second, -1)

    prefix, suffix = parts(MARKERS[1])
    suffix_first, prefix_last = parts(MARKERS[0])
    return F.when(form == "plain", whole).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(prefix_last, middle, suffix_first))
