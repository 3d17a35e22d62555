"""Line deduplication by a sharded minimal perfect hash.

Lines that many documents hold are found by one aggregation over 128-bit line hashes (partial sums on the map side, so a
line that a third of all documents hold costs one row per task).  The distinct hashes of the lines that are to go are dealt
to shards; each shard becomes a minimal perfect hash (levels of bit arrays with ranks) that indexes three compact arrays:
a 64-bit fingerprint, the number of documents and the id of the document that keeps the line.  Documents then probe these
arrays; lines are never joined.  An index of up to `broadcast_bytes` is sent to every executor and texts are not shuffled;
a larger one stays dealt out, and only the line hashes travel to its shards.

Defined results: a null or empty text is one empty line; rows that share an id are one document, so they count once and, if
the id is the largest, all keep the line; rows without an id count one by one and never are the largest; a table without rows gives none; only the id
and the text columns are read, whatever others there are.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, arrow_map, id_text, pieces, staged

SHARDS, SHARD_KEYS = 256, 1 << 16
GAMMA = 2.0
#: A fixed odd multiplier for each level of a perfect hash.
_MIX = np.uint64(0xBF58476D1CE4E5B9)
OUT = "doc_id long, n_lines long, n_dropped long, kept binary"


def line_keys(text: bytes) -> list[bytes]:
    """Stripped and ASCII lower-cased lines."""
    return [line.strip(BLANKS).lower() for line in text.split(b"\n")]


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


def hash_key(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _level(lo: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = lo + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * _MIX
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys: on each level the keys that meet no other take their bit, the rest go on."""

    def __init__(self, sizes: list[int], bits: list[np.ndarray], ranks: list[np.ndarray], n: int) -> None:
        self.sizes, self.bits, self.ranks, self.n = sizes, bits, ranks, n

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, bits, ranks, base = keys, [], [], [], 0
        while len(left):
            size = max(64, -(-int(GAMMA * len(left)) // 64) * 64)
            at = _level(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            packed = np.packbits(alone, bitorder="little").view("<u8")
            counts = np.bitwise_count(packed).astype(np.int64)
            sizes.append(size)
            bits.append(packed)
            ranks.append((base + np.concatenate([[0], np.cumsum(counts)[:-1]])).astype("<u4"))
            base += int(counts.sum())
            left = left[~alone[at]]
        return cls(sizes, bits, ranks, base)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for those that surely are not in the set (others may share a slot: compare fingerprints)."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for k, size in enumerate(self.sizes):
            if not len(left):
                break
            at = _level(keys[left], k, size)
            word, bit = self.bits[k][at >> 6], (at & 63).astype(np.uint64)
            found = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[found]] = (self.ranks[k][at >> 6].astype(np.int64) + below)[found]
            left = left[~found]
        return out

    def dump(self) -> bytes:
        head = struct.pack("<II", self.n, len(self.sizes)) + struct.pack(f"<{len(self.sizes)}I", *self.sizes)
        return head + b"".join(b.tobytes() + r.tobytes() for b, r in zip(self.bits, self.ranks, strict=True))

    @classmethod
    def load(cls, blob: bytes) -> PerfectHash:
        n, levels = struct.unpack_from("<II", blob)
        sizes = list(struct.unpack_from(f"<{levels}I", blob, 8))
        at, bits, ranks = 8 + 4 * levels, [], []
        for size in sizes:
            w = size // 64
            bits.append(np.frombuffer(blob, "<u8", w, at))
            ranks.append(np.frombuffer(blob, "<u4", w, at + 8 * w))
            at += 12 * w
        return cls(sizes, bits, ranks, n)


class Shard:
    """One shard of the index: the perfect hash, then fingerprints, document counts and keeping ids by slot.

    The perfect hash is over 64 bits of each line's hash; of lines that agree in them (expected once in some 10^4 corpora of
    10^10 frequent lines) one gets the slot, the others are in a list of their own, by their whole hashes.
    """

    def __init__(self, mph: PerfectHash, prints: np.ndarray, counts: np.ndarray, keepers: np.ndarray, more: dict[tuple[int, int], int] | None = None) -> None:
        self.mph, self.prints, self.counts, self.keepers, self.more = mph, prints, counts, keepers, more or {}

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> Shard:
        _, first = np.unique(lo, return_index=True)
        others = np.setdiff1d(np.arange(len(lo)), first)
        more = {(int(hi[k]), int(lo[k])): int(keepers[k]) for k in others}
        hi, lo, counts, keepers = (a[first] for a in (hi, lo, counts, keepers))
        mph = PerfectHash.build(lo)
        slot = mph.slots(lo)
        out = [np.empty(len(lo), d) for d in ("<u8", "<i8", "<i8")]
        for arr, values in zip(out, (hi, counts, keepers), strict=True):
            arr[slot] = values
        return cls(mph, *out, more)

    def probe(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each line is in the index, and the id of the document that keeps it."""
        if not self.mph.n:
            return np.zeros(len(lo), bool), np.zeros(len(lo), np.int64)
        slot = self.mph.slots(lo)
        safe = np.maximum(slot, 0)
        found, keeper = (slot >= 0) & (self.prints[safe] == hi), self.keepers[safe]
        for (h, low), own in self.more.items():
            same = (hi == np.uint64(h)) & (lo == np.uint64(low))
            found |= same
            keeper = np.where(same, own, keeper)
        return found, keeper

    def dump(self) -> bytes:
        mph = self.mph.dump()
        more = b"".join(struct.pack("<QQq", h, low, own) for (h, low), own in self.more.items())
        return struct.pack("<I", len(mph)) + mph + self.prints.tobytes() + self.counts.tobytes() + self.keepers.tobytes() + more

    @classmethod
    def load(cls, blob: bytes) -> Shard:
        (size,) = struct.unpack_from("<I", blob)
        mph = PerfectHash.load(blob[4 : 4 + size])
        at, n = 4 + size, mph.n
        more = {(h, low): own for h, low, own in struct.iter_unpack("<QQq", blob[at + 24 * n :])}
        return cls(mph, np.frombuffer(blob, "<u8", n, at), np.frombuffer(blob, "<i8", n, at + 8 * n), np.frombuffer(blob, "<i8", n, at + 16 * n), more)


def _line_hashes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            ids, raw, owner = b.column(0), bytearray(), []
            for i, text in enumerate(b.column(1).to_pylist()):
                found = {hash_key(k) for k in line_keys(text) if long_enough(k, min_chars)}
                for h in found:
                    raw += h
                owner += [i] * len(found)
            both = np.frombuffer(bytes(raw), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), ids.take(pa.array(owner, pa.int64()))], ["hi", "lo", "doc_id"])

    return run


def frequent_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """hi, lo (128-bit hash of a line), n (documents that hold it), keeper (the largest id), for lines of at least min_docs documents."""
    lines = arrow_map(id_text(docs), _line_hashes(min_chars), "hi long, lo long, doc_id long")
    if docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").take(1):
        # only a table with repeated ids has lines that a document could count for twice
        lines = lines.where(F.col("doc_id").isNotNull()).distinct().unionByName(lines.where(F.col("doc_id").isNull()))
    return lines.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)


def _build(shards: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        u = [pdf[c].to_numpy(np.int64) for c in ("hi", "lo", "n", "keeper")]
        shard = Shard.build(u[0].view(np.uint64), u[1].view(np.uint64), u[2], u[3])
        return pd.DataFrame({"shard": [key[0]], "n": [len(pdf)], "blob": [shard.dump()]})

    return run


def build_index(frequent: DataFrame, shards: int) -> DataFrame:
    """shard, n, blob: one row per shard that has lines."""
    dealt = frequent.select(F.pmod("hi", F.lit(shards)).alias("shard"), "hi", "lo", "n", F.coalesce("keeper", F.lit(-(2**63))).alias("keeper"))
    return dealt.groupBy("shard").applyInPandas(_build(shards), "shard long, n long, blob binary")


def _drop(text: bytes, dead: np.ndarray) -> bytes:
    if not dead.any():
        return text
    return b"\n".join(line for line, gone in zip(text.split(b"\n"), dead.tolist(), strict=True) if not gone)


def _hash_batch(texts: list[bytes], min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    raw, owner, number, counts = bytearray(), [], [], []
    for i, text in enumerate(texts):
        keys = line_keys(text)
        counts.append(len(keys))
        for k, key in enumerate(keys):
            if long_enough(key, min_chars):
                raw += hash_key(key)
                owner.append(i)
                number.append(k)
    return np.frombuffer(bytes(raw), "<i8").reshape(-1, 2), np.array(owner, np.int64), np.array(number, np.int64), counts


def _probe_here(held, shards: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {s: Shard.load(blob) for s, blob in held.value}
        for b in pieces(batches):
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            both, owner, number, counts = _hash_batch(texts, min_chars)
            own = np.array([-(2**63) if i is None else i for i in ids], np.int64)[owner] if len(owner) else owner
            shard, gone = np.mod(both[:, 0], shards), np.zeros(len(owner), bool)
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[order])) + 1
            for rows in np.split(order, cuts):
                if len(rows) and (s := index.get(int(shard[rows[0]]))):
                    found, keeper = s.probe(both[rows, 0].view(np.uint64), both[rows, 1].view(np.uint64))
                    gone[rows] = found & (keeper != own[rows])
            dropped = [0] * len(ids)
            kept = texts
            lost = np.flatnonzero(gone)
            for rows in np.split(lost, np.flatnonzero(np.diff(owner[lost])) + 1) if len(lost) else []:
                i = int(owner[rows[0]])
                dead = np.zeros(counts[i], bool)
                dead[number[rows]] = True
                dropped[i] = len(rows)
                kept[i] = _drop(texts[i], dead)
            yield _out(b, counts, dropped, kept)

    return run


def _out(b: pa.RecordBatch, counts: list, dropped: list, kept: list) -> pa.RecordBatch:
    cols, names = [b.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_lines", "n_dropped", "kept"]
    if (at := b.schema.get_field_index("row")) >= 0:
        cols.append(b.column(at))
        names.append("row")
    return pa.RecordBatch.from_arrays(cols, names)


def _probe_rows(shards: int, salts: int, min_chars: int):
    """One row per document and shard: the document, its lines' numbers and hashes there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            ids, texts, keys = (b.column(k).to_pylist() for k in range(3))
            both, owner, number, _ = _hash_batch(texts, min_chars)
            shard = np.mod(both[:, 0], shards)
            order = np.lexsort((shard, owner))
            group = owner[order] * shards + shard[order]
            out = {k: [] for k in ("shard", "salt", "doc_id", "key", "numbers", "hashes")}
            for rows in np.split(order, np.flatnonzero(np.diff(group)) + 1) if len(order) else []:
                i = int(owner[rows[0]])
                out["shard"].append(int(shard[rows[0]]))
                out["salt"].append(xxhash.xxh3_64_intdigest(keys[i]) % salts)
                out["doc_id"].append(ids[i])
                out["key"].append(keys[i])
                out["numbers"].append(number[rows].astype("<i4").tobytes())
                out["hashes"].append(both[rows].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out["shard"], pa.int64()), pa.array(out["salt"], pa.int64()), pa.array(out["doc_id"], pa.int64()), pa.array(out["key"], pa.binary()), pa.array(out["numbers"], pa.binary()), pa.array(out["hashes"], pa.binary())], list(out))

    return run


def _probe_shard(rows: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    if not len(rows) or not len(index):
        return pd.DataFrame({"key": [], "dead": []})
    shard, keys, dead = Shard.load(index["blob"].iloc[0]), [], []
    for doc_id, key, numbers, hashes in zip(rows["doc_id"], rows["key"], rows["numbers"], rows["hashes"], strict=True):
        both = np.frombuffer(hashes, "<i8").reshape(-1, 2)
        found, keeper = shard.probe(both[:, 0].view(np.uint64), both[:, 1].view(np.uint64))
        found &= keeper != (-(2**63) if pd.isna(doc_id) else int(doc_id))
        if found.any():
            keys.append(key)
            dead.append(np.frombuffer(numbers, "<i4")[found].tobytes())
    return pd.DataFrame({"key": keys, "dead": dead})


def _drop_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        texts, dead = b.column(1).to_pylist(), b.column(2).to_pylist()
        counts, dropped, kept = [], [], []
        for text, parts in zip(texts, dead, strict=True):
            gone = np.zeros(text.count(b"\n") + 1, bool)
            for part in parts or []:
                gone[np.frombuffer(part, "<i4")] = True
            counts.append(len(gone))
            dropped.append(int(gone.sum()))
            kept.append(_drop(text, gone))
        yield _out(b, counts, dropped, kept)


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, broadcast_bytes: int = 32 << 20, salts: int = 16, carry: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text for every row of docs (module docstring); with carry also row, a struct of all its columns.

    broadcast_bytes bounds the index that is sent to every executor; beyond it the probes travel to the shards, each shard
    being copied to `salts` groups so that a shard with a very common line is spread too.
    """
    spark = docs.sparkSession
    frequent = staged(frequent_lines(docs, min_chars, min_docs), "lines")
    n = frequent.count()
    shards = max(SHARDS, -(-n // SHARD_KEYS))
    index = staged(build_index(frequent, shards), "line-index")
    size = index.agg(F.sum(F.length("blob"))).first()[0] or 0
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", text.alias("text"), *[F.struct("*").alias("row")] * carry)
    out = OUT + f", row {rows.schema['row'].dataType.simpleString()}" * carry if carry else OUT
    if size <= broadcast_bytes:
        held = spark.sparkContext.broadcast([(r["shard"], bytes(r["blob"])) for r in index.select("shard", "blob").toLocalIterator()])
        done = arrow_map(rows, _probe_here(held, shards, min_chars), out)
    else:
        # equal rows have equal verdicts, so id and content name a row
        keyed = rows.withColumn("key", F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(" "), F.sha2("text", 256)), 256)))
        probes = arrow_map(keyed.select("doc_id", "text", "key"), _probe_rows(shards, salts, min_chars), "shard long, salt long, doc_id long, key binary, numbers binary, hashes binary").dropDuplicates(["key", "shard"])
        copies = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select("shard", F.col("salt").cast("long").alias("salt"), "blob")
        dead = probes.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(_probe_shard, "key binary, dead binary")
        dead = dead.groupBy("key").agg(F.collect_list("dead").alias("dead"))
        done = arrow_map(keyed.join(dead, "key", "left").select("doc_id", "text", "dead", *["row"] * carry), _drop_rows, out)
    return done.select("doc_id", "n_lines", "n_dropped", F.col("kept").cast("string").alias("kept_text"), *["row"] * carry)
