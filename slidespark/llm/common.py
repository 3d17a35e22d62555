"""Helpers shared by the training-data operators: the shared folder, staged tables and Arrow passes."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from slidespark.session import ship

#: Bytes that the contracts call blank: [\x20\x09-\x0D].
BLANKS = b" \t\n\x0b\x0c\r"


#: Most rows of a table of one or two numbers that is sent to every executor.
SMALL = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where none is set, a temporary folder will do in
    local mode, where driver and executors are one process; on a cluster that is an error."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="slidespark-"))
        held = jsc.getCheckpointDir().get()
    return held.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; the file system removes it when the application ends."""
    ship(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target)
    fs.deleteOnExit(target)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut and any executor can be lost."""
    spark = df.sparkSession
    path = shared_path(spark, name) + "/t"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path.removesuffix("/t")
    return out


def release(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """df, to be sent to every executor if it has at most so many rows (they are counted); else Spark joins it as any table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def partitions(spark: SparkSession) -> int:
    """How many tasks a shuffle makes; given to repartition() where tasks are heavy but few bytes, so that they are not merged."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text as UTF-8 bytes (null: empty), whatever other columns there are."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def pieces(batches: Iterator[pa.RecordBatch], max_bytes: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece holds about max_bytes of the column (one longer value makes a piece of its own)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        at = batch.schema.get_field_index(column)
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0), dtype=np.int64)
        part = np.cumsum(sizes) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def crc_bucket(doc_id: str, mod: int):
    """crc32 of the id as text, modulo mod."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def crc_of(value: object, mod: int) -> int:
    return zlib.crc32(("" if value is None else str(value)).encode()) % mod


_LANE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F))
_LANES = 128
#: The first 0 to 8 bytes of a word.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def strong_hashes(buf: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of many byte strings [start, end) of a buffer, eight bytes at a step over all of them.

    Each step multiplies and folds, so that, unlike for sums of powers, no kind of text is known to collide.  Strings of more
    than 1024 bytes are hashed one by one.
    """
    at, left = np.array(starts, np.int64), (ends - starts).astype(np.int64)
    long = np.flatnonzero(left > 8 * _LANES)
    words = np.ndarray((len(buf) + 1,), "<u8", buffer=bytes(buf) + b"\0" * 8, strides=(1,))
    out, rows = np.empty(len(left), np.uint64), None
    with np.errstate(over="ignore"):
        h = (left.astype(np.uint64) + np.uint64(seed)) * _LANE[2]
        left[long] = 0
        while len(left):
            w = words[at] & _MASKS[np.minimum(left, 8)]
            w *= _LANE[0]
            w ^= w >> np.uint64(29)
            h ^= w
            h *= _LANE[1]
            h ^= h >> np.uint64(32)
            more = np.flatnonzero(left > 8)
            if len(more) < len(left):
                if rows is None:
                    out[:] = h
                else:
                    out[rows] = h
                h, at, left, rows = h[more], at[more], left[more], more if rows is None else rows[more]
            at += 8
            left -= 8
        out ^= out >> np.uint64(29)
        out *= _LANE[0]
        out ^= out >> np.uint64(32)
    for i in long.tolist():
        out[i] = xxhash.xxh3_64_intdigest(buf[int(starts[i]) : int(ends[i])], seed)
    return out


def most_frequent(df: DataFrame, count: str, limit: int) -> DataFrame:
    """The rows with the largest counts, at most limit of them; rows whose counts lie within a 16th of a power of two go together.

    A histogram of the logarithms (some hundred rows) gives the least count to keep, so nothing is sorted and no task
    sends more than its own share to the driver.
    """
    step = F.floor(F.log2(F.col(count).cast("double")) * 16).cast("int")
    least, total = None, 0
    for r in sorted(df.where(F.col(count) > 0).groupBy(step.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["b"]):
        total += r["n"]
        if total > limit:
            break
        least = r["b"]
    if least is None and total:  # more than limit rows are among the most frequent: of these, those with the largest counts, then by hash
        return df.where(F.col(count) > 0).orderBy(F.desc(count), F.xxhash64(*df.columns)).limit(limit)
    return df.where(step >= least if least is not None else F.lit(False))


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)
