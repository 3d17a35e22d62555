"""Files wherever they are: the folder that all executors share, staged tables, and reads of byte ranges."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from slidespark.session import ship

#: Bytes between two wanted ranges that are read along rather than making another request, and the most that one request reads.
GAP, MOST = 16 << 10, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  Where none is set, a temporary folder will do in local mode only."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="slidespark-"))
        held = jsc.getCheckpointDir().get()
    return held.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(target)
    system.deleteOnExit(target)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: lineage is cut, and any executor can be lost."""
    spark = df.sparkSession
    path = scratch(spark, name) + "/t"
    ship(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rounds: int = 4) -> DataFrame:
    """df dealt to some tasks for each core, for work that is long beside the bytes that it reads: Spark plans tasks by bytes."""
    return df.repartition(rounds * df.sparkSession.sparkContext.defaultParallelism)


def drop(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:(//)?", "", path)
    return fs.FileSystem.from_uri(path)


def exists(path: str) -> bool:
    system, inner = locate(path)
    return system.get_file_info(inner).type != fs.FileType.NotFound


class Blocks:
    """A file as a sequence of bytes of which only the blocks that are asked for are read (for headers that are all over it)."""

    def __init__(self, path: str, block: int = 64 << 10) -> None:
        system, inner = locate(path)
        self.file, self.block, self.held, self.bytes_read = system.open_input_file(inner), block, {}, 0
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        first, last = at // self.block, max(at, at + n - 1) // self.block
        for k in range(first, last + 1):
            if k not in self.held:
                self.held[k] = self.file.read_at(max(0, min(self.block, self.size - k * self.block)), k * self.block)
                self.bytes_read += len(self.held[k])
        data = self.held[first] if first == last else b"".join(self.held[k] for k in range(first, last + 1))
        return data[at - first * self.block :][:n]

    def close(self) -> None:
        self.file.close()


def runs(ranges: Sequence[tuple[int, int]], gap: int = GAP, most: int = MOST) -> Iterator[list[int]]:
    """Numbers of the ranges (offset, length), in order of their offsets, in runs that one request reads."""
    run: list[int] = []
    end = begin = 0
    for k in sorted(range(len(ranges)), key=lambda i: ranges[i]):
        at, n = ranges[k]
        if run and (at > end + gap or max(end, at + n) - begin > most):
            yield run
            run = []
        if not run:
            begin, end = at, at
        run.append(k)
        end = max(end, at + n)
    if run:
        yield run


def read_ranges(path: str, ranges: Sequence[tuple[int, int]], gap: int = GAP) -> Iterator[tuple[int, bytes]]:
    """Number and bytes of each range, read in coalesced requests in order of offsets."""
    system, inner = locate(path)
    with system.open_input_file(inner) as f:
        for run in runs(ranges, gap):
            begin = ranges[run[0]][0]
            data = f.read_at(max(a + n for a, n in (ranges[k] for k in run)) - begin, begin)
            for k in run:
                at, n = ranges[k]
                if len(data) < at - begin + n:
                    raise ValueError(f"{path} ends within the {n} bytes at {at}")
                yield k, data[at - begin : at - begin + n]
