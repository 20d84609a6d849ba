"""Work tables in the shared folder, and Arrow helpers that all the text operators use."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that the numpy code looks at in one go; a longer single text is looked at whole.
SLICE_BYTES = 1 << 20


#: By application, the folder of a Spark in one process that names none; a running session's setting can't be changed.
OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where it is unset and Spark runs in one process, as in tests, a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="schemaloom-"))
    return found.rstrip("/")


#: Short rows of a file, at least, where their number is known.
FILE_ROWS = 1 << 16


class Tables:
    """Tables of one run under the shared folder. cut() writes a frame and reads it back, so that what follows starts from files that outlive executors.

    A result may read its run's tables as long as it lives. Once it is written elsewhere they can go: all tables made
    within `with Tables.passing():` are removed at its end.
    """

    _within: ContextVar[list[Tables] | None] = ContextVar("tables", default=None)

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        if (all_ := self._within.get()) is not None:
            all_.append(self)

    @classmethod
    @contextmanager
    def passing(cls) -> Iterator[None]:
        made: list[Tables] = []
        token = cls._within.set(made)
        try:
            yield
        finally:
            cls._within.reset(token)
            for t in made:
                t._remove(t.root)

    def cut(self, df: DataFrame, rows: int | None = None, codec: str = "snappy", group: int = 128 << 20) -> DataFrame:
        """rows: how many short rows there are, about, if that is known; few of them go into few files. codec: Parquet's compression; zstd for tables that hold texts. group: bytes of a row group, which a task holds till it is full."""
        self.n += 1
        if rows is not None and rows // FILE_ROWS < partitions(self.spark):
            df = df.coalesce(rows // FILE_ROWS + 1)
        path = f"{self.root}/t{self.n}"
        df.write.option("compression", codec).option("parquet.block.size", group).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._work_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Removes a table of cut() that nothing reads any more."""
        if path := getattr(df, "_work_path", None):
            self._remove(path)

    def _remove(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def give_back() -> None:
    """Hands memory that Python no longer uses back to the system, as the driver has little to spare; without glibc it stays."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives back what it no longer uses: workers live on, beside those of the stages that follow."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of a table's files for which one hash range is made, at least.
RANGE_BYTES = 256 << 20


def ranges(rows: DataFrame) -> int:
    """Hash ranges that tasks work through one at a time: as many as partitions, or more for a table that is large by the sizes of its files, so that what a task holds at once doesn't grow with the table."""
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(partitions(rows.sparkSession), min(size // RANGE_BYTES, 1 << 20) if size < 1 << 60 else 1)  # 2 ** 63 - 1 stands for an unknown size


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of a batch with at most so many bytes in a column, one row at least."""
    n = batch.num_rows
    if not n:
        return
    _, offsets = buffers(batch.column(column))
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield batch.slice(at, end - at)
        at = end


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column, and where each begins, n + 1 places from 0. A null counts as empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    first, last = int(places[0]), int(places[-1])
    return (np.frombuffer(data, np.uint8, last - first, first) if last > first else np.empty(0, np.uint8)), places - first


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 of each text."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as compressed byte planes; unpack() needs the length and their types."""
    return zstandard.compress(b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays if len(a)), 1)


def unpack(blob: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    data, at, out = np.frombuffer(zstandard.decompress(blob) if n else b"", np.uint8), 0, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(data[at : at + n * size].reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    return out


def rises(values: np.ndarray) -> np.ndarray:
    """Differences of sorted values, which pack well; np.cumsum undoes it."""
    return np.diff(values, prepend=values.dtype.type(0))


class Marks:
    """A Bloom filter of 64-bit keys in a fixed number of bytes, in segments by the keys' high bits, so that each task can fill its own."""

    PROBES = 3

    def __init__(self, segments: int, segment_bytes: int, bits: np.ndarray | None = None):
        self.segments, self.size = segments, segment_bytes
        self.bits = np.zeros(segments * segment_bytes, np.uint8) if bits is None else bits

    @staticmethod
    def range_of(keys: np.ndarray, segments: int) -> np.ndarray:
        """The segment of each key, in the order of keys."""
        return ((keys >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)

    @classmethod
    def places(cls, keys: np.ndarray, size: int) -> Iterator[np.ndarray]:
        """Bits of each key within a segment of so many bytes."""
        h = keys * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
        step = (keys * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
        for _ in range(cls.PROBES):
            yield ((h >> np.uint64(32)) * np.uint64(size * 8) >> np.uint64(32)).astype(np.int64)
            h = h + step

    @classmethod
    def segment(cls, keys: np.ndarray, size: int) -> bytes:
        flags = np.zeros(size * 8, bool)
        for at in cls.places(keys, size):
            flags[at] = True
        return np.packbits(flags, bitorder="little").tobytes()

    def has(self, keys: np.ndarray) -> np.ndarray:
        base = self.range_of(keys, self.segments) * self.size
        out = np.ones(len(keys), bool)
        for at in self.places(keys, self.size):
            out &= (self.bits[base + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 > 0
        return out


def gathered_marks(segments: DataFrame, many: int, size: int) -> Marks:
    """The filter of rows (r int, bits binary). Its size is fixed: many * size bytes, whatever the input."""
    marks = Marks(many, size)
    for row in segments.select("r", "bits").collect():
        marks.bits[row["r"] * size : (row["r"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    give_back()
    return marks


def filter_of(keys: DataFrame, column: str, many: int, size: int) -> Marks:
    """The Bloom filter of a column of longs."""

    def fill(table: pa.Table) -> pa.Table:
        return pa.table({"r": table.column("r")[:1].cast(pa.int32()), "bits": pa.array([Marks.segment(table.column("k").to_numpy().view(np.uint64), size)], pa.binary())})

    high = F.shiftrightunsigned(F.col(column), 32)
    return gathered_marks(keys.select(F.col(column).alias("k"), F.shiftrightunsigned(high * F.lit(many).cast("long"), 32).cast("int").alias("r")).groupBy("r").applyInArrow(fill, "r int, bits binary"), many, size)


def by_range(keys: np.ndarray, many: int) -> Iterator[tuple[int, slice]]:
    """For sorted keys, the runs that belong to each of so many ranges, empty ones left out."""
    of = Marks.range_of(keys, many)
    cuts = np.flatnonzero(np.diff(of, prepend=-1))
    for at, end in zip(cuts, [*cuts[1:], len(keys)], strict=True):
        yield int(of[at]), slice(int(at), int(end))
