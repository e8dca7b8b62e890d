"""Helpers shared by the training-data operators: byte buffers, hashing, blobs and checkpoints."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import inspect
import shutil
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Text bytes handled at once in a Python worker; a longer single document is handled alone.
CHUNK_BYTES = 1 << 18

_P = 0x9E3779B97F4A7C15 | 1  # base of the polynomial hashes, odd so that it has an inverse mod 2**64
_PINV = pow(_P, -1, 1 << 64)
U64 = np.uint64
_powers: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder, read by Spark (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch that goes to a Python worker: it is held on both sides, and texts are long.
BATCH_BYTES = 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bytes in an Arrow batch to BATCH_BYTES, unless they are fewer already; its rows stay as they are.

    A DataFrame reads the setting when it runs, so it can't be put back before; it bounds memory and changes no result.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(str(spark.conf.get(name))))
    if held <= 0 or held > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def trim() -> None:
    """Give memory that a worker has freed back to the system: workers are used again and would keep the most that any task took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(f: Callable) -> Callable:
    """Of a function from batches to batches, or from groups to a table: trim at the end."""

    @functools.wraps(f)
    def batches(*args, **options):
        try:
            yield from f(*args, **options)
        finally:
            trim()

    @functools.wraps(f)
    def group(*args, **options):
        try:
            return f(*args, **options)
        finally:
            trim()

    return batches if inspect.isgeneratorfunction(f) else group


def rows_where(docs: DataFrame, make: Callable[[], Callable[[pa.Array], np.ndarray]]) -> DataFrame:
    """The rows of docs, with all their columns whatever they are called, for whose texts a function of texts is true.

    make() gives the function, once in each task. Columns travel under plain names, so that dots in names do no harm.
    """
    at = docs.columns.index("text")
    plain = [f"c{i}" for i in range(len(docs.columns))]
    schema = StructType([StructField(n, f.dataType, True) for n, f in zip(plain, docs.schema.fields, strict=True)])

    @lean
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good = make()
        for batch in batches:
            yield batch.filter(pa.array(good(batch.column(at)), pa.bool_()))

    return docs.toDF(*plain).mapInArrow(keep, schema).toDF(*docs.columns)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; make a temporary one only where none is set and Spark runs in one process."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="checkpoints-")
    atexit.register(shutil.rmtree, path, True)
    spark.sparkContext.setCheckpointDir(path)


#: Files of a checkpoint, for each task that can run at once, at least; and bytes of its input for which there is another.
FILES, FILE_BYTES = 4, 128 << 20


def source_bytes(df: DataFrame) -> int:
    """What the files that a table is read from hold, as Spark's plan has it (a table that isn't read from files: a very large number)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def cut(spark: SparkSession, df: DataFrame, size: int = 0) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder and cut its lineage.

    Neighbouring partitions are written by one task where they are many and small: `size` is about what all of it came from, in
    bytes, and files are as many as that asks for, or as a few for each task that can run at once.
    """
    ensure_checkpoint_dir(spark)
    files = max(FILES * max(1, spark.sparkContext.defaultParallelism), size // FILE_BYTES)
    return df.coalesce(min(files, 1 << 30)).checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of plans that are no longer referenced, and give back memory on the driver."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim()


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether a row is held out from learning, by the CRC of its id as text (a null id is held out)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(True))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising mixer over uint64 (in a new array)."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xC2B2AE3D27D4EB4F)
    x ^= x >> U64(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i mod 2**64 for i < n; a worker keeps those that chunks of usual size need."""
    have = _powers if _powers and len(_powers["p"]) >= n else {}
    if not have:
        m = max(n, CHUNK_BYTES + CHUNK_BYTES // 8)
        for key, base in (("p", _P), ("q", _PINV)):
            out = np.full(m, base, dtype=U64)
            out[0] = 1
            have[key] = np.multiply.accumulate(out)
        if m <= 2 * CHUNK_BYTES:
            _powers.update(have)
    return have["p"][:n], have["q"][:n]


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]


class Chunk:
    """Some documents as one byte buffer, a newline after each: data[start[i]:end[i]] is document i."""

    __slots__ = ("data", "end", "rows", "start")

    def __init__(self, rows: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.rows, self.data, self.start, self.end = rows, data, start, end


def text_chunks(text: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of a column (null: empty) in chunks of about `limit` bytes; rows holds their row numbers."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    n = len(text)
    if not n:
        return
    text = pc.fill_null(text.cast(pa.large_string()) if not pa.types.is_large_binary(text.type) else text, "" if not pa.types.is_large_binary(text.type) else b"")
    sizes = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(sizes)
    at = 0
    while at < n:
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
        part = text.slice(at, to - at)
        offsets = np.frombuffer(part.buffers()[1], dtype=np.int64)[part.offset : part.offset + len(part) + 1]
        raw = np.frombuffer(part.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if part.buffers()[2] is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
        size = sizes[at:to]
        start = np.cumsum(size + 1) - (size + 1)
        data = np.full(len(raw) + len(size), 10, dtype=np.uint8)
        body = np.ones(len(data), dtype=bool)
        body[start + size] = False
        data[body] = raw
        yield Chunk(np.arange(at, to), data, start, start + size)
        at = to


def word_runs(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of word bytes; the buffer ends with a byte that is none."""
    flag = is_word[data].view(np.int8)
    edge = np.flatnonzero(flag[1:] != flag[:-1]) + 1
    if len(flag) and flag[0]:
        edge = np.concatenate([[0], edge])
    return edge[0::2], edge[1::2]


class RunHasher:
    """64-bit hashes of byte runs of a buffer, A-Z lower-cased if asked; equal runs have equal hashes anywhere."""

    def __init__(self, data: np.ndarray, lower: bool = True):
        p, self.inverse = powers(len(data) + 1)
        self.total = np.empty(len(data) + 1, dtype=U64)
        self.total[0] = 0
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * p[:-1], out=self.total[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.inverse[start] + (end - start).astype(U64))


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    return RunHasher(data, lower)(start, end)
