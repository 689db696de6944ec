"""What several corpus operators share: scratch folders, checkpoints, slices of text, hashes."""

from __future__ import annotations

import atexit
import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once inside a task, in bytes; a longer single text is handled alone.
SLICE_BYTES = 1 << 20

#: Texts handed to a Python worker at once, in bytes.
BATCH_BYTES = 4 << 20

_MADE: list[str] = []
_LOADED: list = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode an own one where it is unset."""
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if set_dir:
        return set_dir.rstrip("/")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyforge-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends.

    Whatever writes there also hands texts to Python in batches of BATCH_BYTES at most: long texts at
    10,000 rows a batch would not fit beside the JVM.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    path = f"{shared_dir(spark)}/tallyforge/{uuid.uuid4().hex}-{name}"
    if not _MADE:
        atexit.register(_remove, spark)
    _MADE.append(path)
    return path


def _remove(spark: SparkSession) -> None:
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _MADE:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
    except Exception:  # noqa: BLE001  the session is gone; the folder is the cluster's to clean
        return


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """The rows written to the shared folder and read again, so that nothing before is computed twice."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes tables that cut() wrote, when nothing that is still to run reads them."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sparkContext().hadoopConfiguration()
        for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def sized_broadcast(df: DataFrame, most_rows: int) -> DataFrame:
    """df marked for broadcast if a count shows that it has at most most_rows rows, else as it is."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def per_worker(make: Callable) -> Callable:
    """make, with its results kept by a Python worker until a stage that is lean() and doesn't name it runs there."""
    _LOADED.append(cache(make))
    return _LOADED[-1]


def let_go(but: tuple[Callable, ...] = ()) -> None:
    """Drops what per_worker() keeps, but for those functions, and gives memory that is free back to the system."""
    own = sys.modules.get("tallyforge.llm.common")  # this function may be a shipped copy; what is kept is in the worker's own module, if it has one
    for kept in own._LOADED if own else ():
        if kept not in but:
            kept.cache_clear()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def lean(run: Callable, *needs: Callable) -> Callable:
    """run for mapInArrow, with the memory of its worker given back before and after; of what per_worker() keeps, needs stay.

    Workers serve the stages of a session in turn. Each would else hold the vocabularies of all of them and the most
    that any of them took, also while it has no task.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(needs)
        try:
            yield from run(batches)
        finally:
            let_go(needs)

    return task


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def total_bytes(df: DataFrame, column: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def text_slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES, column: int = 1) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of at most limit bytes of text (or one row); null texts become empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(column)
        if col.null_count:
            col = pc.fill_null(col, "")
            batch = batch.set_column(column, batch.schema.names[column], col)
        ends = np.cumsum(pc.binary_length(col).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def as_bytes(col: pa.Array) -> list[bytes]:
    return col.cast(pa.binary()).to_pylist()


def raw_text(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column without nulls as one array, and its len+1 offsets."""
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    offsets = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective mixing of unsigned 64-bit values (multiply and xor-shift)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def pack6(values: np.ndarray) -> bytes:
    """The low 48 bits of unsigned 64-bit values, six bytes each."""
    return np.ascontiguousarray(np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack6(data: bytes) -> np.ndarray:
    six = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view("<u8").ravel()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (lengths[0] of them), then starts[1] ..., as one index array."""
    if not len(lengths):
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


SPACE = np.zeros(256, np.bool_)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_R = 0x5851F42D4C957F2D
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**i and r**-i modulo 2**64 for 0 <= i < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        both = []
        for base in (_R, pow(_R, -1, 1 << 64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _POWERS[:] = both
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Sums of values[j] * r**j over j < i, for 0 <= i <= n; span_hash reads the hash of any span from them."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * powers(len(values))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans start:end, equal for equal contents wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(np.uint64))


def words_of(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends in raw of the words of every text (by default [^\\x20\\x09-\\x0D]+; space tells what ends a word), and the text of each."""
    blank = space[raw]
    before = np.concatenate([[True], blank[:-1]]) if len(raw) else blank
    after = np.concatenate([blank[1:], [True]]) if len(raw) else blank
    filled = np.flatnonzero(np.diff(offsets))
    before[offsets[:-1][filled]] = True
    after[offsets[1:][filled] - 1] = True
    starts = np.flatnonzero(~blank & before)
    ends = np.flatnonzero(~blank & after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word windows, A-Z in lower case; fewer words make one window."""
    raw = LOWER[raw]
    starts, ends, doc = words_of(raw, offsets)
    word = span_hash(prefix_hash(raw + np.uint64(1)), starts, ends)
    sums = prefix_hash(word)
    first = np.searchsorted(doc, np.arange(len(offsets)))
    out = []
    n = len(word)
    windows = span_hash(sums, np.arange(n - width + 1), np.arange(width, n + 1)) if n >= width else np.empty(0, np.uint64)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            got = np.sort(windows[a : b - width + 1])
            keep = np.ones(len(got), np.bool_)
            np.not_equal(got[1:], got[:-1], out=keep[1:])
            out.append(got[keep])
        else:
            out.append(span_hash(sums, np.array([a]), np.array([b])) if b > a else np.empty(0, np.uint64))
    return out


def binary_rows(arrays: list[np.ndarray], kind: str) -> pa.Array:
    """Each array's bytes as one binary value."""
    return pa.array([np.ascontiguousarray(a, kind).tobytes() for a in arrays], pa.binary())
