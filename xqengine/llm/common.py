"""What the operators of this subpackage share: tables, the shared folder, text kernels.

The kernels work on one Arrow string column at a time and treat it as one byte
buffer, so a batch costs a few numpy passes instead of a Python loop over words.
Word hashes are polynomial prefix hashes mod 2**64 with a murmur finaliser.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel works on at a time; one longer document is one piece.
PIECE_BYTES = 1 << 20
#: Most rows that go to a Python worker at once: texts are long, and both sides hold a batch.
BATCH_ROWS = 2000
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_R = 0x9E3779B97F4A7C55 | 1
_M64 = (1 << 64) - 1
_RINV = pow(_R, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see; a temporary one only where none is named and all
    runs on one machine, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="xqengine-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def materialise(df: DataFrame, name: str, **options) -> DataFrame:
    """Write to the shared folder and read again: lineage ends there, and a lost
    executor costs only a reread."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote and nothing reads any more."""
    for df in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Give memory that a task no longer uses back to the system: workers outlive tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` whose workers can import this package. Where it lies in a folder they
    don't see, ship it with --py-files."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    conf = df.sparkSession.conf
    if int(conf.get(_BATCH_ROWS)) > BATCH_ROWS:
        conf.set(_BATCH_ROWS, BATCH_ROWS)
    df.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return df.mapInArrow(tidy, schema)


def held_out(doc_id, modulus: int):
    """crc32 of the id's decimal text leaves remainder 2; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == 2


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def separators(*spans: tuple[int, int]) -> np.ndarray:
    t = np.zeros(256, bool)
    for a, b in spans:
        t[a : b + 1] = True
    return t


LOWER = lower_ascii()
SPACES = separators((0x20, 0x20), (0x09, 0x0D))


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) runs of whole rows of about ``most`` bytes; null text is ''."""
    i = batch.schema.get_field_index(column)
    text = batch.column(i)
    if text.null_count:
        text = text.fill_null("")
    text = text.cast(pa.large_binary())
    n = len(text)
    if not n:
        return
    off = np.frombuffer(text.buffers()[1], np.int64, n + 1 + text.offset)[text.offset :]
    data = text.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield batch.slice(a, b - a), whole[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def spans(b: np.ndarray, off: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes outside ``sep``, cut at row borders, and
    for each row the index of its first word (one more entry than rows)."""
    if not len(b):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    word = ~sep[b]
    cut = np.zeros(len(b) + 1, bool)
    cut[off] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | cut[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | cut[1:-1]
    s = np.flatnonzero(begin)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, off)


def mix(h: np.ndarray) -> np.ndarray:
    """Murmur3's 64-bit finaliser (fixed constants)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, PIECE_BYTES + 1)
        both = []
        for base in (_R, _RINV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        if n > 4 * PIECE_BYTES:
            return both[0], both[1]
        _powers = both[0], both[1]
    return _powers


def span_hashes(b: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    if not len(s):
        return np.zeros(0, np.uint64)
    up, down = _power(len(b) + 1)
    prefix = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=prefix[1:])
    h = (prefix[e] - prefix[s]) * down[s]
    return mix(h + (e - s).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Order-dependent hashes of all k consecutive entries (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[j : j + n]
        out ^= out >> np.uint64(29)
    return mix(out)


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row index of each word, from ``spans``' third result."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
