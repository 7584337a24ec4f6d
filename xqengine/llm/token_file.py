"""Token ids as static range-ANS blocks.

Format. A set of files has one table and many blocks, both rows of Parquet files, so any
store that Spark writes to will do.

* Table: for each id that occurs, a frequency of at least 1; they sum to 2**bits.
* Block: whole documents in ascending order of id, coded by the shared table and by
  nothing else, so each can be decoded alone. ``LANES`` interleaved 64-bit states share
  one stream of 32-bit words: symbol ``i`` belongs to lane ``i % LANES``. After every
  ``CHECKPOINT_STEPS`` steps the states and the place in the stream are kept, so that a
  block can be decoded from several points at once. All fields end in a CRC-32 that the
  reader verifies; the document lengths give the borders.

Defined results: null and '' are one end id; rows that repeat an id follow each other,
ordered by length and checksum; a null id sorts first; an empty table has no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from xqengine.llm.common import discard, map_arrow, materialise, partitions_for, shared_dir, table
from xqengine.llm.tokens import encoder, forget

MAGIC = b"XQR1"
LANES = 2048
CHECKPOINT_STEPS = 32
BLOCK_TOKENS = 1 << 19
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sHHIIII")


@dataclass(frozen=True)
class Table:
    """Frequencies (0: doesn't occur) and their running sum; ``slots`` maps back."""

    bits: int
    freq: np.ndarray
    start: np.ndarray
    slots: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Table:
        """Scale counts to a sum of 2**bits, at least 1 for each id that occurs."""
        counts = counts.astype(np.float64)
        there = np.flatnonzero(counts)
        bits = max(12, int(np.ceil(np.log2(max(len(there), 1)))) + 3)
        freq = np.zeros(len(counts), np.int64)
        if len(there):
            share = counts[there] / counts.sum() * (1 << bits)
            f = np.maximum(1, np.floor(share)).astype(np.int64)
            # What is left over or owed goes to the largest, which feel it least.
            big = np.argsort(-f, kind="stable")
            short = (1 << bits) - int(f.sum())
            k = 0
            while short:
                i = big[k % len(big)]
                step = short if short > 0 and k == 0 else max(short, -int(f[i] // 2))
                if short > 0 or f[i] > 1:
                    f[i] += step
                    short -= step
                k += 1
            freq[there] = f
        start = np.concatenate([[0], np.cumsum(freq)])[:-1]
        slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        return cls(bits, freq.astype(np.uint64), start.astype(np.uint64), slots)


def encode_symbols(ids: np.ndarray, t: Table) -> bytes:
    """Stream, states and checkpoints of one block's ids."""
    n = len(ids)
    steps = -(-n // LANES)
    if not steps:
        return struct.pack("<II", 0, 0)
    grid = np.full(steps * LANES, ids[-1], np.int64)
    grid[:n] = ids
    f = t.freq[grid].reshape(steps, LANES)
    c = t.start[grid].reshape(steps, LANES)
    bits, word = np.uint64(t.bits), np.uint64(32)
    most = f << np.uint64(63 - t.bits)
    x = np.full(LANES, _LOW, np.uint64)
    chunks, marks, out = [], [], 0
    for k in range(steps - 1, -1, -1):
        full = x >= most[k]
        if full.any():
            chunks.append(x[full].astype(np.uint32))
            out += len(chunks[-1])
            x = np.where(full, x >> word, x)
        q = x // f[k]
        x = (q << bits) + (x - q * f[k]) + c[k]
        if k % CHECKPOINT_STEPS == 0:
            marks.append((out, x))
    words = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, np.uint32)
    marks = marks[::-1]
    at = np.array([len(words) - o for o, _ in marks], np.uint32)
    states = np.concatenate([s for _, s in marks])
    return struct.pack("<II", len(words), len(marks)) + at.tobytes() + states.tobytes() + words.tobytes()


def decode_symbols(data: bytes, n: int, t: Table, part: int | None = None) -> np.ndarray:
    """The ids, or those from checkpoint ``part`` to the next. All checkpoints of a block
    are decoded side by side, as lanes of one array."""
    n_words, n_marks = struct.unpack_from("<II", data)
    if not n_marks:
        return np.zeros(0, np.uint32)
    at = np.frombuffer(data, np.uint32, n_marks, 8).astype(np.int64)
    states = np.frombuffer(data, np.uint64, n_marks * LANES, 8 + 4 * n_marks).reshape(n_marks, LANES)
    words = np.frombuffer(data, np.uint32, n_words, 8 + 4 * n_marks + 8 * n_marks * LANES).astype(np.uint64)
    steps = -(-n // LANES)
    which = range(n_marks) if part is None else [part]
    sizes = [min(CHECKPOINT_STEPS, steps - m * CHECKPOINT_STEPS) for m in which]
    out = np.zeros((len(sizes), CHECKPOINT_STEPS, LANES), np.uint32)
    mask, bits, word = np.uint64((1 << t.bits) - 1), np.uint64(t.bits), np.uint64(32)
    live = np.array(list(which))
    x, pos = states[live].copy(), at[live].copy()
    size = np.array(sizes)
    for k in range(CHECKPOINT_STEPS):
        rows = np.flatnonzero(size > k)
        if not len(rows):
            break
        if len(rows) < len(x):  # only the last part of a block is shorter
            x, pos, size, live = x[rows], pos[rows], size[rows], live[rows]
        slot = x & mask
        sym = t.slots[slot]
        out[: len(x), k] = sym
        x = t.freq[sym] * (x >> bits) + slot - t.start[sym]
        less = x < _LOW
        need = less.sum(1)
        if need.any():
            where = np.repeat(pos - np.concatenate([[0], np.cumsum(need)[:-1]]), need) + np.arange(need.sum())
            x[less] = (x[less] << word) | words[where]
            pos = pos + need
    flat = [out[i, : sizes[i]].reshape(-1) for i in range(len(sizes))]
    got = np.concatenate(flat)
    return got[: n - (live[0] if part is not None else 0) * CHECKPOINT_STEPS * LANES]


def pack_block(ids: np.ndarray, lengths: np.ndarray, t: Table) -> bytes:
    body = _HEAD.pack(MAGIC, 1, t.bits, LANES, CHECKPOINT_STEPS, len(lengths), len(ids)) + lengths.astype("<u4").tobytes() + encode_symbols(ids, t)
    return body + struct.pack("<I", zlib.crc32(body))


def unpack_block(data: bytes, t: Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths); raises ValueError if the bytes are not what was written."""
    body, (crc,) = data[:-4], struct.unpack("<I", data[-4:])
    if zlib.crc32(body) != crc:
        raise ValueError("token block: checksum differs")
    magic, version, bits, lanes, every, n_docs, n = _HEAD.unpack_from(body)
    if (magic, version, bits, lanes, every) != (MAGIC, 1, t.bits, LANES, CHECKPOINT_STEPS):
        raise ValueError("token block: another format or table")
    lengths = np.frombuffer(body, "<u4", n_docs, _HEAD.size).astype(np.int64)
    return decode_symbols(body[_HEAD.size + 4 * n_docs :], n, t), lengths


def tokens_in(head: bytes) -> int:
    return _HEAD.unpack(head)[6]


def encode_texts(docs: DataFrame, tokenizer_path: str, end_id: int | None, id_col: str, text_col: str) -> DataFrame:
    """(id, n_tokens, crc, ids): little-endian, two bytes an id where all fit, else four.
    Each task adds a row with ``n_tokens`` -1 that has how often each id occurs in it."""
    keep = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(tokenizer_path).ids
        total = np.zeros(0, np.int64)
        for whole in batches:
            for a in range(0, whole.num_rows, 200):
                b = whole.slice(a, 200)
                n, crc, out, seen = [], [], [], []
                for t in b.column("text"):
                    raw = ids(t.as_py()) + end
                    n.append(len(raw) >> 2)
                    crc.append(zlib.crc32(raw))
                    x = np.frombuffer(raw, "<u4")
                    seen.append(x)
                    out.append(b"\2" + x.astype("<u2").tobytes() if not len(x) or x.max() < 1 << 16 else b"\4" + raw)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(out, pa.binary())], ["id", "n_tokens", "crc", "ids"])
                total = added(total, np.bincount(np.concatenate(seen)))
        if len(total):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([-1]), pa.array([0]), pa.array([zlib.compress(total.astype("<i8").tobytes(), 1)])], ["id", "n_tokens", "crc", "ids"])

    return map_arrow(keep, run, "id long, n_tokens long, crc long, ids binary")


def _ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if raw[:1] == b"\2" else "<u4", offset=1)


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of two arrays of counts, as long as the longer."""
    if len(a) < len(b):
        a, b = b, a
    out = a.copy()
    out[: len(b)] += b
    return out


def count_ids(encoded: DataFrame) -> np.ndarray:
    """How often each id occurs. The driver gets one row for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total = np.zeros(0, np.int64)
        for b in batches:
            for x in b.column("ids"):
                total = added(total, np.frombuffer(zlib.decompress(x.as_py()), "<i8"))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["token", "n"])

    rows = map_arrow(encoded.where("n_tokens = -1").select("ids"), run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(rows["token"].max()) + 1 if len(rows) else 1, np.int64)
    counts[rows["token"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts


def write_token_files(docs: DataFrame, tokenizer_path: str, out_path: str, *, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text and write the table and blocks under ``out_path``."""
    spark = docs.sparkSession
    encoded = materialise(encode_texts(docs, tokenizer_path, end_id, id_col, text_col), "token-ids")
    counts = count_ids(encoded)
    t = Table.of(counts)
    rows = [(int(i), int(t.freq[i])) for i in np.flatnonzero(t.freq)]
    spark.createDataFrame(rows, "token long, freq long").withColumn("size", F.lit(len(counts))).withColumn("bits", F.lit(t.bits)).coalesce(1).write.parquet(f"{out_path}/table")
    shared = spark.sparkContext.broadcast(counts)  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        t, part = Table.of(shared.value), TaskContext.get().partitionId()
        names = ["part", "seq", "part_start", "doc_ids", "payload"]
        held, n, seq, start = [], 0, 0, 0

        def block() -> pa.RecordBatch:
            ids = np.concatenate([_ids(x) for _, x in held])
            lengths = np.array([len(_ids(x)) for _, x in held])
            cols = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([start], pa.int64()), pa.array([[i for i, _ in held]], pa.list_(pa.int64())), pa.array([pack_block(ids, lengths, t)], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names)

        for b in batches:
            for i, x in zip(b.column("id"), b.column("ids"), strict=True):
                held.append((i.as_py(), x.as_py()))
                n += len(_ids(held[-1][1]))
                if n >= BLOCK_TOKENS:
                    yield block()
                    held, n, seq, start = [], 0, seq + 1, start + n
        if held:
            yield block()

    ordered = encoded.where("n_tokens >= 0").repartitionByRange(partitions_for(spark), "id").sortWithinPartitions("id", "n_tokens", "crc")
    blocks = map_arrow(ordered.select("id", "ids"), run, "part int, seq int, part_start long, doc_ids array<long>, payload binary")
    blocks.write.parquet(f"{out_path}/blocks")
    discard(spark, encoded)


def read_table(spark: SparkSession, out_path: str) -> Table:
    rows = spark.read.parquet(f"{out_path}/table").toPandas()
    if not len(rows):
        return Table.of(np.zeros(1, np.int64))
    freq = np.zeros(int(rows["size"].iloc[0]), np.int64)
    freq[rows["token"].to_numpy(np.int64)] = rows["freq"].to_numpy(np.int64)
    start = np.concatenate([[0], np.cumsum(freq)])[:-1]
    return Table(int(rows["bits"].iloc[0]), freq.astype(np.uint64), start.astype(np.uint64), np.repeat(np.arange(len(freq), dtype=np.uint32), freq))


def read_token_files(spark: SparkSession, out_path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids array]) from the files alone."""
    blocks = spark.read.parquet(f"{out_path}/blocks")
    shared = spark.sparkContext.broadcast(read_table(spark, out_path))
    heads = blocks.select("part", F.substring("payload", 1, _HEAD.size).alias("head"))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            n = [tokens_in(x.as_py()) for x in b.column("head")]
            yield pa.RecordBatch.from_arrays([b.column("part"), pa.array(n, pa.int64())], ["part", "n"])

    # One row for each file part; its running sum is the only unpartitioned window.
    parts = map_arrow(heads, sizes, "part int, n long").groupBy("part").agg(F.sum("n").alias("n"))
    before = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    placed = blocks.join(F.broadcast(before), "part").select((F.col("before") + F.col("part_start")).alias("start"), "doc_ids", "payload")
    schema = "id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            for start, docs, payload in zip(b.column("start"), b.column("doc_ids"), b.column("payload"), strict=True):
                ids, lengths = unpack_block(payload.as_py(), shared.value)
                ends = np.cumsum(lengths)
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[e - k : e].tobytes()) for e, k in zip(ends, lengths, strict=True)]
                cols = [docs.values, pa.array(start.as_py() + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, ["id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return map_arrow(placed, run, schema).withColumnRenamed("id", "doc_id")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    out = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), out)
    return read_token_files(spark, out)
