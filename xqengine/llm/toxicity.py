"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes ratios.

Features are n-grams of code points (lower case, white space as one kind), hashed to
2**HASH_BITS; a text has a feature or not, however often. From labelled rows, each feature
gets its naive Bayes log-count ratio r; the features whose ratio is surest are kept, and a
logistic regression is fitted to the scaled features x * r.

Fitting uses at most ``max_rows`` labelled rows (a documented bound: those with the
smallest hash of their id). One task adds up their counts and chooses the features, one
learns the weights, so the driver gets no more than the model. Scoring reads every row
whole, in the executors, with one table look-up for each byte and order.

Only text is an input of a score. Defined results: null and '' get the score of a text
without features; rows whose label is null aren't learned from; several labels of one id
count as toxic if one is; without labelled rows of both kinds every score is the share of
toxic ones (0 without any); further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xqengine.llm.common import held_out, map_arrow, pieces, table

ORDERS = (4, 5, 6)
HASH_BITS = 20
#: Characters that are looked at together; (row, feature) pairs that are.
SEGMENT, PAIRS = 1 << 17, 1 << 18
_MULT, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _fold() -> np.ndarray:
    """Each character's lower case, where that is one character; white space is a space."""
    low = [c if 0xD800 <= c < 0xE000 or len(x := chr(c).lower()) > 1 else 32 if x.isspace() else ord(x) for c in range(1 << 16)]
    return np.array([*low, 0], np.uint32)  # the last stands for all others


_FOLD = _fold()


@dataclass(frozen=True)
class Model:
    """Weights of the kept features (hash, weight) and the intercept."""

    features: np.ndarray
    weights: np.ndarray
    bias: float


def code_points(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of rows of UTF-8 bytes and the rows' borders among them; bytes that are
    no UTF-8 count as U+FFFD."""
    try:
        text = b.tobytes().decode()
    except UnicodeDecodeError:
        rows = [b[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(off[:-1], off[1:], strict=True)]
        return np.frombuffer("".join(rows).encode("utf-32-le"), "<u4"), np.cumsum([0, *map(len, rows)])
    lead = np.zeros(len(b) + 1, np.int64)
    np.cumsum((b & 0xC0) != 0x80, out=lead[1:])
    return np.frombuffer(text.encode("utf-32-le"), "<u4"), lead[off]


def hits(b: np.ndarray, off: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs among the features flagged in ``wanted``, a segment at a
    time, so that a long text takes no more room than its distinct features."""
    chars, off = code_points(b, off)
    found = np.zeros(0, np.int64)
    most = max(ORDERS)
    for a in range(0, len(chars), SEGMENT):
        part = chars[a : a + SEGMENT + most - 1]
        x = _FOLD[np.minimum(part, len(_FOLD) - 1)].astype(np.uint64)
        np.copyto(x, part, where=part >= len(_FOLD) - 1)
        row = np.searchsorted(off, np.arange(a, a + len(x)), "right") - 1
        left = off[row + 1] - np.arange(a, a + len(x))  # characters to the row's end
        g, new = x.copy(), []
        for have in range(1, most + 1):
            if have > 1:
                g = g[:-1] * _MIX + x[have - 1 :]
            if have in ORDERS:
                h = ((g + np.uint64(have)) * _MULT >> np.uint64(64 - HASH_BITS)).astype(np.int64)[:SEGMENT]
                at = np.flatnonzero(wanted[h] & (left[: len(h)] >= have))
                new.append(row[at] << HASH_BITS | h[at])
            if len(g) < 2:
                break
        found = np.unique(np.concatenate([found, *new]))
    return found >> HASH_BITS, found & ((1 << HASH_BITS) - 1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> DataFrame:
    """(label, text) of the rows to learn from. The ids are bounded, hence broadcast."""
    lab = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label IS NOT NULL AND id IS NOT NULL")
    lab = lab.where(~held_out(F.col("id"), 4)).groupBy("id").agg(F.max("label").alias("label"))
    lab = lab.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(lab), "id").select("label", "text")


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 20_000, max_features: int = 8192, tasks: int = 24) -> Model:
    sample = _sample(docs, labels, id_col, text_col, label_col, max_rows).repartition(tasks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << HASH_BITS), np.int32)
        rows = [0, 0]
        everything = np.ones(1 << HASH_BITS, bool)
        for batch in batches:
            for part, b, off in pieces(batch, "text", 1 << 18):
                y = part.column("label").to_numpy() > 0
                r, f = hits(b, off, everything)
                for k in (0, 1):
                    total[k] += np.bincount(f[y[r] == k], minlength=1 << HASH_BITS).astype(np.int32)
                    rows[k] += int((y == k).sum())
        if sum(rows):
            yield pa.RecordBatch.from_arrays([pa.array([rows[0]]), pa.array([rows[1]]), pa.array([zlib.compress(total.tobytes(), 1)])], ["neg", "pos", "counts"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, neg, pos = np.zeros((2, 1 << HASH_BITS), np.int32), 0, 0
        for batch in batches:
            for r in batch.to_pylist():
                total += np.frombuffer(zlib.decompress(r["counts"]), np.int32).reshape(2, -1)
                neg, pos = neg + r["neg"], pos + r["pos"]
        chosen, ratio = sure_features(total, neg, pos, max_features) if neg and pos else (np.zeros(0, np.int64), np.zeros(0))
        yield pa.RecordBatch.from_arrays([pa.array([neg]), pa.array([pos]), pa.array([chosen.astype("<i8").tobytes()]), pa.array([ratio.tobytes()])], ["neg", "pos", "chosen", "ratio"])

    counts = map_arrow(sample, count, "neg long, pos long, counts binary").repartition(1)
    found = map_arrow(counts, choose, "neg long, pos long, chosen binary, ratio binary").collect()  # a row of max_features at most
    neg, pos = (found[0]["neg"], found[0]["pos"]) if found else (0, 0)
    if not neg or not pos:
        share = pos / max(1, neg + pos)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    chosen, ratio = np.frombuffer(found[0]["chosen"], "<i8"), np.frombuffer(found[0]["ratio"])
    wanted = np.zeros(1 << HASH_BITS, bool)
    wanted[chosen] = True

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, b, off in pieces(batch, "text", 1 << 18):
                r, f = hits(b, off, wanted)
                cut = np.searchsorted(r, np.arange(part.num_rows + 1))
                found = [f[cut[i] : cut[i + 1]].astype("<i4").tobytes() for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(found, pa.binary())], ["label", "features"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.min_scalar_type(max(1, len(chosen)))
        rows = sorted((y, x) for batch in batches for y, x in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True))  # so that sums don't depend on the order they came in
        y = np.array([y > 0 for y, _ in rows], float)
        feats = [np.searchsorted(chosen, np.frombuffer(x, "<i4")).astype(kind) for _, x in rows]
        size = [len(x) for x in feats]
        weights, bias = logistic(np.repeat(np.arange(len(feats), dtype=np.int32), size), np.concatenate([np.zeros(0, kind), *feats]), ratio, y)
        yield pa.RecordBatch.from_arrays([pa.array([(weights * ratio).tobytes()]), pa.array([bias])], ["weights", "bias"])

    rows = map_arrow(sample, extract, "label int, features binary").repartition(1)
    learned = map_arrow(rows, learn, "weights binary, bias double").first()
    return Model(chosen, np.frombuffer(learned["weights"]), learned["bias"])


def sure_features(total: np.ndarray, neg: int, pos: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The features whose share of rows differs most surely between the labels, ascending, and
    their log-count ratios."""
    some = np.flatnonzero(total.sum(0) >= 5)
    n, y = total[:, some]
    p, q = (y + 0.5) / (pos + 1), (n + 0.5) / (neg + 1)
    mean = (n + y + 1) / (neg + pos + 2)
    sure = np.abs((p - q) / np.sqrt(mean * (1 - mean) * (1 / pos + 1 / neg)))
    best = np.argsort(-sure, kind="stable")[:most]
    best = np.sort(best[sure[best] > 3])
    return some[best], np.log(p[best] / q[best])


def logistic(row: np.ndarray, col: np.ndarray, scale: np.ndarray, y: np.ndarray, rounds: int = 300, ridge: float = 1e-4, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression on sparse 0/1 features times ``scale`` (Adam on
    the whole sample; the order of rows doesn't matter)."""
    n, w, b = max(len(y), 1), np.zeros(len(scale)), 0.0
    m, v = np.zeros(len(scale) + 1), np.zeros(len(scale) + 1)
    runs = [slice(a, a + PAIRS) for a in range(0, len(row), PAIRS)]
    for k in range(1, rounds + 1):
        x, z, g = w * scale, np.zeros(len(y)), np.zeros(len(scale))
        for at in runs:
            z += np.bincount(row[at], x[col[at]], len(y))
        err = sigmoid(z + b) - y
        for at in runs:
            g += np.bincount(col[at], err[row[at]], len(scale))
        g = np.append(g * scale / n + ridge * w, err.sum() / n)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", keep_text: bool = False, name: str = "score") -> DataFrame:
    """``docs`` (without the text unless ``keep_text``) plus the score; text is read
    whole."""
    keys = [c for c in docs.columns if c != name and (keep_text or c != text_col)]
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keys] + [f"`{name}` double"])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most max_features weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        wanted = np.zeros(1 << HASH_BITS, bool)
        weight = np.zeros(1 << HASH_BITS)
        wanted[m.features], weight[m.features] = True, m.weights
        for batch in batches:
            for part, b, off in pieces(batch, text_col):
                r, f = hits(b, off, wanted)
                z = np.bincount(r, weight[f], part.num_rows) + m.bias
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in keys] + [pa.array(sigmoid(z))], [*keys, name])

    return map_arrow(docs, run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **fitting) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of ``docs``."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **fitting)
    scored = score(docs.select(id_col, text_col), model, text_col=text_col)
    return scored.select(id_col, held_out(F.col(id_col), 4).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
