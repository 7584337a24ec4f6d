"""Removal of repeated lines and sentences by hashing.

Units are lines, cut further after sentence ends ('.', '!' or '?' before white space), so
that a passage that starts inside a line still meets its other occurrences. A unit is
normalised (lower-case A-Z, runs of white space as one) and gets a 128-bit digest. Of the
units with one digest the earliest stays, by document rank and then place in the text; the
rest go, whatever their length: a removed stretch is a run of neighbouring repeated units,
and a single word is one too. Only a caller that sets ``min_words`` keeps shorter runs.
Offsets count the code points of the original text.

A digest's earliest document is a partially aggregated minimum, and only digests that
occur twice are joined back, through a written table, so that a digest that fills a third
of the rows is summed before it moves and its join can be split.

Defined results: null, empty and white-space texts have no units; each row is a document of
its own, with a repeated or null id too: rank is the id (null last), then the text's hash,
then the row's number, so of equal rows one stays; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from xqengine.llm.common import LOWER, SPACES, _power, map_arrow, materialise, mix, pieces, span_hashes, spans, table

_CUT = np.zeros(256, bool)
_CUT[0] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


def units(b: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """row, ord, start, end (code points), words, h1, h2 and again (has an equal unit
    earlier in its row) of each unit."""
    b = LOWER[b]
    marked = b.copy()
    cut = SPACES[b]
    cut[1:] &= (b[1:] == 10) | _STOP[b[:-1]]
    cut[:1] &= b[:1] == 10
    marked[cut] = 0
    us, ue, _ = spans(marked, off, _CUT)
    ws, we, _ = spans(b, off, SPACES)
    i, j = np.searchsorted(ws, us), np.searchsorted(ws, ue)
    real = j > i
    i, j = i[real], j[real]
    if not len(i):
        z = np.zeros(0, np.int64)
        return {k: z for k in ("row", "ord", "start", "end", "words", "h1", "h2", "again")}
    h = span_hashes(b, ws, we)
    up, down = _power(len(h) + 1)
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        prefix = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h ^ np.uint64(salt)) * up[: len(h)], out=prefix[1:])
        out.append(mix((prefix[j] - prefix[i]) * down[i] + (j - i).astype(np.uint64) * np.uint64(salt)).view(np.int64))
    start, end = ws[i], we[j - 1]
    row = np.searchsorted(off, start, "right") - 1
    points = np.zeros(len(b) + 1, np.int64)
    np.cumsum((b & 0xC0) != 0x80, out=points[1:])
    base = points[off[row]]
    order = np.lexsort((np.arange(len(row)), out[1], out[0], row))
    same = (row[order[1:]] == row[order[:-1]]) & (out[0][order[1:]] == out[0][order[:-1]]) & (out[1][order[1:]] == out[1][order[:-1]])
    again = np.zeros(len(row), bool)
    again[order[1:]] = same
    first = np.searchsorted(row, np.arange(len(off)))
    return {"row": row, "ord": np.arange(len(row)) - first[row], "start": points[start] - base, "end": points[end] - base, "words": j - i, "h1": out[0], "h2": out[1], "again": again}


def _numbered(row_col: str | None) -> Column:
    """A row's key: the caller's, or its place in the table as it is read."""
    return F.col(row_col).cast("long") if row_col else F.monotonically_increasing_id()


def unit_rows(docs: DataFrame, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    names = ("ord", "start", "end", "words", "h1", "h2", "again")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, b, off in pieces(batch, "text"):
                u = units(b, off)
                at = pa.array(u["row"])
                keys = [part.column(k).take(at) for k in ("id", "text_hash", "row")]
                cols = [pa.array(u[k].astype(bool if k == "again" else np.int64)) for k in names]
                yield pa.RecordBatch.from_arrays([*keys, *cols], ["id", "text_hash", "row", *names])

    keep = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), _numbered(row_col).alias("row"), F.col(text_col).alias("text"))
    return map_arrow(keep, run, "id long, text_hash long, row long, ord long, start long, end long, words long, h1 long, h2 long, again boolean")


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, min_words: int = 1) -> DataFrame:
    """(doc_id, start, end, n_units, n_words, kept_doc_id, text_hash, row): the stretches to
    remove, where the earliest document with one of a stretch's units is ``kept_doc_id``.
    ``row`` is the row's key: ``row_col``, unique, or else the row's place in the table."""
    found = unit_rows(docs, id_col, text_col, row_col)
    last = F.lit((1 << 63) - 1)
    rank = F.struct(F.coalesce("id", last).alias("id"), "text_hash", "row")
    first = found.groupBy("h1", "h2").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = materialise(first, "unit-firsts")
    hit = found.join(first, ["h1", "h2"]).where(F.col("again") | (rank > F.col("first"))).withColumn("first_id", F.col("first.id"))
    runs = hit.withColumn("run", F.col("ord") - F.row_number().over(W.partitionBy("row").orderBy("ord")))
    out = runs.groupBy("row", "run").agg(F.max("id").alias("id"), F.max("text_hash").alias("text_hash"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_units"), F.sum("words").alias("n_words"), F.min("first_id").alias("kept"))
    return out.where(F.col("n_words") >= min_words).select(F.col("id").alias(id_col), "start", "end", "n_units", "n_words", F.nullif("kept", last).alias("kept_doc_id"), "text_hash", "row")


def remove_spans(docs: DataFrame, found: DataFrame, *, text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """``docs`` with the stretches cut out, and ``removed``: their original offsets. Without
    a ``row_col``, ``docs`` must be the table that ``found`` was made from, read alike."""
    lists = found.groupBy(F.col("row").alias("__row")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed"))
    joined = docs.withColumn("__key", _numbered(row_col)).join(lists, F.col("__key") == F.col("__row"), "left").drop("__row", "__key")
    nothing = F.struct(F.lit("").alias("t"), F.lit(0).cast("long").alias("at"))
    text = F.col(text_col)
    cut = F.aggregate("removed", nothing, lambda a, x: F.struct(F.concat(a["t"], F.substr(text, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int"))).alias("t"), x["end"].alias("at")))
    whole = F.concat(cut["t"], F.substr(text, (cut["at"] + 1).cast("int")))
    return joined.withColumn(text_col, F.when(F.col("removed").isNull(), text).otherwise(whole))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents")).drop("row", "text_hash")


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: Of tables whose ids are unique; units are compared themselves instead of by digests.
ORACLE = f"""
WITH cut AS (SELECT doc_id, string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '([.!?])[\x20\x09-\x0D]', '\\1' || chr(10), 'g'), chr(10)) AS parts FROM documents),
flat AS (SELECT doc_id, unnest(parts) AS p, generate_subscripts(parts, 1) AS k FROM cut),
placed AS (SELECT *, sum(length(p) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(p) - 1 AS pre, regexp_extract_all(p, '[^\x20\x09-\x0D]+') AS ws FROM flat),
u AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS ord, pre + length(p) - length(ltrim(p, {_BLANKS})) AS s, pre + length(rtrim(p, {_BLANKS})) AS e, len(ws) AS words, array_to_string(ws, ' ') AS norm FROM placed WHERE len(ws) > 0),
f AS (SELECT norm, min(doc_id) AS first_id FROM u GROUP BY norm HAVING count(*) > 1),
hit AS (SELECT * FROM (SELECT u.*, first_id, row_number() OVER (PARTITION BY doc_id, norm ORDER BY ord) > 1 AS again FROM u JOIN f USING (norm)) WHERE again OR doc_id > first_id),
runs AS (SELECT *, ord - row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS run FROM hit)
SELECT doc_id, CAST(min(s) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS "end", count(*) AS n_units, CAST(sum(words) AS BIGINT) AS n_words, min(first_id) AS kept_doc_id FROM runs GROUP BY doc_id, run"""
