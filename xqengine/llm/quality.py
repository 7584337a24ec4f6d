"""Quality rules whose cutoffs follow the data.

One pass counts what the rules need in every text. Quantile sketches of each measure, by
(lang, source), then set the cutoffs, and a join with them filters.

The sketch is a histogram over integer bins that keep the top six significant bits of a
value, so a quantile is off by less than 1/32 of itself. Sketches merge by adding counts:
the result doesn't depend on how rows were spread, and the sketch of a language or of the
whole table is the sum of its sources' sketches. A (lang, source) with fewer than
``min_rows`` rows takes its language's cutoffs, and a small language the table's.

Cutoffs are quartile fences: a measure may pass the upper quartile by ``reach`` times the
quartile range plus the measure's ``slack``; mean word length has a lower fence as well.

Defined results: null and '' have no words and fail the base rules; a null lang or source
is a group of its own; every row gets a row; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xqengine.llm.common import SPACES, map_arrow, materialise, pieces, rows_of, separators, span_hashes, spans, table, window_hashes

_NOT_LINE = separators((0x0A, 0x0A))
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


@dataclass(frozen=True)
class Measure:
    """An integer ratio: 1000 * top / bottom, rounded down."""

    name: str
    top: str
    bottom: str
    slack: int
    two_sided: bool = False


MEASURES = (
    Measure("repeats", "n_repeat_words", "n_words", 150),
    Measure("dup_lines", "n_dup_lines", "n_lines", 150),
    Measure("symbols", "n_symbols", "n_words", 100),
    Measure("word_length", "word_chars", "n_words", 1500, True),
)
#: Most groups for which the cutoffs are broadcast; beyond it the join shuffles.
BROADCAST_GROUPS = 100_000


def _twice(keys: np.ndarray) -> np.ndarray:
    """Which entries have an equal one elsewhere."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def text_counts(b: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of each row of a byte buffer."""
    rows = len(off) - 1
    s, e, first = spans(b, off, SPACES)
    n_words = np.diff(first)
    upto = np.zeros(len(b) + 1, np.int64)
    np.cumsum(((b & 0xC0) != 0x80) & ~SPACES[b], out=upto[1:])
    word_chars = upto[off[1:]] - upto[off[:-1]]
    sym = np.zeros(len(b) + 1, np.int64)
    np.cumsum(_SYMBOL[b], out=sym[1:])
    n_symbols = sym[off[1:]] - sym[off[:-1]]
    # Lines with a word: a line's code points outside white space are more than none.
    ls, le, lfirst = spans(b, off, _NOT_LINE)
    lrow = rows_of(lfirst)
    real = upto[le] > upto[ls]
    ls, le, lrow = ls[real], le[real], lrow[real]
    n_lines = np.bincount(lrow, minlength=rows)
    salt = lrow.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    keys = np.sort(span_hashes(b, ls, le) ^ salt) if len(ls) else np.zeros(0, np.uint64)
    n_dup = np.zeros(rows, np.int64)
    if len(keys) and (keys[1:] == keys[:-1]).any():
        key = span_hashes(b, ls, le) ^ salt
        order = np.lexsort((key, lrow))
        again = (key[order[1:]] == key[order[:-1]]) & (lrow[order[1:]] == lrow[order[:-1]])
        n_dup = np.bincount(lrow[order[1:]][again], minlength=rows)
    # Three-word windows inside one row.
    row = rows_of(first)
    w = window_hashes(span_hashes(b, s, e), 3)
    n_rep = np.zeros(rows, np.int64)
    if len(w):
        at = np.flatnonzero(row[:-2] == row[2:])
        seen = at[_twice(w[at] ^ (row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))]
        hit = np.zeros(len(s), bool)
        for j in range(3):
            hit[seen + j] = True
        n_rep = np.bincount(row[hit], minlength=rows)
    return dict(zip(COUNTS, (n_words, word_chars, n_symbols, n_dup, n_rep, n_lines), strict=True))


def with_counts(docs: DataFrame, id_col: str, text_col: str, by: tuple[str, ...]) -> DataFrame:
    """(id, *by, COUNTS) of every row."""
    keep = docs.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"by_{i}") for i, c in enumerate(by)], F.col(text_col).alias("text"))
    keys = [c for c in keep.columns if c != "text"]
    schema = ", ".join([f"{c} {t}" for c, t in keep.dtypes if c != "text"] + [f"{c} long" for c in COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, b, off in pieces(batch, "text"):
                got = text_counts(b, off)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keys] + [pa.array(got[c].astype(np.int64)) for c in COUNTS], [*keys, *COUNTS])

    return map_arrow(keep, run, schema)


def _value(m: Measure) -> str:
    return f"(CASE WHEN {m.bottom} > 0 THEN ({1000} * {m.top}) div {m.bottom} ELSE 0 END)"


def _bin(v: str) -> str:
    """The value with all but its top six bits cleared."""
    return f"shiftleft(shiftright({v}, greatest(0, length(bin({v})) - 6)), greatest(0, length(bin({v})) - 6))"


def cutoffs(counted: DataFrame, n_by: int, min_rows: int, reach: int) -> DataFrame:
    """(by_0.., low_<measure>, high_<measure>) for each group that occurs."""
    by = [f"by_{i}" for i in range(n_by)]
    stack = ", ".join(f"'{m.name}', {_value(m)}" for m in MEASURES)
    long = counted.where("n_words > 0").selectExpr(*by, f"stack({len(MEASURES)}, {stack}) AS (measure, v)").selectExpr(*by, "measure", f"{_bin('v')} AS bin")
    sketch = long.groupBy(*by, "measure", "bin").agg(F.count("*").alias("n"))
    sketch = materialise(sketch, "quality-sketch")
    groups = counted.select(*by).distinct()
    limits = None
    for depth in range(n_by, -1, -1):  # this group's sketch, then its parents'
        keys = by[:depth]
        merged = sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
        cols = ", ".join([*keys, "measure"])
        quart = counted.sparkSession.sql(f"""
            WITH c AS (SELECT *, sum(n) OVER (PARTITION BY {cols} ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {cols}) AS total FROM {{sketch}})
            SELECT {cols}, max(total) AS total, min(bin) FILTER (WHERE 4 * upto >= total) AS q1, min(bin) FILTER (WHERE 4 * upto >= 3 * total) AS q3
            FROM c GROUP BY {cols}""", sketch=merged)
        slack = F.create_map(*[x for m in MEASURES for x in (F.lit(m.name), F.lit(m.slack))])[F.col("measure")]
        wide = quart.groupBy(*keys).agg(
            F.max("total").alias(f"total_{depth}"),
            *[F.max(F.when(F.col("measure") == m.name, F.col("q3") + reach * (F.col("q3") - F.col("q1")) + slack)).alias(f"high_{m.name}_{depth}") for m in MEASURES],
            *[F.max(F.when(F.col("measure") == m.name, F.col("q1") - reach * (F.col("q3") - F.col("q1")) - slack)).alias(f"low_{m.name}_{depth}") for m in MEASURES if m.two_sided],
        )
        left = groups if limits is None else limits
        if keys:
            right = wide.select(*[F.col(k).alias(f"r_{k}") for k in keys], *[c for c in wide.columns if c not in keys])
            on = None
            for k in keys:
                same = F.col(k).eqNullSafe(F.col(f"r_{k}"))
                on = same if on is None else on & same
            limits = left.join(right, on, "left").drop(*[f"r_{k}" for k in keys])
        else:
            whole = wide.first()  # the whole table's sketch: one row
            limits = left.select("*", *[F.lit(whole[c]).cast("long").alias(c) for c in wide.columns])
    def pick(name: str):
        options = [F.when(F.col(f"total_{d}") >= min_rows, F.col(f"{name}_{d}")) for d in range(n_by, 0, -1)]
        return F.coalesce(*options, F.col(f"{name}_0")).alias(name)

    names = [f"high_{m.name}" for m in MEASURES] + [f"low_{m.name}" for m in MEASURES if m.two_sided]
    return limits.select(*by, *[pick(n) for n in names])


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, ...] = ("lang", "source"), min_words: int = 50, min_rows: int = 200, reach: int = 3) -> DataFrame:
    """(doc_id, COUNTS without n_lines, base_failed, kept), one row for each row."""
    counted = materialise(with_counts(docs, id_col, text_col, by), "quality-counts")
    limits = materialise(cutoffs(counted, len(by), min_rows, reach), "quality-cutoffs")
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    on = None
    for i in range(len(by)):
        same = F.col(f"a.by_{i}").eqNullSafe(F.col(f"b.by_{i}"))
        on = same if on is None else on & same
    joined = counted.alias("a").join(limits.alias("b"), on, "left")
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fine = ~base
    for m in MEASURES:
        v = F.expr(_value(m))
        fine = fine & (v <= F.col(f"high_{m.name}"))
        if m.two_sided:
            fine = fine & (v >= F.col(f"low_{m.name}"))
    return joined.select(F.col("id").alias(id_col), *[c for c in COUNTS if c != "n_lines"], base.alias("base_failed"), F.coalesce(fine, F.lit(False)).alias("kept"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def _sql_value(m: Measure) -> str:
    return f"(CASE WHEN {m.bottom} > 0 THEN (1000 * {m.top}) // {m.bottom} ELSE 0 END)"


def _oracle() -> str:
    """The same rules in SQL; the sketch's bins as integer division by a power of two."""
    values = ", ".join(f"{_sql_value(m)} AS v_{m.name}" for m in MEASURES)
    parts = []
    for m in MEASURES:
        p = f"(CASE WHEN v_{m.name} >= 64 THEN CAST(2 ** (length(bin(v_{m.name})) - 6) AS BIGINT) ELSE 1 END)"
        parts.append(f"SELECT lang, source, '{m.name}' AS measure, {m.slack} AS slack, (v_{m.name} // {p}) * {p} AS bin FROM v WHERE n_words > 0")
    levels = []
    for depth, (lang, source) in enumerate((("NULL", "NULL"), ("lang", "NULL"), ("lang", "source"))):
        levels.append(f"SELECT {depth} AS depth, {lang} AS lang, {source} AS source, measure, any_value(slack) AS slack, count(*) AS total, quantile_disc(bin, 0.25) AS q1, quantile_disc(bin, 0.75) AS q3 FROM bins GROUP BY ALL")
    checks = []
    for m in MEASURES:
        pick = lambda side: f"coalesce((SELECT {side} FROM cut WHERE depth = 2 AND total >= 200 AND measure = '{m.name}' AND cut.lang IS NOT DISTINCT FROM v.lang AND cut.source IS NOT DISTINCT FROM v.source), (SELECT {side} FROM cut WHERE depth = 1 AND total >= 200 AND measure = '{m.name}' AND cut.lang IS NOT DISTINCT FROM v.lang), (SELECT {side} FROM cut WHERE depth = 0 AND measure = '{m.name}'))"
        checks.append(f"v_{m.name} <= {pick('high')}")
        if m.two_sided:
            checks.append(f"v_{m.name} >= {pick('low')}")
    sep = "[\\x20\\x09-\\x0D]"
    return f"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
c AS (SELECT w.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{sep}', '', 'g')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(lines.dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {values} FROM c),
bins AS ({' UNION ALL '.join(parts)}),
cut AS (SELECT *, q3 + 3 * (q3 - q1) + slack AS high, q1 - 3 * (q3 - q1) - slack AS low FROM ({' UNION ALL '.join(levels)}))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {' AND '.join(checks)} AS kept FROM v"""


ORACLE = _oracle()
