"""Benchmark decontamination by a prefix-filtered join; DataFrame operations only.

An item is found where one of its windows of ``window`` consecutive words occurs whole; an
item of fewer words is one window. A window's tokens are its shingles of up to
``shingle`` words. Exact containment needs all of them, so its necessary prefix is one
token: the rarest of the window in the documents. The steps:

1. All positions of all documents are looked up among the benchmark's shingles (a hash of
   words taken in generated code). This is the one pass over the texts; it also writes a
   row for each document with its word count.
2. The shingles found are counted, and each window keeps its rarest as its prefix token.
3. Documents' tokens meet the windows' prefix tokens. Length and position bound a match:
   the window must start at or after the first word and end at or before the last.
4. The candidates' documents, and no others, are read again and the words at that place
   compared with the window's words.

The benchmark side is broadcast while it has at most ``broadcast_rows`` shingles, else it
is shuffled; the ids of candidates are broadcast up to ``broadcast_ids``. Matches of a
popular passage grow with the documents that hold it, never with pairs of documents. Defined results: null and '' have no words; null items have no
windows; rows that repeat a document id are one document (its largest word count, the
union of its hits); an empty benchmark hits nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from xqengine.llm.common import materialise, table

#: What stands between words: ASCII that is no letter or digit (after lower-casing A-Z).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text in order. Whatever stands between them becomes one blank."""
    line = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), BETWEEN, " "))
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, " "))


def _hash_at(pos: str, size: int) -> str:
    """xxhash64 of ``size`` words from 0-based ``pos``: single look-ups (null past the end),
    so that it stays in generated code."""
    return f"xxhash64({', '.join(f'get(ws, {pos} + {j})' for j in range(size))})"


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(window_id, item_id) and (window_id, win array, k, offset, token)."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("ws")).where("size(ws) > 0")
    starts = F.expr(f"explode(sequence(0, greatest(size(ws) - {window}, 0)))")
    wins = items.withColumn("at", starts).select("item_id", F.expr(f"slice(ws, at + 1, {window})").alias("ws"))
    wins = wins.withColumn("window_id", F.sha2(F.concat_ws(" ", "ws"), 256))
    owners = wins.select("window_id", "item_id").distinct()
    sizes = None
    unique = wins.groupBy("window_id").agg(F.first("ws").alias("ws"))
    for k in range(1, shingle + 1):
        own = unique.where(f"size(ws) >= {k}" if k == shingle else f"size(ws) = {k}")
        own = own.withColumn("offset", F.expr(f"explode(sequence(0, size(ws) - {k}))")).select("window_id", F.col("ws").alias("win"), F.lit(k).alias("k"), "offset", F.expr(_hash_at("offset", k)).alias("token"))
        sizes = own if sizes is None else sizes.unionByName(own)
    return owners, sizes


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, shingle: int = 5, broadcast_rows: int = 200_000, broadcast_ids: int = 1_000_000) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), a row a document."""
    owners, shingles = item_windows(benchmark, item_col, item_text_col, window, shingle)
    owners, shingles = materialise(owners, "bench-owners"), materialise(shingles, "bench-shingles")

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= broadcast_rows else df

    tokens = shingles.select("k", "token").distinct()
    lengths = sorted(r["k"] for r in tokens.select("k").distinct().collect())  # at most ``shingle``
    tokens = side(tokens)
    texts = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("ws"))
    # Entry -1 is the document's own row; after it, each position takes an entry for each
    # shingle length. One generator, whose entries must meet a token before anything is
    # built from them: the words are never copied. Entries without a shingle have a length
    # that no token has and spread by id, should the join be a shuffle.
    if lengths:
        m = len(lengths)
        spread = texts.select("id", "ws", F.size("ws").alias("n_words"), F.expr(f"explode(sequence(-1, greatest(size(ws) * {m} - 1, -1)))").alias("i"))
        pos = f"CASE WHEN i < 0 THEN -1 ELSE i div {m} END"
        k = "CASE i % " + str(m) + " " + " ".join(f"WHEN {j} THEN {k}" for j, k in enumerate(lengths)) + " END"
        hashed = f"CASE i % {m} " + " ".join(f"WHEN {j} THEN {_hash_at(f'CAST(i div {m} AS INT)', k)}" for j, k in enumerate(lengths)) + " END"
        fits = f"i >= 0 AND i div {m} + {k} <= n_words"
        seen = spread.select("id", "n_words", F.expr(f"CAST({pos} AS INT)").alias("pos"), F.expr(f"CASE WHEN {fits} THEN {k} ELSE -1 END").alias("k"), F.expr(f"CASE WHEN {fits} THEN {hashed} ELSE xxhash64(id) END").alias("token"))
    else:
        seen = texts.select("id", F.size("ws").alias("n_words"), F.lit(-1).alias("pos"), F.lit(None).cast("int").alias("k"), F.lit(None).cast("long").alias("token"))
    if lengths:
        flagged = tokens.withColumn("there", F.lit(True))
        seen = seen.join(flagged, ["k", "token"], "left").where("pos < 0 OR there").drop("there")
    seen = materialise(seen.select("id", "n_words", "pos", "k", "token"), "bench-seen")
    counts = seen.where("pos < 0").groupBy("id").agg(F.max("n_words").cast("long").alias("n_words"))
    hits = seen.where("pos >= 0")
    # The rarest token of each window; a window with a token that no document has is out.
    rarity = hits.groupBy("k", "token").agg(F.count("*").alias("df"))
    ranked = shingles.join(rarity, ["k", "token"], "left")
    prefix = ranked.groupBy("window_id").agg(F.count("*").alias("all"), F.count("df").alias("met"), F.first("win").alias("win"), F.min(F.struct("df", "token", "offset", "k")).alias("p")).where("all = met")
    prefix = materialise(prefix.select("window_id", "win", F.col("p.k").alias("k"), F.col("p.token").alias("token"), F.col("p.offset").alias("offset")), "bench-prefixes")
    # A prefix token can stand at several places of its window; any one of them will do.
    cand = hits.join(side(prefix), ["k", "token"]).withColumn("at", F.col("pos") - F.col("offset"))
    cand = cand.where("at >= 0 AND at + size(win) <= n_words").select("id", "at", "window_id", "win")
    per_doc = materialise(cand.groupBy("id").agg(F.collect_set(F.struct("at", "window_id", "win")).alias("cands")), "bench-candidates")
    per_doc = per_doc.withColumnRenamed("id", "cand_id")
    # Only the candidates' texts move: the others are left out by id before any exchange.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if per_doc.count() <= broadcast_ids:
        texts = texts.join(F.broadcast(per_doc.select("cand_id")), F.col("id").eqNullSafe(F.col("cand_id")), "left_semi")
    check = texts.join(per_doc, F.col("id").eqNullSafe(F.col("cand_id")))
    # The words as a lambda's variable: taken once a document, not once a candidate.
    met = F.transform(F.array(words(F.col("text"))), lambda ws: F.filter("cands", lambda c: F.slice(ws, c["at"] + 1, F.size(c["win"])) == c["win"]))
    check = check.select("id", met[0].alias("ok")).where("size(ok) > 0")
    ok = materialise(check.select("id", F.expr("inline(ok)")).select("id", "at", "window_id", F.size("win").alias("len")), "bench-matches")
    n_hit = ok.select("id", F.expr("explode(sequence(at, at + len - 1))").alias("w")).distinct().groupBy("id").agg(F.count("*").alias("n_hit"))
    items = ok.select("id", "window_id").distinct().join(side(owners), "window_id").groupBy("id").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = counts.alias("c").join(n_hit.alias("h"), F.col("c.id").eqNullSafe(F.col("h.id")), "left").join(items.alias("i"), F.col("c.id").eqNullSafe(F.col("i.id")), "left")
    found = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    hit = F.coalesce(F.col("n_hit"), F.lit(0))
    return out.select(F.col("c.id").alias(id_col), "n_words", hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"), F.sha2(F.array_join(found, ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WS} AS ws FROM documents),
b AS (SELECT item_id, {_WS} AS ws FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(ws), 10) AS len, array_to_string(ws[a0 + 1 : a0 + 10], ' ') AS win FROM (SELECT item_id, ws, unnest(range(0, greatest(len(ws) - 10, 0) + 1)) AS a0 FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT len FROM wins),
pos AS (SELECT doc_id, ws, unnest(range(0, len(ws))) AS a0 FROM d),
occ AS (SELECT doc_id, a0, s.len, array_to_string(ws[a0 + 1 : a0 + s.len], ' ') AS win FROM pos, sizes s WHERE a0 + s.len <= len(ws)),
m AS (SELECT DISTINCT occ.doc_id, occ.a0, occ.len, wins.item_id FROM occ JOIN wins ON occ.len = wins.len AND occ.win = wins.win),
h AS (SELECT doc_id, count(DISTINCT w) AS n FROM (SELECT doc_id, unnest(range(a0, a0 + len)) AS w FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items, sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)"""
