"""Token counts through a digest cache.

A text's count depends on its content and the tokenizer alone, so counts are stored by
(content digest, tokenizer digest). A run joins its texts to the stored counts, encodes
one text of each digest that has none, and appends the new counts.

Normalising must not change a count, so it is only: null becomes the empty text.
Defined results: null and '' count 0 tokens; rows that repeat a text or an id each get
their row; an empty table gives no rows and appends nothing; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xqengine.llm.common import map_arrow, materialise, shared_dir, table
from xqengine.llm.tokens import digest_of_file, encoder

#: Most digests to encode that are broadcast (some 200 bytes each), and the least number of
#: rows for each of them.
BROADCAST_MISSES, FEW = 500_000, 10
CACHE_SCHEMA = "content_digest string, tokenizer_digest string, n_tokens long"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("content_digest"))


def count_misses(misses: DataFrame, path: str) -> DataFrame:
    """(content_digest, n_tokens) of (content_digest, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(path).count
        for b in batches:
            n = np.fromiter((count(t.as_py()) for t in b.column("text")), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("content_digest"), pa.array(n)], ["content_digest", "n_tokens"])

    return map_arrow(misses.select("content_digest", "text"), run, "content_digest string, n_tokens long")


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row for each row of ``docs``.

    Only the 64-hex digests and ids are grouped. Where few texts are to encode, as a filled
    cache leaves it, the list of their digests is broadcast and no text moves; else texts
    move once, to meet that list, in a hash join whose build side holds the ids (no sort of
    texts).
    The cache has one row a key, as only keys that it lacks are appended (one writer at a
    time), so the last join is of two plain reads and a digest that many rows share can be
    split."""
    spark = docs.sparkSession
    version = digest_of_file(tokenizer_path)
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def stored() -> DataFrame:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer_digest") == version).select("content_digest", "n_tokens")

    keyed = _keyed(docs, id_col, text_col)
    # One row stands for each digest: the smallest id, and any of that id's equal rows.
    first = keyed.groupBy("content_digest").agg(F.min("id").alias("first_id"))
    if fs.exists(path):
        first = first.join(stored(), "content_digest", "left_anti")
    first = materialise(first, "token-misses")
    n = first.count()
    few = n <= BROADCAST_MISSES and FEW * n <= docs.count()
    a, b = keyed.alias("a"), (F.broadcast(first) if few else first.hint("shuffle_hash")).alias("b")
    same = F.col("a.id").eqNullSafe(F.col("b.first_id")) & (F.col("a.content_digest") == F.col("b.content_digest"))
    misses = a.join(b, same, "left_semi")
    new = count_misses(misses, tokenizer_path).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens")).withColumn("tokenizer_digest", F.lit(version))
    new.select("content_digest", "tokenizer_digest", "n_tokens").write.mode("append").parquet(cache_path)
    out = keyed.drop("text").join(stored(), "content_digest", "left")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}")
