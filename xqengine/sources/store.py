"""A Parquet store of shredded documents that shreds again only what has changed.

It is one table, written in one pass over the documents: all nodes and errors, each with the
first 64 bits of its content's digest, and on a document's first row also the digest, the text
and what there is to know of its tags. A document's current rows are those with its present
digest, so new versions are appended and old ones ignored until ``compact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from xqengine.operators.shred import NODE, Corpus, shred, unsized
from xqengine.operators.skipping import doc_stats, filter_of_names

_STATS = ("content_hash", "tag_names", "n_elements", "max_depth")


def _version(content_hash: str) -> Column:
    """The first 64 bits of a digest, signed."""
    return F.conv(F.substr(F.col(content_hash), F.lit(1), F.lit(16)), 16, -10).cast("long")


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("content", F.lit("")).alias("content")).withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256))


def save(corpus: Corpus, path: str, mode: str = "append") -> None:
    """Write a corpus; nodes are sorted by kind and name in runs inside files, so name filters
    skip pages. One that was shredded from documents is written as they are shredded, without
    an exchange; one that is kept or put together otherwise meets its documents' digests."""
    if corpus.stored is not None:
        corpus.stored().write.mode(mode).parquet(f"{path}/nodes")
        return
    keys = _hashed(corpus.docs).select("doc_id", "content_hash", _version("content_hash").alias("version"))
    first = keys.join(doc_stats(corpus), "doc_id", "left").join(unsized(corpus.texts), "doc_id", "left").select("doc_id", "version", *_STATS, "doc_text")
    nodes = corpus.nodes.join(keys.select("doc_id", "version"), "doc_id")
    roots = corpus.nodes.where("kind = 'root'").join(unsized(first), "doc_id")
    errors = corpus.errors.join(unsized(first), "doc_id").select("*", F.lit("error").alias("kind"), F.col("error.kind").alias("name"), F.col("error.offset").alias("byte_start"), F.col("error.message").alias("text")).drop("error")
    rows = roots.unionByName(nodes.where("kind <> 'root'"), allowMissingColumns=True).unionByName(errors, allowMissingColumns=True)
    rows.select("doc_id", *NODE, "doc_text", "version", *_STATS).sortWithinPartitions("kind", "name", "doc_id", "node_id").write.mode(mode).parquet(f"{path}/nodes")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load(spark: SparkSession, path: str, docs: DataFrame) -> Corpus:
    """The stored rows of these documents' present contents."""
    now = _hashed(docs)
    keys = now.select("doc_id", _version("content_hash").alias("version"))
    rows = spark.read.parquet(f"{path}/nodes").select("doc_id", *NODE, "doc_text", "version")
    return Corpus.of(now.select("doc_id", "content"), rows.join(unsized(keys), ["doc_id", "version"], "left_semi").drop("version"))


def stale(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    """The documents that the store doesn't have with their present content."""
    now = _hashed(docs)
    if not _exists(spark, f"{path}/nodes"):
        return now.select("doc_id", "content")
    known = read_stats(spark, path).select("doc_id", "content_hash")
    return now.join(unsized(known), ["doc_id", "content_hash"], "left_anti").select("doc_id", "content")


def load_or_shred(spark: SparkSession, path: str, docs: DataFrame) -> Corpus:
    """Shred what is stale, append it, and load all."""
    save(shred(stale(spark, path, docs)), path)
    return load(spark, path, docs)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, content_hash, tag_names, bloom_lo, bloom_hi, n_elements, max_depth): only what
    is selected is read, of documents' first rows alone. The filter is made from the names."""
    first = spark.read.parquet(f"{path}/nodes").where("kind IN ('root', 'error')")
    return filter_of_names(first, F.col("tag_names")).select("doc_id", "content_hash", "tag_names", "bloom_lo", "bloom_hi", "n_elements", "max_depth")
