"""Leaving documents out that can't match.

Before shredding, a document without ``<name`` in its bytes can't have that element. After
it, each document's tag names are kept exactly and as a 128-bit filter; the filter is a
first test that reads 16 bytes a document, the names decide.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xqengine.operators.shred import Corpus
from xqengine.plans.analyze import Selectivity


def prescan(docs: DataFrame, required: frozenset[str], content_col: str = "content") -> DataFrame:
    """The documents in whose text every required name opens a tag."""
    return reduce(lambda d, n: d.where(F.contains(F.col(content_col), F.lit(f"<{n}"))), sorted(required), docs)


def _bits(name: Column) -> tuple[Column, Column]:
    """Two places from 0 to 127."""
    h = F.xxhash64(name)
    return F.pmod(h, F.lit(128)).cast("int"), F.pmod(F.shiftright(h, 32), F.lit(128)).cast("int")


def _word(bits: tuple[Column, Column], high: bool) -> Column:
    out = F.lit(0).cast("long")
    for b in bits:
        at = b - 64 if high else b
        out = F.when((b >= 64) if high else (b < 64), out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))).otherwise(out)
    return out


def doc_stats(corpus: Corpus) -> DataFrame:
    """(doc_id, tag_names sorted, bloom_lo, bloom_hi, n_nodes, max_depth)."""
    tags = corpus.nodes.where("kind = 'element'")
    bits = _bits(F.col("name"))
    per = tags.select("doc_id", "name", "depth", _word(bits, False).alias("lo"), _word(bits, True).alias("hi"))
    got = per.groupBy("doc_id").agg(F.array_sort(F.collect_set("name")).alias("tag_names"), F.bit_or("lo").alias("bloom_lo"), F.bit_or("hi").alias("bloom_hi"), F.count("*").alias("n_elements"), F.max("depth").alias("max_depth"))
    docs = corpus.nodes.where("kind = 'root'").select("doc_id")
    return docs.join(got, "doc_id", "left").select("doc_id", F.coalesce("tag_names", F.array().cast("array<string>")).alias("tag_names"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("bloom_lo", "bloom_hi", "n_elements", "max_depth")])


def may_contain(name: str) -> Column:
    """The filter's answer on ``bloom_lo`` and ``bloom_hi``: false means surely not."""
    bits = _bits(F.lit(name))
    lo, hi = _word(bits, False), _word(bits, True)
    return (F.col("bloom_lo").bitwiseAND(lo) == lo) & (F.col("bloom_hi").bitwiseAND(hi) == hi)


def may_contain_any(names: tuple[str, ...]) -> Column:
    """Whether the filter admits at least one of some names; no names are never there."""
    return reduce(lambda a, n: a | may_contain(n), names, F.lit(False))


def filter_to_bytes() -> Column:
    """``bloom_lo`` and ``bloom_hi`` as 16 bytes, the high byte of each first."""
    return F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("bloom_lo", "bloom_hi")]))


def filter_from_bytes(df: DataFrame, col: str) -> DataFrame:
    """``df`` with the two words of a 16-byte filter; null for any other length."""
    word = lambda at: F.when(F.octet_length(col) == 16, F.conv(F.hex(F.substring(col, at, 8)), 16, -10).cast("long"))
    return df.withColumn("bloom_lo", word(1)).withColumn("bloom_hi", word(9))


def possible(corpus: Corpus, need: Selectivity) -> Corpus:
    """The corpus of the documents that have every required name; results can't change,
    for a document without one of them has none."""
    if not need.required:
        return corpus
    names = sorted(need.required)
    have = corpus.nodes.where((F.col("kind") == "element") & F.col("name").isin(*names)).groupBy("doc_id").agg(F.count_distinct("name").alias("n")).where(F.col("n") == len(names)).select("doc_id")
    keep = lambda df: df.join(have, "doc_id", "left_semi")
    return Corpus(corpus.docs, keep(corpus.nodes), keep(corpus.texts), corpus.errors)


def filter_from_content(docs: DataFrame, content_col: str = "content") -> DataFrame:
    """``docs`` with ``bloom_lo`` and ``bloom_hi`` of the tag names seen in the raw text,
    without shredding (names inside comments count too: more may pass, never fewer)."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(content_col), F.lit("")), F.lit(r"<([^/!?\s>][^\s>/]*)"), F.lit(1)))
    return filter_of_names(docs, found)


def filter_of_names(df: DataFrame, names: Column) -> DataFrame:
    """``df`` with ``bloom_lo`` and ``bloom_hi`` of an array of names; null for null."""

    def all_of(high: bool) -> Column:
        return F.aggregate(names, F.lit(0).cast("long"), lambda a, n: a.bitwiseOR(_word(_bits(n), high)))

    return df.withColumn("bloom_lo", all_of(False)).withColumn("bloom_hi", all_of(True))


def possible_by_filter(stats: DataFrame, need: Selectivity) -> DataFrame:
    """The rows of ``stats`` (with the filter's columns) whose document may match."""
    return reduce(lambda d, n: d.where(may_contain(n)), sorted(need.required), stats)
