"""The corpus pipeline: toxic documents go, one of each near-duplicate class stays,
contaminated documents go, sources are mixed to their weights, rows are placed on shards.

Each stage works on all that the one before it kept, and its result is written as Parquet
and read again, so a lost executor costs at most a stage's own work. Stages return the
columns of ``documents``, whatever further columns there are and whatever their names; the
last adds ``slot`` and ``shard``, in place of columns of these names. Rows are told apart by
a key that a stage gives them, not by their ids: rows with one id, or none, are documents
of their own. Of near duplicates the row with the least id stays (of several, any one; a
null id comes last). Mixing may take a document in several epochs, each of them a row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xqengine.llm.common import materialise, table
from xqengine.llm.decontamination import decontaminate
from xqengine.llm.jaccard import jaccard_classes
from xqengine.llm.mixing import WEIGHTS, mix, with_domain
from xqengine.llm.sharding import shard
from xqengine.llm.toxicity import fit, score

TOXIC = 0.3
#: Most row keys (8 bytes each) that a stage broadcasts; more are met by a shuffle.
BROADCAST_IDS = 1_000_000


def _own_name(stem: str) -> str:
    return f"__{stem}_{uuid.uuid4().hex[:12]}"


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key for each row, written, so that it stays the same."""
    key = _own_name("row")
    return materialise(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def _without(docs: DataFrame, key: str, gone: DataFrame, name: str) -> DataFrame:
    """The rows of keyed ``docs`` whose key isn't among ``gone``, without the key."""
    gone = materialise(gone.select(key), name)
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, key, "left_anti").drop(key)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model, name = fit(docs, table(spark, sf_dir, "labels")), _own_name("score")
    return score(docs, model, keep_text=True, name=name).where(F.col(name) < TOXIC).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, key = _keyed(docs)
    classes = jaccard_classes(docs, id_col=key).select(key, "component_id")
    rows = docs.select(key, F.col("doc_id").alias("doc")).join(classes, key)
    rows = materialise(rows.select(key, "component_id", F.struct(F.col("doc").isNull().alias("no"), "doc", F.col(key).alias("row")).alias("rank")), "near-duplicate-ranks")
    first = rows.groupBy("component_id").agg(F.count("*").alias("n"), F.min("rank").alias("rank")).where("n > 1")
    gone = rows.join(first.select("component_id", F.col("rank.row").alias("first")), "component_id").where(F.col(key) != F.col("first"))
    return _without(docs, key, gone, "near-duplicates")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, key = _keyed(docs)
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), id_col=key)
    return _without(docs, key, found.where("contaminated"), "contaminated")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    domain = _own_name("domain")
    mixed = mix(with_domain(docs, domain), levels=(domain, "lang", "source"), weights=WEIGHTS, tokens_out=_own_name("tokens"), epoch_out=_own_name("epoch"))
    return mixed.select(*[F.col(f"`{c}`") for c in docs.columns])


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]
#: The first stage's scores come from a fitted model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
