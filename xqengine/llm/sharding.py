"""Placement of rows on shards by a permutation-filled look-up table.

Each shard has a permutation of the slots of a prime-sized table, given by an offset and a
step from its name's md5. The shards take turns; each claims the next free slot of its own
order until the table is full. Shards so own equally many slots (give or take one), and
when one goes, nearly all slots of the others stay theirs. A row's key hashes to a slot,
and the table, whose size is a parameter and doesn't grow with the data, is broadcast.

Defined results: a null id hashes as ''; rows that repeat an id share a shard; an empty
table gives no rows; other columns stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from xqengine.llm.common import table

SHARDS = tuple(f"shard-{i:04d}" for i in range(64))
#: A prime of at least a hundred slots a shard.
SLOTS = 8191


def fill(shards: Sequence[str], slots: int) -> list[int]:
    """The owner (index into ``shards``) of each slot."""
    if not shards or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)) or slots < len(shards):
        raise ValueError("sharding: needs shards and a prime number of slots, at least one a shard")
    at, step = [], []
    for s in shards:
        h = hashlib.md5(s.encode()).digest()
        at.append(int.from_bytes(h[:8], "big") % slots)
        step.append(int.from_bytes(h[8:], "big") % (slots - 1) + 1 if slots > 2 else 1)
    owner, free = [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            owner[at[i]] = i
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: Column, slots: int) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % slots).cast("int")


def shard(docs: DataFrame, shards: Sequence[str] = SHARDS, slots: int = SLOTS, *, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``slot`` and ``shard``."""
    rows = [(i, shards[o]) for i, o in enumerate(fill(shards, slots))]
    owners = docs.sparkSession.createDataFrame(rows, "slot int, shard string")
    kept = [c for c in docs.columns if c not in ("slot", "shard")]
    return docs.select(*[F.col(f"`{c}`") for c in kept]).withColumn("slot", slot_of(F.col(id_col), slots)).join(F.broadcast(owners), "slot").select(*kept, "slot", "shard")


def write_shards(sharded: DataFrame, path: str, files_a_shard: int = 8) -> None:
    """One folder a shard; a shard's rows are spread over several writers."""
    spread = F.pmod(F.xxhash64(*[c for c in sharded.columns if c != "shard"]), F.lit(files_a_shard))
    sharded.repartition(F.col("shard"), spread).write.partitionBy("shard").parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"))


def _oracle() -> str:
    """The look-up table as a list: SQL has no turn-taking, but it can place the rows."""
    owners = ", ".join(map(str, fill(SHARDS, SLOTS)))
    return f"""
WITH d AS (SELECT doc_id, lang, source, CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % {SLOTS} AS INTEGER) AS slot FROM documents)
SELECT doc_id, lang, source, slot, 'shard-' || lpad(CAST(([{owners}])[slot + 1] AS VARCHAR), 4, '0') AS shard FROM d"""


ORACLE = _oracle()
