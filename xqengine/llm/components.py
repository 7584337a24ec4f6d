"""Connected components of an edge table: a short one's in one task, any other's by alternating
large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xqengine.llm.common import discard, map_arrow, materialise

#: Most edges (16 bytes each) that one task holds; stars cost some ten exchanges a round.
SHORT = 500_000


def _least(edges: DataFrame, name: str) -> DataFrame:
    """(u, m): the least neighbour of each node; written, so that the join with it has two
    exchanges and can split a hub."""
    return materialise(edges.groupBy("u").agg(F.min("v").alias("m")), name)


def _digest(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))).alias("h")).first()
    return r["n"], r["h"] or 0


def least_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, sorted, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        low, now = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(now, label[a], low)
        np.minimum.at(now, label[b], low)
        while (now != (up := now[now])).any():
            now = up
        if (now == label).all():
            return nodes, nodes[label]
        label = now


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(x.column("u").to_numpy(), x.column("v").to_numpy()) for x in batches]
        if held:
            nodes, least = least_nodes(*map(np.concatenate, zip(*held, strict=True)))
            for i in range(0, len(nodes), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + (1 << 16)]) for x in (nodes, least)], ["node", "component"])

    return map_arrow(edges.coalesce(1), run, "node long, component long")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) for every node of the (u, v) edges; a component's name is its
    least node. Beyond ``SHORT`` edges each round is two joins whose rows are at most twice the edges; hubs are
    summed before they move, and nothing is collected. The result is read from a written
    table."""
    e = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "cc-edges")
    spark, before = edges.sparkSession, _digest(e)
    if before[0] <= SHORT:
        found = materialise(_in_one_task(e), "cc-short")
        discard(spark, e)
        return found
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = _least(both, "cc-least")
        m = first.withColumn("m", F.least("m", "u"))
        large = both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "cc-large")
        discard(spark, first)
        m = _least(large, "cc-least")
        small = large.join(m, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s")).select("s.u", "s.v").where("u <> v").distinct()
        old, e = e, materialise(small, "cc-small")
        discard(spark, old, large, m)
        after = _digest(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components: no fixed point")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
