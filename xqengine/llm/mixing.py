"""Mixing sources to target weights by hierarchical budgets; DataFrame operations only.

The leaves (domain, language, source) form a tree. A token budget goes down it: a node's
children share its budget by weight, none gets more than its leaves hold in
``max_epochs`` epochs, and what one child can't use goes to its siblings. Only what no
sibling can use is left for the parent's own siblings, because a node's capacity is the
sum of its leaves' capacities. A leaf's budget is so many whole epochs and a prefix of one
more: documents in the order of md5('seed:epoch:doc_id'), while their running token count
stays within the rest.

The tree is small (one row for each leaf). The running count never sorts a whole leaf: the
order's hash range is cut into buckets of about ``BUCKET_ROWS`` documents, bucket sums
show in which bucket a leaf's prefix ends, and only that bucket's rows are ordered.

Shares are whole numbers of tokens: floor(weight * rest / weights), so a budget may be
missed by less than one token for each child. Defined results: rows without a word (null,
empty) are never taken; null levels are nodes of their own; rows that repeat an id are
taken or left together in each leaf; a null id counts as ''; an empty table gives no rows;
other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from xqengine.llm.common import materialise, table

BUCKET_ROWS = 2000
#: Most leaves or prefix-end rows that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
WORDS = r"[^\x20\x09-\x0D]+"
#: The query's domains, by source, and its weights; what isn't named weighs 1.
DOMAIN_SQL = "CASE WHEN source IS NULL THEN 'unknown' WHEN source = 'src0' THEN 'crawl' WHEN source IN ('src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7', 'src8', 'src9') THEN 'reference' ELSE 'community' END"
WEIGHTS = ({"crawl": 5, "reference": 3, "community": 2}, {"en": 6, "de": 2, "fr": 2, "es": 2}, {})
SEED = 17


def _weight(name: str, weights: Mapping[str, int]) -> Column:
    col = F.lit(1)
    for key, w in weights.items():
        col = F.when(F.col(name).eqNullSafe(F.lit(key)), F.lit(w)).otherwise(col)
    return col.cast("long")


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return on


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Sequence[Mapping[str, int]], max_epochs: int, budget: int | None) -> DataFrame:
    """(levels, tokens, n_docs, granted) for each leaf of (levels, tokens, n_docs)."""
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    above = leaves.agg(F.coalesce(F.lit(budget).cast("long"), F.sum("tokens"), F.lit(0)).alias("granted"))
    for depth, level in enumerate(levels):
        keys, parents = list(levels[: depth + 1]), list(levels[:depth])
        nodes = leaves.groupBy(*keys).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(level, weights[depth]))
        nodes = nodes.alias("n").join(F.broadcast(above).alias("p") if not parents else above.alias("p"), _same("n", "p", parents)).select("n.*", "p.granted")
        # By rising capacity for its weight, a child is full if its share of what the
        # children before it have left would exceed what it can hold.
        order = W.partitionBy(*parents).orderBy(F.col("cap") / F.greatest("w", F.lit(1)), level)
        upto, onward = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
        nodes = nodes.where("w > 0").withColumn("left", F.col("granted") - F.coalesce(F.sum("cap").over(upto), F.lit(0))).withColumn("ws", F.sum("w").over(onward))
        nodes = nodes.withColumn("full", F.col("cap") * F.col("ws") <= F.col("w") * F.col("left"))
        everyone = W.partitionBy(*parents)
        rest = F.col("granted") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everyone), F.lit(0))
        ws = F.sum(F.when(~F.col("full"), F.col("w"))).over(everyone)
        nodes = nodes.withColumn("rest", rest).withColumn("open", ws)
        share = F.when(F.col("full"), F.col("cap")).otherwise(F.expr("(w * rest) div open"))
        above = nodes.select(*keys, share.alias("granted"))
    return leaves.alias("n").join(above.alias("p"), _same("n", "p", levels)).select(*[F.col(f"n.{k}") for k in levels], "n.tokens", "n.n_docs", "p.granted")


def mix(docs: DataFrame, *, levels: Sequence[str], weights: Sequence[Mapping[str, int]], budget: int | None = None, max_epochs: int = 2, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None, tokens_out: str = "n_tokens", epoch_out: str = "epoch") -> DataFrame:
    """The rows of ``docs`` that are taken, once for each epoch, with ``tokens_out`` and
    ``epoch_out`` (from 1); columns of these names are replaced. ``budget``: tokens to take;
    by default as many as there are."""
    tag = uuid.uuid4().hex[:12]
    n, whole, rest, buckets, h, b, end, before, cut, copies = (f"__{x}_{tag}" for x in ("n", "whole", "rest", "buckets", "h", "b", "end", "before", "cut", "copies"))
    count = (F.regexp_count(F.col(text_col), F.lit(WORDS)) if tokens is None else tokens).cast("long")
    counted = docs.withColumn(n, count).where(F.col(n) > 0)
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    slim = materialise(counted.select(*levels, ident.alias(h), n), "mix-counts")
    leaves = slim.groupBy(*levels).agg(F.sum(n).alias("tokens"), F.count("*").alias("n_docs"))
    plan = budgets(materialise(leaves, "mix-leaves"), levels, weights, max_epochs, budget)
    plan = plan.withColumn(whole, F.expr("granted div tokens")).withColumn(rest, F.expr("granted % tokens"))
    plan = materialise(plan.select(*levels, whole, rest, F.ceil(F.col("n_docs") / BUCKET_ROWS).alias(buckets)), "mix-plan")
    small_plan = _bounded(plan)

    def placed(rows: DataFrame, ident: Column) -> DataFrame:
        """Rows with their leaf's plan, their hash in its last epoch, and their bucket."""
        out = rows.alias("n").join(small_plan.alias("p"), _same("n", "p", levels)).select("n.*", *[F.col(f"p.{c}") for c in (whole, rest, buckets)])
        out = out.withColumn(h, F.md5(F.concat(F.lit(f"{seed}:"), (F.col(whole) + 1).cast("string"), F.lit(":"), ident)))
        return out.withColumn(b, F.expr(f"shiftright(conv(substring({h}, 1, 8), 16, 10) * {buckets}, 32)"))

    where = placed(slim, F.col(h))
    sums = where.groupBy(*levels, b).agg(F.sum(n).alias(n), F.first(rest).alias(rest))
    run = sums.withColumn("upto", F.sum(n).over(W.partitionBy(*levels).orderBy(b)))
    ends = run.where(F.col("upto") > F.col(rest)).groupBy(*levels).agg(F.min(F.struct(F.col(b).alias("b"), (F.col("upto") - F.col(n)).alias("before"))).alias("e"))
    ends = materialise(ends.select(*levels, F.col("e.b").alias(end), F.col("e.before").alias(before)), "mix-ends")
    # In the bucket where a prefix ends, equal ids are one entry, however many rows they
    # have; the last hash that is in tells for every row whether it is.
    last = where.alias("n").join(_bounded(ends).alias("p"), _same("n", "p", levels) & (F.col(f"n.{b}") == F.col(f"p.{end}"))).select("n.*", F.col(f"p.{before}"))
    last = last.groupBy(*levels, h).agg(F.sum(n).alias(n), F.first(rest).alias(rest), F.first(before).alias(before))
    upto = F.col(before) + F.sum(n).over(W.partitionBy(*levels).orderBy(h))
    cuts = last.withColumn("upto", upto).where(F.col("upto") <= F.col(rest)).groupBy(*levels).agg(F.max(h).alias(cut))
    cuts = materialise(ends.alias("n").join(cuts.alias("p"), _same("n", "p", levels), "left").select("n.*", F.col(f"p.{cut}")), "mix-cuts")
    out = placed(counted, ident).alias("n").join(_bounded(cuts).alias("p"), _same("n", "p", levels), "left").select("n.*", F.col(f"p.{end}"), F.col(f"p.{cut}"))
    inside = F.when(F.col(end).isNull() | (F.col(b) < F.col(end)), 1).when((F.col(b) == F.col(end)) & (F.col(h) <= F.col(cut)), 1).otherwise(0)
    out = out.withColumn(copies, F.col(whole) + inside).where(F.col(copies) > 0)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (tokens_out, epoch_out)]
    return out.withColumn(buckets, F.explode(F.expr(f"sequence(1L, {copies})"))).select(*kept, F.col(n).alias(tokens_out), F.col(buckets).alias(epoch_out))


def with_domain(docs: DataFrame, name: str = "domain") -> DataFrame:
    """``docs`` with its rows' domains, in place of a column of that name."""
    return docs.withColumn(name, F.expr(DOMAIN_SQL))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_domain(table(spark, sf_dir, "documents"))
    taken = mix(docs, levels=("domain", "lang", "source"), weights=WEIGHTS)
    return taken.select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def _case(name: str, weights: Mapping[str, int]) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {w}" for k, w in weights.items())
    return f"(CASE {name} {arms} ELSE 1 END)" if arms else "1"


def _oracle(max_epochs: int = 2) -> str:
    """The same tree in SQL, with the running count taken over whole leaves."""
    levels = ("domain", "lang", "source")
    parts = [
        f"d AS (SELECT doc_id, {DOMAIN_SQL} AS domain, lang, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents)",
        f"leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) AS BIGINT) * {max_epochs} AS cap FROM d WHERE n_tokens > 0 GROUP BY ALL)",
        "g0 AS (SELECT CAST(sum(tokens) AS BIGINT) AS granted FROM leaf)",
    ]
    for i, level in enumerate(levels):
        keys, up = ", ".join(levels[: i + 1]), ", ".join(levels[:i])
        part = f"PARTITION BY {up}" if up else ""
        on = " AND ".join(f"x.{k} IS NOT DISTINCT FROM p.{k}" for k in levels[:i]) or "true"
        parts += [
            f"n{i} AS (SELECT x.*, p.granted, {_case('x.' + level, WEIGHTS[i])} AS w FROM (SELECT {keys}, CAST(sum(cap) AS BIGINT) AS cap FROM leaf GROUP BY ALL) x JOIN g{i} p ON {on})",
            f"o{i} AS (SELECT *, cap * sum(w) OVER ({part} ORDER BY cap / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= w * (granted - coalesce(sum(cap) OVER ({part} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS is_full FROM n{i})",
            f"g{i + 1} AS (SELECT {keys}, CAST(CASE WHEN is_full THEN cap ELSE (w * (granted - coalesce(sum(cap) FILTER (WHERE is_full) OVER ({part}), 0))) // sum(w) FILTER (WHERE NOT is_full) OVER ({part}) END AS BIGINT) AS granted FROM o{i})",
        ]
    on = " AND ".join(f"x.{k} IS NOT DISTINCT FROM p.{k}" for k in levels)
    on_d = " AND ".join(f"d.{k} IS NOT DISTINCT FROM p.{k}" for k in levels)
    parts += [
        f"plan AS (SELECT x.*, granted // tokens AS whole, granted % tokens AS rest FROM leaf x JOIN g3 p ON {on})",
        f"c AS (SELECT d.*, whole, rest, sum(n_tokens) OVER (PARTITION BY d.domain, d.lang, d.source ORDER BY md5('{SEED}:' || (whole + 1) || ':' || doc_id)) AS upto FROM d JOIN plan p ON {on_d} WHERE n_tokens > 0)",
    ]
    return "WITH " + ",\n".join(parts) + "\nSELECT doc_id, domain, lang, source, n_tokens, unnest(range(1, CAST(whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT) + 1)) AS epoch FROM c"


ORACLE = _oracle()
