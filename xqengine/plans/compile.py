"""XPath trees to DataFrame plans.

A step is a join of the context with the node table on the document and the axis's
condition on ids (equal parents, or the interval of descendants). Positions are windows
over one context node's matches. Predicates are decorrelated: all candidates of a step
are keyed, an inner path is evaluated once for all keys, summed by key and joined back.
Types are known from the syntax, so every value is a column of one type.

Rewrites: ``//x`` becomes one ``descendant`` step where no position counts; a first step
from the root is a filter without a join; ``@a`` and ``.`` as values are expressions on
the candidate's own row; duplicates are dropped only behind axes that can make them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from xqengine.functions import values as V
from xqengine.operators.shred import NODE, Corpus, unsized
from xqengine.plans.ast import REVERSE, Binary, Call, Expr, Filter, Negate, Num, Path, Step, Str, Test, Union, positional, type_of

#: Axes that from a set of distinct nodes reach no node twice.
_SINGLE = frozenset({"child", "attribute", "self", "namespace"})
_XML_NS = "http://www.w3.org/XML/1998/namespace"


def test_condition(test: Test, axis: str, n: str = "") -> Column:
    kind, name = F.col(f"{n}kind"), F.col(f"{n}name")
    main = {"attribute": "attribute", "namespace": "namespace"}.get(axis, "element")
    if test.kind == "node":
        return F.lit(True)
    if test.kind == "any":
        return kind == main
    if test.kind == "name":
        return (kind == main) & (name == test.name)
    if test.kind == "prefix":
        return (kind == main) & F.startswith(name, F.lit(f"{test.name}:"))
    if test.kind == "pi" and test.name:
        return (kind == "pi") & (name == test.name)
    return kind == test.kind


def fuse(steps: tuple[Step, ...]) -> tuple[Step, ...]:
    """Write descendant-or-self::node()/child::x as descendant::x where no predicate of x
    counts positions; likewise before self, descendant and descendant-or-self steps."""
    out: list[Step] = []
    for s in steps:
        if out and out[-1] == Step("descendant-or-self", Test("node")) and not any(map(positional, s.preds)) and s.axis in ("child", "descendant", "self", "descendant-or-self"):
            out[-1] = Step("descendant" if s.axis in ("child", "descendant") else "descendant-or-self", s.test, s.preds)
        else:
            out.append(s)
    return tuple(out)


class Plan:
    """Evaluates trees over one corpus."""

    def __init__(self, corpus: Corpus):
        self.corpus, self.n = corpus, 0
        #: Whether candidates are the roots, one for each document; not so inside predicates.
        self.at_roots = True

    def fresh(self, stem: str) -> str:
        self.n += 1
        return f"__{stem}{self.n}"

    # Contexts -------------------------------------------------------------------------

    def roots(self) -> DataFrame:
        """Candidates for a whole expression: each document's root, at position 1 of 1."""
        return self.keyed(self.corpus.nodes.where("kind = 'root'").withColumn("ck", F.lit("")).withColumn("cx", F.lit(0).cast("long"))).withColumn("__pos", F.lit(1.0)).withColumn("__last", F.lit(1.0))

    def contexts(self, nodes: DataFrame) -> DataFrame:
        """Candidates from a node-set: each node is a context of its own."""
        self.at_roots = False
        own = nodes.select("doc_id", F.lit("").alias("ck"), F.lit(0).cast("long").alias("cx"), *NODE)
        return self.keyed(own).withColumn("__pos", F.lit(1.0)).withColumn("__last", F.lit(1.0))

    @staticmethod
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("__k", F.concat_ws("|", "ck", F.col("cx").cast("string"), F.col("node_id").cast("string")))

    @staticmethod
    def _as_context(cands: DataFrame) -> DataFrame:
        return cands.select("doc_id", F.col("__k").alias("ck"), *NODE)

    # Node-sets ------------------------------------------------------------------------

    def node_set(self, e: Expr, cands: DataFrame | None) -> DataFrame:
        """(doc_id, ck, NODE): the distinct nodes of ``e`` for each candidate's key; with
        no candidates, for each document's root under the key ''."""
        if isinstance(e, Path):
            steps = fuse(e.steps)
            if e.base is not None:
                return self.steps(self.node_set(e.base, cands), steps, cands is None or self.at_roots)
            if cands is None:
                return self.from_root(steps)
            start = self._as_context(cands)
            if e.absolute:
                start = start.select("doc_id", "ck").distinct().join(self.corpus.nodes.where("kind = 'root'"), "doc_id").select("doc_id", "ck", *NODE)
            return self.steps(start, steps, self.at_roots)
        if isinstance(e, Union):
            both = self.node_set(e.left, cands).unionByName(self.node_set(e.right, cands))
            return both.dropDuplicates(["doc_id", "ck", "node_id"])
        if isinstance(e, Filter):
            whole = self.node_set(e.expr, cands).withColumn("cx", F.lit(0).cast("long"))
            return self.predicates(whole, e.preds, False).select("doc_id", "ck", *NODE)
        if isinstance(e, Call) and e.name == "id":
            return self.by_id(e.args[0], cands)
        raise TypeError(f"not a node-set: {e}")

    def from_root(self, steps: tuple[Step, ...]) -> DataFrame:
        """Paths from the root need no join for their first step."""
        nodes = self.corpus.nodes
        first = steps[0] if steps else None
        if first is None or first.axis not in ("child", "descendant", "descendant-or-self"):
            start = nodes.where("kind = 'root'").withColumn("ck", F.lit("")).select("doc_id", "ck", *NODE)
            return self.steps(start, steps, True)
        where = {"child": "parent_id = 0 AND kind <> 'attribute'", "descendant": "kind NOT IN ('root', 'attribute')", "descendant-or-self": "kind <> 'attribute'"}[first.axis]
        found = nodes.where(where).where(test_condition(first.test, first.axis)).select("doc_id", F.lit("").alias("ck"), F.lit(0).cast("long").alias("cx"), *NODE)
        found = self.predicates(found, first.preds, False).select("doc_id", "ck", *NODE)
        return self.steps(found, steps[1:], True)

    def steps(self, start: DataFrame, steps: tuple[Step, ...], one_key: bool = False) -> DataFrame:
        for s in steps:
            start = self.step(start, s, one_key)
        return start

    def step(self, ctx: DataFrame, s: Step, one_key: bool = False) -> DataFrame:
        """One step from every context; ``one_key``: each document has a single key."""
        if s.axis not in _SINGLE and s.axis != "parent" and not any(map(positional, s.preds)):
            found = self.axis_set(ctx, s, one_key)
            if found is not None:
                return self.predicates(found, s.preds, False).select("doc_id", "ck", *NODE)
        if s.axis == "self":
            found = ctx.where(test_condition(s.test, "child")).withColumn("cx", F.col("node_id"))
        elif s.axis == "namespace":
            found = self.namespaces(ctx, s.test)
        else:
            found = self.axis(ctx, s)
        found = self.predicates(found, s.preds, s.axis in REVERSE).select("doc_id", "ck", *NODE)
        return found if s.axis in _SINGLE else found.dropDuplicates(["doc_id", "ck", "node_id"])

    def axis(self, ctx: DataFrame, s: Step) -> DataFrame:
        c = ctx.select(F.col("doc_id").alias("c_doc"), "ck", F.col("node_id").alias("cx"), F.col("parent_id").alias("c_parent"), F.col("close_id").alias("c_close"), F.col("kind").alias("c_kind"))
        n = self.corpus.nodes.where(test_condition(s.test, s.axis))
        tree = "kind <> 'attribute' AND "
        on = {
            "child": tree + "parent_id = cx",
            "descendant": tree + "node_id > cx AND node_id < c_close AND kind <> 'root'",
            "descendant-or-self": f"(node_id = cx OR ({tree} node_id > cx AND node_id < c_close))",
            "parent": "node_id = c_parent",
            "ancestor": "kind IN ('root', 'element') AND node_id < cx AND close_id > cx",
            "ancestor-or-self": "(node_id = cx OR (kind IN ('root', 'element') AND node_id < cx AND close_id > cx))",
            "following-sibling": tree + "parent_id = c_parent AND node_id > cx AND c_kind <> 'attribute'",
            "preceding-sibling": tree + "parent_id = c_parent AND node_id < cx AND c_kind <> 'attribute'",
            "following": tree + "node_id > c_close",
            "preceding": tree + "kind <> 'root' AND close_id < cx",
            "attribute": "kind = 'attribute' AND parent_id = cx",
        }[s.axis]
        return c.join(n, (F.col("c_doc") == F.col("doc_id")) & F.expr(on)).select("doc_id", "ck", "cx", *NODE)

    def axis_set(self, ctx: DataFrame, s: Step, one_key: bool) -> DataFrame | None:
        """The distinct nodes that an axis reaches from each key's contexts, where positions
        don't count: (doc_id, ck, cx, NODE), or None where only a join of pairs will do.

        What follows some context follows the one that ends first; what precedes some
        context ends before the last; so of all contexts one bound is left. Descendants
        and ancestors come from one sweep over a document's nodes and contexts in order:
        intervals are nested or apart, so the furthest end (or the next context) decides."""
        n = self.corpus.nodes.where(test_condition(s.test, s.axis))
        tree, cx = n.where("kind NOT IN ('root', 'attribute')"), F.lit(0).cast("long").alias("cx")
        own = (F.col("doc_id") == F.col("b_doc"),)
        if s.axis in ("following", "preceding"):
            bound = F.min("close_id") if s.axis == "following" else F.max("node_id")
            b = ctx.groupBy(F.col("doc_id").alias("b_doc"), "ck").agg(bound.alias("b"))
            return b.join(tree, own[0] & (F.col("node_id") > F.col("b") if s.axis == "following" else F.col("close_id") < F.col("b"))).select("doc_id", "ck", cx, *NODE)
        if s.axis in ("following-sibling", "preceding-sibling"):
            bound = F.min("node_id") if s.axis == "following-sibling" else F.max("node_id")
            b = ctx.where("kind NOT IN ('attribute', 'namespace', 'root')").groupBy(F.col("doc_id").alias("b_doc"), "ck", F.col("parent_id").alias("b_parent")).agg(bound.alias("b"))
            side = F.col("node_id") > F.col("b") if s.axis == "following-sibling" else F.col("node_id") < F.col("b")
            return b.join(tree, own[0] & (F.col("parent_id") == F.col("b_parent")) & side).select("doc_id", "ck", cx, *NODE)
        if not one_key:
            return None
        marks = ctx.select("doc_id", "node_id", F.col("close_id").alias("_end"), F.col("ck").alias("_key"), F.lit(True).alias("_mark"))
        down = s.axis.startswith("descendant")
        rows = (tree if down else n.where("kind IN ('root', 'element')")).withColumn("_mark", F.lit(False))
        swept = rows.unionByName(marks, allowMissingColumns=True)
        before = W.partitionBy("doc_id").orderBy(F.asc("node_id") if down else F.desc("node_id"), F.asc("_mark")).rowsBetween(W.unboundedPreceding, -1)
        seen = F.max("_end").over(before) if down else F.min(F.when(F.col("_mark"), F.col("node_id"))).over(before)
        hit = F.col("_seen") > F.col("node_id") if down else F.col("_seen") < F.col("close_id")
        found = swept.withColumn("_seen", seen).withColumn("ck", F.max("_key").over(before)).where(~F.col("_mark") & hit).select("doc_id", "ck", cx, *NODE)
        if s.axis.endswith("-or-self"):
            selves = ctx.where(test_condition(s.test, s.axis)).select("doc_id", "ck", cx, *NODE)
            found = found.unionByName(selves).dropDuplicates(["doc_id", "node_id"])
        return found

    def namespaces(self, ctx: DataFrame, test: Test) -> DataFrame:
        """In-scope declarations, the nearest of each prefix; ``xml`` is always there."""
        own = ctx.where("kind = 'element'").select("doc_id", "ck", *NODE).withColumn("cx", F.col("node_id"))
        up = self.axis(own, Step("ancestor-or-self", Test("any")))
        decl = up.select("doc_id", "ck", "cx", "depth", F.explode("attrs").alias("a")).where("a.name = 'xmlns' OR startswith(a.name, 'xmlns:')")
        decl = decl.select("doc_id", "ck", "cx", "depth", F.expr("substr(a.name, 7)").alias("prefix"), F.col("a.value").alias("uri"))
        near = decl.groupBy("doc_id", "ck", "cx", "prefix").agg(F.max_by("uri", "depth").alias("uri")).where("uri <> ''")
        near = near.unionByName(own.select("doc_id", "ck", "cx", F.lit("xml").alias("prefix"), F.lit(_XML_NS).alias("uri")))
        order = F.row_number().over(W.partitionBy("doc_id", "ck", "cx").orderBy("prefix"))
        made = near.withColumn("node_id", F.col("cx") + 60000 + order).select(
            "doc_id", "ck", "cx", "node_id", F.lit("namespace").alias("kind"), F.col("prefix").alias("name"), F.col("cx").alias("parent_id"), F.lit(0).alias("depth"), F.col("node_id").alias("close_id"), F.lit(None).cast("array<struct<name:string,value:string,raw:string>>").alias("attrs"), F.col("uri").alias("text"), F.lit(False).alias("is_cdata"), *[F.lit(0).cast("long").alias(x) for x in ("t0", "t1", "c0", "c1", "byte_start", "byte_end")]
        )
        return made.where(test_condition(test, "namespace"))

    def by_id(self, arg: Expr, cands: DataFrame | None) -> DataFrame:
        """Elements whose attribute ``id`` is one of the argument's words."""
        cands = self.roots() if cands is None else cands
        if type_of(arg) == "nodeset":
            words = self.strings(self.node_set(arg, cands)).select("doc_id", "ck", "sv")
        else:
            df, col, kind = self.value(arg, cands)
            words = df.select("doc_id", F.col("__k").alias("ck"), V.to_string(col, kind).alias("sv"))
        words = words.select(F.col("doc_id").alias("w_doc"), "ck", F.explode(F.split(F.trim(F.regexp_replace("sv", r"[ \t\r\n]+", " ")), " ")).alias("w")).where("w <> ''").distinct()
        named = self.corpus.nodes.where("kind = 'element'").withColumn("_id", F.expr("try_element_at(transform(filter(attrs, a -> a.name = 'id'), a -> a.value), 1)")).where("_id IS NOT NULL")
        found = words.join(named, (F.col("w_doc") == F.col("doc_id")) & (F.col("w") == F.col("_id")))
        return found.select("doc_id", "ck", *NODE).dropDuplicates(["doc_id", "ck", "node_id"])

    # Predicates -----------------------------------------------------------------------

    def predicates(self, df: DataFrame, preds: tuple[Expr, ...], reverse: bool) -> DataFrame:
        """Filter (doc_id, ck, cx, NODE) rows; positions start anew after each predicate."""
        for p in preds:
            if positional(p):
                own = W.partitionBy("doc_id", "ck", "cx")
                df = df.withColumn("__pos", F.row_number().over(own.orderBy(F.desc("node_id") if reverse else F.asc("node_id"))).cast("double"))
                if not isinstance(p, Num):
                    df = df.withColumn("__last", F.count("*").over(own).cast("double"))
                else:
                    df = df.withColumn("__last", F.lit(0.0))
            else:
                df = df.withColumn("__pos", F.lit(0.0)).withColumn("__last", F.lit(0.0))
            outside, self.at_roots = self.at_roots, False
            df, col, kind = self.value(p, self.keyed(df))
            self.at_roots = outside
            keep = (F.col("__pos") == col) if kind == "number" else V.to_boolean(col, kind)
            df = df.where(keep).select("doc_id", "ck", "cx", *NODE)
        return df

    # Values ---------------------------------------------------------------------------

    def strings(self, df: DataFrame) -> DataFrame:
        """Add ``sv``, the nodes' string value: a slice of the document's text."""
        d = self.fresh("d")
        texts = self.corpus.texts.select(F.col("doc_id").alias(d), F.col("doc_text").alias("__text"))
        sv = F.when(F.col("kind").isin("element", "root"), F.substr("__text", (F.col("t0") + 1).cast("int"), (F.col("t1") - F.col("t0")).cast("int"))).otherwise(F.coalesce("text", F.lit("")))
        return df.join(texts, F.col("doc_id") == F.col(d)).withColumn("sv", sv).drop("__text", d)

    def attach(self, df: DataFrame, by_key: DataFrame, cols: list[str]) -> tuple[DataFrame, list[Column]]:
        """Join (doc_id, ck, cols) back to the candidates under fresh names."""
        d, k, names = self.fresh("d"), self.fresh("c"), [self.fresh("v") for _ in cols]
        right = by_key.select(F.col("doc_id").alias(d), F.col("ck").alias(k), *[F.col(c).alias(n) for c, n in zip(cols, names, strict=True)])
        joined = df.join(unsized(right), (F.col("doc_id") == F.col(d)) & (F.col("__k") == F.col(k)), "left").drop(d, k)
        return joined, [F.col(n) for n in names]

    def single(self, e: Expr, df: DataFrame) -> tuple[DataFrame, Column] | None:
        """``@name`` and ``.`` as a column that is null where there is no node."""
        if not (isinstance(e, Path) and not e.absolute and e.base is None and len(e.steps) == 1 and not e.steps[0].preds):
            return None
        s = e.steps[0]
        if s.axis == "attribute" and s.test.kind == "name" and not s.test.name.startswith("xmlns"):
            name = s.test.name.replace("\\", "\\\\").replace("'", "\\'")
            return df, F.expr(f"try_element_at(filter(attrs, a -> a.name = '{name}'), 1).value")
        if s.axis == "self" and s.test.kind == "node":
            n = self.fresh("s")
            return self.strings(df).withColumnRenamed("sv", n), F.col(n)
        return None

    def exists(self, e: Expr, df: DataFrame) -> tuple[DataFrame, Column]:
        if one := self.single(e, df):
            return one[0], one[1].isNotNull()
        there = self.node_set(e, df).select("doc_id", "ck").distinct().withColumn("v", F.lit(True))
        df, (v,) = self.attach(df, there, ["v"])
        return df, F.coalesce(v, F.lit(False))

    def first_string(self, e: Expr, df: DataFrame) -> tuple[DataFrame, Column]:
        if one := self.single(e, df):
            return one[0], F.coalesce(one[1], F.lit(""))
        least = self.node_set(e, df)
        least = self.strings(least).groupBy("doc_id", "ck").agg(F.min_by("sv", "node_id").alias("v"))
        df, (v,) = self.attach(df, least, ["v"])
        return df, F.coalesce(v, F.lit(""))

    def scalar(self, e: Expr, df: DataFrame) -> tuple[DataFrame, Column, str]:
        """As ``value``, with a node-set reduced to its first node's string."""
        if type_of(e) == "nodeset":
            df, col = self.first_string(e, df)
            return df, col, "string"
        return self.value(e, df)

    def value(self, e: Expr, df: DataFrame) -> tuple[DataFrame, Column, str]:
        """(candidates with what the value needs joined, its column, its type). A node-set
        as a value is its truth: whether there is a node."""
        if isinstance(e, Num):
            return df, F.lit(e.value), "number"
        if isinstance(e, Str):
            return df, F.lit(e.value), "string"
        if type_of(e) == "nodeset":
            df, col = self.exists(e, df)
            return df, col, "boolean"
        if isinstance(e, Negate):
            df, col, kind = self.scalar(e.arg, df)
            return df, -V.to_number(col, kind), "number"
        if isinstance(e, Binary):
            return self.binary(e, df)
        return self.call(e, df)

    def binary(self, e: Binary, df: DataFrame) -> tuple[DataFrame, Column, str]:
        if e.op in ("and", "or"):
            df, a, ka = self.value(e.left, df)
            df, b, kb = self.value(e.right, df)
            a, b = V.to_boolean(a, ka), V.to_boolean(b, kb)
            return df, (a & b) if e.op == "and" else (a | b), "boolean"
        if e.op in ("+", "-", "*", "div", "mod"):
            df, a, ka = self.scalar(e.left, df)
            df, b, kb = self.scalar(e.right, df)
            return df, V.arithmetic(e.op, V.to_number(a, ka), V.to_number(b, kb)), "number"
        left, right = type_of(e.left) == "nodeset", type_of(e.right) == "nodeset"
        if left and right:
            return (*self.sets(e, df), "boolean")
        if left:
            return (*self.set_scalar(e.op, e.left, e.right, df), "boolean")
        if right:
            turned = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(e.op, e.op)
            return (*self.set_scalar(turned, e.right, e.left, df), "boolean")
        df, a, ka = self.value(e.left, df)
        df, b, kb = self.value(e.right, df)
        return df, V.compare(e.op, a, ka, b, kb), "boolean"

    def set_scalar(self, op: str, ns: Expr, other: Expr, df: DataFrame) -> tuple[DataFrame, Column]:
        """Whether any node compares so with the scalar."""
        if type_of(other) == "boolean":
            df, a = self.exists(ns, df)
            df, b, kb = self.value(other, df)
            return df, V.compare(op, a, "boolean", b, kb)
        if one := self.single(ns, df):
            df, a = one
            df, b, kb = self.value(other, df)
            return df, F.coalesce(V.compare(op, a, "string", b, kb), F.lit(False))
        found = self.strings(self.node_set(ns, df))
        if isinstance(other, (Num, Str)):
            kb = type_of(other)
            hit = found.where(V.compare(op, F.col("sv"), "string", F.lit(other.value), kb)).select("doc_id", "ck").distinct().withColumn("v", F.lit(True))
            df, (v,) = self.attach(df, hit, ["v"])
            return df, F.coalesce(v, F.lit(False))
        # The scalar differs from candidate to candidate: compare it with the key's
        # distinct values, or for an order with their bounds.
        df, b, kb = self.value(other, df)
        if op in ("=", "!="):
            many = found.groupBy("doc_id", "ck").agg(F.collect_set("sv").alias("v"))
            df, (v,) = self.attach(df, many, ["v"])
            return df, F.coalesce(F.exists(v, lambda x: V.compare(op, x, "string", b, kb)), F.lit(False))
        x = V.to_number(F.col("sv"), "string")
        ends = found.where(~F.isnan(x)).groupBy("doc_id", "ck").agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
        df, (lo, hi) = self.attach(df, ends, ["lo", "hi"])
        return df, F.coalesce(V.compare(op, lo if op in ("<", "<=") else hi, "number", b, kb), F.lit(False))

    def sets(self, e: Binary, df: DataFrame) -> tuple[DataFrame, Column]:
        """Whether some pair of nodes compares so: an equi-join for '=', else bounds."""
        a, b = (self.strings(self.node_set(x, df)).select("doc_id", "ck", "sv") for x in (e.left, e.right))
        if e.op == "=":
            hit = a.distinct().join(b.distinct(), ["doc_id", "ck", "sv"], "left_semi").select("doc_id", "ck").distinct().withColumn("v", F.lit(True))
            df, (v,) = self.attach(df, hit, ["v"])
            return df, F.coalesce(v, F.lit(False))
        if e.op == "!=":
            ends = [x.groupBy("doc_id", "ck").agg(F.min("sv").alias("lo"), F.max("sv").alias("hi")) for x in (a, b)]
        else:
            x = V.to_number(F.col("sv"), "string")
            ends = [s.where(~F.isnan(x)).groupBy("doc_id", "ck").agg(F.min(x).alias("lo"), F.max(x).alias("hi")) for s in (a, b)]
        df, (alo, ahi) = self.attach(df, ends[0], ["lo", "hi"])
        df, (blo, bhi) = self.attach(df, ends[1], ["lo", "hi"])
        test = {"!=": ~((alo == ahi) & (blo == bhi) & (alo == blo)), "<": alo < bhi, "<=": alo <= bhi, ">": ahi > blo, ">=": ahi >= blo}[e.op]
        return df, F.coalesce(test & alo.isNotNull() & blo.isNotNull(), F.lit(False))

    # Functions ------------------------------------------------------------------------

    def _own_or_arg(self, e: Call, df: DataFrame) -> tuple[DataFrame, Column, str]:
        return self.scalar(e.args[0] if e.args else Path(False, (Step("self", Test("node")),)), df)

    def _name_of(self, e: Call, df: DataFrame) -> tuple[DataFrame, Column]:
        """The qualified name of the first node (or the context node)."""
        named = "CASE WHEN kind IN ('element', 'attribute', 'pi', 'namespace') THEN name ELSE '' END"
        if not e.args:
            return df, F.expr(named)
        least = self.node_set(e.args[0], df).groupBy("doc_id", "ck").agg(F.min_by(F.expr(named), "node_id").alias("v"))
        df, (v,) = self.attach(df, least, ["v"])
        return df, F.coalesce(v, F.lit(""))

    def _namespace_uri(self, e: Call, df: DataFrame) -> tuple[DataFrame, Column]:
        if e.args:
            ns = self.node_set(e.args[0], df)
            first = ns.groupBy("doc_id", "ck").agg(F.min("node_id").alias("_first"))
            ns = ns.join(unsized(first), ["doc_id", "ck"]).where("node_id = _first").drop("_first")
        else:
            ns = self._as_context(df)
        ns = ns.where("kind IN ('element', 'attribute')")
        c = ns.select(F.col("doc_id").alias("c_doc"), F.col("ck").alias("c_k"), F.col("node_id").alias("cx"), F.col("kind").alias("c_kind"), F.when(F.contains("name", F.lit(":")), F.substring_index("name", ":", 1)).otherwise("").alias("prefix"))
        c = c.where("NOT (c_kind = 'attribute' AND prefix = '')")
        n = self.corpus.nodes.where("kind = 'element' AND size(attrs) > 0")
        up = c.join(n, (F.col("c_doc") == F.col("doc_id")) & F.expr("node_id <= cx AND (node_id = cx OR close_id > cx)"))
        decl = up.select("doc_id", F.col("c_k").alias("ck"), "prefix", "depth", F.explode("attrs").alias("a")).where("a.name = CASE WHEN prefix = '' THEN 'xmlns' ELSE concat('xmlns:', prefix) END")
        near = decl.groupBy("doc_id", "ck").agg(F.max_by(F.col("a.value"), "depth").alias("v"))
        xml = c.where("prefix = 'xml'").select(F.col("c_doc").alias("doc_id"), F.col("c_k").alias("ck"), F.lit(_XML_NS).alias("v"))
        df, (v,) = self.attach(df, near.unionByName(xml), ["v"])
        return df, F.coalesce(v, F.lit(""))

    def _lang(self, e: Call, df: DataFrame) -> tuple[DataFrame, Column]:
        df, want, kind = self.scalar(e.args[0], df)
        c = self._as_context(df).select(F.col("doc_id").alias("c_doc"), "ck", F.col("node_id").alias("cx"))
        n = self.corpus.nodes.where("kind = 'element'").withColumn("_lang", F.expr("try_element_at(filter(attrs, a -> a.name = 'xml:lang'), 1).value")).where("_lang IS NOT NULL")
        up = c.join(n, (F.col("c_doc") == F.col("doc_id")) & F.expr("node_id <= cx AND (node_id = cx OR close_id > cx)"))
        df, (v,) = self.attach(df, up.groupBy("doc_id", "ck").agg(F.max_by("_lang", "depth").alias("v")), ["v"])
        v, want = F.lower(F.coalesce(v, F.lit(""))), F.lower(V.to_string(want, kind))
        return df, (v == want) & (F.length(want) > 0) | F.startswith(v, F.concat(want, F.lit("-"))) & (F.length(want) > 0)

    def call(self, e: Call, df: DataFrame) -> tuple[DataFrame, Column, str]:
        name = e.name
        if name in ("position", "last"):
            return df, F.col("__pos" if name == "position" else "__last"), "number"
        if name in ("true", "false"):
            return df, F.lit(name == "true"), "boolean"
        if name in ("count", "sum"):
            if type_of(e.args[0]) != "nodeset":
                raise ValueError(f"{name}() takes a node-set")
            ns = self.node_set(e.args[0], df)
            if name == "count":
                by_key = ns.groupBy("doc_id", "ck").agg(F.count("*").cast("double").alias("v"))
            else:
                by_key = self.strings(ns).groupBy("doc_id", "ck").agg(F.sum(V.to_number(F.col("sv"), "string")).alias("v"))
            df, (v,) = self.attach(df, by_key, ["v"])
            return df, F.coalesce(v, F.lit(0.0)), "number"
        if name in ("name", "local-name"):
            df, col = self._name_of(e, df)
            return df, col if name == "name" else F.when(F.contains(col, F.lit(":")), F.substr(col, F.position(F.lit(":"), col) + 1)).otherwise(col), "string"
        if name == "namespace-uri":
            return (*self._namespace_uri(e, df), "string")
        if name == "lang":
            return (*self._lang(e, df), "boolean")
        if name in ("boolean", "not"):
            df, col, kind = self.value(e.args[0], df)
            col = V.to_boolean(col, kind)
            return df, col if name == "boolean" else ~col, "boolean"
        if name in ("string", "number", "string-length", "normalize-space"):
            df, col, kind = self._own_or_arg(e, df)
            if name == "number":
                return df, V.to_number(col, kind), "number"
            text = V.to_string(col, kind)
            if name == "string-length":
                return df, F.length(text).cast("double"), "number"
            return df, V.normalize_space(text) if name == "normalize-space" else text, "string"
        cols = []
        for a in e.args:
            df, col, kind = self.scalar(a, df)
            cols.append((col, kind))
        if name in ("floor", "ceiling", "round"):
            x = V.to_number(*cols[0])
            return df, {"floor": V.floor, "ceiling": V.ceiling, "round": V.round_half_up}[name](x), "number"
        if name == "substring":
            size = V.to_number(*cols[2]) if len(cols) > 2 else None
            return df, V.substring(V.to_string(*cols[0]), V.to_number(*cols[1]), size), "string"
        text = [V.to_string(*c) for c in cols]
        if name in ("contains", "starts-with"):
            return df, (F.contains if name == "contains" else F.startswith)(text[0], text[1]), "boolean"
        how = {"concat": F.concat, "substring-before": V.substring_before, "substring-after": V.substring_after, "translate": V.translate}[name]
        return df, how(*text), "string"
