"""Entry points: compile an expression once, evaluate it over a corpus of documents."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xqengine.functions import values as V
from xqengine.operators.shred import NODE, Corpus, shred, unsized
from xqengine.plans.analyze import Selectivity, selectivity
from xqengine.plans.ast import Expr, type_of
from xqengine.plans.compile import Plan
from xqengine.plans.interpret import per_document, register_functions
from xqengine.plans.parser import XPathError, parse_xpath

__all__ = ["CompiledXPath", "Corpus", "XPathError", "compile_xpath", "count_matches", "eval_expr", "eval_standalone", "eval_text", "eval_text_batch", "evaluate_from", "per_document", "register_functions", "shred"]


@dataclass(frozen=True)
class CompiledXPath:
    """A parsed expression with its static type; small, hashable and picklable."""

    text: str
    ast: Expr

    @property
    def kind(self) -> str:
        return type_of(self.ast)

    def selectivity(self) -> Selectivity:
        return selectivity(self.ast)

    def interesting_names(self) -> frozenset[str] | None:
        """Element names the expression can be answered from; None: any may matter."""
        return self.selectivity().names

    def select(self, corpus: Corpus) -> DataFrame:
        """The node-set, (doc_id, NODE); other types raise."""
        if self.kind != "nodeset":
            raise ValueError(f"{self.text!r} is a {self.kind}, not a node-set")
        return Plan(corpus).node_set(self.ast, None).select("doc_id", *NODE)

    def string_values(self, corpus: Corpus) -> DataFrame:
        """(doc_id, node_id, kind, name, value) with each node's string value. Of a corpus
        that was shredded for this expression and isn't kept, in one pass over its documents."""
        if corpus.only is not None and corpus.only[0] == self.text and self.kind == "nodeset":
            return per_document(corpus.docs, self.text, mode=corpus.only[1])
        plan = Plan(corpus)
        return plan.strings(self.select(corpus)).select("doc_id", "node_id", "kind", "name", F.col("sv").alias("value"))

    def texts(self, corpus: Corpus, raw: bool = False) -> DataFrame:
        """(doc_id, node_id, text_id, text): each element's direct text, a row a run; text
        and attribute nodes give their own value."""
        found = self.select(corpus)
        own = found.where("kind IN ('text', 'attribute')").select("doc_id", "node_id", F.col("node_id").alias("text_id"), "kind", "text", "c0", "c1")
        parents = found.where("kind = 'element'").select(F.col("doc_id").alias("p_doc"), F.col("node_id").alias("p_id"))
        runs = corpus.nodes.where("kind = 'text'")
        kids = parents.join(runs, (F.col("p_doc") == F.col("doc_id")) & (F.col("p_id") == F.col("parent_id")))
        out = own.unionByName(kids.select("doc_id", F.col("p_id").alias("node_id"), F.col("node_id").alias("text_id"), "kind", "text", "c0", "c1"))
        if raw:
            own_docs = corpus.docs.join(out.select("doc_id").distinct(), "doc_id", "left_semi")
            out = out.join(unsized(own_docs), "doc_id").withColumn("text", F.when(F.col("kind") == "text", F.substr("content", (F.col("c0") + 1).cast("int"), (F.col("c1") - F.col("c0")).cast("int"))).otherwise(F.col("text")))
        return out.select("doc_id", "node_id", "text_id", "text")

    def evaluate(self, corpus: Corpus) -> DataFrame:
        """Node-sets as ``select``; any other type as (doc_id, value), a row a document."""
        return self.select(corpus) if self.kind == "nodeset" else eval_expr(corpus, self.text)

    def display(self, corpus: Corpus) -> DataFrame:
        """(doc_id, display): scalars as text, a node-set's string values by line."""
        docs = corpus.nodes.where("kind = 'root'").select("doc_id")
        if self.kind != "nodeset":
            return eval_expr(corpus, self.text).select("doc_id", V.to_string(F.col("value"), self.kind).alias("display"))
        lists = self.string_values(corpus).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "value"))).alias("v"))
        return docs.join(lists, "doc_id", "left").select("doc_id", F.coalesce(F.array_join(F.col("v.value"), "\n"), F.lit("")).alias("display"))


@lru_cache(maxsize=1024)
def compile_xpath(text: str) -> CompiledXPath:
    return CompiledXPath(text, parse_xpath(text))


def eval_text(corpus: Corpus, text: str, *, lazy: bool = False) -> DataFrame:
    """(doc_id, texts): all documents, those without a match with an empty array.
    ``lazy``: look only at documents that have the names the expression needs."""
    x = compile_xpath(text)
    source = corpus
    if lazy:
        from xqengine.operators.skipping import possible

        source = possible(corpus, x.selectivity())
    lists = x.texts(source).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "text_id", "text"))).alias("t"))
    docs = corpus.nodes.where("kind = 'root'").select("doc_id")
    return docs.join(lists, "doc_id", "left").select("doc_id", F.coalesce(F.col("t.text"), F.array().cast("array<string>")).alias("texts"))


def eval_text_batch(docs: DataFrame, text: str, *, skip: str = "names", partitions: int | None = None) -> DataFrame:
    """``eval_text`` of raw (doc_id, content) documents. ``skip`` leaves documents out
    before they are shredded: 'names' by the required names in their text, 'filter' by
    the 128-bit filter, 'none' not at all; they get an empty array like any other without
    a match. ``partitions`` deals documents out anew, for few files with many documents."""
    from xqengine.operators import skipping

    need = compile_xpath(text).selectivity()
    few = docs
    if skip == "names":
        few = skipping.prescan(docs, need.required)
    elif skip == "filter":
        few = skipping.possible_by_filter(skipping.filter_from_content(docs), need).select("doc_id", "content")
    if partitions:
        few = few.repartition(partitions, "doc_id")
    found = eval_text(shred(few), text)
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("texts", F.array().cast("array<string>")).alias("texts"))


def count_matches(corpus: Corpus, text: str) -> DataFrame:
    """(doc_id, n) of all documents."""
    found = compile_xpath(text).select(corpus).groupBy("doc_id").agg(F.count("*").alias("n"))
    docs = corpus.nodes.where("kind = 'root'").select("doc_id")
    return docs.join(found, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n"))


def _valued(plan: Plan, e: Expr, cands: DataFrame, keys: list[str]) -> DataFrame:
    if type_of(e) == "nodeset":
        df, col = plan.first_string(e, cands)
    else:
        df, col, _ = plan.value(e, cands)
    return df.select(*keys, col.alias("value"))


def eval_expr(corpus: Corpus, text: str, context: DataFrame | None = None) -> DataFrame:
    """The whole grammar at each document's root, (doc_id, value), or at each node of a
    (doc_id, NODE) ``context``, (doc_id, node_id, value), at position 1 of 1. A node-set
    gives its first node's string value."""
    plan = Plan(corpus)
    if context is None:
        return _valued(plan, compile_xpath(text).ast, plan.roots(), ["doc_id"])
    return _valued(plan, compile_xpath(text).ast, plan.contexts(context), ["doc_id", "node_id"])


def evaluate_from(corpus: Corpus, context: DataFrame, text: str) -> DataFrame:
    """(doc_id, context_id, NODE): the node-set from each node of ``context``."""
    plan = Plan(corpus)
    found = plan.node_set(compile_xpath(text).ast, plan.contexts(context))
    return found.withColumn("context_id", F.element_at(F.split("ck", "[|]"), -1).cast("long")).select("doc_id", "context_id", *NODE)


def eval_standalone(spark: SparkSession, text: str):
    """The value of an expression that looks at no document (evaluated at ``<r/>``)."""
    corpus = shred(spark.createDataFrame([(0, "<r/>")], "doc_id int, content string"))
    return eval_expr(corpus, text).first()["value"]
