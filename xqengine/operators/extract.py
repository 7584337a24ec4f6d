"""What can be read off nodes: text, raw markup, serialisations, neighbours.

Each function takes the corpus and (doc_id, NODE) rows and adds columns or returns rows;
slices of the document or of one string per document replace joins that gather parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from xqengine.operators.shred import SLOT, Corpus, unsized


def _slice(text: str, start: Column, end: Column) -> Column:
    return F.substr(F.col(text), (start + 1).cast("int"), (end - start).cast("int"))


def _docs_of(corpus: Corpus, nodes: DataFrame) -> DataFrame:
    """The documents that have one of the nodes: only their contents move to a join."""
    return unsized(corpus.docs.join(nodes.select("doc_id").distinct(), "doc_id", "left_semi"))


def raw_xml(corpus: Corpus, nodes: DataFrame) -> DataFrame:
    """Add ``raw_xml``: from the open tag through its close, as written."""
    return nodes.join(_docs_of(corpus, nodes), "doc_id").withColumn("raw_xml", _slice("content", F.col("c0"), F.col("c1"))).drop("content")


def raw_tag(corpus: Corpus, nodes: DataFrame) -> DataFrame:
    """Add ``raw_tag``: the open tag as written."""
    tag = F.regexp_extract(_slice("content", F.col("c0"), F.col("c1")), r"""^(?s)<(?:[^"'>]++|"[^"]*+"|'[^']*+'|["'].?)*+>""", 0)
    own = nodes.where("kind = 'element'")
    return own.join(_docs_of(corpus, own), "doc_id").withColumn("raw_tag", tag).drop("content")


def string_value(corpus: Corpus, nodes: DataFrame) -> DataFrame:
    """Add ``string_value``."""
    own = F.when(F.col("kind").isin("element", "root"), _slice("doc_text", F.col("t0"), F.col("t1"))).otherwise(F.coalesce("text", F.lit("")))
    return nodes.join(corpus.texts, "doc_id").withColumn("string_value", own).drop("doc_text")


def direct_text(corpus: Corpus, nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, texts, first_text) of elements: their own text runs in order."""
    p = nodes.where("kind = 'element'").select(F.col("doc_id").alias("p_doc"), F.col("node_id").alias("p_id"))
    t = corpus.nodes.where("kind = 'text'").select("doc_id", "parent_id", F.col("node_id").alias("t_id"), "text")
    runs = p.join(t, (F.col("p_doc") == F.col("doc_id")) & (F.col("p_id") == F.col("parent_id")), "left")
    lists = runs.groupBy(F.col("p_doc").alias("doc_id"), F.col("p_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.when(F.col("t_id").isNotNull(), F.struct("t_id", "text")))).alias("t"))
    return lists.select("doc_id", "node_id", F.col("t.text").alias("texts"), F.try_element_at(F.col("t.text"), F.lit(1)).alias("first_text"))


def itertext(corpus: Corpus, nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, text_id, text): the non-empty text runs inside each element."""
    p = nodes.where("kind IN ('element', 'root')").select(F.col("doc_id").alias("p_doc"), F.col("node_id").alias("p_id"), F.col("close_id").alias("p_close"))
    t = corpus.nodes.where("kind = 'text'").select("doc_id", F.col("node_id").alias("text_id"), "text")
    inside = (F.col("p_doc") == F.col("doc_id")) & (F.col("text_id") > F.col("p_id")) & (F.col("text_id") < F.col("p_close"))
    return p.join(t, inside).select("doc_id", F.col("p_id").alias("node_id"), "text_id", "text")


def tail_text(corpus: Corpus) -> DataFrame:
    """(doc_id, node_id, tail): the text that starts where an element ends."""
    kids = corpus.nodes.where("kind IN ('element', 'text')")
    ahead = F.lead(F.struct("kind", "c0", "text")).over(W.partitionBy("doc_id", "parent_id").orderBy("node_id"))
    near = kids.withColumn("n", ahead).where("kind = 'element' AND n.kind = 'text' AND n.c0 = c1")
    return near.select("doc_id", "node_id", F.col("n.text").alias("tail"))


def child_positions(corpus: Corpus) -> DataFrame:
    """(doc_id, node_id, parent_id, child_position from 0, child_count of the parent)."""
    kids = corpus.nodes.where("kind = 'element'")
    own = W.partitionBy("doc_id", "parent_id")
    return kids.select("doc_id", "node_id", "parent_id", (F.row_number().over(own.orderBy("node_id")) - 1).alias("child_position"), F.count("*").over(own).alias("child_count"))


def child_at(corpus: Corpus, k: int) -> DataFrame:
    """(doc_id, parent_id, node_id): each parent's element child number ``k``, from 0."""
    return child_positions(corpus).where(F.col("child_position") == k).select("doc_id", "parent_id", "node_id")


def post_order(corpus: Corpus) -> DataFrame:
    """(doc_id, node_id, post_order) of elements, from 0."""
    tags = corpus.nodes.where("kind = 'element'")
    return tags.select("doc_id", "node_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("close_id", F.desc("node_id"))) - 1).alias("post_order"))


def tags_by_name(corpus: Corpus, name: str) -> DataFrame:
    return corpus.nodes.where((F.col("kind") == "element") & (F.col("name") == name))


def is_ancestor(a: str, d: str) -> Column:
    """Whether row ``a.`` holds row ``d.`` of the same document."""
    return F.expr(f"{a}.node_id < {d}.node_id AND {d}.node_id < {a}.close_id")


def attribute(name: str) -> Column:
    """The decoded value of an element's attribute, null where it has none."""
    own = F.filter("attrs", lambda a: a["name"] == F.lit(name))
    return F.try_element_at(own, F.lit(1))["value"]


def attribute_names() -> Column:
    """Names without namespace declarations."""
    return F.expr("transform(filter(attrs, a -> a.name <> 'xmlns' AND NOT startswith(a.name, 'xmlns:')), a -> a.name)")


def namespace_decls() -> Column:
    """The prefixed declarations, (prefix, uri)."""
    return F.expr("transform(filter(attrs, a -> startswith(a.name, 'xmlns:')), a -> named_struct('prefix', substr(a.name, 7), 'uri', a.value))")


def counts(corpus: Corpus) -> DataFrame:
    """(doc_id, n_elements, n_texts, n_comments, n_pis, n_attributes, max_depth)."""
    one = lambda kind: F.count_if(F.col("kind") == kind)
    return corpus.nodes.groupBy("doc_id").agg(one("element").alias("n_elements"), one("text").alias("n_texts"), one("comment").alias("n_comments"), one("pi").alias("n_pis"), one("attribute").alias("n_attributes"), F.coalesce(F.max(F.when(F.col("kind") == "element", F.col("depth"))), F.lit(0)).alias("max_depth"))


def _escaped(text: str, quote: bool) -> str:
    out = f"replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return f"""replace({out}, '"', '&quot;')""" if quote else out


def canonical(corpus: Corpus, nodes: DataFrame) -> DataFrame:
    """Add ``canonical``: attributes sorted and without xmlns, no self-closing tags, text
    decoded and escaped anew, comments and processing instructions in their own form.

    One string a document is built from open and close pieces in order; a node's form is
    its slice."""
    attrs = "array_sort(filter(transform(coalesce(attrs, array()), a -> named_struct('n', a.name, 'v', a.value)), a -> a.n <> 'xmlns' AND NOT startswith(a.n, 'xmlns:')))"
    listed = f"array_join(transform({attrs}, a -> concat(' ', a.n, '=\"', {_escaped('a.v', True)}, '\"')), '')"
    tree = corpus.nodes.where("kind IN ('element', 'text', 'comment', 'pi')")
    first = tree.select("doc_id", F.col("node_id").alias("at"), F.lit(0).cast("long").alias("sub"), "node_id", F.lit(True).alias("opens"), F.expr(f"CASE kind WHEN 'element' THEN concat('<', name, {listed}, '>') WHEN 'text' THEN {_escaped('text', False)} WHEN 'comment' THEN concat('<!--', text, '-->') ELSE concat('<?', name, CASE WHEN text = '' THEN '' ELSE ' ' END, text, '?>') END").alias("s"))
    last = tree.where("kind = 'element'").select("doc_id", F.col("close_id").alias("at"), (-F.col("node_id")).alias("sub"), "node_id", F.lit(False).alias("opens"), F.concat(F.lit("</"), "name", F.lit(">")).alias("s"))
    run = W.partitionBy("doc_id").orderBy("at", "sub").rowsBetween(W.unboundedPreceding, 0)
    size = F.length("s").cast("long")
    pieces = first.unionByName(last).withColumn("end", F.sum(size).over(run)).withColumn("begin", F.col("end") - size)
    whole = pieces.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "sub", "s"))), lambda x: x["s"]), "").alias("__all"))
    ends = pieces.groupBy("doc_id", "node_id").agg(F.min("begin").alias("__b"), F.max("end").alias("__e"))
    return nodes.join(unsized(ends), ["doc_id", "node_id"]).join(unsized(whole), "doc_id").withColumn("canonical", _slice("__all", F.col("__b"), F.col("__e"))).drop("__all", "__b", "__e")


def descendants_of(corpus: Corpus, nodes: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(doc_id, top_id, node_id, name): elements of some names inside the given ones."""
    a = nodes.select(F.col("doc_id").alias("a_doc"), F.col("node_id").alias("top_id"), F.col("close_id").alias("a_close"))
    d = corpus.nodes.where((F.col("kind") == "element") & F.col("name").isin(*names))
    on = (F.col("a_doc") == F.col("doc_id")) & (F.col("node_id") > F.col("top_id")) & (F.col("node_id") < F.col("a_close"))
    return a.join(d, on).select("doc_id", "top_id", "node_id", "name")


__all__ = ["SLOT", "attribute", "attribute_names", "canonical", "child_at", "child_positions", "counts", "descendants_of", "direct_text", "is_ancestor", "itertext", "namespace_decls", "post_order", "raw_tag", "raw_xml", "string_value", "tags_by_name", "tail_text"]
