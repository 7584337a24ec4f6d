"""Registered queries over sources, stores, streams, odd markup and single documents; in a
module of their own, as ``queries`` has the axes, predicates and functions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xqengine import api
from xqengine.operators import extract, skipping
from xqengine.operators.shred import Corpus, shred
from xqengine.plans.interpret import per_document, register_functions
from xqengine.sources.documents import read_files, read_records
from xqengine.sources.store import load_or_shred, read_stats, save, stale
from xqengine.streaming.stream import stream_values

Documents = Callable[[SparkSession, str], DataFrame]


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder the session names; on one machine a temporary
    folder will do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="xqengine-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def odd_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's key and status in markup of six odd kinds, by key."""
    key, status = F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    kinds = (
        F.concat(F.lit("<a>1<![CDATA[<c>&amp;]]>"), key, F.lit("</a>")),
        F.concat(F.lit("</z><a>"), key, F.lit("</a></b>")),
        F.concat(F.lit("<a><b>"), key, F.lit("</a>")),
        F.concat(F.lit('<a x="1>'), key, F.lit("</a>")),
        F.concat(F.lit("<a>&#65;&#x42;&unk;&amp;lt;"), status, F.lit("</a>")),
        F.concat(F.lit("<a>"), status, F.lit("<!-- <b> --><?p <c>?></a><!-- never closed")),
    )
    content = F.lit(None).cast("string")
    for i, made in enumerate(kinds):
        content = F.when(F.col("o_orderkey") % 6 == i, made).otherwise(content)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"), content.alias("content"))


_ODD = "CASE o_orderkey % 6 WHEN 0 THEN '1<c>&amp;' || o_orderkey WHEN 4 THEN 'AB&unk;&lt;' || o_orderstatus WHEN 5 THEN o_orderstatus ELSE CAST(o_orderkey AS VARCHAR) END"


def bad_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each third order's document ends in a tag that nothing closes."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    end = F.when(F.col("o_orderkey") % 3 == 0, "<open").otherwise("</r>")
    return o.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("<r>"), "o_orderpriority", end).alias("content"))


def supplier_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a file for each supplier."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    body = F.concat(F.lit("<s><name>"), "s_name", F.lit("</name>\n<nation>"), "s_nationkey", F.lit("</nation></s>"))
    path = work_dir(spark, "files")
    s.select(F.col("s_suppkey").alias("key"), body.alias("value")).repartition(4).write.partitionBy("key").text(path)
    return path


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_files(spark, supplier_files(spark, sf_dir), "*.txt")
    docs = docs.select(F.regexp_extract("doc_id", r"key=(\d+)", 1).cast("long").alias("doc_id"), "content")
    return api.compile_xpath("/s/name | /s/nation").string_values(shred(docs)).select("doc_id", "name", "value")


def records(documents: Documents) -> Documents:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = work_dir(spark, "records")
        documents(spark, sf_dir).select(F.regexp_replace("content", r"^<\?xml[^>]*>", "").alias("value")).write.text(path)
        docs = read_records(spark, path, "order")
        return per_document(docs, "concat(/order/@key, ':', count(//line))").select("value")

    return run


def stored(documents: Documents) -> Documents:
    """Through the store: half the documents are there with an old content, then all are
    brought up to date and read."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs, path = documents(spark, sf_dir), work_dir(spark, "store")
        old = docs.where("doc_id % 2 = 0").withColumn("content", F.lit("<order/>"))
        save(shred(old), path)
        return api.count_matches(load_or_shred(spark, path, docs), "//line")

    return run


def stale_documents(documents: Documents) -> Documents:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs, path = documents(spark, sf_dir), work_dir(spark, "store")
        kept = docs.where("doc_id % 2 = 0").withColumn("content", F.when(F.col("doc_id") % 4 == 0, F.col("content")).otherwise("<old/>"))
        save(shred(kept), path)
        return stale(spark, path, docs).select("doc_id")

    return run


def stored_stats(documents: Documents) -> Documents:
    """The filter columns alone, read from the store."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs, path = documents(spark, sf_dir), work_dir(spark, "store")
        save(shred(docs), path)
        stats = skipping.filter_from_bytes(read_stats(spark, path).select("doc_id", "tag_names", skipping.filter_to_bytes().alias("f")), "f")
        return stats.select("doc_id", F.octet_length("f").alias("size"), skipping.may_contain("order").alias("has_order"), skipping.may_contain_any(("cust", "qty")).alias("has_any"), F.array_contains("tag_names", "qty").alias("has_qty"))

    return run


def streamed(documents: Documents, text: str) -> Documents:
    """The documents from files, by a stream that runs until all are read."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = work_dir(spark, "stream")
        documents(spark, sf_dir).write.parquet(f"{base}/in")
        docs = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).parquet(f"{base}/in")
        writer = stream_values(docs, text).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
        writer.trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{base}/out")

    return run


def raises(documents: Documents) -> Documents:
    """How a strict reading of bad documents ends."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        message = ""
        try:
            shred(documents(spark, sf_dir), mode="FAILFAST").nodes.select("doc_id").write.format("noop").mode("overwrite").save()
        except Exception as e:  # noqa: BLE001: the error is the result
            message = str(e)
        return spark.createDataFrame([("UnclosedTag" in message,)], "raised boolean")

    return run


def _sql_functions(documents: Documents, text: str) -> Documents:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_functions(spark)
        return spark.sql(text, docs=documents(spark, sf_dir))

    return run


def register(queries: dict, sql: dict, corpus: Callable, makers: dict[str, Documents], o: str) -> None:
    """Add the queries and their SQL; ``o`` starts with the orders and their lines."""
    orders, conversations = makers["orders"], makers["conversations"]

    def on(name: str, of: str, how: Callable[[Corpus], DataFrame], text: str) -> None:
        queries[name], sql[name] = (lambda spark, sf_dir: how(corpus(spark, sf_dir, of))), text

    def add(name: str, how: Documents, text: str) -> None:
        queries[name], sql[name] = how, text

    def value(name: str, xpath: str, text: str) -> None:
        on(name, "orders", lambda c: api.eval_expr(c, xpath), text)

    number = "CAST(l_linenumber AS VARCHAR)"
    line, qty, words, order, cust = ("CAST((5 * i + 1) * 65536 AS BIGINT)", "CAST((5 * i + 2) * 65536 AS BIGINT)", "CAST((5 * i + 3) * 65536 AS BIGINT)", "CAST(2 * 65536 AS BIGINT)", "CAST(3 * 65536 AS BIGINT)")
    of_l = "SELECT l_orderkey AS doc_id, {} AS node_id FROM l {}".format
    of_o = "SELECT o_orderkey AS doc_id, {} AS node_id FROM o {}".format
    union = " UNION ALL ".join
    ids = lambda xpath: lambda c: api.compile_xpath(xpath).select(c).select("doc_id", "node_id")
    for name, xpath, parts in (
        ("axis_descendant_or_self", "/order/descendant-or-self::*", (of_o(order, ""), of_o(cust, ""), of_l(line, ""), of_l(qty, ""))),
        ("axis_ancestor", "//qty/ancestor::*", (of_o(order, "WHERE n > 0"), of_l(line, ""))),
        ("axis_ancestor_or_self", "//qty/ancestor-or-self::node()", (of_o("CAST(0 AS BIGINT)", "WHERE n > 0"), of_o(order, "WHERE n > 0"), of_l(line, ""), of_l(qty, ""))),
        ("axis_following", "//cust/following::*", (of_l(line, ""), of_l(qty, ""))),
        ("axis_preceding", "/order/line[last()]/preceding::*", (of_o(cust, "WHERE n > 0"), of_l(line, "WHERE i < m"), of_l(qty, "WHERE i < m"))),
        ("axis_following_position", "/order/line/following::qty[2]", (of_l(qty, "WHERE i > 2"),)),
        ("axis_preceding_position", "/order/line/preceding::line[1]", (of_l(line, "WHERE i < m"),)),
        ("axis_ancestor_position", "//qty/ancestor::*[2]", (of_o(order, "WHERE n > 0"),)),
        ("axis_sibling_sets", "//line/following-sibling::*", (of_l(line, "WHERE i > 1"),)),
        ("test_node", "/order/node()", (of_o(cust, ""), of_l(line, ""))),
    ):
        on(name, "orders", ids(xpath), o + union(parts))
    on("extract_itertext", "orders", lambda c: extract.itertext(c, extract.tags_by_name(c, "order")).select("doc_id", "text_id", "text"), o + f"SELECT o_orderkey AS doc_id, CAST(4 * 65536 AS BIGINT) AS text_id, CAST(o_custkey AS VARCHAR) AS text FROM o UNION ALL SELECT l_orderkey, {words}, CAST(l_quantity AS VARCHAR) FROM l")
    on("from_context", "orders", lambda c: api.evaluate_from(c, api.compile_xpath("//line").select(c), "qty/text()").select("doc_id", "context_id", "node_id"), o + f"SELECT l_orderkey AS doc_id, {line} AS context_id, {words} AS node_id FROM l")
    on("index_descendants_of", "orders", lambda c: extract.descendants_of(c, extract.tags_by_name(c, "order"), ("qty", "cust")), o + f"SELECT o_orderkey AS doc_id, {order} AS top_id, {cust} AS node_id, 'cust' AS name FROM o UNION ALL SELECT l_orderkey, {order}, {qty}, 'qty' FROM l")
    on("index_post_order", "orders", lambda c: extract.post_order(c), o + f"SELECT o_orderkey AS doc_id, {cust} AS node_id, 0 AS post_order FROM o UNION ALL SELECT l_orderkey, {qty}, CAST(2 * i - 1 AS INTEGER) FROM l UNION ALL SELECT l_orderkey, {line}, CAST(2 * i AS INTEGER) FROM l UNION ALL SELECT o_orderkey, {order}, CAST(2 * n + 1 AS INTEGER) FROM o")

    def pairs(c: Corpus) -> DataFrame:
        a, d = extract.tags_by_name(c, "line").alias("a"), extract.tags_by_name(c, "qty").alias("d")
        return a.join(d, (F.col("a.doc_id") == F.col("d.doc_id")) & extract.is_ancestor("a", "d")).select("a.doc_id", F.col("a.node_id").alias("top_id"), F.col("d.node_id").alias("node_id"))

    on("index_is_ancestor", "orders", pairs, o + f"SELECT l_orderkey AS doc_id, {line} AS top_id, {qty} AS node_id FROM l")
    on("index_child_slices", "orders", lambda c: api.compile_xpath("/order/line[1]/node()").select(c).where("kind <> 'text'").select("doc_id", "node_id", "byte_start", "depth"), o + f"SELECT l_orderkey AS doc_id, {qty} AS node_id, CAST(21 + length('<order key=\"' || o_orderkey || '\" status=\"' || o_orderstatus || '\"><cust>' || o_custkey || '</cust><line n=\"' || l_linenumber || '\" flag=\"' || l_returnflag || '\">') AS BIGINT) AS byte_start, 2 AS depth FROM l WHERE i = 1")
    value("operator_unary_minus", "-count(//line) - - 1", o + "SELECT o_orderkey AS doc_id, CAST(1 - n AS DOUBLE) AS value FROM o")
    value("function_number", "number(/order/cust) + number(/order/@key)", o + "SELECT o_orderkey AS doc_id, CAST(o_custkey + o_orderkey AS DOUBLE) AS value FROM o")
    value("function_number_of_text", "string(number(/order/@status))", o + "SELECT o_orderkey AS doc_id, 'NaN' AS value FROM o")
    value("number_to_string", "string(sum(//qty) div 8)", o + "SELECT o_orderkey AS doc_id, regexp_replace(CAST(coalesce(qty, 0) / 8 AS VARCHAR), '\\.0$', '') AS value FROM o")
    for name, xpath, where in (("predicate_negative", "//line[- 1]/@n", "WHERE false"), ("predicate_negated_value", "//line[-@n < -2]/@n", "WHERE l_linenumber > 2"), ("predicate_union", "//line[@missing | qty]/@n", ""), ("predicate_string", "//line['x']['']/@n", "WHERE false")):
        on(name, "orders", lambda c, xpath=xpath: api.compile_xpath(xpath).string_values(c).select("doc_id", "value"), o + f"SELECT l_orderkey AS doc_id, {number} AS value FROM l {where}")
    on("eval_with_context", "orders", lambda c: api.eval_expr(c, "concat(@n, '/', position(), '/', last(), '/', ../cust)", api.compile_xpath("//line").select(c)), o + f"SELECT l_orderkey AS doc_id, {line} AS node_id, l_linenumber || '/1/1/' || o_custkey AS value FROM l")
    on("evaluate_node_set", "orders", lambda c: api.compile_xpath("//line[2]").evaluate(c).select("doc_id", "node_id"), o + of_l(line, "WHERE i = 2"))
    on("evaluate_scalar", "orders", lambda c: api.compile_xpath("count(//line) > 2").evaluate(c), o + "SELECT o_orderkey AS doc_id, n > 2 AS value FROM o")
    add("eval_standalone", lambda spark, sf_dir: spark.createDataFrame([(api.eval_standalone(spark, "1 + 2 * 3 - count(/r)"),)], "value double"), "SELECT CAST(6 AS DOUBLE) AS value")
    raw = "replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
    turns = "FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL AND text <> ''"
    on("texts_raw", "conversations", lambda c: api.compile_xpath("//turn").texts(c, raw=True).select("doc_id", "text"), f"SELECT conv_id AS doc_id, {raw} AS text {turns}")
    names = {"//a/b[@k]": "a,b", "//a[1]": None, "//c[lang('en')]": None, "//b | //@a": None, "count(//a[c])": "a,c", "//*": None, "id('x')": None}
    add("interesting_names", lambda spark, sf_dir: spark.createDataFrame([(t, None if (n := api.compile_xpath(t).interesting_names()) is None else ",".join(sorted(n))) for t in names], "xpath string, names string"), "SELECT * FROM (VALUES " + ", ".join("('" + t.replace("'", "''") + "', " + ("CAST(NULL AS VARCHAR)" if n is None else f"'{n}'") + ")" for t, n in names.items()) + ") t(xpath, names)")
    wanted = "//line[qty > 30]/@n"
    add("shred_for_xpath", lambda spark, sf_dir: api.compile_xpath(wanted).string_values(shred(orders(spark, sf_dir), for_xpath=wanted)).select("doc_id", "value"), o + f"SELECT l_orderkey AS doc_id, {number} AS value FROM l WHERE l_quantity > 30")
    add("shred_names", lambda spark, sf_dir: shred(orders(spark, sf_dir), names=("line", "order")).nodes.where("kind = 'element'").select("doc_id", "node_id", "name"), o + f"SELECT o_orderkey AS doc_id, {order} AS node_id, 'order' AS name FROM o UNION ALL SELECT l_orderkey, {line}, 'line' FROM l")
    one = "SELECT o_orderkey AS doc_id, {} AS value FROM orders".format
    add("odd_markup_text", lambda spark, sf_dir: api.eval_expr(shred(odd_documents(spark, sf_dir)), "string(/)"), one(_ODD))
    add("odd_markup_elements", lambda spark, sf_dir: api.eval_expr(shred(odd_documents(spark, sf_dir)), "count(//*)"), one("CAST(CASE o_orderkey % 6 WHEN 2 THEN 2 ELSE 1 END AS DOUBLE)"))
    add("per_document_text", lambda spark, sf_dir: per_document(odd_documents(spark, sf_dir), "string(/)"), one(_ODD))
    add("per_document_nodes", lambda spark, sf_dir: per_document(orders(spark, sf_dir), "/order/line[@flag = 'R'][last()]/qty").select("doc_id", "node_id", "name", "value"), o + f"SELECT l_orderkey AS doc_id, {qty} AS node_id, 'qty' AS name, CAST(l_quantity AS VARCHAR) AS value FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY i DESC) AS j FROM l WHERE l_returnflag = 'R') WHERE j = 1")
    add("per_document_number", lambda spark, sf_dir: per_document(orders(spark, sf_dir), "sum(//qty)"), o + "SELECT o_orderkey AS doc_id, CAST(coalesce(qty, 0) AS DOUBLE) AS value FROM o")
    add("sql_table_function", _sql_functions(orders, "SELECT d.doc_id, n.value FROM {docs} d, LATERAL xml_nodes(d.content, '//line/@n') n"), o + f"SELECT l_orderkey AS doc_id, {number} AS value FROM l")
    add("sql_functions", _sql_functions(orders, "SELECT doc_id, xml_number(content, 'count(//line)') AS n, xml_string(content, '/order/@status') AS status, xml_boolean(content, '//line') AS some, array_join(xml_texts(content, '//line/@n'), ',') AS numbers FROM {docs}"), o + "SELECT o_orderkey AS doc_id, CAST(n AS DOUBLE) AS n, o_orderstatus AS status, n > 0 AS some, coalesce((SELECT string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY i) FROM l WHERE l.l_orderkey = o.o_orderkey), '') AS numbers FROM o")
    add("stream_values", streamed(conversations, "//turn[@n = 1]/@role"), "SELECT conv_id AS doc_id, role AS value, 'role' AS name FROM conversations WHERE turn = 1 AND text IS NOT NULL AND role IS NOT NULL")
    streamed_turns = queries["stream_values"]
    queries["stream_values"] = lambda spark, sf_dir: streamed_turns(spark, sf_dir).select("doc_id", "value", "name")
    add("errors_unclosed_tag", lambda spark, sf_dir: shred(bad_documents(spark, sf_dir)).errors.select("doc_id", "error.kind", "error.offset"), "SELECT o_orderkey AS doc_id, 'UnclosedTag' AS kind, CAST(3 + strlen(o_orderpriority) AS BIGINT) AS \"offset\" FROM orders WHERE o_orderkey % 3 = 0")
    add("errors_leave_others", lambda spark, sf_dir: api.eval_expr(shred(bad_documents(spark, sf_dir)), "string(/r)"), "SELECT o_orderkey AS doc_id, o_orderpriority AS value FROM orders WHERE o_orderkey % 3 <> 0")
    add("errors_failfast", raises(bad_documents), "SELECT true AS raised")
    add("read_files", _files, "SELECT CAST(s_suppkey AS BIGINT) AS doc_id, 'name' AS name, s_name AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS VARCHAR) FROM supplier")
    add("read_records", records(orders), o + "SELECT o_orderkey || ':' || n AS value FROM o")
    add("store_round_trip", stored(orders), o + "SELECT o_orderkey AS doc_id, n FROM o")
    add("store_stale", stale_documents(orders), "SELECT o_orderkey AS doc_id FROM orders WHERE o_orderkey % 4 <> 0")
    add("store_stats", stored_stats(orders), o + "SELECT o_orderkey AS doc_id, 16 AS size, true AS has_order, true AS has_any, n > 0 AS has_qty FROM o")
