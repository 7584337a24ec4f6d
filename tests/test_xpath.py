"""Axes, tests, predicates, operators and functions on small documents with known values."""

import math

import pytest

from xqengine import api
from xqengine.operators import extract
from xqengine.operators.shred import shred

D1 = '<?xml version="1.0"?><r a="1"><b i="1">x</b><!--n--><b i="2"><c>y</c>z</b><?t d?><e/></r>'
VALUES = {
    "count(//node())": 10, "count(/r/node())": 5, "count(//c/following::node())": 3, "count(//c/preceding::node())": 3, "count(//c/ancestor::node())": 3,
    "count(//c/ancestor::*)": 2, "count(//c/descendant::node())": 1, "name(//c/preceding::node()[3])": "b", "count(//e/preceding-sibling::node())": 4,
    "string(//b[1]/following-sibling::*[1]/@i)": "2", "string(/r)": "xyz", "string(//b[2])": "yz", "count(//@*)": 3, "sum(//@i)": 3, "count(//b[c='y'])": 1,
    "count(//b[@i != '1'])": 1, "string(//b[last()]/@i)": "2", "count((//b)[1])": 1, "count(//b[1])": 1, "count(//text())": 3, "string(//processing-instruction())": "d",
    "string(//comment())": "n", "count(//c/self::node() | //c/..)": 2, "//b = //c/..": True, "//b != //b": True, "count(//b[@i < //b/@i])": 1,
    "count(//namespace::*)": 5, "count(//b/@i/following::node())": 8, "count(//c/ancestor-or-self::*[1])": 1, "boolean(//zz)": False, "not(//zz | //b)": False,
}
SCALARS = {
    "round(-1.5)": -1, "round(2.5)": 3, "substring('12345', 1.5, 2.6)": "234", "substring('12345', 0, 3)": "12", "substring('12345', 0 div 0, 3)": "",
    "substring('12345', -42, 1 div 0)": "12345", "translate('bar','abc','AB')": "BAr", "normalize-space(' a  b ')": "a b", "1 div 0": math.inf, "string(0.1)": "0.1",
    "string(1 div 3)": "0.333333333333333", "string(100)": "100", "string(1e16)": "1e+16", "string(-0.5)": "-0.5", "5 mod -3": 2, "-5 mod 2": -1,
    "string(number('x'))": "NaN", "0 div 0 = 0 div 0": False, "0 div 0 != 0 div 0": True, "1 < 0 div 0": False, "string-length('é')": 1, "concat('a',1,true())": "a1true",
    "substring-before('1999/04','/')": "1999", "substring-after('1999/04','/')": "04", "floor(-1.5)": -2, "ceiling(-1.5)": -1, "floor(1e300)": 1e300, "number(' 12 ')": 12,
    "'a' = 1": False, "true() = 'x'": True, "'2' > 1": True, "contains('abc','')": True, "starts-with('abc','ab')": True,
}


@pytest.fixture(scope="module")
def d1(spark):
    return shred(spark.createDataFrame([(1, D1)], "doc_id int, content string")).persist()


@pytest.mark.parametrize("text", VALUES)
def test_values(d1, text):
    assert api.eval_expr(d1, text).first()["value"] == VALUES[text]


def test_scalars(spark, d1):
    """All at once: one row whose columns are the expressions."""
    from xqengine.plans.compile import Plan

    plan = Plan(d1)
    df = plan.roots()
    cols = []
    for i, text in enumerate(SCALARS):
        df, col, _ = plan.value(api.compile_xpath(text).ast, df)
        cols.append(col.alias(f"v{i}"))
    got = df.select(*cols).first()
    assert dict(zip(SCALARS, got, strict=True)) == SCALARS


def corpus(spark, *contents):
    return shred(spark.createDataFrame(list(enumerate(contents)), "doc_id int, content string"))


def values(c, text):
    return {r["doc_id"]: r["value"] for r in api.eval_expr(c, text).collect()}


def test_shredder_rules(spark):
    c = corpus(spark, "<a x=\"1>2\" y='\"'/>", "<a><b></a>", "</z><a>1</a>", "<a>1<!-- <b> --><![CDATA[<c>&amp;]]>2</a>", "<a", "<d>" * 40, "<a t=\"x id='5'\"><b id=\"5\"/></a>", "<a>&amp;lt; &#65;&#x42; &unk; &</a>", "", "text only", "<!DOCTYPE a [<!ENTITY x \"y\">]><a/>", "<a><!-- never closed", "<?p x", None).persist()
    assert {r["doc_id"]: r["error"]["offset"] for r in c.errors.collect()} == {4: 0}
    got = values(c, "concat(count(//*), ' ', string(/), ' ', count(//*/ancestor::*))")
    assert 4 not in got
    assert got[0] == "1  0" and got[1] == "2  1" and got[2] == "1 1 0" and got[3] == "1 1<c>&amp;2 0"
    assert got[5] == "40  39" and got[7] == "1 &lt; AB &unk; & 0"
    assert got[8] == got[9] == got[13] == "0  0" and got[10] == "1 ]> 0" or got[10] == "1  0"
    assert values(c, "count(//@id)")[6] == 1 and values(c, "string(//comment())")[11] == " never closed"
    assert values(c, "string(/*/@x)")[0] == "1>2"


def test_standard_semantics(spark):
    c = corpus(spark, '<r><p i="0"/><p id="x"/></r>', "<r><k><a>1</a><a>2</a></k><k/></r>", '<n:a xmlns:n="u" xmlns="v"><n:b/><c/></n:a>', '<a xml:lang="en-GB"><b/></a>').persist()
    assert values(c, "count(//p[1][@id='x'])")[0] == 0 and values(c, "count(//*[@id='x'])")[0] == 1
    assert values(c, "count(//k[a='2'])")[1] == 1 and values(c, "count(//k[a!='1'])")[1] == 1 and values(c, "count(//k[a | b])")[1] == 1
    assert values(c, "concat(count(//n:*), local-name(/*), namespace-uri(/*), namespace-uri(//c))")[2] == "2auv"
    assert values(c, "count(//b[lang('en')])")[3] == 1
    assert values(c, "count(//text()[. = '2']/parent::a/preceding-sibling::a)")[1] == 1


def test_axes_partition_a_document(d1):
    for name in ("c", "e", "b[2]"):
        parts = [api.eval_expr(d1, f"count(//{name}/{axis}::node())").first()["value"] for axis in ("self", "ancestor", "descendant", "following", "preceding")]
        assert sum(parts) == 11


def test_api(spark, d1):
    assert api.eval_standalone(spark, "1 + 2") == 3
    with pytest.raises(ValueError):
        api.compile_xpath("1 + 1").select(d1)
    assert [r["text"] for r in api.compile_xpath("//b | //@a").texts(d1).orderBy("node_id", "text_id").collect()] == ["1", "x", "z"]
    assert api.compile_xpath("//b").display(d1).first()["display"] == "x\nyz"
    assert api.count_matches(d1, "//b").first()["n"] == 2
    got = api.evaluate_from(d1, api.compile_xpath("//b").select(d1), "following-sibling::*").groupBy("context_id").count().orderBy("context_id").collect()
    assert [r["count"] for r in got] == [2, 1]
    form = extract.canonical(d1, api.compile_xpath("/r").select(d1)).first()["canonical"]
    assert form == '<r a="1"><b i="1">x</b><!--n--><b i="2"><c>y</c>z</b><?t d?><e></e></r>'


def test_against_another_parser(spark):
    """Random well-formed trees: counts and texts as the standard library finds them."""
    import random
    import xml.etree.ElementTree as ET

    rnd = random.Random(7)

    def tree(depth: int) -> str:
        kids = "".join(tree(depth - 1) if rnd.random() < 0.6 else rnd.choice(["t&amp;", "é", " ", "<!--c-->"]) for _ in range(rnd.randrange(4))) if depth else "x"
        name = rnd.choice("abc")
        return f'<{name} k="{rnd.randrange(3)}">{kids}</{name}>'

    made = [tree(5) for _ in range(20)]
    c = corpus(spark, *made).persist()
    for text, own in (("count(//a)", lambda r: len(list(r.iter("a")))), ("string(/)", lambda r: "".join(r.itertext())), ("count(//b[@k='1']/c)", lambda r: len([x for b in r.iter("b") if b.get("k") == "1" for x in b.findall("c")]))):
        assert values(c, text) == {i: own(ET.fromstring(d)) for i, d in enumerate(made)}


def test_quotes_in_tags(spark):
    """A quote that is closed later runs to there; one that nothing closes is skipped with
    the character behind it; where the tag then never ends, the document is an error."""
    c = corpus(spark, '<a x="1>y</a>', '<a x="1> t <b y="2"></b></a>', '<a x="1> t <b y="2" z=">q</b>', "<a x='>z<b/></a>", '<a "" x="v>w"><b/></a>').persist()
    assert {r["doc_id"]: r["error"]["offset"] for r in c.errors.collect()} == {}
    assert values(c, "string(/)")[0] == "y" and values(c, "count(//*)")[0] == 1
    assert values(c, "count(//*)")[1] == 1 and values(c, "count(//*)")[4] == 2
    bad = corpus(spark, '<a x="1> t <b y="2">', "<a x='").errors.collect()
    assert {r["doc_id"]: (r["error"]["kind"], r["error"]["offset"]) for r in bad} == {0: ("UnclosedTag", 0), 1: ("UnclosedTag", 0)}


def test_failfast_raises_whatever_is_read(spark):
    docs = spark.createDataFrame([(1, "<a/>"), (2, "<a>x<b")], "doc_id int, content string")
    bad = shred(docs, mode="FAILFAST")
    for read in (lambda: bad.nodes.count(), lambda: bad.nodes.select("doc_id").collect(), lambda: api.count_matches(bad, "//a").collect(), lambda: api.compile_xpath("//a").string_values(bad).collect(), lambda: bad.errors.count()):
        with pytest.raises(Exception, match="UnclosedTag at byte 4"):
            read()
    assert shred(docs.where("doc_id = 1"), mode="FAILFAST").nodes.count() == 2
    with pytest.raises(ValueError):
        shred(docs, mode="other")


def test_shredding_needs_no_exchange(spark):
    docs = spark.createDataFrame([(1, "<a/>")], "doc_id int, content string")
    plan = shred(docs).nodes._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    dealt = shred(docs, partitions=3)
    assert dealt.nodes.rdd.getNumPartitions() == 3 and dealt.nodes.count() == 2


def test_offsets_of_bytes_and_characters(spark):
    text = "<a k='é'>ü€😀<b>x</b>&lt;é</a>"
    c = corpus(spark, text)
    for r in c.nodes.where("kind IN ('element', 'text')").collect():
        assert text[r["c0"] : r["c1"]] == text.encode()[r["byte_start"] : r["byte_end"]].decode()
    whole = c.texts.first()["doc_text"]
    assert whole == "ü€😀x<é" and {whole[r["t0"] : r["t1"]] for r in c.nodes.where("kind = 'text'").collect()} == {"ü€😀", "x", "<é"}


def test_attribute_names_are_data(d1):
    got = d1.nodes.where("kind = 'element'").select(extract.attribute("i").alias("i"), extract.attribute("it's\\").alias("odd")).collect()
    assert {r["i"] for r in got} == {None, "1", "2"} and {r["odd"] for r in got} == {None}


PRUNED = [
    "//b", "//b/@k", "//a | //@k", "//a[1]", "//a/b[2]", "//c/ancestor::a", "//a//b[@k='1']/c", "count(//c[lang('en')])", "namespace-uri(//c)", "count(id('0')/c)", "//c/namespace::g", "//b/..", "//a[b]/c",
    "//a/following-sibling::b", "//b/self::b", "(//b)[2]", "string(//a[last()])", "//a[count(b) > 1]", "//b[contains(., 't')]", "/a/b/text()", "//*[self::b]", "//a/descendant::b[1]", "//descendant::a[2]", "sum(//@k)", "//b[not(c)]", "name(//b[1]/*)",
]


def test_pruning_by_names_never_changes_results(spark):
    import random

    rnd = random.Random(11)

    def tree(depth: int) -> str:
        kids = "".join(tree(depth - 1) if rnd.random() < 0.7 else "t" for _ in range(rnd.randrange(4))) if depth else "x"
        name = rnd.choice("abc")
        return f'<{name} id="{rnd.randrange(9)}" k="{rnd.randrange(3)}"{rnd.choice(["", " xml:lang=" + chr(34) + "en" + chr(34), " xmlns=" + chr(34) + "u" + chr(34), " xmlns:g=" + chr(34) + "v" + chr(34)])}>{kids}</{name}>'

    docs = spark.createDataFrame([(i, tree(5)) for i in range(12)], "doc_id int, content string").cache()
    whole = shred(docs).persist()
    for text in PRUNED:
        x = api.compile_xpath(text)
        few = shred(docs, for_xpath=text)
        if x.kind == "nodeset":
            ids = lambda c: sorted((r["doc_id"], r["node_id"], r["value"]) for r in x.string_values(c).collect())
        else:
            ids = lambda c: sorted((r["doc_id"], r["value"]) for r in api.eval_expr(c, text).collect())
        assert ids(few) == ids(whole), text
    names = lambda t: api.compile_xpath(t).interesting_names()
    assert names("//a/b[@k]") == {"a", "b"} and names("//a[1]") is None and names("//c[lang('en')]") is None
    assert {r["name"] for r in shred(docs, for_xpath="/a/b").nodes.where("kind = 'element'").collect()} <= {"a", "b"}


EXTRA = [
    "//c/ancestor::*[1]", "//b/preceding::a[2]", "//b/following::*", "//a/preceding-sibling::*[last()]", "//@k/..", "//@k/following::b[1]", "//b/namespace::*", "//a[@k = ../b/@k]", "//a[@k < 2 or b]", "//*[position() mod 2 = 0]",
    "(//a | //b)[last()]", "id(//b/@k)/c", "//a[.//c]/@id", "//text()[contains(., 't')]/ancestor::b", "//a[string-length(.) > 3][2]", "//*[not(*)][1]", "/descendant-or-self::node()/b", "//a/descendant-or-self::a[2]", "//c/preceding-sibling::node()", "//@*[. = '1']",
    "//comment() | //processing-instruction('p')", "//a[-1 < @k]", "//a[- @k]", "//b[@k != //c/@k]", "//b[@k >= //c/@k]", "//namespace::g/..", "//*[namespace-uri() = 'u']", "//*[lang('en')]/@k", "//a/self::node()/b", "//*[local-name(..) = 'a']",
    "number(//b[2]/@k)", "string(//a/@k * 1.5)", "count(//a) = count(//b)", "//a = //b", "//a/@k < //b/@k", "//a/@k != //b/@k", "boolean(//zz) = false()", "normalize-space(//a)", "translate(//a, 'tx', 'T')", "substring(//b, 2)", "name(//@*[2])", "sum(//@k) div count(//@k)", "concat(name(//*[last()]), '-', //c)",
    "namespace-uri(//@*[3])", "lang('en')", "string(//namespace::*[1])", "round(sum(//@id) div 7)", "-count(//c)", "string()", "(//a)[position() < 3]/b | //c",
]


def test_each_document_in_its_row_gives_the_same(spark, d1):
    """The evaluator of single documents against the plans over the node table."""
    import random

    from xqengine.plans.interpret import per_document

    rnd = random.Random(12)

    def tree(depth: int) -> str:
        kids = "".join(tree(depth - 1) if rnd.random() < 0.7 else rnd.choice(["t", "<!--n-->", "<?p q r?>", "é&amp;", "<![CDATA[<]]>"]) for _ in range(rnd.randrange(4))) if depth else "x"
        name = rnd.choice(["a", "b", "c", "g:a"])
        more = rnd.choice(["", " xml:lang='en'", " xmlns='u'", " xmlns:g='v'", " xmlns=''"])
        return f"<{name} id='{rnd.randrange(9)}' k='{rnd.randrange(3)}'{more}>{kids}</{name}>"

    docs = spark.createDataFrame([(i, tree(4)) for i in range(10)] + [(90, ""), (91, "t<a"), (92, None), (93, "</b><a>x<b>"), (94, D1)], "doc_id int, content string").cache()
    whole = shred(docs).persist()
    for text in [*PRUNED, *EXTRA, *VALUES, *SCALARS]:
        x = api.compile_xpath(text)
        if x.kind == "nodeset":
            rows = lambda df: sorted((r["doc_id"], r["node_id"], r["kind"], r["name"] or "", r["value"]) for r in df.collect())
            assert rows(per_document(docs, text)) == rows(x.string_values(whole)), text
        else:
            rows = lambda df: sorted((r["doc_id"], "NaN" if r["value"] != r["value"] else r["value"]) for r in df.collect())
            assert rows(per_document(docs, text)) == rows(api.eval_expr(whole, text)), text
    plan = per_document(docs, "//a")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    with pytest.raises(Exception, match="UnclosedTag at byte 1"):
        per_document(docs, "//a", mode="FAILFAST").count()


def test_sql_functions(spark):
    from xqengine.plans.interpret import register_functions

    register_functions(spark)
    spark.createDataFrame([(1, "<r><a k='1'>x</a><a k='2'>y</a></r>"), (2, None), (3, "<r><a")], "id int, content string").createOrReplaceTempView("xml_docs")
    got = spark.sql("SELECT id, n.name, n.value FROM xml_docs, LATERAL xml_nodes(content, '//a/@k') n").collect()
    assert sorted(map(tuple, got)) == [(1, "k", "1"), (1, "k", "2")]
    one = spark.sql("SELECT xml_string(content, '//a[2]') s, xml_number(content, 'sum(//@k)') n, xml_boolean(content, '//a[@k > 1]') b, xml_texts(content, '//a') t FROM xml_docs ORDER BY id").collect()
    assert [tuple(r) for r in one] == [("y", 3.0, True, ["x", "y"]), ("", 0.0, False, []), (None, None, None, None)]


def test_large_documents_in_linear_time(spark):
    """Sets of 20,000 nested or neighbouring nodes: pairs of them would take minutes."""
    import time

    n = 20_000
    c = corpus(spark, "<d>" * n + "</d>" * n, "<r>" + "<d/>" * n + "</r>").persist()
    c.nodes.count()
    began = time.time()
    want = {
        "count(//d/ancestor::*)": (n - 1, 1),
        "count(//d/ancestor-or-self::d)": (n, n),
        "count(//d//d)": (n - 1, 0),
        "count(//d/descendant-or-self::*)": (n, n),
        "count(//d/following::d)": (0, n - 1),
        "count(//d/preceding::d)": (0, n - 1),
        "count(//d/following-sibling::d)": (0, n - 1),
        "count(//d/preceding-sibling::d)": (0, n - 1),
    }
    for text, (nested, flat) in want.items():
        assert values(c, text) == {0: nested, 1: flat}, text
    assert time.time() - began < 60


def test_short_documents_are_shredded_like_long_ones(monkeypatch):
    import pyarrow as pa

    from xqengine.operators import shred as S

    parts = ["<a>", "</a>", "<b x='1' y=\"&lt;é\">", "<c xmlns='u' xmlns:p='v' p:z=''>", "<d/>", "t", "é&amp;x", "<!--n-->", "<!--", "<![CDATA[x<y]]>", "<![CDATA[", "<!D x>", "<?xml v?>", "<?p q?>", "<", "<>", "</>", '"', "日"]
    docs = ["".join(parts[(i * 7 + j * j * (i % 11 + 1)) % len(parts)] for j in range(i % 13)).encode() for i in range(2000)]

    def made(names):
        rows = S._Rows(names)
        for raw in docs:
            rows.document(raw, False)
        return rows.batch(pa.array(range(len(docs))))

    for names in (None, frozenset({"a", "c"})):
        fast = made(names)
        with monkeypatch.context() as m:
            m.setattr(S, "_SHORT", -1)
            assert fast.equals(made(names))


def test_a_corpus_for_one_expression_needs_no_join(spark):
    docs = spark.createDataFrame([(1, "<a><b k='1'>x</b><b>y</b></a>"), (2, None), (3, "<b k='2'/>"), (4, "<a><b k='3'")], "doc_id int, content string")
    compiled = api.compile_xpath("//b[@k]/@k")
    lazy = compiled.string_values(shred(docs, for_xpath=compiled.text))
    assert "Join" not in lazy._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, lazy.collect())) == sorted(map(tuple, compiled.string_values(shred(docs).persist()).collect()))


def test_sql_functions_share_a_documents_tree(spark, monkeypatch):
    import sys

    from xqengine.plans import interpret

    made = {}
    monkeypatch.delitem(sys.modules, "_xqengine_recent", raising=False)
    monkeypatch.setattr(interpret.types, "SimpleNamespace", lambda **x: made.setdefault("kept", type("Kept", (), x)()))
    kept = []

    class Registry:
        def register(self, name, how):
            kept.append(how.func)

    interpret.register_functions(type("Session", (), {"udf": Registry(), "udtf": Registry.__new__(type("R", (), {"register": lambda *a: None}))})())
    got = [f("<a k='1'>2</a>", "//a") for f in kept]
    monkeypatch.delitem(sys.modules, "_xqengine_recent", raising=False)
    assert got == ["2", 2.0, True, ["2"]] and len(made["kept"].trees) == 1 and list(made["kept"].parsed) == ["//a"]
