import pyarrow as pa
from pyspark.sql import functions as F

from xqengine import api
from xqengine.operators import shred as kernel
from xqengine.operators import skipping
from xqengine.operators.shred import shred
from xqengine.sources.documents import read_files, read_records
from xqengine.sources.store import load, load_or_shred, read_stats, save, stale
from xqengine.streaming.stream import stream_query


def test_store_shreds_only_what_changed(spark, tmp_path):
    path = str(tmp_path / "store")
    docs = lambda *xs: spark.createDataFrame(list(xs), "doc_id int, content string")
    first = docs((1, "<a>1</a>"), (2, "<b/>"))
    assert api.count_matches(load_or_shred(spark, path, first), "//a").orderBy("doc_id").collect()[0]["n"] == 1
    second = docs((1, "<a>1</a>"), (2, "<b><a/><a/></b>"))
    assert [r["doc_id"] for r in stale(spark, path, second).collect()] == [2]
    got = api.count_matches(load_or_shred(spark, path, second), "//a").orderBy("doc_id").collect()
    assert [r["n"] for r in got] == [1, 2]
    assert stale(spark, path, second).count() == 0
    assert {tuple(r["tag_names"]) for r in read_stats(spark, path).collect()} == {("a",), ("b",), ("a", "b")}


def test_store_is_written_in_one_pass(spark, tmp_path):
    """Each document is read and shredded once, whatever is kept of it; a corpus that is kept in
    the session gives the same store."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    contents = ["<a x='1'>t<b>u</b><?p q?><!--c--></a>", "", None, "<open", "<b><a/><a><c>é</c></a></b>", "text"]
    docs = spark.createDataFrame(list(enumerate(contents * 3)), "doc_id int, content string")
    save(shred(docs.mapInArrow(counted, docs.schema)), str(tmp_path / "one"))
    assert seen.value == len(contents) * 3
    save(shred(docs).persist(), str(tmp_path / "two"))
    rows = lambda df: sorted(map(repr, df.collect()))
    one, two, direct = load(spark, str(tmp_path / "one"), docs), load(spark, str(tmp_path / "two"), docs), shred(docs)
    for part in ("nodes", "texts", "errors"):
        assert rows(getattr(one, part)) == rows(getattr(two, part)) == rows(getattr(direct, part))
    stats = rows(read_stats(spark, str(tmp_path / "one")))
    assert len(stats) == len(contents) * 3 and stats == rows(read_stats(spark, str(tmp_path / "two")))
    of = read_stats(spark, str(tmp_path / "one")).drop("content_hash").where("tag_names IS NOT NULL")
    assert rows(of) == rows(skipping.doc_stats(direct).select(of.columns))


def test_plain_documents_are_shredded_together(spark):
    """Short documents without references, comments and the like take no loop over their
    tokens, and give the same rows as one by one."""
    plain = ["<?xml version='1.0'?><o k='1' s=\"F\"><c>7</c><l n='1'/>t</o>tail", "t<a><a></a><a>x</a></a><b/>", "<a xmlns='u' b=''></a>", "<o k='1' s='F'><c>7</c><l n='1'></l></o>"]
    odd = ["", "text", "<a>&amp;</a>", "<a>\u00e9</a>", "<a><!--c--></a>", "<a><?p q?></a>", "<a>", "</a><a>", "<a", "<a></a></a><b>", "<?xmls x?><a/>"]
    contents = [x.encode() for pair in zip(plain * 3, odd) for x in pair]
    ids = pa.array(range(len(contents)))

    def rows(parts):
        parts = list(parts)
        assert all(sum(counts) == b.num_rows and len(counts) == len(xs) for b, counts, xs in parts)
        return sorted(repr(r) for part in parts for r in kernel._described(*part).to_pylist())

    for names in (None, frozenset("a"), frozenset()):
        one = kernel._Rows(names)
        for raw in contents:
            one.document(raw, False)
        assert rows(kernel._shredded(ids, contents, names, {}, False)) == rows([(one.batch(ids), one.counts, contents)])
    _, _, places, others = kernel._plain(ids, contents, kernel._Rows(None))
    assert {contents[i].decode() for i in places} == set(plain) and {contents[i].decode() for i in others} == set(odd)


def test_files_and_records(spark, tmp_path):
    (tmp_path / "x.xml").write_text("<r><row k='1'>a</row> <row>b</row><rows/></r>")
    docs = read_files(spark, str(tmp_path))
    assert api.count_matches(shred(docs), "//row").first()["n"] == 2
    rows = read_records(spark, str(tmp_path / "x.xml"), "row")
    assert sorted(r["content"] for r in rows.collect()) == ["<row k='1'>a</row>", "<row>b</row>"]


def test_skipping_never_changes_results(spark):
    docs = spark.createDataFrame([(1, "<a><b>x</b></a>"), (2, "<c/>"), (3, "<b/>")], "doc_id int, content string")
    c = shred(docs).persist()
    for text in ("//a/b", "//c | //b", "//zz"):
        need = api.compile_xpath(text).selectivity()
        all_of = {tuple(r) for r in api.compile_xpath(text).select(c).select("doc_id", "node_id").collect()}
        some = api.compile_xpath(text).select(skipping.possible(c, need)).select("doc_id", "node_id").collect()
        assert {tuple(r) for r in some} == all_of
        early = shred(skipping.prescan(docs, need.required))
        assert {tuple(r) for r in api.compile_xpath(text).select(early).select("doc_id", "node_id").collect()} == all_of
    assert skipping.doc_stats(c).where(skipping.may_contain("a") & (F.col("doc_id") == 1)).count() == 1


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "<a>x</a>"), (2, "<a><a>y</a></a>")], "doc_id int, content string").write.parquet(str(tmp_path / "in"))
    rows = []
    source = spark.readStream.schema("doc_id int, content string").parquet(str(tmp_path / "in"))
    q = stream_query(source, "//a", lambda df, n: rows.extend(r["value"] for r in df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(rows) == ["x", "y", "y"]


def test_filter_as_bytes(spark):
    c = shred(spark.createDataFrame([(i, "".join(f"<t{j}/>" for j in range(i))) for i in [*range(9), 200]], "doc_id int, content string")).persist()
    stats = skipping.doc_stats(c)
    packed = stats.select("doc_id", "tag_names", skipping.filter_to_bytes().alias("f"), F.col("bloom_lo").alias("lo"), F.col("bloom_hi").alias("hi"))
    back = skipping.filter_from_bytes(packed, "f").collect()
    assert all((r["bloom_lo"], r["bloom_hi"]) == (r["lo"], r["hi"]) and len(r["f"]) == 16 for r in back)
    assert any(r["lo"] < 0 or r["hi"] < 0 for r in back)
    some = {r["doc_id"] for r in stats.where(skipping.may_contain_any(("t3", "t5"))).collect()}
    assert some >= {4, 5, 6, 7, 8, 200} and stats.where(skipping.may_contain_any(())).count() == 0
    odd = skipping.filter_from_bytes(spark.createDataFrame([(bytearray(b"abc"),)], "f binary"), "f").first()
    assert odd["bloom_lo"] is None and odd["bloom_hi"] is None
