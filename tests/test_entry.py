import glob
import os

import __spark_entry__ as entry
import duckdb
import pytest


FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test data")
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_only_missing_files_are_forgiven(monkeypatch, tmp_path):
    (tmp_path / "needs_more.py").write_text("import there_is_no_such_module")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert entry._present("no_such_package.part") is None
    with pytest.raises(ModuleNotFoundError):
        entry._present("needs_more")


def rows(df, names):
    return sorted(tuple("nan" if x != x else repr(x) for x in r) for r in df[names].astype(object).where(df[names].notna(), None).values.tolist())


@pytest.mark.parametrize("name", [n for n in entry.ORACLE_SQL])
def test_queries_match_sql(spark, con, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns) and rows(got, names) == rows(want, names)


def test_titles_keep_references_that_their_sql_keeps(spark, con, tmp_path):
    pages = [(1, "<html><title>a &quot;b&quot; &amp;lt; c</title></html>"), (2, "<html><title></title></html>"), (3, "<p>no title</p>")]
    spark.createDataFrame([(i, f"u{i}", x) for i, x in pages], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = entry.queries()["pages_titles"](spark, str(tmp_path)).toPandas()
    want = con.execute(f"WITH pages AS (SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')) " + entry.oracle_sql()["pages_titles"]).df()
    assert len(got) == 2 and rows(got, ["doc_id", "value"]) == rows(want, ["doc_id", "value"])


@pytest.mark.parametrize("name", ["test_node", "eval_with_context", "extract_canonical", "test_any_and_text", "odd_markup_elements"])
def test_nodes_are_not_broadcast(spark, name):
    """Their sizes are taken for those of the table they come from, whatever its size."""
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
