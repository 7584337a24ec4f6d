"""Mixing, sharding and the pipeline."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from xqengine.llm import mixing, sharding

LEVELS = ("domain", "lang", "source")


def test_budgets_fill_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "en", "x", 100, 1), ("a", "en", "y", 1000, 1), ("a", "de", "x", 10, 1), ("b", None, "x", 5000, 1), ("b", None, None, 5000, 1)], "domain string, lang string, source string, tokens long, n_docs long")
    got = {tuple(r)[:3]: r["granted"] for r in mixing.budgets(leaves, LEVELS, ({"a": 1, "b": 1}, {}, {"y": 1}), 1, 2000).collect()}
    # a gets 1000: de can hold 10 of its 500, en takes the other 990; x holds 100, y 890.
    assert got == {("a", "en", "x"): 100, ("a", "en", "y"): 890, ("a", "de", "x"): 10, ("b", None, "x"): 500, ("b", None, None): 500}


def test_budgets_pass_on_what_no_sibling_holds(spark):
    leaves = spark.createDataFrame([("a", "en", "x", 100, 1), ("b", "en", "x", 5000, 1)], "domain string, lang string, source string, tokens long, n_docs long")
    got = {r["domain"]: r["granted"] for r in mixing.budgets(leaves, LEVELS, ({"a": 9}, {}, {}), 2, 2000).collect()}
    assert got == {"a": 200, "b": 1800}


@pytest.mark.parametrize("rows", [2000, 3])
def test_mix(docs, no_docs, rows, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", rows)
    got = mixing.mix(mixing.with_domain(docs.drop("n_tokens", "epoch")), levels=LEVELS, weights=mixing.WEIGHTS, budget=3000)
    taken = got.collect()
    assert {"doc_id", "text", "fp", "domain", "n_tokens", "epoch"} <= set(got.columns)
    by_leaf, whole = defaultdict(int), defaultdict(int)
    for r in taken:
        by_leaf[(r["domain"], r["lang"], r["source"])] += r["n_tokens"]
        assert r["n_tokens"] == len((r["text"] or "").encode().split())
    for r in mixing.with_domain(docs).collect():
        whole[(r["domain"], r["lang"], r["source"])] += len((r["text"] or "").encode().split())
    leaves = docs.sparkSession.createDataFrame([(*k, n, 1) for k, n in whole.items() if n], "domain string, lang string, source string, tokens long, n_docs long")
    for r in mixing.budgets(leaves, LEVELS, mixing.WEIGHTS, 2, 3000).collect():
        assert by_leaf[(r["domain"], r["lang"], r["source"])] <= r["granted"]
    assert max(r["epoch"] for r in taken) <= 2
    again = mixing.mix(mixing.with_domain(docs.drop("n_tokens", "epoch").repartition(3)), levels=LEVELS, weights=mixing.WEIGHTS, budget=3000)
    key = lambda rs: Counter((r["doc_id"], r["epoch"]) for r in rs)
    assert key(again.collect()) == key(taken)
    assert mixing.mix(mixing.with_domain(no_docs), levels=LEVELS, weights=mixing.WEIGHTS).count() == 0


def _slow_mix(rows, granted, seed):
    """(row index, epoch) pairs: leaf by leaf, equal ids together, in the order of their hash."""
    taken, leaves = Counter(), defaultdict(list)
    for i, r in enumerate(rows):
        if n := len((r["text"] or "").encode().split()):
            leaves[(r["domain"], r["lang"], r["source"])].append((i, "" if r["doc_id"] is None else str(r["doc_id"]), n))
    for leaf, own in leaves.items():
        tokens = sum(n for *_, n in own)
        whole, rest = divmod(granted[leaf], tokens)
        by_id = defaultdict(int)
        for _, d, n in own:
            by_id[d] += n
        inside, upto = set(), 0
        for d in sorted(by_id, key=lambda d: hashlib.md5(f"{seed}:{whole + 1}:{d}".encode()).hexdigest()):
            upto += by_id[d]
            if upto > rest:
                break
            inside.add(d)
        for i, d, _ in own:
            for epoch in range(1, whole + 1 + (d in inside)):
                taken[(i, epoch)] += 1
    return taken


@pytest.mark.parametrize("bucket", [2000, 2])
@pytest.mark.parametrize("budget", [900, 2000, 5000])
def test_mix_against_a_slow_one(spark, bucket, budget, monkeypatch):
    """Ids in two leaves, repeated and null ids and '', null levels, texts without words, and
    columns named like the results and like inner ones."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    rnd = random.Random(3)
    rows = []
    for i in range(60):
        d = rnd.choice([str(i), "7", "7", "", None])
        text = rnd.choice([None, "", " ".join("w" * rnd.randrange(1, 30))])
        rows.append((i, d, text, rnd.choice(["a", "b"]), rnd.choice(["en", "de", None]), rnd.choice(["x", "y"]), -1, "old", 5, 6))
    df = spark.createDataFrame(rows, "row int, doc_id string, text string, domain string, lang string, source string, n_tokens int, epoch string, __n int, tokens int")
    weights = ({"a": 3, "b": 1}, {"en": 2}, {})
    got = mixing.mix(df, levels=LEVELS, weights=weights, budget=budget).collect()
    whole = defaultdict(lambda: [0, 0])
    for r in df.collect():
        if n := len((r["text"] or "").split()):
            whole[(r["domain"], r["lang"], r["source"])][0] += n
            whole[(r["domain"], r["lang"], r["source"])][1] += 1
    leaves = spark.createDataFrame([(*k, *v) for k, v in whole.items()], "domain string, lang string, source string, tokens long, n_docs long")
    granted = {tuple(r)[:3]: r["granted"] for r in mixing.budgets(leaves, LEVELS, weights, 2, budget).collect()}
    assert Counter((r["row"], r["epoch"]) for r in got) == _slow_mix(df.collect(), granted, mixing.SEED)
    by_leaf = defaultdict(int)
    for r in got:
        by_leaf[(r["domain"], r["lang"], r["source"])] += r["n_tokens"]
        assert (r["__n"], r["tokens"]) == (5, 6) and r["n_tokens"] == len(r["text"].split())
    assert all(by_leaf[k] <= granted[k] for k in by_leaf)
    named = mixing.mix(df, levels=LEVELS, weights=weights, budget=budget, tokens_out="t", epoch_out="e")
    assert {r["epoch"] for r in named.collect()} == {"old"} and {"t", "e", "n_tokens"} <= set(named.columns)


def test_table_is_balanced_and_stable():
    shards = [f"s{i}" for i in range(16)]
    full = sharding.fill(shards, 2039)
    assert max(Counter(full).values()) - min(Counter(full).values()) <= 1
    fewer = sharding.fill(shards[:-1], 2039)
    moved = sum(a != b for a, b in zip(full, fewer, strict=True) if a != 15)
    assert moved < 0.2 * 2039
    with pytest.raises(ValueError):
        sharding.fill(shards, 2040)


def test_table_against_a_plain_one():
    """Turn by turn, each shard's whole preference list written out."""
    for count, slots in ((1, 2), (3, 7), (5, 101), (64, 8191)):
        names = [f"shard-{i:04d}" for i in range(count)]
        wish = []
        for x in names:
            h = hashlib.md5(x.encode()).hexdigest()
            at, step = int(h[:16], 16) % slots, int(h[16:], 16) % (slots - 1) + 1 if slots > 2 else 1
            wish.append(iter([(at + k * step) % slots for k in range(slots)]))
        owner: dict[int, int] = {}
        while len(owner) < slots:
            for i, w in enumerate(wish):
                if len(owner) < slots:
                    owner[next(x for x in w if x not in owner)] = i
        assert sharding.fill(names, slots) == [owner[k] for k in range(slots)]


def test_shard(spark, docs, no_docs, tmp_path):
    got = sharding.shard(docs)
    assert got.count() == docs.count() and got.where("shard IS NULL").count() == 0
    assert got.groupBy("doc_id").agg(F.count_distinct("shard").alias("n")).where("n > 1").count() == 0
    sharding.write_shards(got.select("doc_id", "text", "shard"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()
    assert sharding.shard(no_docs).count() == 0


PASSAGE = " ".join(f"bench{i}" for i in range(14))


@pytest.fixture
def corpus_folder(spark, tmp_path):
    """Documents with repeated and null ids, null and empty texts, near copies, toxic and
    contaminated ones, and columns whose names the stages use inside."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join(word() for _ in range(60)), "en", "src0") for i in range(40)]
    base = rows[5][1]
    rows += [(5, base, "en", "src0"), (50, base + " more", "de", "src1"), (None, base, "en", None), (None, "unlike " + rows[7][1][50:], "fr", "src2"), (6, base + " end", "en", "src0")]
    rows += [(60, f"{rows[8][1]} {PASSAGE}", "en", "src0"), (None, f"{PASSAGE} {rows[9][1]}", "en", "src0"), (61, None, "en", "src0"), (62, "", "en", "src0")]
    rows += [(100 + i, f"vile awful horrid {word()} vile awful", "en", "src0") for i in range(40)]
    schema = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "CAST(coalesce(length(text), 0) AS BIGINT) AS n_chars", "'d' AS domain", "7 AS epoch", "8 AS n_tokens", "9 AS score", "'s' AS shard", "1 AS slot", "2 AS component_id", "3 AS id", "4 AS __score")
    folder = str(tmp_path)
    df.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(40)] + [(100 + i, 0, 1) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline_stages(spark, corpus_folder):
    """Each stage against what a plain reading of its input gives."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{corpus_folder}/documents.parquet")
    key = lambda rs: Counter((r["doc_id"], r["text"]) for r in rs)
    kept = P.toxicity_stage(spark, docs, corpus_folder)
    assert kept.columns == docs.columns
    assert not any((r["text"] or "").startswith("vile") for r in kept.collect()) and kept.count() == docs.count() - 40

    clean = P.near_duplicates_stage(spark, kept, corpus_folder)
    assert clean.columns == docs.columns
    sets = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(max(1, len(w) - 4)) if w}
    groups: list[list] = []
    for r in kept.collect():
        near = [g for g in groups if any(sets(x["text"]) and 100 * len(sets(x["text"]) & sets(r["text"])) >= 75 * len(sets(x["text"]) | sets(r["text"])) for x in g)]
        groups = [g for g in groups if g not in near] + [[r, *(x for g in near for x in g)]]
    want = Counter()
    for g in groups:
        least = min((x["doc_id"] for x in g if x["doc_id"] is not None), default=None)
        assert sum(key(clean.collect())[(x["doc_id"], x["text"])] for x in {(y["doc_id"], y["text"]): y for y in g}.values()) == 1
        want[least] += 1
    assert Counter(r["doc_id"] for r in clean.collect()) == want

    apart = P.decontamination_stage(spark, clean, corpus_folder)
    assert apart.columns == docs.columns
    assert key(apart.collect()) == key(r for r in clean.collect() if PASSAGE not in (r["text"] or ""))

    mixed = P.mixing_stage(spark, apart, corpus_folder)
    assert mixed.columns == docs.columns and set(key(mixed.collect())) <= set(key(apart.collect()))
    assert {(r["domain"], r["epoch"], r["n_tokens"], r["__score"]) for r in mixed.collect()} == {("d", 7, 8, 4)}
    other = mixing.mix(mixing.with_domain(apart), levels=LEVELS, weights=mixing.WEIGHTS)
    assert key(mixed.collect()) == key(other.collect())

    placed = P.sharding_stage(spark, mixed, corpus_folder)
    assert key(placed.collect()) == key(mixed.collect()) and placed.where("shard NOT LIKE 'shard-%'").count() == 0


def test_pipeline(spark, corpus_folder):
    import corpus_pipeline as P

    got = P.run(spark, corpus_folder)
    assert {r["doc_id"] for r in got.collect()} >= set(range(1, 6)) - {5} and set(got.columns) == set(spark.read.parquet(f"{corpus_folder}/documents.parquet").columns)
    assert not any(PASSAGE in r["text"] or "vile" in r["text"] for r in got.collect())


def test_pipeline_of_an_empty_table(spark, no_docs, tmp_path):
    import corpus_pipeline as P

    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
