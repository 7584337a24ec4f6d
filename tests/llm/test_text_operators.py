"""Operators against brute force on awkward rows."""

import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from xqengine.llm import decontamination, jaccard, lm_scoring, quality, substring_dedup, token_counts, token_file, toxicity

SPACE = re.compile("[^\x20\x09-\x0d]+")


def low(t):
    return (t or "").encode().lower().decode()


def bag(found):
    return Counter(map(tuple, found))


def test_token_counts(spark, docs, rows, no_docs, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    want = Counter((r[0], len((r[1] or "").encode()), n := len(tok.encode(r[1] or "", add_special_tokens=False).ids), n > 512) for r in rows)
    cache = str(tmp_path / "cache")
    assert bag(token_counts.token_counts(docs, path, cache).collect()) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == len({r[1] or "" for r in rows})
    assert bag(token_counts.token_counts(docs, path, cache).collect()) == want
    assert spark.read.parquet(cache).count() == stored.count()  # nothing was encoded again
    assert token_counts.token_counts(no_docs, path, str(tmp_path / "none")).count() == 0


def test_token_counts_of_a_filled_cache(spark, tmp_path, monkeypatch):
    """Few new texts among many stored ones: only they are encoded, and no text moves."""
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    tok = Tokenizer.from_file(path)
    old = spark.createDataFrame([(i, f"text number {i}") for i in range(60)], "doc_id long, text string")
    token_counts.token_counts(old, path, cache).count()
    new = [(100, "never seen"), (101, "never seen"), (None, "nor this"), (7, "an id again")]
    both = old.unionByName(spark.createDataFrame(new, old.schema))
    plans, count = [], token_counts.count_misses

    def noting(misses, tokenizer):
        plans.append(misses.select("text")._jdf.queryExecution().executedPlan().toString())
        assert sorted(r["text"] for r in misses.collect()) == ["an id again", "never seen", "nor this"]
        return count(misses, tokenizer)

    monkeypatch.setattr(token_counts, "count_misses", noting)
    got = bag((r["doc_id"], r["n_tokens"]) for r in token_counts.token_counts(both, path, cache).collect())
    assert got == bag((i, len(tok.encode(t, add_special_tokens=False).ids)) for i, t in both.collect())
    assert "BroadcastHashJoin" in plans[0] and "hashpartitioning" not in plans[0]
    assert spark.read.parquet(cache).count() == 63


def test_token_files(spark, docs, rows, no_docs, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    out = str(tmp_path / "files")
    token_file.write_token_files(docs, path, out)
    got = sorted(token_file.read_token_files(spark, out, with_ids=True).collect(), key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    assert bag((r["doc_id"], tuple(r["ids"])) for r in got) == bag((r[0], (*tok.encode(r[1] or "", add_special_tokens=False).ids, 2)) for r in rows)
    token_file.write_token_files(no_docs, path, str(tmp_path / "none"))
    assert token_file.read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_rans_blocks():
    rnd = np.random.default_rng(1)
    ids = (rnd.zipf(1.3, 100_000) % 5000).astype(np.int64)
    t = token_file.Table.of(np.bincount(ids))
    assert t.freq.sum() == 1 << t.bits
    data = token_file.pack_block(ids, np.array([len(ids)]), t)
    assert (token_file.unpack_block(data, t)[0] == ids).all()
    body = data[token_file._HEAD.size + 4 : -4]
    step = token_file.LANES * token_file.CHECKPOINT_STEPS
    assert (token_file.decode_symbols(body, len(ids), t, part=1) == ids[step : 2 * step]).all()
    with pytest.raises(ValueError):
        token_file.unpack_block(data[:100] + bytes([data[100] ^ 1]) + data[101:], t)
    one = np.zeros(3, np.int64)
    t = token_file.Table.of(np.bincount(one))
    assert (token_file.unpack_block(token_file.pack_block(one, np.array([3]), t), t)[0] == one).all()


def brute_counts(t):
    t = t or ""
    ws = SPACE.findall(t)
    wins = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    hit = {j for i in range(len(ws) - 2) if wins[tuple(ws[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if SPACE.search(x)]
    return len(ws), sum(map(len, ws)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality(docs, rows, no_docs):
    got = quality.quality(docs, min_rows=10).collect()
    want = Counter((r[0], *brute_counts(r[1])) for r in rows)
    assert bag(r[:6] for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert {1, 2, 3, 10, 11, 13, 20} <= kept and not kept & {4, 5, 6, 8, 12}
    assert quality.quality(no_docs).count() == 0


def test_toxicity(spark, no_docs):
    import random

    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    made = []
    for i in range(600):
        bad = i % 5 == 0
        w = [rnd.choice(words) for _ in range(60)] + [f"zloth{rnd.choice(words)}"] * bad
        rnd.shuffle(w)
        made.append((i, " ".join(w), int(bad)))
    made += [(600, None, 0), (601, "", None), (None, "zloth", 1), (602, "x " * 50_000, 0)]
    df = spark.createDataFrame(made, "doc_id long, text string, toxic int")
    got = toxicity.toxicity(df.withColumn("score", F.lit("clash")).withColumn("label", F.lit(1)), df.select("doc_id", "toxic"))
    out = {r["doc_id"]: r for r in got.collect()}
    assert len(out) == len(made)
    truth = {i: y for i, _, y in made if y is not None and i is not None and i < 600}
    held = [i for i in truth if out[i]["held_out"]]
    assert len(held) > 50 and sum(out[i]["predicted"] == truth[i] for i in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items() if i is not None)
    none = toxicity.toxicity(df.drop("toxic"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["predicted"] for r in none.collect()} == {0}
    assert toxicity.toxicity(no_docs, df.select("doc_id", "toxic")).count() == 0


def brute_classes(rows):
    sets = []
    for i, t, *_ in rows:
        w = SPACE.findall(low(t))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    ids = {}
    for k, r in enumerate(rows):
        ids.setdefault(find(k), []).append(r[0])
    least = {c: min([i for i in x if i is not None], default=None) for c, x in ids.items()}
    return Counter((r[0], len(sets[k]), least[find(k)] if sets[k] else r[0]) for k, r in enumerate(rows))


@pytest.mark.parametrize("tile", [1000, 4])
def test_jaccard(docs, rows, no_docs, tile, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "PIVOTS", 1 if tile == 4 else 8)
    assert bag(jaccard.jaccard_classes(docs).collect()) == brute_classes(rows)
    if tile == 1000:
        assert jaccard.jaccard_classes(no_docs).count() == 0


@pytest.mark.parametrize("tile, signed", [(1000, 8000), (5, 7)])
def test_jaccard_of_shared_parts(spark, tile, signed, monkeypatch):
    """Texts put together from the same sentences: candidate groups hold sets that share much
    and link in chains or not at all."""
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "SIGNED_TILE", signed)
    monkeypatch.setattr(jaccard, "PIVOTS", 1 if tile == 5 else 8)
    rnd = np.random.default_rng(21)
    parts = [" ".join(f"s{i}w{j}" for j in range(12)) for i in range(14)]
    rows = [(i, " ".join(parts[k] for k in rnd.permutation(14)[: rnd.integers(2, 9)])) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert bag(jaccard.jaccard_classes(df).collect()) == brute_classes(rows)


def test_jaccard_group_of_unlike_sets(spark, monkeypatch):
    """50,000 sets that share a shingle and don't link, but for two in different tiles: only
    these two are compared by their shingles after the first round."""
    n = 50_000
    rnd = np.random.default_rng(22)
    tokens = rnd.integers(1, 1 << 63, (n, 8), np.uint64)
    tokens[:, 0] = 7
    tokens[1] = tokens[0]
    tokens[1, 7] += np.uint64(1)
    tokens.sort(1)
    rows = pa.table({"fp": np.arange(n), "n": np.full(n, 8), "tokens": pa.array([t.tobytes() for t in tokens], pa.binary())})
    sets = spark.createDataFrame(rows.to_pandas()).repartition(8).cache()
    groups = sets.select(F.col("fp").alias("node"), F.lit(0).cast("long").alias("component"))
    met, tiles = [], jaccard._tiles

    def noting(rows, percent):
        met.append(rows.count())
        return tiles(rows, percent)

    monkeypatch.setattr(jaccard, "_tiles", noting)
    got = {tuple(r) for r in jaccard._classes(sets, groups, 75).collect()}
    assert got == {(0, 0), (1, 0)}
    assert met[0] < 1.01 * n + 8 * 50 and met[1] < 20 * jaccard.TILE  # by chance some signatures are alike


def test_substring_dedup(docs, rows, no_docs):
    found = substring_dedup.repeated_spans(docs).collect()
    text = {r[0]: r[1] for r in rows}
    spans = {(r["doc_id"], r["kept_doc_id"]): text[r["doc_id"]][r["start"] : r["end"]] for r in found}
    passage = rows[10][1].split("\n")[1]
    assert spans[(11, 10)] == passage and spans[(2, 1)] == text[1]
    assert not {1, 7, 8, 10} & {r["doc_id"] for r in found}
    small = docs.where("doc_id < 13").select("doc_id", "text")
    cut = {r["doc_id"]: r for r in substring_dedup.remove_spans(small, substring_dedup.repeated_spans(small)).collect()}
    assert passage not in cut[11]["text"] and cut[10]["text"] == text[10] and cut[2]["text"] == ""
    assert cut[4]["text"] is None and cut[11]["removed"][0]["start"] == text[11].index(passage)
    assert substring_dedup.repeated_spans(no_docs).count() == 0


def test_substring_dedup_removes_short_repeats(spark):
    rows = [(1, "First of all. Licensed under CC BY-NC 4.0."), (2, "Other words. Licensed under CC BY-NC 4.0."), (3, "licensed under CC  BY-NC 4.0.\nStop.\nNew here."), (4, "Stop.")]
    found = substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = dict(rows)
    assert {(r["doc_id"], text[r["doc_id"]][r["start"] : r["end"]], r["n_words"], r["kept_doc_id"]) for r in found} == {(2, "Licensed under CC BY-NC 4.0.", 5, 1), (3, "licensed under CC  BY-NC 4.0.", 5, 1), (4, "Stop.", 1, 3)}


def test_substring_dedup_rows_with_one_id_or_none(spark):
    a, b, own = "This passage is shared by rows.", "And so is this one.", "Only here {}."
    rows = [(None, f"{a} {own.format(1)}"), (None, f"{a} {own.format(2)}"), (5, f"{b} {own.format(3)}"), (5, f"{b} {own.format(4)}"), (7, a), (7, a), (None, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = substring_dedup.remove_spans(df, substring_dedup.repeated_spans(df)).collect()
    assert len(out) == len(rows)
    left = [r["text"] for r in out]
    assert sum(a in t for t in left) == 1 and sum(b in t for t in left) == 1
    assert all(sum(own.format(k) in t for t in left) == 1 for k in (1, 2, 3, 4))
    assert {r["kept_doc_id"] for r in substring_dedup.repeated_spans(df).collect()} == {5, 7}
    nulls = spark.createDataFrame([(None, a), (None, a)], "doc_id long, text string")
    assert [r["kept_doc_id"] for r in substring_dedup.repeated_spans(nulls).collect()] == [None]


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_leaks(rows, items):
    docs = {}
    for i, t, *_ in rows:
        docs.setdefault(i, []).append(WORD.findall(low(t)))
    out = Counter()
    for i, all_ws in docs.items():
        hit, own = set(), set()
        for ws in all_ws:
            for item, t in items:
                w = WORD.findall(low(t))
                for a in range(max(1, len(w) - 9)) if w else ():
                    win = w[a : a + 10]
                    for p in range(len(ws) - len(win) + 1):
                        if ws[p : p + len(win)] == win:
                            hit |= set(range(p, p + len(win)))
                            own.add(str(item))
        import hashlib

        out[(i, max(map(len, all_ws)), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit))] += 1
    return out


@pytest.mark.parametrize("limit", [200_000, 0])
def test_decontamination(spark, docs, rows, no_docs, limit):
    long = rows[6][1].split()
    items = [(1, " ".join(long[100:125])), (2, rows[0][1]), (3, "one TWO"), (4, None), (5, " .,!"), (6, "never there at all in any of these texts we made"), (7, rows[10][1].split("\n")[1]), (10, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert bag(decontamination.decontaminate(docs, bench, broadcast_rows=limit).collect()) == brute_leaks(rows, items)
    if limit:
        none = decontamination.decontaminate(docs, bench.limit(0)).collect()
        assert {r["contaminated"] for r in none} == {False}
        assert decontamination.decontaminate(no_docs, bench).count() == 0


def test_lm_scores(docs, rows, no_docs):
    got = lm_scoring.lm_scores(docs, dictionary=200).collect()
    split = lambda t: (t or "").encode().lower().split()
    c = Counter()
    for i, t, *_ in rows:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2:
            c.update(split(t))
            c[None] += 1
    n, v = sum(c.values()), len(c)
    want = Counter((i, len(split(t)) + 1, sum(c[w] > 0 for w in [*split(t), None]), n) for i, t, *_ in rows)
    assert bag((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got) == want
    base = {i: sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*split(t), None]) for i, t, *_ in rows}
    for r in got:
        assert math.isclose(r["base_score"], base[r["doc_id"]], rel_tol=1e-9) and r["score"] < 0
    assert lm_scoring.lm_scores(no_docs).count() == 0


def test_toxicity_features_are_character_ngrams(monkeypatch):
    """Against a plain reading, for letters of all widths, bad bytes and short segments."""
    rnd = np.random.default_rng(3)
    letters = list("abcXYZ 012\t\n\u00e9\u00c9\u0416\u0436\u4e2d\u6587\U0001f600\u0130")
    texts = ["".join(rnd.choice(letters, rnd.integers(0, 60))) for _ in range(40)] + ["", "abc", "\u4e2d\u6587\u4e2d\u6587"]
    fold = lambda c: " " if c.isspace() else c.lower() if len(c.lower()) == 1 else c
    bits, mask = toxicity.HASH_BITS, (1 << 64) - 1
    want = set()
    for r, t in enumerate(texts):
        cs = [ord(fold(c)) if ord(c) < 65536 else ord(c) for c in t]
        for n in toxicity.ORDERS:
            for i in range(len(cs) - n + 1):
                g = cs[i]
                for c in cs[i + 1 : i + n]:
                    g = (g * int(toxicity._MIX) + c) & mask
                want.add((r, ((g + n) * int(toxicity._MULT) & mask) >> (64 - bits)))
    raw = [t.encode() for t in texts]
    b, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    for segment in (1 << 17, 7):
        monkeypatch.setattr(toxicity, "SEGMENT", segment)
        rows, feats = toxicity.hits(b, off, np.ones(1 << bits, bool))
        assert set(zip(rows.tolist(), feats.tolist(), strict=True)) == want and len(rows) == len(want)
    odd = np.frombuffer(b"ab\xff\xfecd" + "\u00e9\u00e9".encode()[:-1], np.uint8)
    chars, borders = toxicity.code_points(odd, np.array([0, 6, len(odd)]))
    assert borders.tolist() == [0, 6, 8] and chars[2] == 0xFFFD


def test_toxicity_weights_against_newton():
    """The fitted weights are those of the regularised likelihood's minimum."""
    rnd = np.random.default_rng(4)
    n, k, ridge = 400, 12, 1e-2
    x = rnd.random((n, k)) < 0.4
    scale = rnd.normal(0, 1.5, k)
    y = (rnd.random(n) < 1 / (1 + np.exp(-(x * scale) @ rnd.normal(0, 2, k)))).astype(float)
    row, col = np.nonzero(x)
    w, b = toxicity.logistic(row, col, scale, y, rounds=3000, ridge=ridge)
    dense = np.hstack([x * scale, np.ones((n, 1))])
    keep = np.diag([ridge] * k + [0.0])
    theta = np.zeros(k + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-dense @ theta))
        theta -= np.linalg.solve(dense.T @ (dense * (p * (1 - p))[:, None]) / n + keep, dense.T @ (p - y) / n + keep @ theta)
    assert np.allclose([*w, b], theta, atol=0.02)


def test_toxicity_is_fitted_outside_the_driver(spark):
    """The driver gets the model alone: no counts of all features, no rows."""
    df = spark.range(3000).selectExpr("id AS doc_id", "concat('word ', sha2(string(id), 512), if(id % 3 = 0, ' hateful', ' friendly')) AS text", "int(id % 3 = 0) AS toxic")
    tracemalloc.start()
    try:
        model = toxicity.fit(df.drop("toxic"), df.select("doc_id", "toxic"))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(model.features) > 10 and most < 16 << 20


def test_toxicity_on_held_out_rows(spark):
    """A score per row from text alone: accurate on rows it never learned from."""
    rnd = np.random.default_rng(5)
    word = lambda: "".join(rnd.choice(list("abcdefgh"), 5))
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, " ".join([word() for _ in range(30)] + (["hateful", "\u0432\u0440\u0430\u0433\u0438"] if bad else ["friendly"])), "en", "s"))
        labels.append((i, int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in toxicity.toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [i for i, r in got.items() if r["held_out"]]
    assert len(held) > 50 and all(got[i]["predicted"] == dict(labels)[i] for i in held)
    other = df.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    assert {r["doc_id"]: r["score"] for r in toxicity.toxicity(other, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()} == {i: r["score"] for i, r in got.items()}


def test_mixer_is_a_distribution():
    """The probabilities of all symbols after one context sum to one."""
    code = lm_scoring.Code.of([50, 20, 9, 3, 1, 7])
    rnd = np.random.default_rng(2)
    m = lm_scoring.Mixer(16, 1)
    p = rnd.uniform(0.05, 0.95, len(code.zeros))
    total = 0.0
    for s in range(6):
        own = slice(code.off[s], code.off[s + 1])
        q = m.predict([np.log(p / (1 - p))[code.node[own]].astype(np.float32)], np.zeros(own.stop - own.start, np.int64))
        total += np.prod(np.where(code.bit[own] == 1, q, 1 - q))
    assert math.isclose(total, 1, rel_tol=1e-5)


def test_context_counts_are_exact():
    """Every (context, node) has its own count, with and without the token's own."""
    code = lm_scoring.Code.of([50, 20, 9, 3, 1, 7])
    rnd = np.random.default_rng(4)
    one, two, sym, learn = rnd.integers(0, 9, 4000), rnd.integers(0, 1 << 40, 4000) % 3000, rnd.integers(0, 6, 4000), rnd.integers(0, 2, 4000)
    want = Counter()
    for a, b, y, k in zip(one, two, sym, learn, strict=True):
        for j in range(code.off[y], code.off[y + 1]):
            for ctx in ((a,), (a, b)):
                want[(ctx, code.node[j], code.bit[j])] += k
    shard = lm_scoring.Shard(one, two, sym, learn, code)
    logit = lambda n: math.log((n[1] + 0.4) / (n[0] + 0.4))
    for d, (at, bit, full, less) in enumerate(shard.events()):
        for k, i in enumerate(at):
            a, b, y = shard.one[i], shard.two[i], shard.sym[i]
            node = code.node[code.off[y] + d]
            assert bit[k] == code.bit[code.off[y] + d]
            for j, ctx in ((1, (a,)), (2, (a, b))):
                n = [want[(ctx, node, x)] for x in (0, 1)]
                assert math.isclose(full[j][k], logit(n), abs_tol=1e-5)
                if shard.c[i]:
                    n[bit[k]] -= 1
                    assert math.isclose(less[j][k], logit(n), abs_tol=1e-5)


def test_shard_scores_like_a_slow_mixer():
    """Token by token and bit by bit, with the same weights; equal tokens score alike, and
    words that follow their context score better than others."""
    code = lm_scoring.Code.of([50, 20, 9, 3, 1, 7])
    rnd = np.random.default_rng(5)
    n = 3000
    one, two = rnd.integers(0, 5, n), rnd.integers(0, 5, n)
    sym = np.where(rnd.random(n) < 0.9, one, rnd.integers(0, 6, n))
    learn = (rnd.random(n) < 0.8).astype(np.int64)
    shard = lm_scoring.Shard(one, two, sym, learn, code)
    got, mixers = None, []
    real = lm_scoring.Mixer

    class Noted(real):
        def __post_init__(self):
            super().__post_init__()
            mixers.append(self)

    lm_scoring.Mixer = Noted
    try:
        got = shard.scores()
    finally:
        lm_scoring.Mixer = real
    (m,) = mixers
    assert m.seen.sum() == sum(learn[i] * (code.off[y + 1] - code.off[y]) for i, y in enumerate(sym))  # all training tokens' bits
    counts = Counter()
    for a, b, y, k in zip(one, two, sym, learn, strict=True):
        for j in range(code.off[y], code.off[y + 1]):
            for ctx in ((a,), (a, b)):
                counts[(ctx, code.node[j], code.bit[j])] += k
    sure = lambda t: int(t > 0) + int(t > 2) + int(t > 15)
    for i in range(0, n, 50):
        total = 0.0
        for j in range(code.off[sym[i]], code.off[sym[i] + 1]):
            node, bit = code.node[j], code.bit[j]
            pairs = [(code.zeros[node], code.ones[node])] + [tuple(counts[(ctx, node, x)] for x in (0, 1)) for ctx in ((one[i],), (one[i], two[i]))]
            gate = sure(sum(pairs[1])) * 4 + sure(sum(pairs[2]))
            z = sum(w * math.log((b + 0.4) / (a + 0.4)) for w, (a, b) in zip(m.w[gate], pairs, strict=False)) + m.w[gate, -1]
            z = min(7.99, max(-7.99, z))
            at = (z + 8) * 2
            low = int(at)
            refined = m.apm[gate, low] + (m.apm[gate, low + 1] - m.apm[gate, low]) * (at - low)
            p = 0.5 / (1 + math.exp(-z)) + 0.5 * refined
            total += math.log10(p if bit else 1 - p)
        assert math.isclose(got[i], total, abs_tol=1e-3)
    assert got[sym == one].mean() > got[sym != one].mean() + 0.5


def test_shards_of_frequent_words():
    """A token's shard is the same for equal contexts; only frequent words and pairs have
    several."""
    before = np.array([10, 400_000, 9_000_000, 8_000_000, 5, 0])
    n = 20_000
    rnd = np.random.default_rng(6)
    uid = rnd.integers(0, 1000, n)
    full = lambda k: np.full(n, k)
    places = lambda one, two: len(np.unique(lm_scoring.shard_of(one, two, uid, before, 1000)))
    assert places(full(4), rnd.integers(0, 5, n)) == 1 and places(full(1), full(4)) == 1
    assert places(full(1), rnd.integers(0, 5, n)) > 1 and places(full(2), full(1)) == 1
    assert places(full(2), full(3)) > 1


def test_long_texts_in_stretches(spark, monkeypatch):
    """Counts and the base don't depend on where a text is cut, and nothing is lost."""
    text = " ".join(f"w{i % 97} {'  ' * (i % 3)}x{i % 7}" for i in range(3000))
    df = spark.createDataFrame([(1, text), (2, text[:500]), (3, " " * 5000), (4, ""), (5, "y" * 9000)], "doc_id long, text string")
    facts = lambda: sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), r["score"] < 0, r["bits_per_byte"] > 0) for r in lm_scoring.lm_scores(df).collect())
    whole = facts()
    monkeypatch.setattr(lm_scoring, "STRETCH", 700)
    monkeypatch.setattr(lm_scoring, "RUN_BYTES", 1000)
    assert facts() == whole
    assert b" ".join(lm_scoring.stretches(text.encode())).split() == text.encode().split()


def test_lm_scores_beat_the_base_on_held_out_texts(spark, monkeypatch):
    """Texts with a fixed order of words: the words before tell the next."""
    rnd = np.random.default_rng(8)
    chain = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        k = int(rnd.integers(0, 300))
        rows.append((i, " ".join(chain[(k + j) % 300] for j in range(60))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for tokens in (250_000, 2_000):
        monkeypatch.setattr(lm_scoring, "SHARD_TOKENS", tokens)
        held = [r for r in lm_scoring.lm_scores(df).collect() if r["held_out"]]
        assert held and sum(r["score"] for r in held) > 0.4 * sum(r["base_score"] for r in held)


def test_lm_spelling_weights_come_from_all_training_words(docs, rows, monkeypatch):
    """Each bit of each spelled word is an event."""
    seen, whole = {}, lm_scoring.averaged

    def noting(mixers, fresh):
        m = whole(mixers, fresh)
        seen[fresh.gates] = m.seen.sum()
        return m

    monkeypatch.setattr(lm_scoring, "averaged", noting)
    lm_scoring.lm_scores(docs, dictionary=200).count()
    c = Counter()
    for i, t, *_ in rows:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2:
            c.update((t or "").encode().lower().split())
    sizes = Counter(n for n in c.values() if n >= lm_scoring.LEAST_COUNT)
    least = min((n for n in sizes if sum(k for m, k in sizes.items() if m >= n) <= 200), default=math.inf)
    rare = [w for w, n in c.items() if n < least]
    code = lm_scoring.Code.of((lm_scoring.letter_counts(rare) + 1).tolist())
    bits = np.diff(code.off)
    assert seen[64] == sum(bits[list(w + b"\n")].sum() for w in rare)


def test_repeated_words_of_a_text():
    rnd = np.random.default_rng(7)
    texts = [rnd.integers(0, 6, k) for k in (0, 1, 30, 0, 7)]
    again, text, word, n = lm_scoring.repeats(5, np.repeat(np.arange(5), [len(t) for t in texts]), np.concatenate(texts))
    for k, ws in enumerate(texts):
        slow, before = 0.0, Counter()
        for j, w in enumerate(ws.tolist()):
            if before[w]:
                slow += math.log10(lm_scoring.RECALL * before[w] / j)
            before[w] += 1
        assert math.isclose(again[k], slow, abs_tol=1e-9)
        assert {x: m for x, m, t in zip(word.tolist(), n.tolist(), text.tolist(), strict=True) if t == k} == before
    nothing = np.zeros(0, np.int64)
    assert all(len(x) == 0 for x in lm_scoring.repeats(2, nothing, nothing)[1:])


def test_words_of_bytes():
    """As Python splits bytes, whatever they are."""
    texts = [b"", b" \t\n\x0b\x0c\r ", b"A b\x0bC\x0cd\re", b"\x1c\x85\xa0 \x00x", b"\xff\xfe Z\xc3", "É\u3000x \u2003".encode(), b"  one", b"two  "]
    words, border = lm_scoring.split_words(pa.array(texts, pa.binary()))
    got = [x.as_buffer().to_pybytes() for x in words]
    assert [got[a:b] for a, b in zip(border[:-1], border[1:], strict=True)] == [t.lower().split() for t in texts]
