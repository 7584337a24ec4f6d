"""Near-duplicate classes by an exact Jaccard join over word shingles.

A text's set is its distinct ``words``-word shingles, as 64-bit hashes. Texts link if the
intersection is at least ``percent`` per cent of the union. The steps, all exact:

1. Equal sets become one (by a 64-bit digest): groups of copies count once from here on.
2. Shingles are dealt out by hash range; each range finds those that two sets share. A set
   with too few shared shingles to reach the bound with any other is done.
3. The others order their shingles by rarity. Linked sets share one of their rarest
   (size - required overlap + 1), so each such shingle ties its sets to its least set, and
   the components of these ties, the candidate groups, hold every link.
4. Groups are compared as size-banded tiles of at most ``TILE`` sets: sets sorted by size,
   only partners of a size that can reach the bound, hashed bitmap signatures whose bit
   counts bound the overlap from above, and an exact intersection of sorted arrays for
   those that pass and aren't in one class already. A group that fills several tiles adds
   its least sets to each as pivots; afterwards, the signatures of sets outside the group's
   largest class meet those of all others, and the tiles in which one may have a link meet
   it, block by block, so no link is lost. Sets inside a class aren't compared again: a
   group of near copies costs one comparison a set, not all pairs, and a group of unlike
   sets moves signatures, not tokens.
5. Components of the links give the classes.

Defined results: null, empty and white-space texts have an empty set and link to nothing;
fewer words than ``words`` make one shingle; rows that repeat an id each get a row; a null
id joins classes but never names one (a class of null ids only has a null name); an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from xqengine.llm.common import LOWER, SPACES, discard, map_arrow, materialise, mix, pieces, release, rows_of, span_hashes, spans, table, window_hashes
from xqengine.llm.components import components

#: Sets compared with each other in one tile; pivots that several tiles share.
TILE, PIVOTS = 1000, 8
#: Sets whose signatures (128 bytes each) are compared in one tile.
SIGNED_TILE = 8000
#: Text bytes for each hash range, which one task holds.
RANGE_BYTES = 16 << 20
SIGNATURE_WORDS = 16
_TOKEN = np.dtype("<u8")


def shingle_sets(b: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each row, and the row borders among them."""
    b = LOWER[b]
    s, e, first = spans(b, off, SPACES)
    h, row, n = span_hashes(b, s, e), rows_of(first), np.diff(first)
    w = window_hashes(h, words)
    at = np.flatnonzero(row[: len(w)] == row[words - 1 :]) if len(w) else np.zeros(0, np.int64)
    keys, owner = [w[at]], [row[at]]
    for k in range(1, words):  # texts of k words
        short = np.flatnonzero(n == k)
        if len(short):
            keys.append(window_hashes(h, k)[first[short]])
            owner.append(short)
    key, own = np.concatenate(keys), np.concatenate(owner)
    order = np.lexsort((key, own))
    key, own = key[order], own[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    key, own = key[fresh], own[fresh]
    return key, np.searchsorted(own, np.arange(len(off)))


def set_digests(key: np.ndarray, border: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(key ^ np.uint64(0xA0761D6478BD642F)))])
    n = np.diff(border)
    return mix(total[border[1:]] - total[border[:-1]] + n.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)).view(np.int64)


def sets_of(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, n, fp): size and digest of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, b, off in pieces(batch, "text"):
                key, border = shingle_sets(b, off, words)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(border)), pa.array(set_digests(key, border))], ["id", "n", "fp"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), run, "id long, n long, fp long")


def _binary(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _raw(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    return off - off[0], data[off[0] : off[-1]]


def _packed(key: list[np.ndarray], cols: dict[str, np.ndarray], own: np.ndarray, per_token: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Runs of tokens by ``key`` (arrays that tell a row, sorted), one row each: for the sets
    in it their ``cols`` and number of tokens, and the tokens' own columns, all as bytes.
    ``own`` is each token's set."""
    n = len(own)
    row = np.ones(n, bool)
    row[1:] = False
    for k in key:
        row[1:] |= k[1:] != k[:-1]
    new = row.copy()
    new[1:] |= own[1:] != own[:-1]
    first, begin = np.flatnonzero(row), np.flatnonzero(new)
    size = np.diff(np.append(begin, n)).astype("<u4")
    sets = np.append(np.searchsorted(begin, first), len(begin))
    ends = np.append(first, n)
    arrays = [pa.array(k[first]) for k in key]
    arrays += [_binary(sets * x.itemsize, x[own[begin]].view(np.uint8)) for x in (c.astype(c.dtype.newbyteorder("<")) for c in cols.values())]
    arrays.append(_binary(sets * 4, size.view(np.uint8)))
    arrays += [_binary(ends * x.itemsize, np.ascontiguousarray(x).view(np.uint8)) for x in per_token.values()]
    return pa.RecordBatch.from_arrays(arrays, [*(f"key{i}" for i in range(len(key))), *cols, "size", *per_token])


def _ranged(docs: DataFrame, text_col: str, words: int, k: int) -> DataFrame:
    """(range, fp, n, size, token): the tokens in each of 2**k hash ranges, a row for a piece
    of the input's sets; equal sets of a piece once. A token costs its 8 bytes, and each set
    16 more for every range it has tokens in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, b, off in pieces(batch, "text"):
                key, border = shingle_sets(b, off, words)
                fp, n = set_digests(key, border), np.diff(border).astype(np.int32)
                first = np.zeros(len(fp), bool)
                first[np.unique(fp, return_index=True)[1]] = True
                own = np.repeat(np.arange(len(n)), n)
                keep = first[own]
                token, own = key[keep], own[keep]
                if not len(token):
                    continue
                part = (token >> np.uint64(64 - k)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                out = _packed([part[order]], {"fp": fp, "n": n}, own[order], {"token": token[order]})
                yield out.rename_columns(["range", "fp", "n", "size", "token"])

    return map_arrow(docs.select(F.col(text_col).alias("text")), run, "range int, fp binary, n binary, size binary, token binary")


def _flat(t: pa.Table | pa.RecordBatch, name: str, kind: str) -> np.ndarray:
    return _raw(t.column(name))[1].view(kind)


def _shared(t: pa.Table, k: int) -> pa.Table:
    """Of one range: the tokens that several sets have, with how many have them, in rows by
    the set's digest: (bucket, fp, n, size, token, df)."""
    fp, n, size = _flat(t, "fp", "<i8"), _flat(t, "n", "<i4"), _flat(t, "size", "<u4")
    token = _flat(t, "token", "<u8")
    rows = np.unique(fp, return_index=True)[1]  # equal sets have equal rows in a range
    mine = np.zeros(len(fp), bool)
    mine[rows] = True
    own = np.repeat(np.arange(len(fp)), size)
    keep = mine[own]
    token, own = token[keep], own[keep]
    order = np.argsort(token, kind="stable")
    st = token[order]
    edge = np.flatnonzero(np.diff(st, prepend=~st[:1])) if len(st) else np.zeros(0, np.int64)
    count = np.diff(np.append(edge, len(st)))
    df = np.empty(len(st), np.int64)
    df[order] = np.repeat(count, count)
    some = df > 1
    token, own, df = token[some], own[some], np.minimum(df[some], 65535).astype("<u2")
    bucket = _bucket(fp, k)[own]
    order = np.lexsort((own, bucket))
    out = _packed([bucket[order]], {"fp": fp, "n": n}, own[order], {"token": token[order], "df": df[order]})
    release()
    return pa.Table.from_batches([out.rename_columns(["bucket", "fp", "n", "size", "token", "df"])])


def _bucket(fp: np.ndarray, k: int) -> np.ndarray:
    """Digests are hashes: their high bits deal sets out evenly."""
    return (fp.view(np.uint64) >> np.uint64(64 - k)).astype(np.int32)


def required(n: int, percent: int) -> int:
    """Least overlap of a set of ``n`` with any partner."""
    return -(-percent * n // 100)


def _survivors(t: pa.Table, percent: int) -> pa.Table:
    """Of one bucket: (fp, n, prefix, tokens sorted) of sets with enough shared tokens;
    ``prefix`` are the rarest, of which a linked set has one in its own."""
    size = _flat(t, "size", "<u4")
    fp, n = np.repeat(_flat(t, "fp", "<i8"), size), np.repeat(_flat(t, "n", "<i4"), size)
    token, df = _flat(t, "token", "<u8"), _flat(t, "df", "<u2")
    order = np.lexsort((token, df, fp))
    fp, n, token = fp[order], n[order], token[order]
    begin = np.flatnonzero(np.diff(fp, prepend=~fp[:1])) if len(fp) else np.zeros(0, np.int64)
    ends = np.append(begin, len(fp))
    out: dict[str, list] = {"fp": [], "n": [], "prefix": [], "tokens": []}
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        first = b - a - required(int(n[a]), percent) + 1
        if first > 0:
            for name, x in (("fp", fp[a]), ("n", n[a]), ("prefix", np.sort(token[a : a + first]).tobytes()), ("tokens", np.sort(token[a:b]).tobytes())):
                out[name].append(x)
    release()
    return pa.table([pa.array(out["fp"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["prefix"], pa.binary()), pa.array(out["tokens"], pa.binary())], list(out))


def _prefix_rows(sets: DataFrame, k: int) -> DataFrame:
    """(range, fp, size, token): the prefixes, dealt out by hash range again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, data = _raw(batch.column("prefix"))
            token = data.view("<u8")
            own = np.repeat(np.arange(batch.num_rows), np.diff(off) // 8)
            part = (token >> np.uint64(64 - k)).astype(np.int32)
            order = np.lexsort((own, part))
            out = _packed([part[order]], {"fp": batch.column("fp").to_numpy()}, own[order], {"token": token[order]})
            yield out.rename_columns(["range", "fp", "size", "token"])

    return map_arrow(sets.select("fp", "prefix"), run, "range int, fp binary, size binary, token binary")


def _ties(t: pa.Table) -> pa.Table:
    """Of one range: (set, least set) for each token that several prefixes have."""
    token, own = _flat(t, "token", "<u8"), np.repeat(_flat(t, "fp", "<i8"), _flat(t, "size", "<u4"))
    order = np.lexsort((own, token))
    token, own = token[order], own[order]
    start = np.diff(token, prepend=~token[:1]) != 0
    least = own[np.maximum.accumulate(np.where(start, np.arange(len(own)), 0))]
    pairs = np.stack([own, least], 1)[own != least]
    pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
    return pa.table({"u": pa.array(pairs[:, 0]), "v": pa.array(pairs[:, 1])})


def signatures(tokens: list[np.ndarray]) -> np.ndarray:
    """A hashed bitmap of 64 * SIGNATURE_WORDS bits for each set."""
    out = np.zeros((len(tokens), SIGNATURE_WORDS), np.uint64)
    for i, t in enumerate(tokens):
        bit = t % np.uint64(64 * SIGNATURE_WORDS)
        np.bitwise_or.at(out[i], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out


def tile_links(fp: np.ndarray, n: np.ndarray, tokens: list[np.ndarray], label: np.ndarray, other: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links of a tile that join different classes. ``label``: the class so far; sets with
    one label are joined already. ``other``: sets compared only with those without the
    mark (all are compared where none is marked)."""
    order = np.lexsort((fp, n))
    fp, n, label, other = fp[order], n[order], label[order], other[order]
    tokens = [tokens[i] for i in order]
    root = {x: x for x in label.tolist()}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    have = np.array([len(t) for t in tokens])
    sig = signatures(tokens)
    bits = np.bitwise_count(sig).sum(1)
    split = bool(other.any())
    top = np.searchsorted(n, n * 100 // percent, "right")  # partners of a size that can link
    now = label.copy()
    found = []
    for i in range(len(fp)):
        j = np.arange(i + 1, top[i])
        if not len(j):
            continue
        j = j[now[j] != now[i]]
        if split:
            j = j[other[j] != other[i]]
        if not len(j):
            continue
        most = _bounded_overlap(sig[j], bits[j], have[j], sig[i], bits[i], have[i])
        j = j[100 * most >= percent * (n[i] + n[j] - most)]
        for x in j.tolist():
            if now[x] == now[i]:
                continue
            at = np.searchsorted(tokens[x], tokens[i])
            at[at == len(tokens[x])] = 0
            both = int((tokens[x][at] == tokens[i]).sum())
            if 100 * both >= percent * (int(n[i]) + int(n[x]) - both):
                found.append((int(fp[i]), int(fp[x])))
                a, c = find(int(now[i])), find(int(now[x]))
                root[max(a, c)] = min(a, c)
                now[now == max(a, c)] = min(a, c)
    return found


def _tiles(rows: DataFrame, percent: int) -> DataFrame:
    """(u, v) links of (tile_a, tile_b, fp, n, tokens, label, other) rows, tile by tile."""
    keys = ["tile_a", "tile_b", "tile_c"]
    sorted_rows = rows.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def links(held: list) -> pa.RecordBatch:
            fp, n, tokens, label, other = zip(*held, strict=True)
            found = tile_links(np.array(fp), np.array(n), [np.frombuffer(t, _TOKEN) for t in tokens], np.array(label), np.array(other), percent)
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([c for _, c in found], pa.int64())], ["u", "v"])

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in (*keys, "fp", "n", "tokens", "label", "other")], strict=True):
                if row[:3] != at:
                    if len(held) > 1:
                        yield links(held)
                    held, at = [], row[:3]
                held.append(row[3:])
        if len(held) > 1:
            yield links(held)

    return map_arrow(sorted_rows, run, "u long, v long")


def _classes(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the linked sets. ``groups``: (node, component) candidates."""
    g = groups.withColumnRenamed("node", "fp").withColumnRenamed("component", "grp")
    sizes = materialise(g.groupBy("grp").agg(F.count("*").alias("m")).withColumn("chunks", F.ceil(F.col("m") / TILE)), "jaccard-sizes")
    g = materialise(g.join(sizes, "grp"), "jaccard-groups")
    rows = sets.select("fp", "n", "tokens").join(g, "fp").withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")))
    base = [F.col("grp").alias("tile_a"), F.col("chunk").alias("tile_b"), F.lit(0).cast("long").alias("tile_c"), "fp", "n", "tokens", F.col("fp").alias("label"), F.lit(False).alias("other")]
    large = g.where("chunks > 1")
    several = large.limit(1).count() > 0
    first = rows.select(*base)
    if several:
        least = large.withColumn("r", F.row_number().over(W.partitionBy("grp", F.pmod("fp", F.lit(64))).orderBy("fp"))).where(F.col("r") <= PIVOTS)
        least = least.withColumn("r", F.row_number().over(W.partitionBy("grp").orderBy("fp"))).where(F.col("r") <= PIVOTS).select("fp", "grp", "chunks")
        pivots = sets.select("fp", "n", "tokens").join(F.broadcast(least) if least.count() <= 100_000 else least, "fp").withColumn("chunk", F.explode(F.expr("sequence(0L, chunks - 1)")))
        pivots = pivots.where(F.col("chunk") != F.pmod(F.xxhash64("fp"), F.col("chunks")))
        first = first.unionByName(pivots.select(*base))
    links = materialise(_tiles(first, percent), "jaccard-links")
    done = materialise(components(links), "jaccard-classes")
    if not several:
        return done
    # Sets outside the largest class of a group of several tiles meet the other tiles.
    inside = large.join(done.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("component", "fp")).select("fp", "grp", "chunks", "label")
    inside = materialise(inside, "jaccard-inside")
    most = inside.groupBy("grp", "label").agg(F.count("*").alias("m")).groupBy("grp").agg(F.max(F.struct("m", "label")).alias("x")).select("grp", F.col("x.label").alias("main"))
    outside = materialise(inside.join(F.broadcast(most) if most.count() <= 100_000 else most, "grp").where("label <> main"), "jaccard-outside")
    if not outside.limit(1).count():
        return done
    inside = inside.join(outside.select("fp", F.lit(True).alias("out")), "fp", "left").withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")))
    asked = materialise(_asked(inside.join(sets.select("fp", "n", "tokens"), "fp"), percent), "jaccard-asked")
    # Chunks that some set asks for meet the sets that ask, a block of these at a time.
    blocks = materialise(asked.groupBy("grp", "chunk").agg(F.ceil(F.count("*") / TILE).alias("blocks")), "jaccard-blocks")
    whole = inside.join(sets.select("fp", "n", "tokens"), "fp")
    met = whole.join(blocks, ["grp", "chunk"]).withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)"))).withColumn("other", F.lit(False))
    out = asked.join(blocks, ["grp", "chunk"]).withColumn("block", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks"))).withColumn("other", F.lit(True))
    out = out.join(whole.select("fp", "n", "tokens", "label"), "fp")
    cols = [F.col("grp").alias("tile_a"), F.col("chunk").alias("tile_b"), F.col("block").alias("tile_c"), "fp", "n", "tokens", "label", "other"]
    more = materialise(_tiles(met.select(*cols).unionByName(out.select(*cols)), percent), "jaccard-links")
    return materialise(components(links.unionByName(more)), "jaccard-classes")


def _bounded_overlap(sig: np.ndarray, bits: np.ndarray, have: np.ndarray, i_sig: np.ndarray, i_bits: int, i_have: int) -> np.ndarray:
    """The most shingles that a set can share with each of others, by their signatures."""
    both = np.bitwise_count(sig & i_sig).sum(1)
    return np.minimum(i_have - (i_bits - both), have - (bits - both))


def _asked(rows: DataFrame, percent: int) -> DataFrame:
    """(grp, chunk, fp): the chunks of its group that a set marked ``out`` may have a link
    in, other than its own, by signatures alone. These are small, so that sets that share
    shingles but are unlike never make their tokens move."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(t.as_py(), _TOKEN) for t in batch.column("tokens")]
            sig = signatures(tokens)
            keep = [batch.column(c) for c in ("grp", "chunk", "fp", "n", "label")]
            cols = [*keep, batch.column("out").fill_null(False), pa.array([len(t) for t in tokens], pa.int64()), _binary(np.arange(len(sig) + 1) * sig[:1].nbytes, sig.view(np.uint8).ravel())]
            yield pa.RecordBatch.from_arrays(cols, ["grp", "chunk", "fp", "n", "label", "out", "have", "sig"])

    columns = ("grp", "chunk", "fp", "n", "label", "out", "have", "sig")
    signed = map_arrow(rows.select("grp", "chunk", "fp", "n", "label", "out", "tokens"), sign, "grp long, chunk long, fp long, n long, label long, out boolean, have long, sig binary")
    signed = materialise(signed, "jaccard-signatures")
    sizes = signed.groupBy("grp").agg(F.ceil(F.count("*") / SIGNED_TILE).alias("as"), F.ceil(F.count_if("out") / SIGNED_TILE).alias("bs"))
    signed = signed.join(materialise(sizes, "jaccard-signed-sizes"), "grp")
    mine, turn = F.pmod(F.xxhash64("fp", F.lit(2)), F.col("as")), F.pmod(F.xxhash64("fp", F.lit(3)), F.col("bs"))
    every = signed.withColumn("asks", F.lit(False)).withColumn("a", mine).withColumn("b", F.explode(F.expr("sequence(0L, bs - 1)")))
    asking = signed.where("out").withColumn("asks", F.lit(True)).withColumn("b", turn).withColumn("a", F.explode(F.expr("sequence(0L, `as` - 1)")))
    both = every.unionByName(asking).select("a", "b", "asks", *columns)
    both = both.repartition("grp", "a", "b").sortWithinPartitions("grp", "a", "b", "asks")

    def meet(held: list[tuple]) -> pa.RecordBatch:
        asks, grp, chunk, fp, n, label, _, have, sig = (np.array(x) if k < 8 else x for k, x in enumerate(zip(*held, strict=True)))
        sig = np.frombuffer(b"".join(sig), np.uint64).reshape(len(held), -1)
        bits = np.bitwise_count(sig).sum(1)
        at = np.flatnonzero(~asks)
        at = at[np.argsort(n[at], kind="stable")]
        sizes, near = n[at], (sig[at], bits[at], have[at])
        found = []
        for i in np.flatnonzero(asks).tolist():
            low, high = np.searchsorted(sizes, -(-int(n[i]) * percent // 100)), np.searchsorted(sizes, int(n[i]) * 100 // percent, "right")
            most = _bounded_overlap(*(x[low:high] for x in near), sig[i], bits[i], have[i])
            k = at[low:high][100 * most >= percent * (n[i] + sizes[low:high] - most)]
            k = k[(label[k] != label[i]) & (chunk[k] != chunk[i])]
            found += [(int(c), int(fp[i])) for c in np.unique(chunk[k])]
        return pa.RecordBatch.from_arrays([pa.array([int(grp[0])] * len(found), pa.int64()), pa.array([c for c, _ in found], pa.int64()), pa.array([f for _, f in found], pa.int64())], ["grp", "chunk", "fp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for key, row in zip(zip(*[batch.column(c).to_pylist() for c in ("grp", "a", "b")], strict=True), zip(*[batch.column(c).to_pylist() for c in ("asks", *columns)], strict=True), strict=True):
                if key != now:
                    if held:
                        yield meet(held)
                    held, now = [], key
                held.append(row)
        if held:
            yield meet(held)

    return map_arrow(both, run, "grp long, chunk long, fp long").distinct()


def jaccard_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of ``docs``."""
    spark = docs.sparkSession
    slim = materialise(sets_of(docs, id_col, text_col, words), "jaccard-sets")
    size = docs.agg(F.sum(F.octet_length(F.col(text_col))).alias("b")).first()["b"] or 0
    k = max(5, int(np.ceil(np.log2(max(1, size / RANGE_BYTES)))))  # only how work is dealt out
    shared = _ranged(docs, text_col, words, k).groupBy("range").applyInArrow(lambda t: _shared(t, k), "bucket int, fp binary, n binary, size binary, token binary, df binary")
    sets = shared.groupBy("bucket").applyInArrow(lambda t: _survivors(t, percent), "fp long, n long, prefix binary, tokens binary")
    sets = materialise(sets, "jaccard-survivors")
    ties = _prefix_rows(sets, k).groupBy("range").applyInArrow(_ties, "u long, v long")
    groups = components(ties)
    classes = _classes(sets, groups, percent).select(F.col("node").alias("fp"), "component")
    discard(spark, sets)
    # From sets to documents: equal sets share their digest.
    by_set = slim.where("n > 0").groupBy("fp").agg(F.min("id").alias("least"))
    named = by_set.join(classes, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = materialise(named, "jaccard-named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    names = materialise(named.join(materialise(least, "jaccard-least"), "component").select("fp", "component_id"), "jaccard-names")
    out = slim.join(names, "fp", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle; fast enough for a few thousand documents.
ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS sh FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT b.v, r.c FROM r JOIN both_ways b ON b.u = r.doc_id WHERE r.c < b.v)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(r.c), d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY d.doc_id"""
