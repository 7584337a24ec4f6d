"""Language-model scores by online logistic context mixing.

A text is a row of words and an end mark. A word of the dictionary (the most frequent
training words), the end mark or an escape is coded by the bits of its Huffman code; each
bit is predicted by several predictors, one from the code's own counts and one from each
hashed context (the word before, the two words before). A second model of the same make
spells words that training never saw, bit by bit, from the letters before. In both, the
predictors' logits are combined with weights that the predictors' confidences select, the
weights having been learned online, and an adaptive probability map refines the result.

Counts of word contexts grow with the corpus: each token goes, with the two words before, to
the shard of its context, where a context's symbols lie sorted by code, so that a node's
count is a sum over neighbours. A shard has about ``SHARD_TOKENS`` tokens whatever the
input. The shard of a token follows from the word before; the contexts of a word that alone
fills much of a shard are dealt out by the word before that too, and then each part has its
own counts of the word. Two words that are both among the most frequent are dealt out by
text as well, so no context, however frequent, has to fit into one task. The dictionary
grows with the square root of the corpus, up to ``DICTIONARY_MOST``. Words beyond it are
contexts by a 31-bit hash.

The shard is also a gate: its mixing weights and map are learned online from all its training
tokens, each with its own count taken out, as if held out, and then score all its tokens.
Spelling's weights are learned by task from all training words outside the dictionary and
averaged by events seen. Letter tables have a fixed number of slots.

Words outside the dictionary: after the escape, a known word has the probability of its
count, less the mass of unseen words (as many as words seen once, by Good and Turing);
an unseen word has that mass times its spelling's probability. A part of the probability
goes to the escaped words that the same text had before. So all words' probabilities sum
to at most one.

Defined results: null and '' are one end mark; rows that repeat an id each get a row;
without training rows N and V are 0 and only spelling is used; further columns are
ignored. Texts longer than ``STRETCH`` bytes are scored in stretches, each of which begins
without context.
"""

from __future__ import annotations

import heapq
import pickle
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xqengine.llm.common import held_out, map_arrow, materialise, mix, span_hashes, table

#: Least and most words of the dictionary; see ``dictionary_size``.
DICTIONARY, DICTIONARY_MOST = 65_536, 1 << 20
#: Tokens of a shard; of a word from which on its contexts are dealt over shards; and of two
#: words that may follow each other from which on their context is dealt over texts, too.
SHARD_TOKENS = 250_000
HOT_TOKENS = 50_000
PAIR_TOKENS = 4_000_000
#: log2 of the slots of each hashed context of the letters.
LETTER_BITS = (16, 20, 20, 20)
#: Rarer words aren't in the dictionary, so that training meets escapes as scoring will.
LEAST_COUNT = 3
#: Share of an escaped word's probability for the text's own earlier escaped words.
RECALL = 0.05
#: Bytes of a long text that are taken at a time; each such stretch begins without context.
STRETCH = 1 << 20
#: Bytes of texts that a task cuts into words and sorts by shard at a time.
RUN_BYTES = 8 << 20
#: Words that a counting task holds before it hands them on.
HELD_WORDS = 400_000
#: Texts whose scores are added up together: 2 to this.
BUCKET_BITS = 13
_BLOCK = 1 << 18
_GAP = re.compile(rb"[\t-\r ]+")
_LONGEST = 62
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_STEPS = 33


@dataclass(frozen=True)
class Code:
    """A Huffman code: for symbol i, entries off[i]:off[i+1] of node and bit; counts of
    zeros and ones below each node."""

    off: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray

    @classmethod
    def of(cls, counts: list[int]) -> Code:
        heap = [(c, i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        n, kids, weight = len(counts), {}, list(counts)
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            kids[len(weight)] = (i, j)
            heapq.heappush(heap, (a + b, len(weight)))
            weight.append(a + b)
        paths: dict[int, list[tuple[int, int]]] = {len(weight) - 1: []}
        for k in range(len(weight) - 1, n - 1, -1):
            for bit, child in enumerate(kids[k]):
                paths[child] = [*paths[k], (k - n, bit)]
            del paths[k]
        flat = [paths[i] for i in range(n)]
        off = np.cumsum([0, *map(len, flat)])
        both = np.array([x for p in flat for x in p], np.int64).reshape(-1, 2)
        zeros = np.array([weight[kids[k][0]] for k in range(n, len(weight))], np.float64)
        ones = np.array([weight[kids[k][1]] for k in range(n, len(weight))], np.float64)
        return cls(off, both[:, 0], both[:, 1], zeros, ones)

    @cached_property
    def aligned(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each symbol's bits as a number, the first at ``_LONGEST`` - 1 (or 30, if that will
        do), their count, and the symbol's rank by these numbers."""
        size = np.diff(self.off)
        owner = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(owner)) - self.off[owner]
        value = np.zeros(len(size), np.int64)
        np.add.at(value, owner, self.bit << (_LONGEST - 1 - place))
        rank = np.empty(len(size), np.int64)
        rank[np.argsort(value, kind="stable")] = np.arange(len(size))
        if size.max(initial=0) <= 31:
            value = (value >> (_LONGEST - 31)).astype(np.int32)
        return value, size, rank


@dataclass
class Mixer:
    """Gated weights over ``k`` logits and a bias, and the adaptive map behind them."""

    gates: int
    k: int
    w: np.ndarray = field(init=False)
    seen: np.ndarray = field(init=False)
    apm: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.w = np.full((self.gates, self.k + 1), 1.0 / self.k, np.float32)
        self.w[:, -1] = 0
        self.seen = np.zeros(self.gates)
        at = np.linspace(-8, 8, _STEPS)
        self.apm = np.tile(1 / (1 + np.exp(-at)), (self.gates, 1)).astype(np.float32)

    def _logit(self, s: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        by_input = np.ascontiguousarray(self.w.T)
        z = by_input[self.k].take(gate)
        for k, x in enumerate(s):
            z += by_input[k].take(gate) * x
        return np.clip(z, np.float32(-7.99), np.float32(7.99))

    def _refine(self, z: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (z + np.float32(8)) * np.float32((_STEPS - 1) / 16)
        low = at.astype(np.int32)
        part = at - low.astype(np.float32)
        flat, i = self.apm.ravel(), gate * _STEPS + low
        a = flat.take(i)
        return a + (flat.take(i + 1) - a) * part, i, part

    def predict(self, s: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        """The probability of a one."""
        z = self._logit(s, gate)
        half = np.float32(0.5)
        p = half / (1 + np.exp(-z)) + half * self._refine(z, gate)[0]
        return np.clip(p, np.float32(1e-6), np.float32(1 - 1e-6))

    def log10_of(self, s: list[np.ndarray], gate: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """The log10 probability of each event's own bit."""
        p = self.predict(s, gate)
        return np.log(np.where(bit == 1, p, 1 - p)) * np.float32(1 / np.log(10))

    def learn(self, s: list[np.ndarray], gate: np.ndarray, bit: np.ndarray, times: np.ndarray | None = None) -> None:
        """One step from a few thousand events, which may count several ``times``: weights,
        then the map."""
        z = self._logit(s, gate)
        err = bit - 1 / (1 + np.exp(-z))
        if times is not None:
            err = err * times
        n = np.bincount(gate, times, self.gates)
        self.seen += n
        rate = 0.5 / np.sqrt(1 + self.seen / 20_000) / np.maximum(n, 50)
        for k, x in enumerate([*s, np.ones_like(z)]):
            self.w[:, k] += (rate * np.bincount(gate, err * x, self.gates)).astype(np.float32)
        _, i, part = self._refine(z, gate)
        flat = self.apm.ravel()
        near = i + (part > 0.5)
        hits = np.bincount(near, times, len(flat))
        ones = np.bincount(near, bit if times is None else bit * times, len(flat))
        some = hits > 0
        step = hits / (hits + 100.0)
        flat[some] += (step * (np.clip(ones / np.maximum(hits, 1), 1e-4, 1 - 1e-4) - flat))[some].astype(np.float32)


def slots(context: np.ndarray, node: np.ndarray, bits: int, order: int) -> np.ndarray:
    h = (context + node.astype(np.uint64) * _ODD[3]) * _ODD[order % 3]
    h ^= h >> np.uint64(32)
    return ((h * _ODD[0]) >> np.uint64(64 - bits)).astype(np.int64)


#: log(n + 0.4) of a slot's counts, and how sure a total makes (0 to 3; 16 stands for more).
_LOG = np.log(np.arange(1 << 16) + 0.4).astype(np.float32)
_SURE = np.array([0, 1, 1, *[2] * 13, 3], np.int64)
_SURE_OF = np.array([*_SURE, 3, 0], np.int8)  # the last is that of a total of -1


def logits(n: np.ndarray, slot: np.ndarray, bit: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Logit and confidence (0 to 3) of slots of interleaved (zeros, ones) counts; with
    ``bit``, the event's own count is taken out."""
    pair = n.view("<u4")[slot].view("<u2")
    zeros, ones = pair[::2].astype(np.int32), pair[1::2].astype(np.int32)
    if bit is not None:
        zeros, ones = np.maximum(zeros - (1 - bit), 0), np.maximum(ones - bit, 0)
    return _LOG[ones] - _LOG[zeros], _SURE[np.minimum(zeros + ones, 16)]


def dictionary_size(tokens: int) -> int:
    return min(DICTIONARY_MOST, max(DICTIONARY, int((64 * tokens) ** 0.5)))


def contexts(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before and the one before that, plus 1; 0 is none."""
    starts = starts[starts < len(ids)]
    one = np.concatenate([np.zeros(1, np.int64), ids[:-1] + 1])
    two = np.concatenate([np.zeros(1, np.int64), one[:-1]])
    one[starts] = 0
    two[starts] = 0
    second = starts + 1
    two[second[second < len(two)]] = 0
    return one, two


def shard_of(one: np.ndarray, two: np.ndarray, uid: np.ndarray, before: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each token. ``before``: how often each dictionary word, plus 1, comes
    before another. A word's tokens are in one shard; those of a frequent word are dealt
    out by the word before it, and where both are very frequent by text as well."""
    last = len(before) - 1
    h = mix(one.astype(np.uint64) * _ODD[0])
    n1 = before[np.minimum(one, last)]
    hot = np.flatnonzero(n1 > HOT_TOKENS)
    if len(hot):
        n1, two = n1[hot], two[hot]
        texts = (1 + np.minimum(n1, before[np.minimum(two, last)]) // PAIR_TOKENS).astype(np.uint64)
        text = mix(uid[hot].astype(np.uint64) * _ODD[0]) % texts
        part = mix((two.astype(np.uint64) + text * _ODD[1]) * _ODD[2]) % (1 + 2 * n1 // SHARD_TOKENS).astype(np.uint64)
        h[hot] = mix(one[hot].astype(np.uint64) * _ODD[0] + part * _ODD[1])
    return (h % np.uint64(shards)).astype(np.int32)


def pack_arrays(arrays: list[np.ndarray]) -> bytes:
    """Arrays of one length and 4-byte numbers, by byte place, compressed."""
    planes = b"".join(np.ascontiguousarray(a.astype(a.dtype.newbyteorder("<")).view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays)
    return struct.pack("<I", len(planes)) + pa.compress(planes, codec="zstd", asbytes=True)


def unpack_arrays(data: bytes, kinds: list[str]) -> list[np.ndarray]:
    planes = pa.decompress(data[4:], decompressed_size=struct.unpack_from("<I", data)[0], codec="zstd", asbytes=True)
    b = np.frombuffer(planes, np.uint8).reshape(len(kinds), 4, -1)
    return [np.ascontiguousarray(x.T).view(k).ravel() for x, k in zip(b, kinds, strict=True)]


def levels(new: np.ndarray, code: np.ndarray, size: np.ndarray, c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For (context, symbol) rows sorted by context and code, with ``new`` where a context
    begins: by depth the rows whose code has a bit there, that bit, and the context's counts
    of zeros and ones at the node. Rows under one node are neighbours, and each bit splits
    them; a code that ends was alone under its node."""
    at, edge, c = np.arange(len(code)), new.copy(), c.astype(np.float32)
    top = 30 if code.dtype == np.int32 else _LONGEST - 1
    d = 0
    while True:
        keep = size > d
        if not keep.all():
            at, code, size, c, edge = (x[keep] for x in (at, code, size, c, edge))
        if not len(at):
            return
        bit = ((code >> (top - d)) & 1).astype(np.int8)
        first = np.flatnonzero(edge)
        lengths = np.diff(np.append(first, len(at)))
        ones = np.add.reduceat(c * bit, first)
        zeros = np.add.reduceat(c, first) - ones
        yield at, bit, np.repeat(zeros, lengths), np.repeat(ones, lengths)
        edge[1:] |= bit[1:] != bit[:-1]
        d += 1


def both_logits(zeros: np.ndarray, ones: np.ndarray, bit: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Logit and confidence (0 to 3) of a node's counts, and the same without one token whose
    bit is ``bit``."""
    total = np.minimum(zeros + ones, np.float32(17)).astype(np.int8)
    rest = [np.maximum(zeros - 1 + bit, 0), np.maximum(ones - bit, 0)]
    logit = lambda z, o: np.log((o + np.float32(0.4)) / (z + np.float32(0.4)))
    return [(logit(zeros, ones), _SURE_OF[total]), (logit(*rest), _SURE_OF[total - 1])]


def _edges(*cols: np.ndarray) -> np.ndarray:
    new = np.ones(len(cols[0]), bool)
    new[1:] = False
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return new


def _mixed(cols: list[np.ndarray], block: int = 64, size: int = 16_384) -> Iterator[list[np.ndarray]]:
    """Batches of all entries, by blocks of neighbours in a seeded random order."""
    n = len(cols[0]) // block
    order = np.random.default_rng(1).permutation(n)
    whole = [c[: n * block].reshape(n, block) for c in cols]
    for s in _slices(n, size // block):
        yield [c[order[s]].ravel() for c in whole]
    if n * block < len(cols[0]):
        yield [c[n * block :] for c in cols]


class Shard:
    """The contexts of a shard's tokens, with their exact counts in it."""

    def __init__(self, one, two, sym, learn, code: Code):
        value, size, rank = code.aligned
        both = one.astype(np.uint64) << np.uint64(32) | two.astype(np.uint64)
        rank = rank.astype(np.uint64)
        order = np.argsort(both)
        context = np.empty(len(order), np.uint64)
        context[order] = np.cumsum(_edges(both[order])).astype(np.uint64)
        order = np.argsort(context << np.uint64(32) | rank[sym])
        both, y = both[order], sym[order]
        first = np.flatnonzero(_edges(both, y))
        self.row = np.empty(len(order), np.int64)  # of each token
        self.row[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        both, self.sym = both[first], y[first]
        self.one, self.two = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.c = np.bincount(self.row, learn, len(first))
        self.code, self.value, self.size, self.new = code, value, size, _edges(both)
        order = np.argsort(np.cumsum(_edges(self.one)).astype(np.uint64) << np.uint64(32) | rank[self.sym])
        new = _edges(self.one[order], self.sym[order])
        self.pair = np.empty(len(order), np.int64)
        self.pair[order] = np.cumsum(new) - 1
        at = order[np.flatnonzero(new)]
        self.one_new, self.one_sym, self.one_c = _edges(self.one[at]), self.sym[at], np.bincount(self.pair, self.c)

    def events(self) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]]:
        """(rows, bit, inputs and gate, and the same without one of the row's own tokens) by
        depth of the code. Inputs are the logits of the code's own counts, of the word
        before and of the two words before."""
        zero = np.log((self.code.ones + 0.4) / (self.code.zeros + 0.4)).astype(np.float32)
        n1 = np.zeros((2, len(self.one_sym)), np.float32)
        by_one = levels(self.one_new, self.value[self.one_sym], self.size[self.one_sym], self.one_c)
        by_two = levels(self.new, self.value[self.sym], self.size[self.sym], self.c)
        node_at = self.code.off[self.sym]
        for d, ((at1, _, *n), (at, bit, zeros2, ones2)) in enumerate(zip(by_one, by_two, strict=True)):
            n1[0][at1], n1[1][at1] = n
            near = self.pair[at]
            zeros1, ones1 = n1[0][near], n1[1][near]
            x0 = zero[self.code.node[node_at[at] + d]]
            one, two = both_logits(zeros1, ones1, bit), both_logits(zeros2, ones2, bit)
            both = [[x0, x1, x2, sure1 * np.int8(4) + sure2] for (x1, sure1), (x2, sure2) in zip(one, two, strict=True)]
            yield at, bit, *both

    def scores(self) -> np.ndarray:
        """The log10 probability of each token, by weights learned online from all training
        tokens in a mixed order, each with its own count taken out."""
        asked, taught, c = [], [], self.c.astype(np.float32)
        for at, bit, full, less in self.events():
            asked.append([at.astype(np.int32), bit, *full])
            taught.append([c[at], bit, *less])  # a row without training tokens counts 0 times
        out = np.zeros(len(self.sym))
        if not asked:
            return out[self.row]
        m = Mixer(16, 3)
        cols = [np.concatenate(x) for x in zip(*taught, strict=True)]
        del taught
        for times, bit, *x, gate in _mixed(cols):
            m.learn(x, gate.astype(np.int64), bit, times)
        for part in asked:
            for s in _slices(len(part[0])):
                at, bit, *x, gate = (c[s] for c in part)
                out[at] += m.log10_of(x, gate.astype(np.int64), bit)
        return out[self.row]


def averaged(mixers: Iterator[Mixer], fresh: Mixer) -> Mixer:
    """Weights and maps averaged gate by gate, by the events that each mixer saw."""
    w, apm, seen = np.zeros(fresh.w.shape), np.zeros(fresh.apm.shape), np.zeros(fresh.gates)
    for m in mixers:
        w += m.w * m.seen[:, None]
        apm += m.apm * m.seen[:, None]
        seen += m.seen
    some = seen > 0
    fresh.w[some] = w[some] / seen[some, None]
    fresh.apm[some] = apm[some] / seen[some, None]
    fresh.seen = seen
    return fresh


def letter_counts(words: list[bytes]) -> np.ndarray:
    """How often each byte occurs, a line feed counting as each word's end."""
    return np.bincount(np.frombuffer(b"\n".join(words) + b"\n", np.uint8), minlength=256)


def letter_events(words: list[bytes], code: Code) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(word of each bit, slots by order, bit): a letter's bits are those of its code; a line
    feed is each word's end."""
    b = np.frombuffer(b"\n".join(words) + b"\n", np.uint8).astype(np.uint64)
    ends = np.flatnonzero(b == 10)
    sizes = np.diff(ends, prepend=-1)
    own = np.repeat(np.arange(len(ends)), sizes)
    place = np.arange(len(b)) - np.repeat(np.concatenate([[0], ends[:-1] + 1]), sizes)
    contexts, h = [], np.zeros(len(b), np.uint64)
    for order in range(1, len(LETTER_BITS) + 1):
        back = np.zeros(len(b), np.uint64)
        back[order:] = b[:-order] + np.uint64(1)
        back[place < order] = 0
        h = mix(h * _ODD[1] + back + np.uint64(order))
        contexts.append(h)
    at = b.astype(np.int64)
    bits = (code.off[1:] - code.off[:-1])[at]
    entry = np.repeat(code.off[:-1][at] - np.concatenate([[0], np.cumsum(bits)[:-1]]), bits) + np.arange(bits.sum())
    node = code.node[entry]
    wide = [np.repeat(c, bits) for c in contexts]
    return np.repeat(own, bits), [slots(c, node, k, i) for i, (c, k) in enumerate(zip(wide, LETTER_BITS, strict=True))], code.bit[entry]


_expanded: dict[str, list[np.ndarray]] = {}


def expanded(name: str, blocks: list[tuple[int, int, bytes]], bits: tuple[int, ...]) -> list[np.ndarray]:
    """A model's tables from their compressed blocks, once for each worker process."""
    if name not in _expanded:
        if len(_expanded) >= 3:  # those of an earlier model
            _expanded.clear()
        out = [np.zeros(2 << b, "<u2") for b in bits]
        for k, j, data in blocks:
            part = np.frombuffer(zlib.decompress(data), "<u2")
            out[k][j * _BLOCK : j * _BLOCK + len(part)] = part
        _expanded[name] = out
    return _expanded[name]


def _tables(rows: DataFrame, run) -> list[tuple[int, int, bytes]]:
    """Sum the tasks' tables block by block, in two rounds, and fetch them, compressed: a
    fixed size at most, whatever the input. ``run(batches)`` gives a task's list of
    tables."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % 64
        for k, n in enumerate(run(batches)):
            for j in range(0, len(n), _BLOCK):
                if (part := n[j : j + _BLOCK]).any():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([j // _BLOCK], pa.int32()), pa.array([salt], pa.int32()), pa.array([zlib.compress(part.astype("<i8").tobytes(), 1)])], ["k", "block", "salt", "n"])

    def total(t: pa.Table) -> np.ndarray:
        parts = (np.frombuffer(zlib.decompress(x.as_py()), "<i8") for x in t.column("n"))
        out = next(parts).copy()
        for part in parts:  # all of one length
            out += part
        return out

    def first(t: pa.Table) -> pa.Table:
        return t.slice(0, 1).select(["k", "block"]).append_column("n", pa.array([zlib.compress(total(t).tobytes(), 1)]))

    def last(t: pa.Table) -> pa.Table:
        pair = total(t).reshape(-1, 2)
        over = np.maximum(1, -(-pair.sum(1, keepdims=True) // 65535))
        small = (-(-pair // over)).clip(0, 65535).astype("<u2")  # a count above 0 stays so
        return t.slice(0, 1).select(["k", "block"]).append_column("n", pa.array([zlib.compress(small.tobytes(), 1)]))

    schema = "k int, block int, n binary"
    emitted = map_arrow(rows, emit, "k int, block int, salt int, n binary")
    summed = emitted.groupBy("k", "block", "salt").applyInArrow(first, schema).groupBy("k", "block").applyInArrow(last, schema)
    return [(r["k"], r["block"], bytes(r["n"])) for r in summed.toLocalIterator()]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of binary texts, A-Z lowered, one after the other, and the texts' borders
    among them. The kernels look at ASCII alone, so that bytes need not be UTF-8."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    words = lists.flatten()
    if (empty := pc.equal(pc.binary_length(words), 0)).true_count:  # of texts without a word
        owner = np.repeat(np.arange(len(sizes)), sizes)
        keep = pc.invert(empty)
        words, sizes = words.filter(keep), np.bincount(owner[keep.to_numpy(zero_copy_only=False)], minlength=len(sizes))
    return words, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) of all texts; words are bytes with A-Z lowered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def out() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"])

        for batch in _sliced(batches):
            counts = pc.value_counts(split_words(_stretched(batch)[1])[0])
            held.append(pa.table({"word": counts.field("values").view(pa.binary()), "c": counts.field("counts")}))
            if sum(t.num_rows for t in held) > HELD_WORDS:
                held = [out()]
                if held[0].num_rows > HELD_WORDS // 2:
                    yield from held[0].to_batches()
                    held = []
        if held:
            yield from out().to_batches()

    return map_arrow(texts.select("text"), run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def stretches(raw: bytes) -> Iterator[bytes]:
    """A text whole, or in parts of about ``STRETCH`` bytes cut at white space."""
    a = 0
    while len(raw) - a > STRETCH and (m := _GAP.search(raw, a + STRETCH)):
        yield raw[a : m.start()]
        a = m.end()
    yield raw[a:] if a else raw


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about ``RUN_BYTES`` of text at a time; a longer text is alone."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy())
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + RUN_BYTES, "right")))
            yield batch.slice(a, b - a)
            a = b


def _stretched(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array]:
    """The stretches of a batch's texts: the row of each, and the bytes."""
    texts = batch.column("text")
    if not batch.num_rows or pc.max(pc.binary_length(texts)).as_py() <= STRETCH:
        return np.arange(batch.num_rows), texts
    parts = [(i, part) for i, text in enumerate(texts) for part in stretches(text.as_py())]
    return np.array([i for i, _ in parts]), pa.array([x for _, x in parts], pa.binary())


@dataclass
class Run:
    """The tokens of some texts' stretches: symbols, or hashes from the escape on, and where
    each stretch starts; the row of each; the words outside the dictionary and their
    stretches."""

    ids: np.ndarray
    starts: np.ndarray
    row: np.ndarray
    rare: pa.Array
    rare_in: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, known: pa.Array, end: int) -> Run:
        row, texts = _stretched(batch)
        words, border = split_words(texts)
        found = pc.index_in(words, value_set=known)
        other = found.is_null()
        rare = words.filter(other)
        plain = found.fill_null(end + 1).to_numpy().astype(np.int64)
        at = np.flatnonzero(other.to_numpy(zero_copy_only=False))
        plain[at] += (_word_hashes(rare) & np.uint64(0x7FFFFFFF)).astype(np.int64)
        last = np.append(row[1:] != row[:-1], True)[: len(row)]  # a text's last stretch has its end mark
        starts = border[:-1] + np.cumsum(last) - last
        ids = np.full(len(plain) + int(last.sum()), end, np.int64)
        own = np.repeat(np.arange(len(row)), np.diff(border))
        ids[np.arange(len(plain)) + (starts - border[:-1])[own]] = plain
        return cls(ids, starts, row, rare, own[at])


def _word_hashes(words: pa.Array) -> np.ndarray:
    off = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1 + words.offset)[words.offset :].astype(np.int64)
    if not len(words):
        return np.zeros(0, np.uint64)
    return span_hashes(np.frombuffer(words.buffers()[2], np.uint8)[off[0] : off[-1]], off[:-1] - off[0], off[1:] - off[0])


def _slices(n: int, size: int = 1 << 16) -> Iterator[slice]:
    for a in range(0, n, size):
        yield slice(a, a + size)


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the stretches, of which some may have no token."""
    total = np.concatenate([np.zeros(1, x.dtype), np.cumsum(x)])
    return total[np.append(starts[1:], len(x))] - total[starts]


def repeats(texts: int, text: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of words by text, in order: each text's log10 probability of recalling those that it
    had before (``RECALL`` times the share among the words before), and the text, word and
    number of each distinct word, which its first occurrence has to spell."""
    j = np.arange(len(word)) - np.searchsorted(text, text)
    order = np.lexsort((j, word, text))
    first = np.flatnonzero(_edges(text[order], word[order])) if len(word) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(order)))
    before = np.arange(len(order)) - np.repeat(first, n)
    old = order[before > 0]
    again = np.bincount(text[old], np.log10(RECALL * before[before > 0] / j[old]), texts).astype(np.float64)
    return again, text[order[first]], word[order[first]], n


def score_texts(docs: DataFrame, *, dictionary: int | None = None) -> DataFrame:
    """Score (uid, id, text binary, learn) rows by a model of those to ``learn`` from:
    (id, n_tokens, n_known, train_tokens, base_score, score, n_bytes)."""
    spark = docs.sparkSession
    context = spark.sparkContext
    train = docs.where("learn")
    vocab = materialise(word_counts(train), "lm-vocab")
    n_docs = train.count()
    total = vocab.agg(F.sum("c").alias("c"), F.count("*").alias("v")).first()
    n_all, v_all = (total["c"] or 0) + n_docs, total["v"] + (n_docs > 0)
    # The dictionary is all words of a least count. There are at most about
    # sqrt(2 * tokens) different counts below any dictionary's size.
    most, least, have = dictionary or dictionary_size(n_all), None, 0
    for r in vocab.where(F.col("c") >= LEAST_COUNT).groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(most).toLocalIterator():
        have += r["n"]
        if have > most:
            break
        least = r["c"]
    known = vocab.where(F.col("c") >= least) if least else vocab.limit(0)
    top = known.orderBy(F.desc("c"), "word").collect()  # at most DICTIONARY_MOST words
    words, counts = [bytes(r["word"]) for r in top], [r["c"] for r in top]
    rare = vocab.where(F.col("c") < least) if least else vocab
    r = rare.agg(F.sum("c").alias("c"), F.count(F.when(F.col("c") == 1, 1)).alias("once")).first()
    n_rare, unseen = r["c"] or 0, ((r["once"] or 0) + 0.5) / ((r["c"] or 0) + 1)
    end, escape = len(words), len(words) + 1
    code = Code.of([*counts, max(n_docs, 1), max(n_rare, 1)])
    shards = n_all // SHARD_TOKENS + 1
    before = np.array([n_docs, *counts, 0, 0], np.int64)  # by the word before, plus 1
    lexicon = context.broadcast((pa.array(words, pa.binary()), code, before))
    kinds = ["<u4"] * 4

    def token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each shard, a run of texts' tokens in it: the two words before (the first as
        steps), the symbol and whether to learn from it, the text as steps from ``base``."""
        known, _, before = lexicon.value
        known = known.view(pa.string())
        for batch in _sliced(batches):
            r = Run.of(batch, known, end)
            ids, size = r.ids, np.diff(np.append(r.starts, len(r.ids)))
            keys = batch.column("uid").to_numpy()
            base = int(keys.min())
            uid = np.repeat(keys[r.row] - base, size)
            learn = np.repeat(batch.column("learn").to_numpy(zero_copy_only=False)[r.row], size)
            one, two = contexts(ids, r.starts)
            shard = shard_of(one, two, uid + base, before, shards)
            sym = np.minimum(ids, escape).astype(np.uint32) | learn.astype(np.uint32) << np.uint32(31)
            near = shard.astype(np.uint64) << np.uint64(44) | (one.astype(np.uint64) & np.uint64(0x3FFFFF)) << np.uint64(22) | two.astype(np.uint64) & np.uint64(0x3FFFFF)
            order = np.argsort(near)  # by shard; within it, any order that packs well
            shard, one, two, sym, uid = shard[order], one[order].astype("<u4"), two[order].astype("<u4"), sym[order], uid[order].astype("<u4")
            edge = np.flatnonzero(_edges(shard))
            for part in np.array_split(np.arange(len(edge)), len(edge) // 500 + 1):
                data = []
                for k in part:
                    s = slice(edge[k], edge[k + 1] if k + 1 < len(edge) else None)
                    data.append(pack_arrays([np.diff(one[s], prepend=np.uint32(0)), two[s], sym[s], uid[s]]))
                yield pa.RecordBatch.from_arrays([pa.array(shard[edge[part]]), pa.array(np.full(len(part), base)), pa.array(data, pa.binary())], ["shard", "base", "data"])

    def score_shard(t: pa.Table) -> pa.Table:
        """(bucket, data): what the shard's tokens add to the scores of neighbouring texts."""
        _, code, _ = lexicon.value
        parts, ids, texts = [], [], 0
        for base, data in sorted(zip(t.column("base").to_pylist(), (x.as_py() for x in t.column("data")), strict=True)):
            steps, two, sym, uid = unpack_arrays(data, kinds)
            parts.append((np.cumsum(steps, dtype=np.uint32), two, sym, uid + np.uint32(texts)))
            ids.append(base + np.arange(int(uid.max()) + 1))
            texts += len(ids[-1])
        one, two, sym, at = (np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True))
        del parts
        score = Shard(one, two, sym & 0x7FFFFFFF, sym >> 31, code).scores()
        some = np.flatnonzero(np.bincount(at, minlength=texts))
        texts, sums = np.concatenate(ids)[some], np.bincount(at, score, texts).astype("<f4")[some]
        edge = np.flatnonzero(_edges(texts >> BUCKET_BITS))
        rows = [pack_arrays([np.diff(texts[a:b] & ((1 << BUCKET_BITS) - 1), prepend=0).astype("<i4").view("<u4"), sums[a:b]]) for a, b in zip(edge, [*edge[1:], len(texts)], strict=True)]
        return pa.table({"bucket": pa.array(texts[edge] >> BUCKET_BITS), "data": pa.array(rows, pa.binary())})

    def add_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(uid, score) of rows sorted by bucket."""
        now, total, some = None, np.zeros(1 << BUCKET_BITS), np.zeros(1 << BUCKET_BITS, bool)

        def out() -> pa.RecordBatch:
            at = np.flatnonzero(some)
            return pa.RecordBatch.from_arrays([pa.array((now << BUCKET_BITS) + at), pa.array(total[at])], ["uid", "score"])

        for batch in batches:
            for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data"), strict=True):
                if bucket != now:
                    if now is not None:
                        yield out()
                    now, total[:], some[:] = bucket, 0, False
                steps, sums = unpack_arrays(data.as_py(), ["<i4", "<f4"])
                at = np.cumsum(steps)
                np.add.at(total, at, sums)  # a text in stretches is there several times
                some[at] = True
        if now is not None:
            yield out()

    def count_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sum((letter_counts(b.column("word").to_pylist()) for b in batches), np.zeros(256, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(n)], ["byte", "n"])

    def count_letters(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
        n = [np.zeros(2 << b, np.uint32) for b in LETTER_BITS]
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                _, at, bit = letter_events(batch.column("word").slice(a, 2000).to_pylist(), spelt)
                for k in range(len(n)):
                    np.add.at(n[k], at[k] * 2 + bit, np.uint32(1))
        return n

    tokens = map_arrow(docs.select("uid", "id", "text", "learn"), token_rows, "shard int, base long, data binary")
    by_shard = tokens.groupBy("shard").applyInArrow(score_shard, "bucket long, data binary")
    by_text = map_arrow(by_shard.repartition("bucket").sortWithinPartitions("bucket"), add_texts, "uid long, score double")
    by_byte = map_arrow(rare.select("word"), count_bytes, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n"))
    often = {r["byte"]: r["n"] for r in by_byte.collect()}
    spelt = Code.of([often.get(i, 0) + 1 for i in range(256)])
    letters = context.broadcast(_tables(rare.select("word"), count_letters))
    model = uuid.uuid4().hex

    def letter_inputs(part: list[bytes], own: bool):
        word, at, bit = letter_events(part, spelt)
        n = expanded(f"{model}-letters", letters.value, LETTER_BITS)
        inputs, gate = [], 0
        for k in range(len(LETTER_BITS)):
            x, sure = logits(n[k], at[k], bit if own else None)
            inputs.append(x)
            gate = (gate * 4 + sure) % 64
        return word, inputs, gate, bit

    def learn_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Mixer(64, len(LETTER_BITS))
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                _, inputs, gate, bit = letter_inputs(batch.column("word").slice(a, 2000).to_pylist(), True)
                for s in _slices(len(bit), 8192):
                    m.learn([x[s] for x in inputs], gate[s], bit[s])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(m)])], ["m"])

    spelled = map_arrow(rare.select("word"), learn_letters, "m binary").collect()  # a small row a task
    by_letter = context.broadcast(averaged((pickle.loads(r["m"]) for r in spelled), Mixer(64, len(LETTER_BITS))))
    logs = context.broadcast(np.log10(np.array([*counts, n_docs], np.float64) + 1))
    known_end = int(n_docs > 0)
    facts = "struct<id:long,n_tokens:long,n_known:long,n_bytes:long,base:double,score:double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each stretch of a text with its facts, and one for each of its other
        words."""
        log_of, known = logs.value, lexicon.value[0].view(pa.string())
        for batch in _sliced(batches):
            r = Run.of(batch, known, end)
            base = np.where(r.ids <= end, log_of[np.minimum(r.ids, end)], 0)
            there = np.where(r.ids < end, 1, np.where(r.ids == end, known_end, 0))
            size = np.diff(np.append(r.starts, len(r.ids)))
            rare = r.rare.dictionary_encode()
            # The first of a stretch's equal words is spelled; later ones are recalled.
            again, part, word, n = repeats(len(size), r.rare_in, rare.indices.to_numpy().astype(np.int64))
            uid, row = batch.column("uid"), pa.array(r.row)
            n_bytes = np.where(np.append(r.row[1:] != r.row[:-1], True), pc.binary_length(batch.column("text")).to_numpy()[r.row], 0)
            parts = [batch.column("id").take(row), pa.array(size), pa.array(_sums(there, r.starts)), pa.array(n_bytes, pa.int64()), pa.array(_sums(base, r.starts)), pa.array(again)]
            told = pa.StructArray.from_arrays(parts, ["id", "n_tokens", "n_known", "n_bytes", "base", "score"])
            yield pa.RecordBatch.from_arrays([uid.take(row), pa.nulls(len(row), pa.binary()), pa.array(np.zeros(len(row), np.int32)), told], ["uid", "word", "n", "facts"])
            if len(part):
                words = rare.dictionary.view(pa.binary()).take(pa.array(word))
                yield pa.RecordBatch.from_arrays([uid.take(pa.array(r.row[part])), words, pa.array(n.astype(np.int32)), pa.nulls(len(part), told.type)], ["uid", "word", "n", "facts"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(uid, base, score) of words that training never saw, by their spelling."""
        m = by_letter.value
        for batch in batches:
            for a in range(0, batch.num_rows, 20_000):
                b = batch.slice(a, 20_000)
                uid, n, score = b.column("uid"), pa.array(np.zeros(b.num_rows)), np.empty(b.num_rows)
                for k in range(0, b.num_rows, 2000):
                    words = b.column("word").slice(k, 2000).to_pylist()
                    w, inputs, gate, bit = letter_inputs(words, False)
                    score[k : k + 2000] = np.log10((1 - RECALL) * unseen) + np.bincount(w, m.log10_of(inputs, gate, bit), len(words))
                yield pa.RecordBatch.from_arrays([uid, n, pa.array(score)], ["uid", "base", "score"])

    rows = materialise(map_arrow(docs.select("uid", "id", "text", "learn"), run, f"uid long, word binary, n int, facts {facts}"), "lm-words")
    # Both kinds of other words come from one join, in forms that share its exchanges.
    others = rows.where("facts IS NULL AND word IS NOT NULL").select("uid", "word", "n")
    joined = others.join(rare.where("word IS NOT NULL").hint("shuffle_hash"), "word", "left")
    nothing = {"id": F.lit(None).cast("long"), "n_tokens": F.lit(0).cast("long"), "n_bytes": F.lit(0).cast("long")}
    share = F.log10(F.lit((1 - RECALL) * (1 - unseen) / max(n_rare, 1)) * F.col("c"))
    seen = joined.where("c IS NOT NULL").select("uid", F.col("n").cast("long").alias("n_known"), (F.col("n") * F.log10(F.col("c") + 1.0)).alias("base"), share.alias("score"))
    new = map_arrow(joined.where("c IS NULL").select("uid", "word", "n"), spell, "uid long, base double, score double")
    parts = seen.unionByName(new.withColumn("n_known", F.lit(0).cast("long"))).select("uid", "n_known", "base", "score", *[x.alias(c) for c, x in nothing.items()])
    parts = parts.unionByName(rows.where("facts IS NOT NULL").select("uid", "facts.*"))
    more = {"n_known": F.lit(0).cast("long"), "base": F.lit(0.0)} | nothing
    parts = parts.unionByName(by_text.select("uid", "score", *[x.alias(c) for c, x in more.items()]))
    out = parts.groupBy("uid").agg(F.max("id").alias("id"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "n_bytes", "base", "score")])
    base = F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(n_all + v_all + 1)))
    return out.select("id", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "n_bytes")


def lm_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, **options) -> DataFrame:
    """Score every row; learn from those that aren't held out."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    scored = score_texts(rows.withColumn("learn", ~held_out(F.col("id"), modulus)), **options)
    bits = -F.col("score") * F.lit(float(np.log2(10))) / F.greatest("n_bytes", F.lit(1))
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id"), modulus).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", bits.alias("bits_per_byte"))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
