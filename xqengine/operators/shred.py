"""Documents to nodes: one Arrow pass over each document, without an exchange.

Token rules: text is what stands between tags; text after the last tag is dropped; a close
tag closes the innermost open element whatever its name, and is ignored where none is
open; unterminated comments and processing instructions run to the end; quoted attribute
values may hold '>'; a quote that the rest of the document doesn't close is skipped with
the character behind it; a '<' that nothing closes makes the document an error without
nodes.

Node ids are the token's place times 65536, so a node's id is its place in document order
and an attribute's id lies right after its element's. ``close_id`` ends the interval of a
node's descendants; ``t0`` and ``t1`` bound its string value inside the document's text,
which replaces the join that would gather an element's text.

A document is one row, so all of its tree is known where it is read: one regular
expression cuts it into tokens. In a long document numpy finds depths, parents and ends for
all of them at once; in a short one, where that would mostly be calls, one loop with a stack
does; plain short ones (``_plain``) are put together and numpy has them all at once. Memory follows the longest document (some 30 times its bytes).
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Executors need no copy of this package: the kernel travels with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOKEN = rb"""(?s)<!--.*?-->|<!--.*|<!\[CDATA\[.*?\]\]>|<!\[CDATA\[|<![^>]*>|<\?.*?\?>|<\?.*|</[^>]*>|<(?:[^"'>]++|"[^"]*+"|'[^']*+'|["'].?)*+>|[^<]++|<"""
ATTRIBUTE = rb"""\s([^\s=/>"']+)=(?:"([^"]*)"|'([^']*)')"""
SLOT = 65536
NODE = ("node_id", "kind", "name", "parent_id", "depth", "close_id", "attrs", "text", "is_cdata", "t0", "t1", "c0", "c1", "byte_start", "byte_end")
ATTRS_SQL = "array<struct<name:string,value:string,raw:string>>"
NODE_SQL = f"node_id long, kind string, name string, parent_id long, depth int, close_id long, attrs {ATTRS_SQL}, text string, is_cdata boolean, t0 long, t1 long, c0 long, c1 long, byte_start long, byte_end long"
#: What the store keeps besides: on every row the first 64 bits of its document's digest, on a
#: document's first row the digest and what there is to know of its tags.
STORED_SQL = "version long, content_hash string, tag_names array<string>, n_elements long, max_depth int"
_PIECE = 1 << 19
#: Rows that are sorted by name together for the store, and that leave for the JVM at once.
_RUN, _LEAVE = 1 << 18, 1 << 14
#: Documents of so many bytes at most are short; so many tags of a run are remembered.
_SHORT, _TAGS = 1 << 15, 1 << 14
_INTS = ("node_id", "parent_id", "depth", "close_id", "t0", "t1", "c0", "c1", "byte_start", "byte_end")
_LISTS = ("kind", "name", "attrs", "text", "is_cdata", "doc_text")
_ROOT, _TEXT, _COMMENT, _CDATA, _OPENER, _DOCTYPE, _PI, _CLOSE, _SELF, _OPEN, _BAD = range(11)
_TOKEN_KINDS = ("root", "text", "comment", "cdata", "opener", "doctype", "pi", "close", "selfclose", "open", "bad")
_NODE_KINDS = ("root", "text", "comment", "text", "", "", "pi", "", "element", "element", "")
_REFERENCE = re.compile(r"&(?:(amp|lt|gt|apos|quot)|#([0-9]{1,9})|#[xX]([0-9A-Fa-f]{1,7}));")
_DECLARATION = re.compile(rb"<\?xml[?>\s]").match
_PI_PARTS = re.compile(rb"(?s)([^?>\s]*)\s*(.*?)(?:\?>)?\Z").match
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "apos": "'", "quot": '"'}


def unsized(df: DataFrame) -> DataFrame:
    """``df`` for joins by sorting: Spark takes a document's many nodes for a few bytes of its
    table, and would broadcast millions of rows from the driver."""
    return df.hint("merge")


@dataclass
class Corpus:
    """Shredded documents: ``docs`` (doc_id, content), ``nodes`` (doc_id, NODE), ``texts``
    (doc_id, doc_text) and ``errors`` (doc_id, error); ``rows`` is what the last three are
    read from, where there is such a table. ``only`` is the (expression, mode) that a corpus
    which isn't kept was shredded for: its values can be found where the documents lie.
    ``stored`` gives the rows with STORED_SQL, in runs sorted by name, in a pass of its own."""

    docs: DataFrame
    nodes: DataFrame
    texts: DataFrame
    errors: DataFrame
    rows: DataFrame | None = None
    only: tuple[str, str] | None = None
    stored: Callable[[], DataFrame] | None = None

    def __post_init__(self) -> None:
        self.docs, self.nodes, self.texts, self.errors = map(unsized, (self.docs, self.nodes, self.texts, self.errors))

    @classmethod
    def of(cls, docs: DataFrame, rows: DataFrame) -> Corpus:
        error = F.struct(F.col("name").alias("kind"), F.col("byte_start").alias("offset"), F.col("text").alias("message"))
        return cls(
            docs,
            rows.where("kind <> 'error'").select("doc_id", *NODE),
            rows.where("kind = 'root'").select("doc_id", "doc_text"),
            rows.where("kind = 'error'").select("doc_id", error.alias("error")),
            rows,
        )

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Corpus:
        """Keep the rows for several queries, dealt out by document."""
        if self.rows is not None:
            return Corpus.of(self.docs, self.rows.repartition("doc_id").persist(level))
        return Corpus(self.docs, self.nodes.repartition("doc_id").persist(level), self.texts.repartition("doc_id").persist(level), self.errors)

    def unpersist(self) -> None:
        for kept in (self.nodes, self.texts) if self.rows is None else (self.rows,):
            kept.unpersist()


def decode(raw: bytes) -> str:
    """Text with the five named and all numeric character references decoded, once; others
    stay as they are."""
    text = raw.decode("utf-8", "replace")
    return _REFERENCE.sub(_referred, text) if "&" in text else text


def _referred(m: re.Match) -> str:
    if m[1]:
        return _NAMED[m[1]]
    n = int(m[2]) if m[2] else int(m[3], 16)
    return chr(n) if 0 < n < 0xD800 or 0xDFFF < n < 0x110000 else m[0]


@dataclass
class Tokens:
    """A document's tokens in order, as arrays; places count from 1."""

    raw: bytes
    kind: np.ndarray
    start: np.ndarray
    end: np.ndarray
    depth: np.ndarray
    count: int

    @classmethod
    def of(cls, raw: bytes, find: Callable) -> Tokens:
        at = np.array([m.end() for m in find(raw)], np.int64)
        n = len(at)
        start = np.concatenate([np.zeros(min(n, 1), np.int64), at[:-1]])
        b = np.frombuffer(raw + b"\0\0\0\0", np.uint8)
        first, second, third = b[start], b[start + 1], b[start + 2]
        tag, size = first == 60, at - start
        bang = tag & (second == 33)
        kind = np.where(tag, np.where((b[at - 2] == 47) & (b[at - 1] == 62), _SELF, _OPEN), _TEXT)
        kind[tag & (second == 47)] = _CLOSE
        kind[tag & (second == 63)] = _PI
        kind[bang] = _DOCTYPE
        kind[bang & (third == 45) & (b[start + 3] == 45)] = _COMMENT
        kind[tag & (size == 1)] = _BAD
        for i in np.flatnonzero(bang & (third == 91)):
            if raw.startswith(b"<![CDATA[", start[i]):
                kind[i] = _CDATA if raw.endswith(b"]]>", start[i] + 9, at[i]) else _OPENER
        if n and kind[-1] == _TEXT:
            kind, start, at = kind[:-1], start[:-1], at[:-1]
        step = (kind == _OPEN).astype(np.int64) - (kind == _CLOSE)
        s = np.cumsum(step)
        after = s - np.minimum(0, np.minimum.accumulate(s)) if len(s) else s
        return cls(raw, kind, start, at, after - (kind == _OPEN), n)

    def bad(self) -> int | None:
        """The offset of a '<' that nothing closes."""
        at = np.flatnonzero(self.kind == _BAD)
        return int(self.start[at[0]]) if len(at) else None

    def chars(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends in characters."""
        if self.raw.isascii():
            return self.start, self.end
        lead = np.zeros(len(self.raw) + 1, np.int64)
        np.cumsum((np.frombuffer(self.raw, np.uint8) & 0xC0) != 0x80, out=lead[1:])
        return lead[self.start], lead[self.end]

    def parents(self) -> np.ndarray:
        """The place of each token's parent; 0 is the root."""
        n = len(self.kind) + 1
        opens = np.flatnonzero(self.kind == _OPEN)
        key = np.sort(self.depth[opens] * n + opens)
        if not len(key):
            return np.zeros(n - 1, np.int64)
        i = np.searchsorted(key, (self.depth - 1) * n + np.arange(n - 1)) - 1
        found = (i >= 0) & (key[i] // n == self.depth - 1)
        return np.where(found, key[i] % n + 1, 0)

    def closes(self) -> np.ndarray:
        """For each open tag the index of the token that closes it, or -1."""
        order = np.argsort(self.depth, kind="stable")
        out = np.full(len(order), -1, np.int64)
        a, b = order[:-1], order[1:]
        pair = (self.depth[a] == self.depth[b]) & (self.kind[a] == _OPEN) & (self.kind[b] == _CLOSE)
        out[a[pair]] = b[pair]
        return out


class _Rows:
    """Node rows of several documents, by column."""

    def __init__(self, names: frozenset[str] | None, known: dict | None = None):
        self.cols: dict[str, list] = {c: [] for c in (*NODE, "doc_text")}
        self.counts: list[int] = []
        self.names = names
        self.finders = re.compile(TOKEN).finditer, re.compile(ATTRIBUTE).findall
        self.named = re.compile(rb"[^\s/>]*").match
        self.known: dict[bytes, tuple] = {} if known is None else known
        self.ints: dict[str, list[int]] = {c: [] for c in _INTS}
        self.held = [*self.ints.values(), *(self.cols[c] for c in _LISTS[:-1])]

    def add(self, **part) -> None:
        n = len(part["node_id"])
        self.settle()
        for c, held in self.cols.items():
            held.extend(part.get(c) or [None] * n) if c in _LISTS else held.append(part[c])

    def settle(self) -> None:
        """Short documents' numbers become an array behind those that are there."""
        if self.ints["node_id"]:
            for c, x in self.ints.items():
                self.cols[c].append(np.array(x, np.int64))
                x.clear()

    def numbers(self, c: str) -> list[int]:
        return [*(x for part in self.cols[c] for x in part.tolist()), *self.ints[c]]

    def tag(self, raw: bytes, a: int, b: int) -> tuple[str, list, list]:
        """An open tag's name, its attributes, and those that are nodes with their number."""
        name = self.named(raw, a + 1)[0].decode("utf-8", "replace")
        attrs = [(x.decode("utf-8", "replace"), decode(y or z), (y or z).decode("utf-8", "replace")) for x, y, z in self.finders[1](raw, a, b)] if raw.find(b"=", a, b) > 0 else []
        return name, attrs, [(i, x, y) for i, (x, y, _) in enumerate(attrs, 1) if x != "xmlns" and not x.startswith("xmlns:")]

    def short(self, raw: bytes) -> bool:
        """``document`` for a short one, by a loop with a stack; False: it has an error."""
        ends = [m.end() for m in self.finders[0](raw)]
        count, low, add, total = len(ends), None, 0, 0
        if ends and raw[(ends[-2] if count > 1 else 0)] != 60:
            ends.pop()
        if not raw.isascii():
            lead = np.zeros(len(raw) + 1, np.int64)
            np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, out=lead[1:])
            low = lead[ends].tolist()
        last_b = ends[-1] if ends else 0
        last_c = low[-1] if low else 0 if low is not None else last_b
        rows, spoken = [[0, -1, -1, 1 << 62, 0, 0, 0, last_c, 0, last_b, "root", None, None, None, False]], []
        open_rows, place, a, ca = [], 0, 0, 0
        parent, depth = 0, 0
        known = self.known
        for at, b in enumerate(ends):
            cb = b if low is None else low[at]
            place += SLOT
            if raw[a] != 60:
                x = decode(raw[a:b])
                spoken.append(x)
                add = total + len(x)
                rows.append([place, parent, depth, place + SLOT - 1, total, add, ca, cb, a, b, "text", None, None, x, False])
                total = add
            elif b - a == 1:
                return False
            elif (second := raw[a + 1]) == 47:
                if open_rows:
                    row, n = open_rows.pop()
                    row = rows[row:n]
                    row[0][3], row[0][5] = place, total
                    for r in row:
                        r[7], r[9] = cb, b
                    parent, depth = row[0][1], depth - 1
            elif second == 63:
                m = _PI_PARTS(raw[a + 2 : b])
                name = m[1].decode("utf-8", "replace")
                if name != "xml":
                    rows.append([place, parent, depth, place + SLOT - 1, total, total, ca, cb, a, b, "pi", name, None, m[2].decode("utf-8", "replace"), False])
            elif second == 33:
                if raw.startswith(b"<!--", a):
                    x = raw[a + 4 : b - 3 if raw.endswith(b"-->", a + 4, b) else b].decode("utf-8", "replace")
                    rows.append([place, parent, depth, place + SLOT - 1, total, total, ca, cb, a, b, "comment", None, None, x, False])
                elif raw.startswith(b"<![CDATA[", a) and raw.endswith(b"]]>", a + 9, b):
                    x = raw[a + 9 : b - 3].decode("utf-8", "replace")
                    if x:
                        spoken.append(x)
                        add = total + len(x)
                        rows.append([place, parent, depth, place + SLOT - 1, total, add, ca, cb, a, b, "text", None, None, x, True])
                        total = add
            else:
                form = raw[a:b]
                if (tag := known.get(form)) is None:
                    if len(known) >= _TAGS:
                        known.clear()
                    tag = known[form] = self.tag(raw, a, b)
                name, attrs, own = tag
                kept, first = self.names is None or name in self.names, len(rows)
                opens = not form.endswith(b"/>")
                rows.append([place, parent, depth, place + SLOT - 1, total, total, ca, cb, a, b, "element", name, attrs, None, False])
                if kept:
                    for i, x, y in own:
                        rows.append([place + i, place, depth + 1, place + i, total, total, ca, cb, a, b, "attribute", x, None, y, False])
                else:
                    rows[-1][10] = ""
                if opens:
                    open_rows.append((first, len(rows)))
                    parent, depth = place, depth + 1
            a, ca = b, cb
        for first, n in open_rows:
            rows[first][3], rows[first][5] = (count + 1) * SLOT, total
            for r in rows[first:n]:
                r[7], r[9] = last_c, last_b
        rows[0][5] = total
        if self.names is not None:
            rows = [r for r in rows if r[10]]
        for held, x in zip(self.held, zip(*rows, strict=True), strict=True):
            held.extend(x)
        self.cols["doc_text"].append("".join(spoken))
        self.cols["doc_text"].extend([None] * (len(rows) - 1))
        self.counts.append(len(rows))
        return True

    def document(self, raw: bytes, strict: bool) -> None:
        if len(raw) <= _SHORT and self.short(raw):
            return
        t = Tokens.of(raw, self.finders[0])
        if (at := t.bad()) is not None:
            if strict:
                raise ValueError(f"UnclosedTag at byte {at}")
            zero = np.zeros(1, np.int64)
            self.add(node_id=zero, kind=["error"], name=["UnclosedTag"], parent_id=zero, depth=zero, close_id=zero, text=["unclosed tag"], t0=zero, t1=zero, c0=zero, c1=zero, byte_start=zero + at, byte_end=zero + at)
            self.counts.append(1)
            return
        n = len(t.kind)
        c0, c1 = t.chars()
        parent, close = t.parents(), t.closes()
        kinds = t.kind.tolist()
        name, text, attrs = [None] * n, [None] * n, [None] * n
        length = np.zeros(n + 1, np.int64)
        spoken: list[str] = []
        for i, (k, a, b) in enumerate(zip(kinds, t.start.tolist(), t.end.tolist(), strict=True)):
            if k == _TEXT or k == _CDATA:
                x = decode(raw[a:b]) if k == _TEXT else raw[a + 9 : b - 3].decode("utf-8", "replace")
                text[i], length[i + 1] = x, len(x)
                spoken.append(x)
            elif k >= _SELF:
                name[i], attrs[i], _ = self.tag(raw, a, b)
            elif k == _COMMENT:
                text[i] = raw[a + 4 : b - 3 if raw.endswith(b"-->", a + 4, b) else b].decode("utf-8", "replace")
            elif k == _PI:
                m = _PI_PARTS(raw[a + 2 : b])
                name[i], text[i] = m[1].decode("utf-8", "replace"), m[2].decode("utf-8", "replace")
        run = np.cumsum(length)
        opened, shut = t.kind == _OPEN, close >= 0
        place = np.arange(1, n + 1) * SLOT

        def end(own: np.ndarray, last: int) -> np.ndarray:
            return np.where(shut, own[close], np.where(opened, last, own)) if n else own

        kept = np.isin(t.kind, (_TEXT, _COMMENT, _CDATA, _PI, _SELF, _OPEN))
        for i in np.flatnonzero(kept):
            k = kinds[i]
            if (k == _PI and name[i] == "xml") or (k in (_TEXT, _CDATA) and not text[i]) or (self.names is not None and k >= _SELF and name[i] not in self.names):
                kept[i] = False
        at = np.flatnonzero(kept)
        pick = at.tolist()
        last_c, last_b = (int(c1[-1]), int(t.end[-1])) if n else (0, 0)
        cols = {
            "node_id": place[at],
            "parent_id": parent[at] * SLOT,
            "depth": t.depth[at],
            "close_id": np.where(shut, (close + 1) * SLOT, np.where(opened, (t.count + 1) * SLOT, place + SLOT - 1))[at],
            "t0": run[:-1][at],
            "t1": end(run[1:], int(run[-1]))[at],
            "c0": c0[at],
            "c1": end(c1, last_c)[at],
            "byte_start": t.start[at],
            "byte_end": end(t.end, last_b)[at],
        }
        lists = {"kind": [_NODE_KINDS[kinds[i]] for i in pick], "name": [name[i] for i in pick], "attrs": [attrs[i] for i in pick], "text": [text[i] for i in pick], "is_cdata": [kinds[i] == _CDATA for i in pick]}
        one = lambda x: np.array([x], np.int64)
        root = {"node_id": one(0), "parent_id": one(-1), "depth": one(-1), "close_id": one(1 << 62), "t0": one(0), "t1": run[-1:], "c0": one(0), "c1": one(last_c), "byte_start": one(0), "byte_end": one(last_b)}
        # Each element's attributes follow it as nodes.
        own = [(j, i, x, y) for j, p in enumerate(lists["attrs"]) if p for i, (x, y, _) in enumerate(p) if x != "xmlns" and not x.startswith("xmlns:")]
        if own:
            of, number, names, values = zip(*own, strict=True)
            j = np.array(of)
            ids = cols["node_id"][j] + 1 + np.array(number)
            more = {c: x[j] for c, x in cols.items()} | {"node_id": ids, "parent_id": cols["node_id"][j], "depth": cols["depth"][j] + 1, "close_id": ids, "t1": cols["t0"][j]}
            order = np.argsort(np.concatenate([cols["node_id"], ids]))
            cols = {c: np.concatenate([x, more[c]])[order] for c, x in cols.items()}
            k, turn = len(own), order.tolist()
            added = {"kind": ["attribute"] * k, "name": list(names), "attrs": [None] * k, "text": list(values), "is_cdata": [False] * k}
            lists = {c: [both[i] for i in turn] for c, x in lists.items() for both in (x + added[c],)}
        m = len(cols["node_id"])
        self.add(**root, kind=["root"], is_cdata=[False], doc_text=["".join(spoken)])
        self.add(**cols, **lists)
        self.counts.append(m + 1)

    def batch(self, ids: pa.Array) -> pa.RecordBatch:
        self.settle()
        owner = np.repeat(np.arange(len(self.counts)), self.counts)
        arrays = [ids.take(pa.array(owner))]
        for c, held in self.cols.items():
            if c == "attrs":
                sizes = np.array([0 if x is None else len(x) for x in held], np.int64)
                flat = [y for x in held if x for y in x]
                parts = [pa.array([y[i] for y in flat], pa.string()) for i in range(3)]
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.array([*(x is None for x in held), False]))
                arrays.append(pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, ["name", "value", "raw"])))
            elif c == "is_cdata":
                arrays.append(pa.array(held, pa.bool_()))
            elif c in ("kind", "name", "text", "doc_text"):
                arrays.append(pa.array(held, pa.string()))
            else:
                x = np.concatenate(held) if held else np.zeros(0, np.int64)
                kind = pa.int32() if c == "depth" else pa.int64()
                arrays.append(pa.array(x.astype(np.int32) if c == "depth" else x, kind, mask=x < 0 if c == "parent_id" else None))
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", *self.cols])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Runs of (ids, contents) of half a megabyte; a longer document is a run of its own."""
    for batch in batches:
        ids, contents = batch.column(0), batch.column(1).cast(pa.binary())
        a = size = 0
        held: list[bytes] = []
        for i, x in enumerate(contents):
            held.append(x.as_py() or b"")
            size += len(held[-1])
            if size >= _PIECE:
                yield ids.slice(a, len(held)), held
                a, size, held = i + 1, 0, []
        if held:
            yield ids.slice(a, len(held)), held


def _strings(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Consecutive pieces of ``data``, which end at ``ends``."""
    return pa.StringArray.from_buffers(len(ends), pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data.tobytes()))


def _plain(ids: pa.Array, contents: list[bytes], rows: _Rows) -> tuple[pa.RecordBatch | None, np.ndarray, list[int], list[int]]:
    """Nodes of the plain documents among several, found for all of them at once: short ASCII,
    nothing but text without references, an XML declaration and tags that close what is open.
    The rows, their number by document, the places of these documents and of the others."""
    find, ends, number, places, others = rows.finders[0], [], [], [], []
    for i, raw in enumerate(contents):
        pis = raw.count(b"<?")
        if raw and len(raw) <= _SHORT and raw.isascii() and b"&" not in raw and b"<!" not in raw and (not pis or (pis == 1 and _DECLARATION(raw))):
            n = len(ends)
            ends.extend([m.end() for m in find(raw)])
            number.append(len(ends) - n)
            places.append(i)
        else:
            others.append(i)
    if not places:
        return None, np.zeros(0, np.int64), [], others
    whole = b"".join([contents[i] for i in places])
    b = np.frombuffer(whole + b"\0\0", np.uint8)
    size = np.array([len(contents[i]) for i in places], np.int64)
    base, number = np.cumsum(size) - size, np.array(number, np.int64)
    doc, first = np.repeat(np.arange(len(places)), number), np.cumsum(number) - number
    end = np.array(ends, np.int64) + base[doc]
    start = np.append(0, end[:-1])
    tag, second = b[start] == 60, b[start + 1]
    kind = np.where(tag, np.where(b[end - 2] == 47, _SELF, _OPEN), _TEXT)
    kind[tag & (second == 47)] = _CLOSE
    kind[tag & (second == 63)] = _PI
    kind[tag & (end - start == 1)] = _BAD
    step = (kind == _OPEN).astype(np.int64) - (kind == _CLOSE)
    after = np.cumsum(step)
    after -= np.repeat(after[first] - step[first], number)
    last = first + number - 1
    fit = (np.minimum.reduceat(after, first) >= 0) & (after[last] == 0) & ~np.logical_or.reduceat(kind == _BAD, first)
    dropped = kind[last] == _TEXT  # text behind the last tag
    fit &= ~dropped | (number > 1)
    here = fit[doc]
    here[last[dropped]] = False
    if not fit.all():
        others = sorted(others + [places[i] for i in np.flatnonzero(~fit)])
        places = [places[i] for i in np.flatnonzero(fit)]
        if not places:
            return None, np.zeros(0, np.int64), [], others
    place = (np.arange(len(kind)) - first[doc] + 1)[here] * SLOT
    doc, start, end, kind, after = doc[here], start[here], end[here], kind[here], after[here]
    base = base[fit]
    doc = (np.cumsum(fit) - 1)[doc]
    n, docs = len(kind), len(places)
    first = np.searchsorted(doc, np.arange(docs))
    last = np.append(first[1:], n) - 1
    depth = after - (kind == _OPEN)
    # Of one depth, opening and closing tags take turns.
    pair = np.flatnonzero((kind == _OPEN) | (kind == _CLOSE))
    pair = pair[np.argsort(depth[pair], kind="stable")]
    opens, closes = pair[::2], pair[1::2]
    shut = np.arange(n)
    shut[opens] = closes
    key = depth[opens] * n + opens
    up = np.searchsorted(key, (depth - 1) * n + np.arange(n)) - 1 if len(key) else np.zeros(n, np.int64)
    parent = np.where(depth > 0, place[opens[up]] if len(key) else 0, 0)
    said = np.where(kind == _TEXT, end - start, 0)
    run = np.append(0, np.cumsum(said))
    t0, t1, total = run[:-1] - run[first][doc], run[1:][shut] - run[first][doc], run[last + 1] - run[first]
    # What there is to know of each distinct tag.
    tags = np.flatnonzero((kind == _OPEN) | (kind == _SELF))
    known, codes, forms = rows.known, {}, []
    of = np.zeros(n, np.int64)
    for j, x, y in zip(tags.tolist(), start[tags].tolist(), end[tags].tolist(), strict=True):
        form = whole[x:y]
        if (c := codes.get(form)) is None:
            if (found := known.get(form)) is None:
                if len(known) >= _TAGS:
                    known.clear()
                found = known[form] = rows.tag(form, 0, len(form))
            c = codes[form] = len(forms)
            forms.append(found)
        of[j] = c
    kept = np.array([rows.names is None or x in rows.names for x, _, _ in forms], bool)
    owned = np.array([len(x) for _, _, x in forms], np.int64)
    own = [x for _, _, attrs in forms for x in attrs]
    element = np.zeros(n, bool)
    element[tags] = kept[of[tags]]
    size = (element | (kind == _TEXT)).astype(np.int64)
    size[element] += owned[of[element]]
    # The rows: a document's root, its nodes, behind each element its attributes.
    at = np.cumsum(size) - size + doc + 1
    total_rows = int(size.sum()) + docs
    counts = np.bincount(doc, size, docs).astype(np.int64) + 1
    root = np.cumsum(counts) - counts
    node = np.flatnonzero(size)
    token = np.zeros(total_rows, np.int64)
    token[root] = first
    token[at[node]] = node
    of_attr = np.flatnonzero(size > 1)
    many = size[of_attr] - 1
    owner = np.repeat(of_attr, many)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    attr = at[owner] + 1 + nth
    token[attr] = owner
    value = (np.cumsum(owned) - owned)[of[owner]] + nth
    ids_of = place[token]
    cols = {"node_id": ids_of.copy(), "parent_id": parent[token], "depth": depth[token], "close_id": np.where(shut != np.arange(n), place[shut], place + SLOT - 1)[token], "t0": t0[token], "t1": t1[token]}
    lo, hi = (start - base[doc])[token], (end[shut] - base[doc])[token]
    cols["node_id"][attr] += np.array([i for i, _, _ in own], np.int64)[value] if own else 0
    cols["close_id"][attr], cols["parent_id"][attr], cols["t1"][attr] = cols["node_id"][attr], ids_of[attr], cols["t0"][attr]
    cols["depth"][attr] += 1
    for c, x in (("node_id", 0), ("parent_id", -1), ("depth", -1), ("close_id", 1 << 62), ("t0", 0), ("t1", total)):
        cols[c][root] = x
    lo[root], hi[root] = 0, end[last] - base
    cols |= {"c0": lo, "c1": hi, "byte_start": lo, "byte_end": hi}
    text = np.flatnonzero(kind == _TEXT)
    inside = np.zeros(len(whole) + 1, np.int8)
    np.add.at(inside, start[text], 1)
    np.add.at(inside, end[text], -1)
    spoken = b[: len(whole)][np.cumsum(inside[:-1]) > 0]
    values = pa.concat_arrays([_strings(spoken, np.cumsum(said[text])), pa.array([x for _, _, x in own], pa.string())])
    names = pa.array([*(x for x, _, _ in forms), *(x for _, x, _ in own)], pa.string())
    parts = [x for _, attrs, _ in forms for x in attrs]
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for _, x, _ in forms])).astype(np.int32)), pa.StructArray.from_arrays([pa.array([x[i] for x in parts], pa.string()) for i in range(3)], ["name", "value", "raw"]))

    def chosen(values: pa.Array, *some: tuple[np.ndarray, np.ndarray]) -> pa.Array:
        pick, none = np.zeros(total_rows, np.int64), np.ones(total_rows, bool)
        for where, what in some:
            pick[where], none[where] = what, False
        return values.take(pa.array(pick, mask=none))

    held = np.flatnonzero(element)
    kinds = np.ones(total_rows, np.int64)
    kinds[root], kinds[at[held]], kinds[attr] = 0, 2, 3
    cols |= {
        "kind": pa.array(["root", "text", "element", "attribute"]).take(pa.array(kinds)),
        "name": chosen(names, (at[held], of[held]), (attr, value + len(forms))),
        "attrs": chosen(lists, (at[held], of[held])),
        "text": chosen(values, (at[text], np.arange(len(text))), (attr, value + len(text))),
        "is_cdata": pa.array(np.zeros(total_rows, bool)),
        "doc_text": chosen(_strings(spoken, run[last + 1]), (root, np.arange(docs))),
    }
    cols["depth"] = cols["depth"].astype(np.int32)
    cols["parent_id"] = pa.array(cols["parent_id"], mask=cols["parent_id"] < 0)
    made = [cols[c] if isinstance(cols[c], pa.Array) else pa.array(cols[c]) for c in rows.cols]
    owner = ids.take(pa.array(np.repeat(np.array(places), counts)))
    return pa.RecordBatch.from_arrays([owner, *made], ["doc_id", *rows.cols]), counts, places, others


def _shredded(ids: pa.Array, contents: list[bytes], names: frozenset[str] | None, known: dict, strict: bool) -> Iterator[tuple[pa.RecordBatch, list[int], list[bytes]]]:
    """Batches of documents' rows with each document's number of rows and the contents: the
    plain documents together, the others one by one."""
    rows = _Rows(names, known)
    batch, counts, places, others = _plain(ids, contents, rows)
    if batch is not None:
        yield batch, counts, [contents[i] for i in places]
    if others:
        for i in others:
            rows.document(contents[i], strict)
        yield rows.batch(ids.take(pa.array(others))), rows.counts, [contents[i] for i in others]


def _described(batch: pa.RecordBatch, counts: list[int], contents: list[bytes]) -> pa.RecordBatch:
    """``batch`` with the columns of STORED_SQL."""
    counts, n = np.array(counts), batch.num_rows
    owner, first = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts) - counts
    other = np.ones(n, bool)
    other[first] = False
    digests = [hashlib.sha256(x).digest() for x in contents]
    version = np.array([int.from_bytes(d[:8], "big", signed=True) for d in digests], np.int64)[owner]
    place = pa.array(np.where(other, 0, owner), mask=other)
    kind, name = batch.column("kind").to_numpy(zero_copy_only=False), batch.column("name").dictionary_encode()
    known = name.dictionary.to_pylist()
    tags = sorted(known)
    places = {x: i for i, x in enumerate(tags)}
    rank = np.array([places[x] for x in known], np.int64)
    tag = np.flatnonzero(kind == "element")
    pair = np.unique(owner[tag] * max(1, len(tags)) + rank[name.indices.to_numpy(zero_copy_only=False)[tag].astype(np.int64)]) if len(tag) else np.zeros(0, np.int64)
    size = np.zeros(n, np.int64)
    size[first] = np.bincount(pair // max(1, len(tags)), minlength=len(counts))
    none = other | (kind == "error")
    ends = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), mask=np.append(none, False))
    names = pa.ListArray.from_arrays(ends, pa.array(tags, pa.string()).take(pa.array(pair % max(1, len(tags)))))
    elements, depth = np.zeros(n, np.int64), np.zeros(len(counts), np.int32)
    elements[first] = np.bincount(owner[tag], minlength=len(counts))
    np.maximum.at(depth, owner[tag], batch.column("depth").to_numpy()[tag])
    more = [pa.array(version), pa.array([d.hex() for d in digests], pa.string()).take(place), names, pa.array(elements, mask=none), pa.array(depth[owner], mask=none)]
    return pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "version", "content_hash", "tag_names", "n_elements", "max_depth"])


def _by_name(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows sorted by kind and name, else in their order."""
    whole = pa.Table.from_batches(held).combine_chunks()
    code = np.zeros(whole.num_rows, np.int64)
    for c in ("kind", "name"):
        x = whole.column(c).combine_chunks().fill_null("").dictionary_encode()
        known = x.dictionary.to_pylist()
        place = {y: i for i, y in enumerate(sorted(known))}
        code = code * len(known) + np.array([place[y] for y in known])[x.indices.to_numpy()]
    order = np.argsort(np.unique(code, return_inverse=True)[1].astype(np.int32), kind="stable")
    yield from whole.take(pa.array(order)).combine_chunks().to_batches(_LEAVE)


def _slim(docs: DataFrame, id_col: str, content_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(content_col), F.lit("")).alias("content"))


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, pos from 1, tok, kind, depth, byte_start, byte_end, c0, c1) of each token; a
    document with a '<' that nothing closes has none."""
    slim = _slim(docs, "doc_id", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(TOKEN).finditer
        for ids, contents in _documents(batches):
            for i, raw in enumerate(contents):
                t = Tokens.of(raw, find)
                if t.bad() is not None:
                    continue
                n = len(t.kind)
                toks = [raw[a:b].decode("utf-8", "replace") for a, b in zip(t.start.tolist(), t.end.tolist(), strict=True)]
                c0, c1 = t.chars()
                cols = [ids.take(pa.array(np.full(n, i))), pa.array(np.arange(1, n + 1)), pa.array(toks, pa.string()), pa.array([_TOKEN_KINDS[k] for k in t.kind], pa.string()), pa.array(t.depth.astype(np.int32)), *map(pa.array, (t.start, t.end, c0, c1))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "pos", "tok", "kind", "depth", "byte_start", "byte_end", "c0", "c1"])

    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, pos long, tok string, kind string, depth int, byte_start long, byte_end long, c0 long, c1 long")


def shred(docs: DataFrame, id_col: str = "doc_id", content_col: str = "content", *, names: tuple[str, ...] | None = None, for_xpath: str | None = None, mode: str = "PERMISSIVE", partitions: int | None = None) -> Corpus:
    """Shred (id, content) rows; null content counts as ''. ``names`` keeps only elements
    of these names (and all else that isn't an element) after the tree is known;
    ``for_xpath`` takes the names from an expression, and keeps all where any element may
    matter. ``partitions`` deals documents out anew before they are shredded, for few files
    with many documents. ``mode``: PERMISSIVE keeps bad documents in ``errors``, FAILFAST raises on the
    first in any job that reads nodes, texts or errors."""
    if for_xpath is not None:
        from xqengine.plans.analyze import selectivity
        from xqengine.plans.parser import parse_xpath

        found = selectivity(parse_xpath(for_xpath)).names
        names = None if found is None else tuple(sorted({*found, *(names or ())}))
    if mode not in ("PERMISSIVE", "FAILFAST"):
        raise ValueError(f"mode is PERMISSIVE or FAILFAST, not {mode!r}")
    slim = _slim(docs, id_col, content_col)
    if partitions:
        slim = slim.repartition(partitions)
    few, strict = None if names is None else frozenset(names), mode == "FAILFAST"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}
        for ids, contents in _documents(batches):
            for batch, _, _ in _shredded(ids, contents, few, known, strict):
                yield batch

    def run_stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}
        held: list[pa.RecordBatch] = []
        for ids, contents in _documents(batches):
            held += [_described(*x) for x in _shredded(ids, contents, few, known, strict)]
            if sum(x.num_rows for x in held) >= _RUN:
                yield from _by_name(held)
                held = []
        if held:
            yield from _by_name(held)

    kind = dict(slim.dtypes)["doc_id"]
    made = Corpus.of(slim, slim.mapInArrow(run, f"doc_id {kind}, {NODE_SQL}, doc_text string"))
    made.only = None if for_xpath is None else (for_xpath, mode)
    made.stored = lambda: slim.mapInArrow(run_stored, f"doc_id {kind}, {NODE_SQL}, doc_text string, {STORED_SQL}")
    return made
