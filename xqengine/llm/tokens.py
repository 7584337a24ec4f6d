"""Encoding with public tokenizer files, by cached pieces of text.

A byte-level BPE never merges across its pre-tokens, so a text's ids are those of its
white-space-separated pieces, put together. ``PieceEncoder`` cuts a text at such places,
looks each piece up in a bounded cache and encodes only pieces it hasn't seen. Pieces that
hold anything unusual go through the library's full ``encode``. Tokenizers of any other
make are used whole, text by text.
"""

from __future__ import annotations

import array
import hashlib
import itertools
import json
from collections.abc import Callable, Iterable

import regex

from xqengine.llm.common import release

#: Distinct pieces that a worker remembers before it starts anew, each with some
#: 200 bytes.
CACHE_PIECES = 700_000
#: Longer ones (in characters) are not remembered.
LONGEST_PIECE = 100
#: Marks that often end a word.
_MARKS = ".,;:!?"
#: What the library's patterns take for white space (Unicode White_Space).
_WS = "\t-\r \x85\xa0  -     　"
_RUNS = regex.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
#: Pieces of these characters need no normalising but lower case (all are NFC-stable).
_PLAIN = regex.compile("[!-;=-~\\xa1-\\xac\\xae-\\u012f\\u0131-\\u024f]+")
_PLAIN_TEXT = regex.compile("[\\s!-;=-~\\xa1-\\xac\\xae-\\u012f\\u0131-\\u024f]*+")
#: The pre-token patterns of the two files' families (fixed values).
_GPT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_CLIP_TEXT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_CLIP = regex.compile(_CLIP_TEXT)


def _byte_chars() -> list[str]:
    """Byte-level BPE's letter for each byte: printable ones stand for themselves."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(i) if i in keep else chr(next(spare)) for i in range(256)]


_BYTE_MAP = {i: c for i, c in enumerate(_byte_chars())}


class _Known(dict):
    """Pieces' ids; those of a piece that isn't there are made and, for a while, kept."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        got = self.make(piece)
        if len(piece) <= LONGEST_PIECE:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = got
        return got


def digest_of_file(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class PieceEncoder:
    """``ids(text)`` as ``Tokenizer.encode(text, add_special_tokens=False)`` or
    sentencepiece's ``encode`` gives them, as an ``array('I')``'s bytes."""

    def __init__(self, path: str):
        self.cache = _Known(self._make)
        self.after = _Known(lambda piece: self._piece(" " + piece))
        if path.endswith(".model"):
            import sentencepiece

            self.kind, self.sp = "whole", sentencepiece.SentencePieceProcessor(model_file=path)
            self._full = lambda t: self.sp.encode(t)
            return
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self._full = lambda t: self.tok.encode(t, add_special_tokens=False).ids
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        pre, norm = made.get("pre_tokenizer") or {}, made.get("normalizer") or {}
        self.kind = "whole"
        plain_added = all(not a["lstrip"] and not a["rstrip"] and not a["normalized"] and not any(c.isspace() for c in a["content"]) and "<" in a["content"] for a in made.get("added_tokens", []))
        if made["model"]["type"] == "BPE" and plain_added and not made.get("truncation") and not made.get("post_processor"):
            if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
                self.kind = "leading"
            elif [n.get("type") for n in norm.get("normalizers", ())] == ["NFC", "Replace", "Lowercase"] and [p.get("type") for p in pre.get("pretokenizers", ())] == ["Split", "ByteLevel"] and pre["pretokenizers"][0]["pattern"] == {"Regex": _CLIP_TEXT}:
                self.kind = "words"
        self._tokenize = self.tok.model.tokenize if self.kind != "whole" else None

    def _make(self, piece: str) -> bytes:
        if self.kind == "words" and piece.isascii() and piece.isalpha():
            return array.array("I", [t.id for t in self._tokenize(piece.lower())]).tobytes()
        return self._piece(piece) if piece else b""

    def _piece(self, piece: str) -> bytes:
        lead = self.kind == "leading" and piece[:1] == " "
        core = piece[1:] if lead else piece
        if not core.isalpha():
            word = core.rstrip(_MARKS)
            if len(word) < len(core) and word.isalpha() and (word.isascii() or _PLAIN.fullmatch(word)):  # a word, then one run of marks
                return (self._after(word) if lead else self._get(word)) + self._get(core[len(word) :])
            if not _PLAIN.fullmatch(core):
                return array.array("I", self._full(piece)).tobytes()
            found = _CLIP.findall(piece.lower()) if self.kind == "words" else _GPT.findall(piece)
        elif core.isascii() or _PLAIN.fullmatch(core):
            low = core.lower()
            found = [piece] if self.kind != "words" else [low] if low.isalpha() else _CLIP.findall(low)
        else:
            return array.array("I", self._full(piece)).tobytes()
        tokenize = self._tokenize
        ids = [t.id for w in found for t in tokenize(w if w.isascii() and w.isalpha() else w.encode().decode("latin-1").translate(_BYTE_MAP))]
        return array.array("I", ids).tobytes()

    def _get(self, piece: str) -> bytes:
        return self.cache[piece]

    def _after(self, piece: str) -> bytes:
        """The ids of a piece that follows a single space."""
        return self.after[piece]

    def parts(self, text: str) -> Iterable[bytes]:
        """The ids of the pieces in order, 4 bytes each in native order."""
        if not text:
            return ()
        if self.kind == "whole":
            return (array.array("I", self._full(text)).tobytes(),)
        if self.kind == "words":
            if "<" not in text and (text.isascii() or _PLAIN_TEXT.fullmatch(text)):  # no special strings: its letters' case is lost anyway
                text = text.lower()
            return map(self.cache.__getitem__, text.replace("\n", " ").split(" "))
        if "  " in text or "\n " in text or " \n" in text or text[-1].isspace() or not text.replace("\n", "").isprintable():
            return map(self.cache.__getitem__, _RUNS.findall(text))
        # Each piece but the first stands after a single space; ``after`` has their ids, by
        # the piece without its space.
        first, *units = text.split(" ")
        return itertools.chain((self.cache[first],), map(self.after.__getitem__, units))

    def count(self, text: str) -> int:
        return sum(map(len, self.parts(text))) >> 2

    def ids(self, text: str) -> bytes:
        return b"".join(self.parts(text))


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def forget() -> None:
    """Empty this worker's caches; tasks that don't encode call it, for workers outlive the
    stage that filled them."""
    for known in _encoders.values():
        for cache in (getattr(known, "cache", {}), getattr(known, "after", {})):
            cache.clear()
    release()
