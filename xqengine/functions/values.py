"""XPath 1.0 values as Spark columns: coercions, arithmetic and the string functions.

Spark says that NaN equals NaN and is larger than all else, raises on a division by zero
and rounds halves away from zero, so none of these is used bare.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Python values: a Column needs a session, which an import has not.
NAN, INF = float("nan"), float("inf")
_NUMBER = r"^[ \t\r\n]*[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?[ \t\r\n]*$"
_BLANK = r"[ \t\r\n\f\x0B]+"


def to_number(c: Column, kind: str) -> Column:
    if kind == "number":
        return c
    if kind == "boolean":
        return c.cast("double")
    return F.when(c.rlike(_NUMBER), F.regexp_replace(c, r"[ \t\r\n]", "").cast("double")).otherwise(F.lit(NAN))


def to_boolean(c: Column, kind: str) -> Column:
    if kind == "boolean":
        return c
    if kind == "number":
        return ~F.isnan(c) & (c != 0)
    return F.length(c) > 0


def to_string(c: Column, kind: str) -> Column:
    if kind == "string":
        return c
    if kind == "boolean":
        return F.when(c, "true").otherwise("false")
    size = F.abs(c)
    whole = F.when(size < 1e15, c.cast("bigint").cast("string"))
    digits = F.regexp_replace(F.format_string("%.14e", c), "[.]?0*e", "e")
    shown = F.format_string("%.14e", F.when((size >= 1e-4) & (size < 1e15), c)).try_cast("decimal(38,20)")
    short = F.when(shown.isNotNull(), F.regexp_replace(shown.cast("string"), "[.]?0+$", "")).otherwise(digits)
    return F.when(F.isnan(c), "NaN").when(c == F.lit(INF), "Infinity").when(c == F.lit(-INF), "-Infinity").when((size < 1e15) & (c == F.floor(c)), whole).otherwise(short)


def compare(op: str, a: Column, ka: str, b: Column, kb: str) -> Column:
    """Scalars: boolean before number before string; order compares numbers."""
    if op in ("=", "!="):
        if "boolean" in (ka, kb):
            same = to_boolean(a, ka) == to_boolean(b, kb)
        elif "number" in (ka, kb):
            x, y = to_number(a, ka), to_number(b, kb)
            same = ~F.isnan(x) & ~F.isnan(y) & (x == y)
        else:
            same = a == b
        return same if op == "=" else ~same
    x, y = to_number(a, ka), to_number(b, kb)
    test = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    return ~F.isnan(x) & ~F.isnan(y) & test


def arithmetic(op: str, a: Column, b: Column) -> Column:
    if op in ("+", "-", "*"):
        return {"+": a + b, "-": a - b, "*": a * b}[op]
    odd = F.isnan(a) | F.isnan(b)
    if op == "div":
        zero = F.when(odd | (a == 0), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
        return F.when(b == 0, zero).otherwise(a / F.when(b != 0, b))
    infinite = (F.abs(a) == F.lit(INF)) | (b == 0)
    return F.when(odd | infinite, F.lit(NAN)).when(F.abs(b) == INF, a).otherwise(a % F.when(b != 0, b))


def _kept(c: Column, how: Column) -> Column:
    """``how`` where a bigint can hold the value; NaN, infinities and large ones stay."""
    return F.when(F.isnan(c) | (F.abs(c) >= 2.0**52), c).otherwise(how.cast("double"))


def floor(c: Column) -> Column:
    return _kept(c, F.floor(c))


def ceiling(c: Column) -> Column:
    return _kept(c, F.ceil(c))


def round_half_up(c: Column) -> Column:
    return _kept(c, F.floor(c + 0.5))


def substring(s: Column, start: Column, length: Column | None) -> Column:
    """Characters whose position p has round(start) <= p < round(start) + round(length)."""
    first = round_half_up(start)
    last = F.lit(INF) if length is None else first + round_half_up(length)
    begin = F.greatest(first, F.lit(1.0))
    size = F.least(last, F.lit(2e9)) - begin
    bad = F.isnan(first) | F.isnan(last) | ~(size > 0) | (begin > 2e9)
    return F.when(bad, "").otherwise(F.substr(s, F.least(begin, F.lit(2e9)).cast("int"), F.greatest(F.least(size, F.lit(2e9)), F.lit(0.0)).cast("int")))


def substring_before(a: Column, b: Column) -> Column:
    at = F.position(b, a)
    return F.when((at > 0) & (F.length(b) > 0), F.substr(a, F.lit(1), at - 1)).otherwise("")


def substring_after(a: Column, b: Column) -> Column:
    at = F.position(b, a)
    return F.when(F.length(b) == 0, a).when(at > 0, F.substr(a, at + F.length(b))).otherwise("")


def normalize_space(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, _BLANK, " "))


def translate(s: Column, old: Column, new: Column) -> Column:
    """Columns on all sides: each character of ``s`` by its first place in ``old``."""
    chars = F.split(s, "")
    put = F.transform(chars, lambda ch: F.when(ch == "", "").when(F.position(ch, old) > 0, F.substr(new, F.position(ch, old), F.lit(1))).otherwise(ch))
    return F.array_join(put, "")


_NAMED = (("amp", "&"), ("lt", "<"), ("gt", ">"), ("apos", "\\'"), ("quot", '"'))


def _code_point(n: str, rest: str) -> str:
    fits = f"({n} BETWEEN 1 AND 55295 OR {n} BETWEEN 57344 AND 1114111)"
    return f"CASE WHEN {fits} THEN concat(decode(unhex(lpad(hex({n}), 8, '0')), 'UTF-32'), {rest}) ELSE concat('&', p) END"


def decode_sql(x: str) -> str:
    """SQL for ``x`` with the five named and all numeric character references decoded,
    once; others stay as they are."""
    named = " ".join(f"WHEN p LIKE '{k};%' THEN concat('{v}', substr(p, {len(k) + 2}))" for k, v in _NAMED)
    after = "substr(p, instr(p, ';') + 1)"
    tens = _code_point("CAST(regexp_extract(p, '^#([0-9]+);', 1) AS BIGINT)", after)
    hexes = _code_point("CAST(conv(regexp_extract(p, '^#[xX]([0-9A-Fa-f]+);', 1), 16, 10) AS BIGINT)", after)
    part = f"CASE {named} WHEN p RLIKE '^#[0-9]{{1,9}};' THEN {tens} WHEN p RLIKE '^#[xX][0-9A-Fa-f]{{1,7}};' THEN {hexes} ELSE concat('&', p) END"
    cut = f"split({x}, '&')"
    return f"CASE WHEN instr({x}, '&') = 0 THEN {x} ELSE concat({cut}[0], array_join(transform(slice({cut}, 2, 1000000000), p -> {part}), '')) END"
