"""XPath 1.0 syntax trees."""

from __future__ import annotations

from dataclasses import dataclass

REVERSE = frozenset({"ancestor", "ancestor-or-self", "preceding", "preceding-sibling"})
AXES = frozenset({"child", "descendant", "descendant-or-self", "parent", "ancestor", "ancestor-or-self", "following-sibling", "preceding-sibling", "following", "preceding", "self", "attribute", "namespace"})


@dataclass(frozen=True)
class Test:
    """kind: name, any, prefix, text, node, comment or pi."""

    kind: str
    name: str | None = None

    def __str__(self) -> str:
        return {"name": f"{self.name}", "any": "*", "prefix": f"{self.name}:*", "text": "text()", "node": "node()", "comment": "comment()", "pi": f"processing-instruction({repr(self.name) if self.name else ''})"}[self.kind]


@dataclass(frozen=True)
class Step:
    axis: str
    test: Test
    preds: tuple[Expr, ...] = ()

    def __str__(self) -> str:
        return f"{self.axis}::{self.test}" + "".join(f"[{p}]" for p in self.preds)


class Expr:
    pass


@dataclass(frozen=True)
class Num(Expr):
    value: float

    def __str__(self) -> str:
        return repr(int(self.value)) if self.value.is_integer() else repr(self.value)


@dataclass(frozen=True)
class Str(Expr):
    value: str

    def __str__(self) -> str:
        return f"'{self.value}'" if "'" not in self.value else f'"{self.value}"'


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr

    def __str__(self) -> str:
        return f"({self.left} {self.op} {self.right})"


@dataclass(frozen=True)
class Negate(Expr):
    arg: Expr

    def __str__(self) -> str:
        return f"(-{self.arg})"


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]

    def __str__(self) -> str:
        return f"{self.name}({', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class Path(Expr):
    """A location path; ``base`` is the filter expression it continues, if any."""

    absolute: bool
    steps: tuple[Step, ...]
    base: Expr | None = None

    def __str__(self) -> str:
        rest = "/".join(map(str, self.steps))
        return f"{self.base}/{rest}" if self.base is not None else ("/" if self.absolute else "") + rest


@dataclass(frozen=True)
class Filter(Expr):
    """``(expr)[preds]``: positions count over the whole set in document order."""

    expr: Expr
    preds: tuple[Expr, ...]

    def __str__(self) -> str:
        return f"({self.expr})" + "".join(f"[{p}]" for p in self.preds)


@dataclass(frozen=True)
class Union(Expr):
    left: Expr
    right: Expr

    def __str__(self) -> str:
        return f"({self.left} | {self.right})"


#: Static types: the functions that give a set, a string, a number or a truth value.
STRING_CALLS = frozenset({"name", "local-name", "namespace-uri", "string", "concat", "substring", "substring-before", "substring-after", "normalize-space", "translate"})
NUMBER_CALLS = frozenset({"position", "last", "count", "sum", "string-length", "number", "floor", "ceiling", "round"})
BOOLEAN_CALLS = frozenset({"contains", "starts-with", "boolean", "not", "true", "false", "lang"})
#: Least and most arguments.
ARITY = {"position": (0, 0), "last": (0, 0), "count": (1, 1), "sum": (1, 1), "id": (1, 1), "name": (0, 1), "local-name": (0, 1), "namespace-uri": (0, 1), "string": (0, 1), "concat": (2, 99), "contains": (2, 2), "starts-with": (2, 2), "substring": (2, 3), "substring-before": (2, 2), "substring-after": (2, 2), "string-length": (0, 1), "normalize-space": (0, 1), "translate": (3, 3), "boolean": (1, 1), "not": (1, 1), "true": (0, 0), "false": (0, 0), "lang": (1, 1), "number": (0, 1), "floor": (1, 1), "ceiling": (1, 1), "round": (1, 1)}


def type_of(e: Expr) -> str:
    """nodeset, string, number or boolean: known before any data is read."""
    if isinstance(e, (Path, Filter, Union)):
        return "nodeset"
    if isinstance(e, Num | Negate):
        return "number"
    if isinstance(e, Str):
        return "string"
    if isinstance(e, Binary):
        return "number" if e.op in ("+", "-", "*", "div", "mod") else "boolean"
    if e.name == "id":
        return "nodeset"
    return "string" if e.name in STRING_CALLS else "number" if e.name in NUMBER_CALLS else "boolean"


def uses_position(e: Expr) -> bool:
    """Whether position() or last() of this very context occurs."""
    if isinstance(e, Call):
        return e.name in ("position", "last") or any(map(uses_position, e.args))
    if isinstance(e, (Binary, Union)):
        return uses_position(e.left) or uses_position(e.right)
    if isinstance(e, Negate):
        return uses_position(e.arg)
    if isinstance(e, Filter):
        return uses_position(e.expr)
    return isinstance(e, Path) and e.base is not None and uses_position(e.base)


def positional(pred: Expr) -> bool:
    return type_of(pred) == "number" or uses_position(pred)
