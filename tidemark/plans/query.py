"""The index query language, compiled to Spark columns.

``and``, ``or`` and ``not`` share ONE precedence level and bind to the left:
``a or b and c`` is ``(a or b) and c``, and ``not a and b`` is ``(not a) and b``.
Brackets group. ``true`` stands alone. Negative numbers, and ``_``, ``-`` and ``.``
inside names, are accepted as an extension.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import exprs

TOKEN = re.compile(r"""[ \t]*(?:(?P<string>"(?:[^"\\\n]|\\.)*")|(?P<double>-?[0-9]+\.[0-9]*)|(?P<int>-?[0-9]+)|(?P<op>=~|>=|<=|=|>|<)|(?P<bracket>[()])|(?P<name>[A-Za-z0-9_][A-Za-z0-9_.-]*))""")
WORDS = {"and", "or", "not", "true", "nil", "tagged"}


class QuerySyntaxError(ValueError):
    pass


@dataclass(frozen=True)
class True_:
    pass


@dataclass(frozen=True)
class Tagged:
    tag: str


@dataclass(frozen=True)
class Compare:
    """``value`` None stands for nil."""

    field: str
    op: str
    value: str | int | float | None


@dataclass(frozen=True)
class Both:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    inner: object


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip(" \t"):
        m = TOKEN.match(text, at)
        if not m:
            raise QuerySyntaxError(f"at {at}: {text[at : at + 20]!r}")
        kind = m.lastgroup
        value = m[kind]
        out.append((value if kind in ("op", "bracket") or (kind == "name" and value in WORDS) else kind, value))
        at = m.end()
    return out


class Parser:
    def __init__(self, text: str):
        self.rest = tokens(text)

    def peek(self) -> str:
        return self.rest[0][0] if self.rest else "end"

    def take(self, *kinds: str) -> str:
        if self.peek() not in kinds:
            raise QuerySyntaxError(f"expected {' or '.join(kinds)}, got {self.rest[0][1] if self.rest else 'the end'}")
        return self.rest.pop(0)[1]

    def whole(self):
        words = [k for k, _ in self.rest]
        depth = words.index("true") if "true" in words else -1
        if depth >= 0 and words == ["("] * depth + ["true"] + [")"] * depth:
            return True_()
        out = self.expression()
        self.take("end") if self.rest else None
        return out

    def expression(self):
        left = self.operand()
        while self.peek() in ("and", "or"):
            op = self.take("and", "or")
            left = Both(op, left, self.operand())
        return left

    def operand(self):
        kind = self.peek()
        if kind == "not":
            self.take("not")
            return Not(self.operand())
        if kind == "(":
            self.take("(")
            inner = self.expression()
            self.take(")")
            return inner
        if kind == "tagged":
            self.take("tagged")
            if self.peek() == "=":
                self.take("=")
            return Tagged(self.take("string")[1:-1])
        field = self.take("name", "int")
        op = self.take("=", "=~", ">", ">=", "<", "<=")
        kind = self.peek()
        value = self.take("string", "int", "double", *["nil"] * (op == "="))
        return Compare(field, op, None if kind == "nil" else value[1:-1] if kind == "string" else int(value) if kind == "int" else float(value))


def parse(text: str):
    """The syntax tree; QuerySyntaxError if the text is none."""
    return Parser(text).whole()


def _ordered(x: Column, op: str, v: Column) -> Column:
    return {"=": x == v, "=~": x == v, ">": x > v, ">=": x >= v, "<": x < v, "<=": x <= v}[op]


def _attribute(name: str) -> Column:
    return F.try_element_at("attributes", F.lit(name))


def compare(c: Compare) -> Column:
    if c.value is None:
        return ~exprs.has_field(c.field)
    if isinstance(c.value, str):
        if c.field in exprs.STRING_FIELDS:
            text = exprs.field_str(c.field)
            return text == c.value if c.op == "=" else exprs.like(text, c.value) if c.op == "=~" else F.lit(False)
        return F.coalesce(_attribute(c.field) == c.value, F.lit(False))
    if isinstance(c.value, int) and c.field in ("time", "ttl"):
        return _ordered(F.coalesce(F.col(c.field).cast("double"), F.lit(0.0)), c.op, F.lit(float(c.value)))
    if c.field == "metric":
        if isinstance(c.value, int):  # an integer needs a metric, a double takes a missing one as 0
            return F.coalesce(_ordered(F.col("metric"), c.op, F.lit(float(c.value))), F.lit(False))
        return _ordered(exprs.metric(), c.op, F.lit(c.value))
    # the numeric prefix of an attribute
    pattern, kind = (r"^\s*([+-]?[0-9]+)", "bigint") if isinstance(c.value, int) else (r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", "double")
    number = F.regexp_extract(_attribute(c.field), pattern, 1).try_cast(kind)
    return F.coalesce(_ordered(number, c.op, F.lit(c.value)), F.lit(False))


def column(tree) -> Column:
    """The predicate of a syntax tree; never NULL."""
    match tree:
        case True_():
            return F.lit(True)
        case Tagged(tag):
            return exprs.has_tag(tag)
        case Compare():
            return compare(tree)
        case Not(inner):
            return ~column(inner)
        case Both(op, left, right):
            return column(left) & column(right) if op == "and" else column(left) | column(right)
    raise TypeError(tree)


def compile_query(text: str) -> Column:
    return column(parse(text))
