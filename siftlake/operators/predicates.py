"""Predicate tree: what filters mean, independent of how they are planned.

Null rules: ``==`` a value is false on null, ``== null`` is the null test,
``!=`` keeps nulls, ordering against null is false on either side.
"""

from __future__ import annotations

import datetime as dt
import decimal
from collections.abc import Iterator
from dataclasses import dataclass
from enum import Enum
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftlake.functions import text as text_functions


class Op(Enum):
    EQ = "=="
    NE = "!="
    LT = "<"
    LE = "<="
    GT = ">"
    GE = ">="

    @property
    def reversed(self) -> Op:
        return {Op.LT: Op.GT, Op.LE: Op.GE, Op.GT: Op.LT, Op.GE: Op.LE}.get(self, self)


def shown(value: Any) -> str:
    """A literal in descriptions: strings quoted, null, timestamps in ISO form."""
    if value is None:
        return "null"
    if isinstance(value, str):
        return f'"{value}"'
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    return str(value)


def column(path: str) -> Column:
    """A column by dotted or slashed path; each part is taken literally."""
    return F.col(".".join(f"`{p}`" for p in path.replace("/", ".").split(".")))


def literal(value: Any) -> Column:
    if isinstance(value, dt.datetime) and value.tzinfo is None:
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    if isinstance(value, decimal.Decimal):
        return F.lit(value)
    return F.lit(value)


class Predicate:
    """A filter condition. Subclass with ``to_column``, ``describe`` and ``columns`` for one of your own."""

    #: Whether the planner may use it on statistics.
    pushable = False

    def to_column(self) -> Column:
        raise NotImplementedError

    def describe(self) -> str:
        raise NotImplementedError

    def columns(self) -> list[str]:
        return []

    def __and__(self, other: Predicate) -> Predicate:
        return And((self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Or((self, other))

    def __invert__(self) -> Predicate:
        return Not(self)

    def __bool__(self) -> bool:
        raise TypeError("combine predicates with &, | and ~")


@dataclass(frozen=True, eq=False)
class Compare(Predicate):
    path: str
    op: Op
    value: Any
    pushable = True

    def to_column(self) -> Column:
        c, v = column(self.path), self.value
        if v is None:
            return {Op.EQ: c.isNull(), Op.NE: c.isNotNull()}.get(self.op, F.lit(False))
        v = v if isinstance(v, Column) else literal(v)
        if self.op is Op.EQ:
            return c == v
        if self.op is Op.NE:
            return ~c.eqNullSafe(v)
        return {Op.LT: c < v, Op.LE: c <= v, Op.GT: c > v, Op.GE: c >= v}[self.op]

    def describe(self) -> str:
        return f"{self.path} {self.op.value} {shown(self.value)}"

    def columns(self) -> list[str]:
        return [self.path]


@dataclass(frozen=True, eq=False)
class StartsWith(Predicate):
    path: str
    prefix: str
    pushable = True

    def to_column(self) -> Column:
        return column(self.path).startswith(self.prefix)

    def describe(self) -> str:
        return f"{self.path}.StartsWith({shown(self.prefix)})"

    def columns(self) -> list[str]:
        return [self.path]


@dataclass(frozen=True, eq=False)
class TokenMatch(Predicate):
    """An analysed token equal to the term, or within some edits of it."""

    path: str
    term: str
    max_edits: int = 0
    prefix_length: int = 0
    transpositions: bool = True
    pushable = True

    def check(self) -> None:
        text_functions.check_fuzzy(self.max_edits, self.prefix_length)

    def to_column(self) -> Column:
        if self.max_edits == 0:
            self.check()
            return text_functions.token_match(column(self.path), self.term)
        return text_functions.fuzzy_match(column(self.path), self.term, self.max_edits, self.prefix_length, self.transpositions)

    def matches_term(self, token: str) -> bool:
        """The same test on one token, for looking an index's terms up."""
        if self.max_edits == 0:
            return token == self.term
        head = self.term[: self.prefix_length]
        if not token.startswith(head):
            return False
        return text_functions.edit_distance(token[len(head) :], self.term[len(head) :], self.transpositions) <= self.max_edits

    def describe(self) -> str:
        if self.max_edits == 0:
            return f"token.match({self.path}, {shown(self.term)})"
        return f"token.fuzzy({self.path}, {shown(self.term)}, edits={self.max_edits}, prefix={self.prefix_length}, transpositions={shown(self.transpositions)})"

    def columns(self) -> list[str]:
        return [self.path]


@dataclass(frozen=True, eq=False)
class TextTest(Predicate):
    """Suffix or substring: evaluated on rows only."""

    path: str
    kind: str
    text: str

    def to_column(self) -> Column:
        c = column(self.path)
        return c.endswith(self.text) if self.kind == "EndsWith" else c.contains(self.text)

    def describe(self) -> str:
        return f"{self.path}.{self.kind}({shown(self.text)})"

    def columns(self) -> list[str]:
        return [self.path]


@dataclass(frozen=True, eq=False)
class NullTest(Predicate):
    path: str
    null: bool

    def to_column(self) -> Column:
        c = column(self.path)
        return c.isNull() if self.null else c.isNotNull()

    def describe(self) -> str:
        return f"{self.path} is {'' if self.null else 'not '}null"

    def columns(self) -> list[str]:
        return [self.path]


@dataclass(frozen=True, eq=False)
class Constant(Predicate):
    value: bool
    text: str = ""

    def to_column(self) -> Column:
        return F.lit(self.value)

    def describe(self) -> str:
        return self.text or shown(self.value)


@dataclass(frozen=True, eq=False)
class Opaque(Predicate):
    """Any Boolean column expression, or SQL text of one; ``reads`` names its columns where they are known."""

    expression: Column | str
    text: str = ""
    reads: tuple[str, ...] = ()

    def to_column(self) -> Column:
        return F.expr(self.expression) if isinstance(self.expression, str) else self.expression

    def describe(self) -> str:
        return self.text or str(self.expression)

    def columns(self) -> list[str]:
        return list(self.reads)


@dataclass(frozen=True, eq=False)
class And(Predicate):
    parts: tuple[Predicate, ...]

    def to_column(self) -> Column:
        return reduce(lambda a, b: a & b, [p.to_column() for p in self.parts], F.lit(True))

    def describe(self) -> str:
        return " && ".join(f"({p.describe()})" for p in self.parts)

    def columns(self) -> list[str]:
        return [c for p in self.parts for c in p.columns()]


@dataclass(frozen=True, eq=False)
class Or(Predicate):
    parts: tuple[Predicate, ...]

    def to_column(self) -> Column:
        return reduce(lambda a, b: a | b, [p.to_column() for p in self.parts])

    def describe(self) -> str:
        return " || ".join(f"({p.describe()})" for p in self.parts)

    def columns(self) -> list[str]:
        return [c for p in self.parts for c in p.columns()]


@dataclass(frozen=True, eq=False)
class Not(Predicate):
    """Two-valued negation: what the inner predicate doesn't select."""

    part: Predicate

    def to_column(self) -> Column:
        return ~F.coalesce(self.part.to_column(), F.lit(False))

    def describe(self) -> str:
        return f"!({self.part.describe()})"

    def columns(self) -> list[str]:
        return self.part.columns()


class Field:
    """``col("a.b")``: comparisons build predicates; anything computed is a row test."""

    def __init__(self, path: str):
        self.path = path

    def __eq__(self, v: Any) -> Predicate:  # type: ignore[override]
        return self._compare(Op.EQ, v)

    def __ne__(self, v: Any) -> Predicate:  # type: ignore[override]
        return self._compare(Op.NE, v)

    def __lt__(self, v: Any) -> Predicate:
        return self._compare(Op.LT, v)

    def __le__(self, v: Any) -> Predicate:
        return self._compare(Op.LE, v)

    def __gt__(self, v: Any) -> Predicate:
        return self._compare(Op.GT, v)

    def __ge__(self, v: Any) -> Predicate:
        return self._compare(Op.GE, v)

    __hash__ = None  # type: ignore[assignment]

    def _compare(self, op: Op, v: Any) -> Predicate:
        if isinstance(v, Field):
            return FieldCompare(self.path, op, v.path)
        return Compare(self.path, op, v)

    def between(self, low: Any, high: Any) -> Predicate:
        return And((self >= low, self <= high))

    def starts_with(self, prefix: str, ordinal: bool = True) -> Predicate:
        if not ordinal:
            return CaseFoldedPrefix(self.path, prefix)
        return StartsWith(self.path, prefix)

    def ends_with(self, suffix: str) -> Predicate:
        return TextTest(self.path, "EndsWith", suffix)

    def contains(self, part: str) -> Predicate:
        return TextTest(self.path, "Contains", part)

    def is_null(self) -> Predicate:
        return Compare(self.path, Op.EQ, None)

    def is_not_null(self) -> Predicate:
        return Compare(self.path, Op.NE, None)

    def is_true(self) -> Predicate:
        return Opaque("`" + self.path.replace("/", ".").replace(".", "`.`") + "`", self.path, (self.path,))

    @property
    def column(self) -> Column:
        return column(self.path)


@dataclass(frozen=True, eq=False)
class FieldCompare(Predicate):
    """A column against a column: evaluated on rows."""

    path: str
    op: Op
    other: str

    def to_column(self) -> Column:
        a, b = column(self.path), column(self.other)
        return {Op.EQ: a.eqNullSafe(b), Op.NE: ~a.eqNullSafe(b), Op.LT: a < b, Op.LE: a <= b, Op.GT: a > b, Op.GE: a >= b}[self.op]

    def describe(self) -> str:
        return f"{self.path} {self.op.value} {self.other}"

    def columns(self) -> list[str]:
        return [self.path, self.other]


@dataclass(frozen=True, eq=False)
class CaseFoldedPrefix(Predicate):
    path: str
    prefix: str

    def to_column(self) -> Column:
        return F.lower(column(self.path)).startswith(self.prefix.lower())

    def describe(self) -> str:
        return f"{self.path}.StartsWith({shown(self.prefix)}, ignore case)"

    def columns(self) -> list[str]:
        return [self.path]


def col(path: str) -> Field:
    return Field(path)


def constant(value: Any, op: str, field: Field) -> Predicate:
    """A comparison with the constant on the left: ``constant(5, "<", col("x"))`` is ``x > 5``."""
    return field._compare(Op(op).reversed, value)


def conjuncts(p: Predicate) -> Iterator[Predicate]:
    """The parts of nested conjunctions."""
    if isinstance(p, And):
        for part in p.parts:
            yield from conjuncts(part)
    else:
        yield p


@dataclass(frozen=True)
class PushdownFilter:
    """Predicates that all must hold and that planning may use."""

    predicates: tuple[Predicate, ...] = ()

    def both(self, other: PushdownFilter) -> PushdownFilter:
        return PushdownFilter(self.predicates + other.predicates)

    @property
    def empty(self) -> bool:
        return not self.predicates

    def to_column(self) -> Column:
        return And(self.predicates).to_column()


class FilterBuilder:
    """Collects pushdown predicates: ``FilterBuilder().eq("a", 1).ge("b", 2).build()``."""

    def __init__(self) -> None:
        self._found: list[Predicate] = []

    def add(self, predicate: Predicate) -> FilterBuilder:
        if predicate is None:
            raise ValueError("a predicate is needed")
        self._found.append(predicate)
        return self

    def eq(self, path: str, value: Any) -> FilterBuilder:
        return self.add(Compare(path, Op.EQ, value))

    def not_eq(self, path: str, value: Any) -> FilterBuilder:
        return self.add(Compare(path, Op.NE, value))

    def lt(self, path: str, value: Any) -> FilterBuilder:
        return self.add(Compare(path, Op.LT, value))

    def le(self, path: str, value: Any) -> FilterBuilder:
        return self.add(Compare(path, Op.LE, value))

    def gt(self, path: str, value: Any) -> FilterBuilder:
        return self.add(Compare(path, Op.GT, value))

    def ge(self, path: str, value: Any) -> FilterBuilder:
        return self.add(Compare(path, Op.GE, value))

    def between(self, path: str, low: Any, high: Any) -> FilterBuilder:
        return self.ge(path, low).le(path, high)

    def starts_with(self, path: str, prefix: str) -> FilterBuilder:
        return self.add(StartsWith(path, prefix))

    def token_match(self, path: str, term: str) -> FilterBuilder:
        return self.add(TokenMatch(path, text_functions.single_term(term)))

    def token_fuzzy(self, path: str, term: str, max_edits: int = 1, prefix_length: int = 0, transpositions: bool = True) -> FilterBuilder:
        return self.add(TokenMatch(path, text_functions.single_term(term), max_edits, prefix_length, transpositions))

    def build(self) -> PushdownFilter:
        return PushdownFilter(tuple(self._found))


def pushdown(*predicates: Predicate) -> PushdownFilter:
    """A filter of its own, to be shared between queries."""
    return PushdownFilter(tuple(predicates))
