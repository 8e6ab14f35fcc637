"""Queries with string-typed predicates, over files whose schema isn't declared."""

from __future__ import annotations

import base64
import binascii
import datetime as dt
import decimal
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.operators import predicates as P
from siftlake.operators.query import Query, StrictPushdownError
from siftlake.plans.indexes import IndexPlanner
from siftlake.plans.report import QueryPlan
from siftlake.sources import scan

_NAMES = {
    "==": "==", "=": "==", "eq": "==", "!=": "!=", "<>": "!=", "ne": "!=", "<": "<", "lt": "<", "<=": "<=", "le": "<=", ">": ">", "gt": ">", ">=": ">=", "ge": ">=",
    "between": "between", "startswith": "startswith", "endswith": "endswith", "contains": "contains", "isnull": "isnull", "isnotnull": "isnotnull",
    "tokenmatch": "tokenmatch", "tokenfuzzy": "tokenfuzzy", **{f"{c}{k}": f"token{k}" for c in ("lucene",) for k in ("match", "fuzzy")},
}


@dataclass(frozen=True)
class DynamicPredicate:
    column: str
    operator: str
    value: str | None = None
    value2: str | None = None
    max_edits: int | None = None
    prefix_length: int | None = None
    transpositions: bool | None = None


def parse_literal(text: str | None, kind: T.DataType) -> Any:
    """A text as a value of a column type; raises ValueError if it isn't one."""
    if text is None:
        return None
    try:
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return int(text)
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return float(text)
        if isinstance(kind, T.DecimalType):
            return decimal.Decimal(text)
        if isinstance(kind, T.BooleanType):
            return {"true": True, "false": False}[text.strip().lower()]
        if isinstance(kind, T.TimestampNTZType):
            at = dt.datetime.fromisoformat(text)
            return at.astimezone(dt.timezone.utc).replace(tzinfo=None) if at.tzinfo else at
        if isinstance(kind, T.TimestampType):
            at = dt.datetime.fromisoformat(text)
            return at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)
        if isinstance(kind, T.DateType):
            return dt.date.fromisoformat(text)
        if isinstance(kind, T.DayTimeIntervalType):
            h, m, s = text.split(":")
            return dt.timedelta(hours=int(h), minutes=int(m), seconds=float(s))
        if isinstance(kind, T.BinaryType):
            return base64.b64decode(text, validate=True)
    except (ValueError, KeyError, decimal.InvalidOperation, binascii.Error) as e:
        raise ValueError(f"{text!r} is not a {kind.simpleString()}") from e
    return text


def guid(text: str) -> str:
    """A GUID in its 36-character form."""
    return str(uuid.UUID(text))


def compile_predicate(p: DynamicPredicate, schema: T.StructType) -> P.Predicate | None:
    """The predicate, or None where the column doesn't exist."""
    name = _NAMES.get(p.operator.strip().lower())
    if name is None:
        raise ValueError(f"unknown operator {p.operator!r}")
    leaves = dict(scan.leaf_paths(schema))
    path = p.column.replace(".", "/") if p.column.replace(".", "/") in leaves else p.column
    kind = leaves.get(path)
    if kind is None:
        if name == "isnull":
            return P.Constant(True, f"{p.column} is null")
        if name == "isnotnull":
            return P.Constant(False, f"{p.column} is not null")
        return None
    text = isinstance(kind, T.StringType)
    if name in ("==", "!=", "<", "<=", ">", ">="):
        return P.Compare(path, P.Op(name), parse_literal(p.value, kind))
    if name == "between":
        return P.And((P.Compare(path, P.Op.GE, parse_literal(p.value, kind)), P.Compare(path, P.Op.LE, parse_literal(p.value2, kind))))
    if name in ("isnull", "isnotnull"):
        return P.NullTest(path, name == "isnull")
    if not text:
        return P.Constant(False, f"{p.column} {p.operator}: not a text column")
    if name == "startswith":
        return P.StartsWith(path, p.value or "")
    if name in ("endswith", "contains"):
        return P.TextTest(path, "EndsWith" if name == "endswith" else "Contains", p.value or "")
    edits = p.max_edits if p.max_edits is not None else (0 if name == "tokenmatch" else 1)
    return P.TokenMatch(path, (p.value or "").lower(), edits, p.prefix_length or 0, True if p.transpositions is None else p.transpositions)


@dataclass(frozen=True)
class DynamicResult:
    rows: list[dict[str, Any]]
    total: int
    plan: QueryPlan


def _flat(df: DataFrame) -> DataFrame:
    """Leaf columns named by slashed path."""
    return df.select(*[P.column(path).alias(path) for path, _ in scan.leaf_paths(df.schema)])


@dataclass(frozen=True)
class DynamicQuery:
    """Predicates are joined by AND. Those on unknown columns are ignored, unless strict, and reported."""

    query: Query
    predicates: tuple[DynamicPredicate, ...] = ()
    strict: bool = False

    @staticmethod
    def from_path(spark: SparkSession, paths: str | Iterable[str]) -> DynamicQuery:
        given = [paths] if isinstance(paths, str) else list(paths)
        return DynamicQuery(Query.from_files(spark, given).with_planner(IndexPlanner(spark)))

    def where(self, *predicates: DynamicPredicate) -> DynamicQuery:
        return replace(self, predicates=(*self.predicates, *predicates)) if predicates else self

    def with_planners(self, planners: Iterable[Any]) -> DynamicQuery:
        return replace(self, query=self.query.with_planners(planners))

    @property
    def ignored(self) -> list[DynamicPredicate]:
        schema = self.query.source().schema
        return [p for p in self.predicates if compile_predicate(p, schema) is None]

    def compiled(self) -> Query:
        schema = self.query.source().schema
        out = self.query
        for p in self.predicates:
            made = compile_predicate(p, schema)
            if made is None:
                if self.strict:
                    raise StrictPushdownError(f"no column {p.column!r}")
            else:
                out = out.where(made)
        return out

    def dataframe(self) -> DataFrame:
        return _flat(self.compiled().filtered())

    def page(self, offset: int = 0, limit: int = 500) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` by file and position.

        Of several files only those that hold rows of the page are sorted,
        known from a count of the matches in each.
        """
        query = self.compiled()
        df = query.filtered()
        if offset and len(query.paths) > 1:
            count = {scan.local(r[0]): r[1] for r in scan.by_file(df).collect()}
            before, held = 0, []
            for path in query.paths:
                n = count.get(scan.local(path), 0)
                if n and before < offset + limit and before + n > offset:
                    held.append((path, before))
                before += n
            if before == sum(count.values()) and held:
                df = replace(query, paths=tuple(p for p, _ in held)).filtered()
                offset -= held[0][1]
        names = [path for path, _ in scan.leaf_paths(df.schema)]
        return scan.in_file_order(df).select(*[P.column(n).alias(n) for n in names]).offset(offset).limit(limit)

    def execute(self, offset: int = 0, limit: int = 500) -> DynamicResult:
        """A page of rows, the number of all matching rows, and the plan."""
        if offset < 0 or limit < 0:
            raise ValueError("offset and limit must not be negative")
        return DynamicResult([r.asDict(recursive=True) for r in self.page(offset, limit).collect()], self.count(), self.plan())

    def to_iterator(self) -> Iterator[dict[str, Any]]:
        return (r.asDict(recursive=True) for r in self.dataframe().toLocalIterator())

    def count(self) -> int:
        return self.compiled().count()

    def any(self) -> bool:
        return self.compiled().any()

    def plan(self) -> QueryPlan:
        return self.compiled().without_cache().plan()

    def with_total(self) -> DataFrame:
        """One row: how many rows match."""
        return self.dataframe().agg(F.count("*").alias("total"))
