"""Write plans from annotated row classes, and a writer that runs index strategies."""

from __future__ import annotations

import copy
import dataclasses
import datetime as dt
import decimal
import enum
import functools
import types
import typing
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class IndexKind(enum.Enum):
    BLOOM = "bloom"
    SORT_KEY = "sort-key"
    EXTERNAL = "external"


@dataclass(frozen=True)
class Bloom:
    """Write a bloom filter for the column."""


@dataclass(frozen=True)
class SortKey:
    """The column's place in the sort order; metadata unless the writer is told to sort."""

    priority: int
    descending: bool = False


@dataclass(frozen=True)
class Index:
    """A named index that a strategy builds; several of a column go by order."""

    name: str
    order: int = 0


BitmapIndex = functools.partial(Index, "bitmap")
TermIndex = functools.partial(Index, "terms")


def column(*marks: Any, name: str | None = None, ignore: bool = False, required: bool = False, precision: tuple[int, int] | None = None, **kwargs: Any) -> Any:
    """A dataclass field with its column name, marks and decimal precision."""
    return field(metadata={"marks": marks, "name": name, "ignore": ignore, "required": required, "precision": precision}, **kwargs)


def write_options(compression: str = "snappy", level: int | None = None, row_group_rows: int | None = None, page_rows: int | None = None):
    """Class decorator: defaults of how rows of the class are written."""

    def mark(cls: type) -> type:
        cls.__write_options__ = {"compression": compression, "level": level, "row_group_rows": row_group_rows, "page_rows": page_rows}
        return cls

    return mark


@dataclass(frozen=True)
class IndexDescriptor:
    column: str
    kind: IndexKind
    name: str = ""
    order: int = 0
    descending: bool = False


@dataclass(frozen=True)
class WritePlan:
    schema: T.StructType
    indexes: tuple[IndexDescriptor, ...]
    options: Mapping[str, str]

    def of_kind(self, kind: IndexKind) -> tuple[IndexDescriptor, ...]:
        return tuple(d for d in self.indexes if d.kind is kind)


_TYPES = {
    bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bytes: T.BinaryType(),
    dt.datetime: T.TimestampNTZType(), dt.date: T.DateType(), dt.timedelta: T.DayTimeIntervalType(), decimal.Decimal: T.DecimalType(38, 18),
}


def _spark_type(hint: Any, precision: tuple[int, int] | None) -> tuple[T.DataType, bool]:
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if origin in (typing.Union, types.UnionType):
        inner = next(a for a in args if a is not type(None))
        return _spark_type(inner, precision)[0], True
    if origin is typing.Annotated:
        return _spark_type(next((a for a in args[1:] if isinstance(a, T.DataType)), args[0]), precision)
    if isinstance(hint, T.DataType):
        return hint, True
    if origin in (list, tuple):
        return T.ArrayType(_spark_type(args[0], precision)[0]), True
    if origin is dict:
        return T.MapType(_spark_type(args[0], None)[0], _spark_type(args[1], None)[0]), True
    if dataclasses.is_dataclass(hint):
        return build_schema(hint), True
    if isinstance(hint, type) and issubclass(hint, enum.Enum):
        return T.StringType(), True
    if hint is decimal.Decimal and precision:
        return T.DecimalType(*precision), True
    if hint in _TYPES:
        return _TYPES[hint], True
    raise TypeError(f"no column type for {hint!r}")


def _fields(cls: type) -> list[tuple[dataclasses.Field, Any]]:
    if not dataclasses.is_dataclass(cls):
        raise TypeError(f"{cls.__name__} must be a dataclass")
    hints = typing.get_type_hints(cls, include_extras=True)
    return [(f, hints[f.name]) for f in dataclasses.fields(cls) if not f.metadata.get("ignore")]


def build_schema(cls: type) -> T.StructType:
    """The schema of a row class; ignored fields are left out."""
    out = []
    for f, hint in _fields(cls):
        kind, nullable = _spark_type(hint, f.metadata.get("precision"))
        out.append(T.StructField(f.metadata.get("name") or f.name, kind, nullable and not f.metadata.get("required", False)))
    return T.StructType(out)


def _descriptors(cls: type, prefix: str = "") -> list[IndexDescriptor]:
    out: list[IndexDescriptor] = []
    for f, hint in _fields(cls):
        path = prefix + (f.metadata.get("name") or f.name)
        inner = next((a for a in typing.get_args(hint) if dataclasses.is_dataclass(a)), hint)
        if dataclasses.is_dataclass(inner):
            out += _descriptors(inner, path + "/")
        for m in f.metadata.get("marks", ()):
            if isinstance(m, Bloom) or m is Bloom:
                out.append(IndexDescriptor(path, IndexKind.BLOOM))
            elif isinstance(m, SortKey):
                out.append(IndexDescriptor(path, IndexKind.SORT_KEY, order=m.priority, descending=m.descending))
            elif isinstance(m, Index):
                out.append(IndexDescriptor(path, IndexKind.EXTERNAL, m.name, m.order))
            else:
                raise TypeError(f"unknown column mark {m!r}")
    return out


def _option_map(settings: Mapping[str, Any]) -> dict[str, str]:
    out = {}
    if settings.get("compression"):
        out["compression"] = settings["compression"]
    if settings.get("level") is not None:
        out["parquet.compression.codec.zstd.level"] = str(settings["level"])
    if settings.get("row_group_rows"):
        out["parquet.block.row.count.limit"] = str(settings["row_group_rows"])
    if settings.get("page_rows"):
        out |= {"parquet.page.row.count.limit": str(settings["page_rows"]), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
    return out


@functools.lru_cache(maxsize=256)
def _built(cls: type) -> WritePlan:
    found = _descriptors(cls)
    keys = sorted((d for d in found if d.kind is IndexKind.SORT_KEY), key=lambda d: d.order)
    external = sorted((d for d in found if d.kind is IndexKind.EXTERNAL), key=lambda d: d.order)
    blooms = [d for d in found if d.kind is IndexKind.BLOOM]
    options = _option_map(getattr(cls, "__write_options__", {"compression": "snappy"}))
    for d in blooms:
        name = d.column.replace("/", ".")
        options |= {f"parquet.bloom.filter.enabled#{name}": "true", f"parquet.enable.dictionary#{name}": "false"}
    return WritePlan(build_schema(cls), tuple(blooms + keys + external), types.MappingProxyType(options))


def build_plan(cls: type, options: Mapping[str, str] | None = None) -> WritePlan:
    """The write plan of a row class, kept per class; explicit options override the class's."""
    plan = _built(cls)
    return dataclasses.replace(plan, options=types.MappingProxyType({**plan.options, **copy.deepcopy(dict(options))})) if options else plan


@dataclass(frozen=True)
class IndexContext:
    spark: SparkSession
    path: str
    plan: WritePlan


class IndexStrategy(Protocol):
    name: str

    def can_handle(self, descriptor: IndexDescriptor) -> bool: ...

    def apply(self, context: IndexContext, descriptor: IndexDescriptor) -> None: ...


def _row(item: Any, cls: type) -> dict[str, Any]:
    out = {}
    for f, _ in _fields(cls):
        v = getattr(item, f.name)
        if dataclasses.is_dataclass(v):
            v = _row(v, type(v))
        elif isinstance(v, enum.Enum):
            v = v.name
        out[f.metadata.get("name") or f.name] = v
    return out


def write(
    spark: SparkSession, rows: DataFrame | Iterable[Any], path: str, cls: type | WritePlan, strategies: Iterable[IndexStrategy] = (),
    options: Mapping[str, str] | None = None, sort: bool = False, files: int | None = None, mode: str = "errorifexists",
) -> WritePlan:
    """Write a DataFrame, or instances of ``cls``, and build the indexes a strategy can handle.

    ``sort`` sorts within files by the sort keys; ``files`` fixes their
    number. An index that fails raises after the data has been written.
    """
    if isinstance(cls, WritePlan):
        plan = dataclasses.replace(cls, options={**cls.options, **dict(options or {})})
    else:
        plan = build_plan(cls, options)
    df = rows if isinstance(rows, DataFrame) else spark.createDataFrame([_row(r, type(r)) if dataclasses.is_dataclass(r) else r for r in rows], plan.schema)
    if files:
        df = df.coalesce(files)
    keys = plan.of_kind(IndexKind.SORT_KEY)
    if sort and keys:
        df = df.sortWithinPartitions(*[F.col(d.column.replace("/", ".")).desc() if d.descending else F.col(d.column.replace("/", ".")).asc() for d in keys])
    df.write.mode(mode).options(**dict(plan.options)).parquet(path)
    strategies = list(strategies)
    for d in plan.indexes:
        for s in strategies:
            if s.can_handle(d):
                s.apply(IndexContext(spark, path, plan), d)
    return plan
