"""What a file holds: schema, footer, indexes, pages of rows."""

from __future__ import annotations

import os
import time
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from siftlake.operators.dynamic import DynamicPredicate, DynamicQuery
from siftlake.operators.textlang import Parsed, parse
from siftlake.plans import footer as footers
from siftlake.plans import indexes
from siftlake.sources import scan


def schema_listing(spark: SparkSession, path: str) -> DataFrame:
    """``path, type, nullable, repeated`` of each leaf column."""
    rows = []

    def walk(s: T.StructType, prefix: str, nullable: bool) -> None:
        for f in s.fields:
            at = prefix + f.name
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, at + "/", nullable or f.nullable)
            else:
                rows.append((at, f.dataType.simpleString(), nullable or f.nullable, isinstance(f.dataType, (T.ArrayType, T.MapType))))

    walk(spark.read.parquet(path).schema, "", False)
    return spark.createDataFrame(rows, "path string, type string, nullable boolean, repeated boolean")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """A row for each column chunk: bounds as texts, counts, codec, sizes, index flags."""
    rows = []
    shown = lambda v: None if v is None else str(v)
    for g in footers.read(path).groups:
        for c in g.chunks.values():
            rows.append((g.ordinal, g.rows, c.path, shown(c.minimum), shown(c.maximum), c.nulls, c.distinct, c.values, c.codec, c.compressed, c.uncompressed, c.has_column_index, c.has_offset_index, c.has_bloom))
    return spark.createDataFrame(
        rows,
        "row_group int, rows long, path string, minimum string, maximum string, nulls long, distinct long, values long, codec string, compressed long, uncompressed long,"
        " column_index boolean, offset_index boolean, bloom boolean",
    )


def key_values(path: str) -> dict[str, str]:
    """Key-values of a file's footer, and those kept beside the dataset, which win."""
    return footers.read(path).key_values | indexes.key_values(os.path.dirname(scan.local(path)))


@dataclass(frozen=True)
class IndexInfo:
    kind: str
    column: str
    detail: str = ""


def index_listing(path: str) -> list[IndexInfo]:
    """Sidecar indexes of a dataset directory, and what the files themselves have."""
    out = []
    for kind in (indexes.BITMAP, indexes.TERMS):
        at = f"{scan.local(path)}/_index/{kind}"
        out += [IndexInfo(kind, c.replace(".", "/").replace("%25", "%")) for c in scan.names(at) if not c.startswith((".", "_"))]
    out += [IndexInfo(indexes.SORT_ORDER, k["path"], k["direction"]) for k in indexes.sort_order(path) or []]
    spark = SparkSession.getActiveSession()
    files = scan.list_directory(spark, path) if spark and not path.endswith(".parquet") else [path] if os.path.isfile(scan.local(path)) else [os.path.join(d, f) for d, _, fs in os.walk(scan.local(path)) for f in sorted(fs) if f.endswith(".parquet") and "/_" not in d]
    seen = set()
    for f in files:
        for g in footers.read(f).groups:
            for c in g.chunks.values():
                seen |= {IndexInfo(k, c.path) for k, has in (("statistics", c.has_statistics), ("column-index", c.has_column_index), ("offset-index", c.has_offset_index), ("bloom", c.has_bloom)) if has}
            seen |= {IndexInfo("sorting-column", p, "desc" if d else "asc") for p, d in g.sorting}
    return out + sorted(seen, key=lambda i: (i.kind, i.column))


def browse(spark: SparkSession, path: str, offset: int = 0, limit: int = 200) -> list[dict[str, Any]]:
    """Rows by position, nested values as they are."""
    df = scan.in_file_order(spark.read.parquet(path)).offset(offset).limit(limit)
    return [r.asDict(recursive=True) for r in df.collect()]


@dataclass(frozen=True)
class Answer:
    rows: list[dict[str, Any]]
    total: int
    milliseconds: float
    plan: list[str]


def ask(spark: SparkSession, path: str, predicates: Iterable[DynamicPredicate], offset: int = 0, limit: int = 200) -> Answer:
    began = time.perf_counter()
    got = DynamicQuery.from_path(spark, path).where(*predicates).execute(offset, limit)
    return Answer(got.rows, got.total, (time.perf_counter() - began) * 1000, got.plan.lines())


def parse_for(spark: SparkSession, path: str, text: str) -> Parsed:
    """Parse the line language against a file's columns."""
    leaves = scan.leaf_paths(spark.read.parquet(path).schema)
    return parse(text, {p: isinstance(t, T.StringType) for p, t in leaves})
