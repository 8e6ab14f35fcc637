"""Sidecar indexes: which row groups hold a value or a term, and a file's sort order.

An index is a Parquet table below ``_index`` in the dataset's directory,
which scans ignore, with rows (file, size, mtime, row_group, value). Each
row group also has a row without value, so that an absent value is known to
be absent. An index that is missing, unreadable or older than its file
gives no verdict, and rows are always tested again.
"""

from __future__ import annotations

import json
import os
import warnings
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.functions.text import tokens, within_edits
from siftlake.operators.predicates import Compare, Op, Predicate, TokenMatch, column
from siftlake.plans import footer as footers
from siftlake.plans.cache import LruPlanCache, file_stamp
from siftlake.plans.prune import Decision
from siftlake.sources import scan
from siftlake.sources.scan import list_directory, local, read_files
from siftlake.sources.write import IndexContext, IndexDescriptor, IndexKind

BITMAP, TERMS, SORT_ORDER, KEY_VALUES = "bitmap", "terms", "sort-order", "key-values"
#: Index builds need all rows. Their filter on nulls would have page indexes read, some 130 KB a row group however small, to skip nothing.
WHOLE = {"parquet.filter.columnindex.enabled": "false"}
SUPPORTED = (
    T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.StringType,
    T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType, T.BinaryType,
)


def supported(kind: T.DataType) -> bool:
    """Whether a bitmap index can hold values of a type."""
    return isinstance(kind, SUPPORTED)


def formatted(c: Column, kind: T.DataType) -> Column:
    """A value as an index key."""
    if isinstance(kind, T.BinaryType):
        return F.base64(c)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return c.cast("string")


def directory(path: str, kind: str, col: str) -> str:
    return f"{local(path)}/_index/{kind}/{col.replace('/', '.').replace('%', '%25')}"


def _read_text(path: str) -> str:
    with scan.opened(path) as f:
        return f.read().decode()


def _groups(spark: SparkSession, files: Iterable[str]) -> tuple[DataFrame, int]:
    """Row ranges of the row groups of each file, from the footers, and how many rows a group has on average, at least 1."""
    rows, total = [], 0
    for f in files:
        _, size, mtime = file_stamp(f)
        at = 0
        for ordinal, n in enumerate(footers.group_rows(f)):
            rows.append((os.path.basename(local(f)), local(f), size, mtime, ordinal, at, at + n))
            at += n
        total += at
    df = spark.createDataFrame(rows, "name string, file string, size long, mtime long, row_group int, first long, after long")
    return df, max(1, -(-total // max(1, len(rows))))


def _binned(groups: DataFrame, width: int) -> DataFrame:
    """``groups``, without empty ones, once for each bin of ``width`` rows of the file that they touch."""
    return groups.where("after > first").withColumn("bin", F.explode(F.expr(f"sequence(first div {width}L, (after - 1) div {width}L)")))


def _placed(spark: SparkSession, path: str, col: str, keys) -> DataFrame:
    """(file, size, mtime, row_group, value) of the distinct keys in each row group.

    Rows meet the groups of their bin only. Bins are as wide as the average
    group, so that groups touch two bins on average at most, and comparisons
    grow with the rows, whatever the groups' sizes.
    """
    files = list_directory(spark, path)
    groups, width = _groups(spark, files)
    source = read_files(spark, files, WHOLE)
    if col.split("/")[0] not in source.columns:
        raise ValueError(f"column {col} is not in {path}")
    uri = F.url_decode(F.regexp_replace(F.regexp_replace("_metadata.file_path", r"\+", "%2B"), "^file:(//)?", ""))
    given = source.select(uri.alias("file"), F.col("_metadata.row_index").alias("row"), F.expr(f"_metadata.row_index div {width}L").alias("bin"), keys(source).alias("value"))
    bins = _binned(groups, width)  # Spark broadcasts it while it is small; else both sides meet by file and bin
    on = (given["file"] == bins["file"]) & (given["bin"] == bins["bin"]) & (given["row"] >= bins["first"]) & (given["row"] < bins["after"])
    found = given.join(bins, on).select(bins["file"], "size", "mtime", "row_group", "value").where("value IS NOT NULL").distinct()
    return found.unionByName(groups.select("file", "size", "mtime", "row_group", F.lit(None).cast("string").alias("value")))


def build_bitmap(spark: SparkSession, path: str, col: str, most: int = 256) -> None:
    """Index the values of a column; nulls are skipped, more than ``most`` values are an error."""
    kind = read_files(spark, list_directory(spark, path)).select(column(col).alias("c")).schema["c"].dataType
    if not supported(kind):
        raise ValueError(f"{col}: values of type {kind.simpleString()} can't be kept in a bitmap index")
    df = _placed(spark, path, col, lambda s: formatted(column(col), kind)).persist()
    try:
        n, rows = df.agg(F.count_distinct("value"), F.count("*")).first()
        if n > most:
            text = f"{col} has {n} values; a bitmap index is for low-cardinality columns of at most {most}. Sort by the column or use a bloom filter"
            warnings.warn(text, stacklevel=2)
            raise ValueError(text)
        df.repartitionByRange(max(1, rows // 100_000), "value", "file", "row_group").sortWithinPartitions("value").write.mode("overwrite").parquet(directory(path, BITMAP, col))
    finally:
        df.unpersist()


def build_terms(spark: SparkSession, path: str, col: str) -> None:
    """Index the analysed tokens of a text column."""
    kind = read_files(spark, list_directory(spark, path)).select(column(col).alias("c")).schema["c"].dataType
    if not isinstance(kind, T.StringType):
        raise ValueError(f"{col}: only text can have a term index, not {kind.simpleString()}")
    df = _placed(spark, path, col, lambda s: F.explode(F.array_distinct(tokens(column(col)))))
    df.repartitionByRange("value", "file", "row_group").sortWithinPartitions("value").write.mode("overwrite").parquet(directory(path, TERMS, col))


class BitmapStrategy:
    name = BITMAP

    def __init__(self, most: int = 256):
        self.most = most

    def can_handle(self, d: IndexDescriptor) -> bool:
        return d.kind is IndexKind.EXTERNAL and d.name == self.name

    def apply(self, context: IndexContext, d: IndexDescriptor) -> None:
        build_bitmap(context.spark, context.path, d.column, self.most)


class TermStrategy:
    name = TERMS

    def can_handle(self, d: IndexDescriptor) -> bool:
        return d.kind is IndexKind.EXTERNAL and d.name == self.name

    def apply(self, context: IndexContext, d: IndexDescriptor) -> None:
        build_terms(context.spark, context.path, d.column)


class SortOrderStrategy:
    """Keeps the sort keys of a dataset, by priority, as a JSON file. Holds no state."""

    name = SORT_ORDER

    def can_handle(self, d: IndexDescriptor) -> bool:
        return d.kind is IndexKind.SORT_KEY

    def apply(self, context: IndexContext, d: IndexDescriptor) -> None:
        keys = [{"path": k.column, "order": k.order, "direction": "desc" if k.descending else "asc"} for k in context.plan.of_kind(IndexKind.SORT_KEY)]
        scan.write_text(f"{local(context.path)}/_index/{SORT_ORDER}.json", json.dumps(keys))


def sort_order(path: str) -> list[dict] | None:
    """The sort keys kept for a dataset; None if there are none or they can't be read."""
    try:
        return json.loads(_read_text(f"{local(path)}/_index/{SORT_ORDER}.json"))
    except (OSError, ValueError):
        return None


def key_values(path: str) -> dict[str, str]:
    """Key-values kept beside the files of a dataset."""
    try:
        return json.loads(_read_text(f"{local(path)}/_index/{KEY_VALUES}.json"))
    except (OSError, ValueError):
        return {}


def set_key_values(path: str, values: Mapping[str, str | None]) -> dict[str, str]:
    """Add or replace key-values of a dataset, None removes one; files stay as they are. Returns what is kept then."""
    kept = {k: v for k, v in {**key_values(path), **values}.items() if v is not None}
    scan.write_text(f"{local(path)}/_index/{KEY_VALUES}.json", json.dumps(kept, sort_keys=True))
    return kept


def find(file: str, kind: str, col: str, up: int = 6) -> str | None:
    """The index of a column in the nearest directory above a file that has one."""
    at = os.path.dirname(local(file))
    for _ in range(up):
        d = directory(at, kind, col)
        if scan.exists(d):
            return d
        at = os.path.dirname(at)
    return None


def _by_directory(files: Iterable[str], kind: str, col: str) -> dict[str, str | None]:
    """:func:`find` for many files, looked for once a directory."""
    return {d: find(f"{d}/x", kind, col) for d in {os.path.dirname(local(f)) for f in files}}


class IndexPlanner:
    """Verdicts from term and bitmap indexes. Results of look-ups are kept while index and files are unchanged."""

    def __init__(self, spark: SparkSession, terms: bool = True, bitmaps: bool = True):
        self.spark, self.terms, self.bitmaps = spark, terms, bitmaps
        self._kept = LruPlanCache(256)

    def stamp(self, files: Iterable[str], predicates: Iterable[Predicate]) -> tuple:
        """What a plan from these indexes depends on: which there are, and their age."""
        out = []
        for p in predicates:
            if self.can_plan(p):
                kind = TERMS if isinstance(p, TokenMatch) else BITMAP
                out += [(d, at, file_stamp(at) if at else None) for d, at in sorted(_by_directory(files, kind, p.columns()[0]).items())]
        return (self.terms, self.bitmaps, tuple(out))

    def can_plan(self, p: Predicate) -> bool:
        if isinstance(p, TokenMatch):
            return self.terms
        return self.bitmaps and isinstance(p, Compare) and p.op is Op.EQ and p.value is not None

    def _look_up(self, d: str, p: Predicate) -> tuple[dict, dict] | None:
        """Row groups of each file that hold a matching key, with some of the keys, and the stamps indexed.

        One row for each row group comes to the driver, as for its footers;
        :meth:`files`, which queries run, gets one for each file.
        """
        key = repr((d, file_stamp(d), p.describe()))
        if (got := self._kept.get(key)) is not None:
            return got
        try:
            hit = self._hit(p)
            df = self.spark.read.parquet(d).where(F.col("value").isNull() | hit)
            keys = F.slice(F.sort_array(F.collect_set("value")), 1, 8)
            found, stamps = {}, {}
            for file, group, size, mtime, some in df.groupBy("file", "row_group").agg(F.max("size"), F.max("mtime"), keys).collect():
                stamps[file] = (size, mtime)
                if some:
                    found.setdefault(file, {})[group] = some
        except Exception as e:
            if isinstance(e, ValueError):
                raise
            return None
        self._kept.set(key, (found, stamps))
        return found, stamps

    def _hit(self, p: Predicate) -> Column:
        if isinstance(p, TokenMatch):
            p.check()
            return F.col("value") == p.term if p.max_edits == 0 else within_edits(F.col("value"), p.term, p.max_edits, p.prefix_length, p.transpositions)
        return F.col("value") == formatted(F.lit(p.value), literal_type(self.spark, p.value))

    def files(self, paths: list[str], p: Predicate) -> list[str]:
        """Those of ``paths`` that may hold a match: files without a usable index, and files with an indexed match."""
        kind = TERMS if isinstance(p, TokenMatch) else BITMAP
        where = _by_directory(paths, kind, p.columns()[0])
        known: dict[str, tuple[int, int, bool]] = {}
        for d in {x for x in where.values() if x}:
            key = repr(("files", d, file_stamp(d), p.describe()))
            got = self._kept.get(key)
            if got is None:
                try:
                    hit = self._hit(p)
                    df = self.spark.read.parquet(d).where(F.col("value").isNull() | hit)
                    got = {r[0]: (r[1], r[2], r[3]) for r in df.groupBy("file").agg(F.max("size"), F.max("mtime"), F.max(F.col("value").isNotNull())).collect()}
                except ValueError:
                    raise
                except Exception:
                    continue
                self._kept.set(key, got)
            known |= got
        keep = []
        for path in paths:
            size, mtime, some = known.get(local(path), (None, None, True))
            if some or file_stamp(path)[1:] != (size, mtime):
                keep.append(path)
        return keep

    def evaluate(self, file: str, group: int, p: Predicate) -> Decision | None:
        """A row group's verdict; None without a usable index."""
        kind = TERMS if isinstance(p, TokenMatch) else BITMAP
        d = find(file, kind, p.columns()[0])
        if d is None:
            return None
        got = self._look_up(d, p)
        if got is None:
            return None
        found, stamps = got
        name = local(file)
        _, size, mtime = file_stamp(file)
        if stamps.get(name) != (size, mtime):
            return None
        keys = found.get(name, {}).get(group)
        if keys:
            return Decision(p.describe(), True, kind, "holds " + ", ".join(keys))
        return Decision(p.describe(), False, kind, "no indexed value matches")


def literal_type(spark: SparkSession, value) -> T.DataType:
    """The column type of a Python literal."""
    known = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bytes: T.BinaryType()}.get(type(value))
    return known or spark.range(1).select(F.lit(value).alias("v")).schema["v"].dataType


def entries(spark: SparkSession, path: str, kind: str, col: str, contains: str | None = None, offset: int = 0, limit: int | None = 100) -> DataFrame:
    """Keys of an index with the row groups that hold them, by key; ``contains`` ignores case, no ``limit`` gives all."""
    df = spark.read.parquet(directory(path, kind, col)).where("value IS NOT NULL")
    if contains:
        df = df.where(F.contains(F.lower("value"), F.lit(contains.lower())))
    grouped = df.groupBy("value").agg(F.sort_array(F.collect_set(F.struct("file", "row_group"))).alias("row_groups"))
    rest = grouped.orderBy("value").offset(offset)
    return rest if limit is None else rest.limit(limit)
