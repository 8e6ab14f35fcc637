"""The fluent query: immutable, lazily a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from contextlib import nullcontext
from dataclasses import dataclass, field, replace
from types import MappingProxyType
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftlake.functions.text import single_term
from siftlake.operators import predicates as P
from siftlake.operators.split import Diagnostic, split
from siftlake.plans import cache as caches
from siftlake.plans import footer as footers
from siftlake.plans.indexes import IndexPlanner
from siftlake.plans.report import QueryPlan, file_plan
from siftlake.sources import scan
from siftlake.sources.encryption import Encryption
from siftlake.sources.pool import ReaderPool


class StrictPushdownError(RuntimeError):
    """A strict query has conditions that can't be pushed down."""


@dataclass(frozen=True)
class Query:
    """Scan, filter and project one set of Parquet files.

    Every method returns a new query. Conditions add up by AND. ``select``
    projects from the source row, so a later one replaces an earlier.
    """

    spark: SparkSession
    paths: tuple[str, ...]
    options: Mapping[str, str] = field(default_factory=lambda: MappingProxyType({}))
    schema: StructType | None = None
    filter: P.PushdownFilter = P.PushdownFilter()
    conditions: tuple[P.Predicate, ...] = ()
    projection: tuple[Any, ...] | None = None
    planners: tuple[Any, ...] = ()
    factory: scan.ReaderFactory = scan.default_factory
    cache: Any = caches.DEFAULT
    strict: bool = False
    encryption: Encryption = Encryption()
    pool: ReaderPool | None = None

    # sources

    @staticmethod
    def from_file(spark: SparkSession, path: str, options: Mapping[str, str] | None = None, schema: StructType | None = None) -> Query:
        return Query.from_files(spark, [path], options, schema)

    @staticmethod
    def from_files(spark: SparkSession, paths: Iterable[str], options: Mapping[str, str] | None = None, schema: StructType | None = None) -> Query:
        return Query(spark, scan.file_set(paths), MappingProxyType(dict(options or {})), schema)

    @staticmethod
    def from_directory(spark: SparkSession, directory: str, pattern: str = "*.parquet", recursive: bool = True, options: Mapping[str, str] | None = None) -> Query:
        return Query.from_files(spark, scan.list_directory(spark, directory, pattern, recursive), options)

    # options

    def with_options(self, options: Mapping[str, str]) -> Query:
        return replace(self, options=MappingProxyType(dict(options)))

    def configure_options(self, change: Callable[[dict[str, str]], None]) -> Query:
        """Change a copy of the options."""
        own = dict(self.options)
        change(own)
        return self.with_options(own)

    def with_reader_factory(self, factory: scan.ReaderFactory) -> Query:
        if factory is None:
            raise ValueError("a factory is needed")
        return replace(self, factory=factory, pool=None)

    def with_reader_pool(self, pool: ReaderPool) -> Query:
        """Scan by a pool, whose lease every result of this query holds while it runs."""
        return replace(self.with_reader_factory(pool.factory), pool=pool)

    def _lease(self):
        return nullcontext() if self.pool is None else self.pool.lease(self.paths)

    def with_cache(self, cache: Any) -> Query:
        return replace(self, cache=cache)

    def without_cache(self) -> Query:
        return replace(self, cache=caches.NoCache())

    def strict_pushdown(self, on: bool = True) -> Query:
        return replace(self, strict=on)

    def with_planner(self, planner: Any) -> Query:
        return replace(self, planners=(*self.planners, planner))

    def with_planners(self, planners: Iterable[Any]) -> Query:
        return replace(self, planners=(*self.planners, *planners))

    def with_text_search(self) -> Query:
        return self.with_planner(IndexPlanner(self.spark, terms=True, bitmaps=False))

    def with_indexes(self) -> Query:
        return self.with_planner(IndexPlanner(self.spark, terms=False, bitmaps=True))

    def with_footer_key(self, key: str) -> Query:
        return replace(self, encryption=replace(self.encryption, footer_key=key))

    def with_footer_signing_key(self, key: str) -> Query:
        return replace(self, encryption=replace(self.encryption, footer_signing_key=key))

    def use_plaintext_footer(self, on: bool = True) -> Query:
        return replace(self, encryption=replace(self.encryption, plaintext_footer=on))

    def with_aad_prefix(self, prefix: str, out_of_band: bool = False) -> Query:
        return replace(self, encryption=replace(self.encryption, aad_prefix=prefix, aad_out_of_band=out_of_band))

    def use_ctr_variant(self, on: bool = True) -> Query:
        return replace(self, encryption=replace(self.encryption, ctr_variant=on))

    def with_column_key_resolver(self, resolver: Callable[[str], str | None]) -> Query:
        return replace(self, encryption=replace(self.encryption, column_key=resolver))

    # conditions

    def pushdown(self, *filters: P.PushdownFilter | P.Predicate | Callable[[P.FilterBuilder], P.FilterBuilder]) -> Query:
        """Add pushdown filters: filters, predicates, or functions of a builder."""
        out = self.filter
        for f in filters:
            if isinstance(f, P.Predicate):
                f = P.PushdownFilter((f,))
            elif not isinstance(f, P.PushdownFilter):
                f = f(P.FilterBuilder()).build()
            out = out.both(f)
        return replace(self, filter=out)

    def where(self, condition: P.Predicate | Column) -> Query:
        """Add any condition; its conjuncts that can be are used in planning too."""
        if isinstance(condition, Column):
            condition = P.Opaque(condition)
        return replace(self, conditions=(*self.conditions, condition))

    def token_match(self, path: str, term: str) -> Query:
        return self.with_text_search().pushdown(P.TokenMatch(path, single_term(term)))

    def token_fuzzy(self, path: str, term: str, max_edits: int = 1, prefix_length: int = 0, transpositions: bool = True) -> Query:
        return self.with_text_search().pushdown(P.TokenMatch(path, single_term(term), max_edits, prefix_length, transpositions))

    def select(self, *items: str | P.Field | Column) -> Query:
        """Project: column paths (a struct or array whole), fields, or column expressions."""
        return replace(self, projection=tuple(items))

    # planning

    def _split(self) -> tuple[tuple[P.Predicate, ...], tuple[P.Predicate, ...], tuple[Diagnostic, ...]]:
        pushed, residual, said = list(self.filter.predicates), [], []
        for c in self.conditions:
            s = split(c)
            pushed += s.pushed
            residual += s.residual
            said += s.diagnostics
        if self.strict and residual:
            raise StrictPushdownError("not pushed down: " + "; ".join(str(d) for d in said))
        return tuple(pushed), tuple(residual), tuple(said)

    def _columns(self, pushed, residual) -> tuple[tuple[str, ...] | None, tuple[str, ...], tuple[str, ...]]:
        slashed = lambda ps: sorted({c.replace(".", "/") for p in ps for c in p.columns()})
        used = slashed((*pushed, *residual))
        if any(isinstance(p, P.Opaque) and not p.reads for p in residual):
            return None, tuple(used), ()
        leaves = [p for p, _ in scan.leaf_paths(self.source().schema)]
        if self.projection is None:
            wanted = set(leaves)
        else:
            names = [i if isinstance(i, str) else i.path if isinstance(i, P.Field) else None for i in self.projection]
            if None in names:
                return None, tuple(used), ()
            wanted = {x for n in names for x in leaves if x == n.replace(".", "/") or x.startswith(n.replace(".", "/") + "/")}
        deferred = sorted(wanted - set(used)) if used else []
        return tuple(sorted(wanted | set(used))), tuple(used), tuple(deferred)

    def _key(self, mode: str) -> str:
        parts = [mode, [caches.file_stamp(p) for p in self.paths], sorted(self.options.items()), self.schema.json() if self.schema else None, self.strict]
        parts += [[p.describe() for p in self.filter.predicates], [c.describe() for c in self.conditions], [str(x.path if isinstance(x, P.Field) else x) for x in self.projection or ()]]
        pushed = self._split()[0]
        stamp = lambda p: p.stamp(self.paths, pushed) if hasattr(p, "stamp") else caches.identity(p)
        parts += [[(type(p).__qualname__, stamp(p)) for p in self.planners], caches.identity(self.factory), self.encryption.fingerprint()]
        return caches.key(parts)

    def plan(self) -> QueryPlan:
        """The plan report, kept in the cache while files and query are the same."""
        pushed, residual, said = self._split()
        key = self._key("plan")
        if (got := self.cache.get(key)) is not None:
            return got
        files = tuple(file_plan(self.spark, p, pushed, self.planners) for p in self.paths)
        read, used, deferred = self._columns(pushed, residual)
        pages = any(g.pages.total for f in files for g in f.groups)
        out = QueryPlan(files, tuple(p.describe() for p in pushed), tuple(p.describe() for p in residual), said, read, used, deferred, pages)
        self.cache.set(key, out)
        return out

    def explain(self, spark_plan: bool = False) -> str:
        out = "\n".join(self.plan().lines())
        if spark_plan:
            out += "\n\n" + self.dataframe()._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return out

    def _selected(self, pushed: tuple[P.Predicate, ...]) -> list[str]:
        """Files that planners don't rule out. Only asked with planners: Spark prunes by partition and statistics itself.

        A planner with ``files`` answers for all of them at once, from one
        look-up; others are asked for each row group of each footer.
        """
        left = list(self.paths)
        asked = []
        for planner in self.planners:
            for p in pushed:
                if planner.can_plan(p):
                    if hasattr(planner, "files"):
                        left = planner.files(left, p)
                    else:
                        asked.append((planner, p))
        if not asked:
            return left
        keep = []
        for path in left:
            groups = range(len(footers.read(path).groups))
            may = lambda g: all((d := planner.evaluate(path, g, p)) is None or d.may_match for planner, p in asked)  # noqa: B023, E731
            if not groups or any(may(g) for g in groups):
                keep.append(path)
        return keep

    def source(self, paths: Iterable[str] | None = None) -> DataFrame:
        """The scan before any condition."""
        paths = list(self.paths if paths is None else paths)
        options = dict(self.options)
        if self.encryption.wanted:
            self.encryption.require_client(self.spark)
            options |= self.encryption.options()
            if self.encryption.column_key:
                schema = self.schema or scan.read_files(self.spark, paths[:1], options).schema
                options |= self.encryption.options([name.replace("/", ".") for name, _ in scan.leaf_paths(schema)])
        if self.schema is not None and self.factory is scan.default_factory:
            return scan.read_files(self.spark, paths, options, self.schema)
        return self.factory(self.spark, paths, options)

    def filtered(self) -> DataFrame:
        pushed, _, _ = self._split()
        for p in pushed:
            if isinstance(p, P.TokenMatch):
                p.check()
        paths = self._selected(pushed)
        df = self.source(paths or self.paths[:1])
        if not paths:
            df = df.where(F.lit(False))
        for p in (*self.filter.predicates, *self.conditions):
            df = df.where(p.to_column())
        return df

    def _projected(self, df: DataFrame) -> DataFrame:
        if self.projection is None:
            return df
        as_column = lambda i: i if isinstance(i, Column) else (P.column(i.path) if isinstance(i, P.Field) else P.column(i))
        return df.select(*[as_column(i) for i in self.projection])

    def dataframe(self) -> DataFrame:
        return self._projected(self.filtered())

    # results

    def to_list(self) -> list[Row]:
        with self._lease():
            return self.dataframe().collect()

    def to_iterator(self) -> Iterator[Row]:
        """Rows pulled partition by partition."""
        with self._lease():
            yield from self.dataframe().toLocalIterator()

    def count(self) -> int:
        """Rows that match. The projection doesn't matter; without conditions Spark reads the footers only, in parallel."""
        with self._lease():
            return self.filtered().count()

    long_count = count

    def any(self) -> bool:
        with self._lease():
            return bool(self.filtered().select(F.lit(1)).limit(1).take(1))

    def first_or_default(self, default: Any = None) -> Row | Any:
        """The first row by file and position.

        Files are in order, so the first file with a match has it: files are
        searched in runs that double, and the search ends with a match.
        """
        with self._lease():
            at, run = 0, 1
            while at < len(self.paths):
                part = replace(self, paths=self.paths[at : at + run])
                got = self._projected(scan.in_file_order(part.filtered())).limit(1).collect()
                if got:
                    return got[0]
                at, run = at + run, run * 2
            return default
