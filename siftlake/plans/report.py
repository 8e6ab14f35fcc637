"""Plan reports: what is pushed, what is residual, which files, row groups and pages could be skipped.

The report is made from footers on the driver and explains; Spark prunes by
itself when the query runs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession

from siftlake.operators.predicates import Compare, Op, Predicate
from siftlake.operators.split import Diagnostic
from siftlake.plans import footer as footers
from siftlake.plans import prune
from siftlake.plans.prune import Decision
from siftlake.sources.scan import partition_values


@dataclass(frozen=True)
class PageReport:
    total: int
    selected: int
    rows: int
    intervals: tuple[tuple[int, int], ...]
    note: str


@dataclass(frozen=True)
class GroupPlan:
    ordinal: int
    rows: int
    selected: bool
    decisions: tuple[Decision, ...]
    pages: PageReport


@dataclass(frozen=True)
class FilePlan:
    path: str
    selected: bool
    rows: int
    decisions: tuple[Decision, ...]
    groups: tuple[GroupPlan, ...]


@dataclass(frozen=True)
class QueryPlan:
    files: tuple[FilePlan, ...]
    pushed: tuple[str, ...]
    residual: tuple[str, ...]
    diagnostics: tuple[Diagnostic, ...]
    read_columns: tuple[str, ...] | None
    filter_columns: tuple[str, ...]
    deferred_columns: tuple[str, ...]
    page_indexes: bool

    @property
    def selected_files(self) -> list[FilePlan]:
        return [f for f in self.files if f.selected]

    @property
    def total_groups(self) -> int:
        return sum(len(f.groups) for f in self.files)

    @property
    def selected_groups(self) -> int:
        return sum(g.selected for f in self.files for g in f.groups)

    @property
    def candidate_rows(self) -> int:
        return sum(g.pages.rows for f in self.files for g in f.groups if g.selected)

    @property
    def late(self) -> bool:
        return bool(self.filter_columns and self.deferred_columns)

    def lines(self) -> list[str]:
        listed = lambda x: ", ".join(x) if x else "none"
        first = f"File: {self.files[0].path}" if len(self.files) == 1 else f"Files: {len(self.selected_files)}/{len(self.files)} selected"
        out = [
            first,
            f"Pushdown: {listed(self.pushed)}",
            f"Residual: {listed(self.residual)}",
            f"Residual Diagnostics: {listed([str(d) for d in self.diagnostics])}",
            f"Read Columns: {'all' if self.read_columns is None else listed(self.read_columns)}",
            f"Filter Columns: {listed(self.filter_columns)}",
            f"Deferred Columns: {listed(self.deferred_columns)}",
            f"Late Materialization: {'yes' if self.late else 'no'}",
            f"Page Indexes: {'used' if self.page_indexes else 'none'}",
        ]
        for f in self.files:
            out.append(f"{f.path}: {'selected' if f.selected else 'skipped'}")
            out += [f"  Partition {d}" for d in f.decisions]
            for g in f.groups:
                p = g.pages
                out.append(f"  RG {g.ordinal}: {'read' if g.selected else 'skip'} ({g.rows} rows, pages {p.selected}/{p.total}, candidate rows <= {p.rows if g.selected else 0})")
                out.append(f"    page pruning: {p.note}")
                out += [f"    {d}" for d in g.decisions]
        return out


def _decide(spark: SparkSession, file: str, group: footers.RowGroup, p: Predicate, jvm: footers.JvmFooter | None, planners: Sequence) -> Decision:
    """Statistics, then the bloom filter, then planners that can; a later source is asked only while a match is possible."""
    chunk = group.chunks.get(p.columns()[0].replace(".", "/")) if p.columns() else None
    if chunk is None:
        found = Decision(p.describe(), True, "schema", "the file has no such column")
    else:
        found = prune.by_statistics(p, chunk, group.rows)
        if found.may_match and jvm is not None and isinstance(p, Compare) and p.op is Op.EQ and p.value is not None and jvm.bloom_misses(group.ordinal, chunk, p.value):
            found = Decision(p.describe(), False, "bloom", "the bloom filter holds no such value")
    for planner in planners:
        if not found.may_match:
            break
        if planner.can_plan(p) and (more := planner.evaluate(file, group.ordinal, p)) is not None:
            source = more.source if found.source == "schema" else f"{found.source}+{more.source}"
            found = Decision(p.describe(), more.may_match, source, more.reason)
    return found


def _pages(group: footers.RowGroup, predicates: Sequence[Predicate], jvm: footers.JvmFooter | None) -> PageReport:
    whole = [(0, group.rows)]
    if jvm is None or not predicates:
        return PageReport(0, 0, group.rows, tuple(whole), "not needed" if not predicates else "no page index")
    left, best, known = whole, [], False
    for p in predicates:
        chunk = group.chunks.get(p.columns()[0].replace(".", "/")) if p.columns() else None
        pages = jvm.pages(group.ordinal, chunk) if chunk is not None else None
        if not pages:
            continue
        known, best = True, pages if len(pages) > len(best) else best
        left = prune.intersect(left, prune.page_intervals(p, pages))
        if not left:
            break
    if not known:
        return PageReport(0, 0, group.rows, tuple(whole), "no page index")
    return PageReport(len(best), len(prune.touched(best, left)), sum(b - a for a, b in left), tuple(left), "by column index")


def file_plan(spark: SparkSession, path: str, predicates: Sequence[Predicate], planners: Sequence = (), pages: bool = True) -> FilePlan:
    values = partition_values(path)
    by_path = [d for p in predicates if (d := prune.by_partition(p, values)) is not None]
    footer = footers.read(path)
    if not all(d.may_match for d in by_path):
        return FilePlan(path, False, footer.rows, tuple(by_path), ())
    inside = [p for p in predicates if p.columns() and p.columns()[0].rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower() not in values]
    jvm = footers.JvmFooter(spark, path) if pages and inside else None
    groups = []
    try:
        for g in footer.groups:
            decisions = [_decide(spark, path, g, p, jvm, planners) for p in inside]
            keep = all(d.may_match for d in decisions)
            report = _pages(g, inside, jvm) if keep else PageReport(0, 0, 0, (), "row group skipped")
            groups.append(GroupPlan(g.ordinal, g.rows, keep and (report.rows > 0 or g.rows == 0), tuple(decisions), report))
    finally:
        if jvm is not None:
            jvm.__exit__()
    return FilePlan(path, any(g.selected for g in groups) or not groups, footer.rows, tuple(by_path), tuple(groups))
