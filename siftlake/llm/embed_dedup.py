"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors whose cosine is t differ by 2 - 2t squared. Rotated and split
into blocks of few coordinates, two such vectors differ in one block at
least by no more than the block's share of it. Each block is a range join
over a grid of its coordinates: a vector is at home in one cell and visits
those neighbouring cells, of lower order, within range. A pair is taken up
in the first block that finds it and verified by the cosine of the whole
vectors, so every link is found and counted once. Equal vectors are joined
as one.

Vectors of a label that fit one task meet there, sent once, and all blocks
are joined in it. Labels of more rows are sent by block and by cells of as
many coordinates as their size asks for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.common import written
from siftlake.llm.components import components

_SLACK = 1e-9


@dataclass(frozen=True)
class Pigeonhole:
    """Cosine from which vectors link, coordinates a block (the grid uses eight at most), and the rows a task compares at once."""

    cosine: float = 0.93
    block: int = 8
    chunk: int = 8192

    def bounds(self, dim: int) -> list[tuple[int, int]]:
        n = max(1, dim // self.block)
        return [(int(p[0]), int(p[-1]) + 1) for p in np.array_split(np.arange(dim), n)]

    def budgets(self, dim: int) -> list[float]:
        """Squared distance a block may take, in proportion to its coordinates."""
        return [(2 - 2 * self.cosine) * (b - a) / dim + _SLACK for a, b in self.bounds(dim)]


def _rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(20240229).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def _rotated(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True) @ _rotation(vectors.shape[1])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of lists of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _width(budget: float) -> float:
    """Side of the cells: four times the range, so that few points are in reach of two sides; a coordinate has at most 128 cells."""
    return max(4 * math.sqrt(budget), 1 / 63)


def routes(x: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of each row's own cell and of the cells of lower order that its range reaches.

    ``x`` has at most eight coordinates, whose cells make the bytes of a
    cell's number, the first coordinate's the highest. Own cells come first,
    in the order of rows.
    """
    width = _width(budget)
    home = np.floor(x / width).astype(np.int64)
    row, gap = np.arange(len(x)), np.zeros(len(x))
    own = np.zeros(len(x), np.uint64)
    cell = own.copy()
    for k in range(x.shape[1]):
        at = (home[:, k] + 128).astype(np.uint64)
        own = own << np.uint64(8) | at
        low, high = (x[:, k] - home[:, k] * width) ** 2, ((home[:, k] + 1) * width - x[:, k]) ** 2
        rows, gaps, cells = [row], [gap], [cell << np.uint64(8) | at[row]]
        for side, step in ((low, -1), (high, 1)):
            near = np.flatnonzero(gap + side[row] <= budget)
            rows.append(row[near])
            gaps.append(gap[near] + side[row[near]])
            cells.append(cell[near] << np.uint64(8) | (at[row[near]].astype(np.int64) + step).astype(np.uint64))
        row, gap, cell = np.concatenate(rows), np.concatenate(gaps), np.concatenate(cells)
    lower = np.flatnonzero(cell < own[row])
    return np.concatenate([np.arange(len(x)), row[lower]]), np.concatenate([own, cell[lower]])


def _expand(begin: np.ndarray, count: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index, place) for ``count`` places from ``begin`` of each index, about ``most`` at a time."""
    ends = np.cumsum(count)
    lo = 0
    while lo < len(count):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        part = count[lo:hi]
        index = np.repeat(np.arange(lo, hi), part)
        yield index, begin[index] + np.arange(len(index)) - np.repeat(np.cumsum(part) - part, part)
        lo = hi


def meetings(x: np.ndarray, left: np.ndarray, right: np.ndarray | None, both: bool, budget: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of ``left`` with each other, or with ``right`` (none in common), that share a cell.

    Rows of ``left`` are at home in what is joined. ``both`` tells that
    those of ``right`` are too, so that left rows visit them as well.
    """
    own = lambda rows: routes(x[rows], budget)

    def match(row: np.ndarray, cell: np.ndarray, rows: np.ndarray, homes: np.ndarray, of_home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        order = np.argsort(of_home, kind="stable")
        sorted_cells = of_home[order]
        begin = np.searchsorted(sorted_cells, cell)
        for index, place in _expand(begin, np.searchsorted(sorted_cells, cell, "right") - begin):
            yield rows[row[index]], homes[order[place]]

    row, cell = own(left)
    n = len(left)
    if right is None:
        order = np.argsort(cell[:n], kind="stable")
        ends = np.searchsorted(cell[:n][order], cell[:n][order], "right")
        for index, place in _expand(np.arange(n) + 1, ends - np.arange(n) - 1):
            yield left[order[index]], left[order[place]]
        yield from match(row[n:], cell[n:], left, left, cell[:n])
        return
    r_row, r_cell = own(right)
    yield from match(r_row, r_cell, right, left, cell[:n])
    if both:
        yield from match(row[n:], cell[n:], left, right, r_cell[: len(right)])


def near_duplicates(vectors: DataFrame, how: Pigeonhole = Pigeonhole(), vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row; ids of any type that has an order.

    Rows link if their labels are equal and not null and their cosine in
    double precision reaches the bound. Vectors that are null, zero or hold
    null or non-finite components, vectors of other lengths and rows with a
    null id or label link with nothing; a null id is kept. ``n_links``
    counts all rows linked directly, equal vectors and repeated ids
    included, ``component_id`` is the smallest id reachable. A cell of more
    rows than a chunk is compared chunk by chunk in tasks of their own, so
    no hot label or cell fills a task. An empty table gives an empty one.
    """
    e = F.col(embedding)
    good = (
        F.col(vec_id).isNotNull() & F.col(label).isNotNull() & e.isNotNull() & (F.size(e) > 0)
        & F.forall(e, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))) & F.exists(e, lambda x: x != 0)
    )
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.when(good, F.struct(F.col(label).alias("label"), e.cast("array<double>").alias("v"))).alias("k"))
    distinct = written(
        rows.where("k IS NOT NULL").groupBy("k").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
        .select(F.monotonically_increasing_id().alias("node"), "rep", "copies", "k.label", "k.v", F.size("k.v").alias("dim")),
        "vectors",
    )
    kind = distinct.schema["label"].dataType.simpleString()
    shape = f"node long, copies long, label {kind}, v array<double>, dim int, block int, cell long, home boolean"
    names = ["node", "copies", "label", "v", "dim", "block", "cell", "home"]
    # One row for each label of more rows than a chunk: at most 1/chunk of the vectors.
    large = distinct.groupBy("label", "dim").count().where(F.col("count") > how.chunk)
    large = written(large.select("label", "dim", F.ceil(F.log2(F.col("count") * 4 / how.chunk)).cast("int").alias("cuts")), "large")
    if large.count() <= 100_000:
        large = F.broadcast(large)
    sized = distinct.join(large, ["label", "dim"], "left")
    small = sized.where("cuts IS NULL").select("node", "copies", "label", "v", "dim", F.lit(-1).alias("block"), F.lit(0).cast("long").alias("cell"), F.lit(True).alias("home"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, cuts = b.column(4).to_numpy(), b.column(5).to_numpy()
            for dim, cut in {(int(d), int(c)) for d, c in zip(dims, cuts, strict=True)}:
                part = b.take(pa.array(np.flatnonzero((dims == dim) & (cuts == cut))))
                y = _rotated(_matrix(part.column(3), dim))
                for k, ((lo, hi), budget) in enumerate(zip(how.bounds(dim), how.budgets(dim), strict=True)):
                    row, cell = routes(y[:, lo : min(hi, lo + 8, lo + cut)], budget)
                    for at in range(0, len(row), 8192):
                        r, c = row[at : at + 8192], cell[at : at + 8192]
                        home = np.arange(at, at + len(r)) < len(y)
                        yield pa.RecordBatch.from_arrays([*part.take(pa.array(r)).columns[:5], pa.array(np.full(len(r), k, np.int32)), pa.array(c.view(np.int64)), pa.array(home)], names)

    placed = sized.where("cuts IS NOT NULL").select("node", "copies", "label", "v", "dim", "cuts").mapInArrow(place, shape)
    key = ["label", "dim", "block", "cell"]
    # Only ids and cells are counted: no vector is shuffled for it.
    loads = written(placed.groupBy(*key).agg(F.count_if("home").alias("homes"), F.count("*").alias("all")).where("homes > 0 AND all > 1"), "cells")
    # Chunk c of a cell's homes meets chunk d >= c of its homes and visitors: one row for each meeting.
    chunks = F.greatest(F.ceil(F.col("all") / how.chunk), F.lit(1)).cast("int")
    parts = placed.join(loads.select(*key, chunks.alias("chunks")), key)
    parts = parts.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("chunks") - 1)
    meet = F.when(
        F.col("home"),
        F.concat(
            F.transform(others, lambda d: F.struct(F.least(d, F.col("mine")).alias("c"), F.greatest(d, F.col("mine")).alias("d"))),
            F.transform(others, lambda d: F.struct(F.col("mine").alias("c"), (d + F.col("chunks")).alias("d"))),
        ),
    ).otherwise(F.transform(others, lambda c: F.struct(c.alias("c"), (F.col("mine") + F.col("chunks")).alias("d"))))
    cut = parts.withColumn("m", F.explode(F.array_distinct(meet))).select(*names, "mine", "m.c", "m.d")
    zero = F.lit(0)
    sent = small.select(*names, zero.alias("mine"), zero.alias("c"), zero.alias("d")).unionByName(cut)

    def compare(table: pa.Table) -> pa.Table:
        dim, block = table.column("dim")[0].as_py(), table.column("block")[0].as_py()
        c, d = table.column("c")[0].as_py(), table.column("d")[0].as_py()
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        v = _matrix(table.column("v"), dim)
        home, mine = table.column("home").to_numpy(), table.column("mine").to_numpy()
        left = np.flatnonzero(home & (mine == c))
        # Chunks of visitors are numbered after those of homes.
        right = None if c == d else np.flatnonzero(~home if (~home).any() else home & (mine == d))
        both = right is not None and bool(len(right)) and bool(home[right].all())
        bounds, budgets = how.bounds(dim), how.budgets(dim)
        y, norm = _rotated(v), np.linalg.norm(v, axis=1)
        n, root = np.zeros(len(node)), np.arange(len(node))
        for k in range(len(bounds)) if block < 0 else (block,):
            lo, hi = bounds[k]
            for i, j in meetings(y[:, lo : min(hi, lo + 8)], left, right, both, budgets[k]):
                near = ((y[i, lo:hi] - y[j, lo:hi]) ** 2).sum(axis=1) <= budgets[k]
                i, j = i[near], j[near]
                for s in range(0, len(i), 1 << 16):
                    p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                    if k:  # a pair belongs to the first block that finds it
                        gaps = (y[p, :lo] - y[q, :lo]) ** 2
                        before = np.add.reduceat(gaps, [b for b, _ in bounds[:k]], axis=1) <= np.array(budgets[:k])
                        p, q = p[~before.any(axis=1)], q[~before.any(axis=1)]
                    ok = (v[p] * v[q]).sum(axis=1) / (norm[p] * norm[q]) >= how.cosine
                    p, q = p[ok], q[ok]
                    n += np.bincount(p, copies[q], len(node)) + np.bincount(q, copies[p], len(node))
                    root = _merged(root, p, q)
        some = np.flatnonzero(n)
        return pa.table({"node": node[some], "n": n[some].astype(np.int64), "to": node[root[some]]})

    by = [*key, "c", "d"]
    found = written(sent.groupBy(*by).applyInArrow(compare, "node long, n long, to long"), "near")
    roots = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    named = distinct.join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(lowest, "root").select(F.struct("label", "v").alias("k"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = rows.join(named, "k", "left")
    component = F.coalesce("component_id", "vec_id")
    return linked.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept")
    )


def _merged(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Roots after joining the rows of some pairs; every row's root is the smallest row of its set."""
    while len(p):
        a, b = root[p], root[q]
        open_ = a != b
        if not open_.any():
            break
        p, q, a, b = p[open_], q[open_], a[open_], b[open_]
        low = np.arange(len(root))
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while (low[low] != low).any():
            low = low[low]
        root = low[root]
    return root
