"""Parquet footers on the driver: row groups, statistics, page indexes, bloom filters."""

from __future__ import annotations

import struct
from dataclasses import dataclass
from typing import Any

import pyarrow.parquet as pq
from pyspark.sql import SparkSession

from siftlake.sources import scan


@dataclass(frozen=True)
class Chunk:
    """One column of one row group; ``minimum`` and ``maximum`` are None where unknown."""

    path: str
    minimum: Any
    maximum: Any
    nulls: int | None
    distinct: int | None
    values: int
    codec: str
    compressed: int
    uncompressed: int
    has_statistics: bool
    has_column_index: bool
    has_offset_index: bool
    has_bloom: bool
    physical: str
    logical: str


@dataclass(frozen=True)
class RowGroup:
    ordinal: int
    rows: int
    chunks: dict[str, Chunk]
    sorting: tuple[tuple[str, bool], ...] = ()


@dataclass(frozen=True)
class Footer:
    path: str
    rows: int
    groups: tuple[RowGroup, ...]
    key_values: dict[str, str]
    created_by: str


def read(path: str) -> Footer:
    """The footer of one file."""
    with scan.opened(path) as f:
        meta = pq.ParquetFile(f).metadata
    groups = []
    for g in range(meta.num_row_groups):
        rg = meta.row_group(g)
        chunks = {}
        for c in range(rg.num_columns):
            col = rg.column(c)
            name = col.path_in_schema.replace(".", "/")
            st = col.statistics if col.is_stats_set else None
            has = st is not None and st.has_min_max
            schema = meta.schema.column(c)
            chunks[name] = Chunk(
                name, st.min if has else None, st.max if has else None, st.null_count if st is not None and st.has_null_count else None,
                st.distinct_count if st is not None and st.has_distinct_count else None, col.num_values, col.compression, col.total_compressed_size,
                col.total_uncompressed_size, has, col.has_column_index, col.has_offset_index, getattr(col, "bloom_filter_offset", None) is not None,
                schema.physical_type, str(schema.logical_type),
            )
        sorting = tuple((meta.schema.column(s.column_index).path.replace(".", "/"), s.descending) for s in rg.sorting_columns) if hasattr(rg, "sorting_columns") else ()
        groups.append(RowGroup(g, rg.num_rows, chunks, sorting))
    kv = {k.decode(errors="replace"): v.decode(errors="replace") for k, v in (meta.metadata or {}).items()}
    return Footer(path, meta.num_rows, tuple(groups), kv, meta.created_by)


def group_rows(path: str) -> list[int]:
    """Rows of each row group of one file; the chunks aren't looked at."""
    with scan.opened(path) as f:
        meta = pq.ParquetFile(f).metadata
    return [meta.row_group(g).num_rows for g in range(meta.num_row_groups)]


@dataclass(frozen=True)
class Page:
    first_row: int
    rows: int
    minimum: Any
    maximum: Any
    nulls: int | None
    all_null: bool


def decode(raw: bytes, physical: str, text: bool) -> Any:
    """A bound of a column index; None where the type's order isn't known."""
    if physical == "INT32" and len(raw) == 4:
        return struct.unpack("<i", raw)[0]
    if physical == "INT64" and len(raw) == 8:
        return struct.unpack("<q", raw)[0]
    if physical == "FLOAT" and len(raw) == 4:
        return struct.unpack("<f", raw)[0]
    if physical == "DOUBLE" and len(raw) == 8:
        return struct.unpack("<d", raw)[0]
    if physical == "BOOLEAN" and len(raw) == 1:
        return raw != b"\0"
    if physical == "BYTE_ARRAY" and text:
        return raw.decode("utf-8", errors="replace")
    return None


class JvmFooter:
    """Page indexes and bloom filters through the Parquet library on Spark's class path."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), spark._jsc.hadoopConfiguration())
        self._jvm, self._reader = jvm, jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
        self._blocks = list(self._reader.getFooter().getBlocks())

    def __enter__(self) -> JvmFooter:
        return self

    def __exit__(self, *_: object) -> None:
        self._reader.close()

    def _column(self, group: int, path: str):
        dotted = path.replace("/", ".")
        return next((c for c in self._blocks[group].getColumns() if c.getPath().toDotString() == dotted), None)

    def pages(self, group: int, chunk: Chunk) -> list[Page] | None:
        """Pages of a column, or None without an index."""
        col = self._column(group, chunk.path)
        if col is None:
            return None
        offsets, index = self._reader.readOffsetIndex(col), self._reader.readColumnIndex(col)
        if offsets is None:
            return None
        n, total = offsets.getPageCount(), self._blocks[group].getRowCount()
        starts = [offsets.getFirstRowIndex(i) for i in range(n)] + [total]
        if index is None:
            return [Page(a, b - a, None, None, None, False) for a, b in zip(starts, starts[1:], strict=False)]
        text = "String" in chunk.logical or "UTF8" in chunk.logical
        lows, highs, nulls, counts = index.getMinValues(), index.getMaxValues(), index.getNullPages(), index.getNullCounts()
        raw = lambda b: bytes(b.array()[b.arrayOffset() + b.position() : b.arrayOffset() + b.limit()])
        out = []
        for i in range(n):
            void = bool(nulls[i])
            low, high = (None, None) if void else (decode(raw(lows[i]), chunk.physical, text), decode(raw(highs[i]), chunk.physical, text))
            out.append(Page(starts[i], starts[i + 1] - starts[i], low, high, counts[i] if counts is not None and len(counts) > i else None, void))
        return out

    def bloom_misses(self, group: int, chunk: Chunk, value: Any) -> bool | None:
        """Whether the bloom filter rules the value out; None without a filter."""
        col = self._column(group, chunk.path)
        bloom = None if col is None else self._reader.getBloomFilterDataReader(self._blocks[group]).readBloomFilter(col)
        if bloom is None:
            return None
        if chunk.physical == "BYTE_ARRAY" and isinstance(value, str):
            hashed = bloom.hash(self._jvm.org.apache.parquet.io.api.Binary.fromString(value))
        elif chunk.physical in ("INT32", "INT64") and isinstance(value, int):
            wrap = self._jvm.java.lang.Integer if chunk.physical == "INT32" else self._jvm.java.lang.Long
            hashed = bloom.hash(wrap.valueOf(value).intValue() if chunk.physical == "INT32" else wrap.valueOf(value).longValue())
        elif chunk.physical == "DOUBLE" and isinstance(value, float):
            hashed = bloom.hash(float(value))
        else:
            return None
        return not bloom.findHash(hashed)
