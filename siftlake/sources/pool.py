"""A pool of prepared scans: DataFrames kept ready by files and options."""

from __future__ import annotations

import hashlib
import threading
from collections import OrderedDict
from collections.abc import Iterable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from siftlake.sources import scan


class ReaderPool:
    """Hands scans out; at most ``max_per_file`` are out for one file at a time.

    A query that runs (``to_list``, ``count``, ``any``, ...) leases its files
    until it has ended. A file can be blocked: leases drain, new ones wait,
    the file may be replaced, and Spark's cached listing of it is refreshed
    on release. The DataFrame of a query may be run at any time, so it holds
    no lease: use :meth:`lease` around it. At most ``capacity`` scans are
    kept ready, the least recently used go first.
    """

    def __init__(self, max_per_file: int = 4, capacity: int = 256):
        if max_per_file < 1 or capacity < 1:
            raise ValueError("max_per_file and capacity must be positive")
        self.max_per_file, self.capacity = max_per_file, capacity
        self._frames: OrderedDict[str, DataFrame] = OrderedDict()
        self._out: dict[str, int] = {}
        self._blocked: set[str] = set()
        self._holders: list[int] = []
        self._change = threading.Condition()
        self.opened = 0

    @staticmethod
    def _key(paths: Iterable[str], options: Mapping[str, str]) -> str:
        return hashlib.sha256(repr((tuple(paths), sorted(options.items()))).encode()).hexdigest()

    @contextmanager
    def rent(self, spark: SparkSession, paths: list[str], options: Mapping[str, str] | None = None) -> Iterator[DataFrame]:
        with self.lease(paths):
            yield self._frame(spark, list(paths), options or {})

    @contextmanager
    def lease(self, paths: Iterable[str]) -> Iterator[None]:
        """Hold files while something reads them; waits while they are blocked or fully leased."""
        paths = list(dict.fromkeys(paths))
        with self._change:
            self._change.wait_for(lambda: not self._blocked.intersection(paths) and all(self._out.get(p, 0) < self.max_per_file for p in paths))
            for p in paths:
                self._out[p] = self._out.get(p, 0) + 1
            self._holders.append(threading.get_ident())
        try:
            yield
        finally:
            with self._change:
                self._holders.remove(threading.get_ident())
                for p in paths:
                    self._out[p] -= 1
                    if not self._out[p]:
                        del self._out[p]
                self._change.notify_all()

    def _frame(self, spark: SparkSession, paths: list[str], options: Mapping[str, str]) -> DataFrame:
        key = self._key(paths, options)
        with self._change:
            found = self._frames.get(key)
            if found is not None:
                self._frames.move_to_end(key)
        if found is None:
            found = scan.read_files(spark, paths, options)
            with self._change:
                self.opened += 1
                self._frames[key] = found
                while len(self._frames) > self.capacity:
                    self._frames.popitem(last=False)
        return found

    def factory(self, spark: SparkSession, paths: list[str], options: Mapping[str, str]) -> DataFrame:
        """The pool as a reader factory of queries; the query that runs holds the lease."""
        with self._change:
            self._change.wait_for(lambda: not self._blocked.intersection(paths) or threading.get_ident() in self._holders)
        return self._frame(spark, list(paths), options)

    def prewarm(self, spark: SparkSession, paths: str | Iterable[str], options: Mapping[str, str] | None = None, n: int = 1) -> None:
        """Plan the scans of some files, so that their schema and listing are known.

        ``n`` readers of a file, at most ``max_per_file``, share one scan,
        as a scan has no state.
        """
        if not 1 <= n <= self.max_per_file:
            raise ValueError(f"between 1 and {self.max_per_file} readers a file")
        for p in scan.file_set([paths] if isinstance(paths, str) else paths):
            _ = self._frame(spark, [p], options or {}).schema

    @contextmanager
    def block(self, spark: SparkSession, path: str) -> Iterator[None]:
        path = scan.absolute(path)
        with self._change:
            self._blocked.add(path)
            self._change.wait_for(lambda: self._out.get(path, 0) == 0)
            self._frames.clear()
        try:
            yield
        finally:
            spark.catalog.refreshByPath(path)
            with self._change:
                self._frames.clear()
                self._blocked.discard(path)
                self._change.notify_all()

    def clear(self) -> None:
        with self._change:
            self._frames.clear()
