"""Parquet scans: file sets, Hive-style partitions in paths, deterministic order."""

from __future__ import annotations

import fnmatch
import io
import os
from collections.abc import Callable, Iterable, Mapping
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: (spark, paths, options) -> DataFrame
ReaderFactory = Callable[[SparkSession, list[str], Mapping[str, str]], DataFrame]


def absolute(path: str) -> str:
    return path if urlparse(path).scheme else os.path.abspath(path)


def local(path: str) -> str:
    """A local path from a path or file URI."""
    return unquote(urlparse(path).path) if path.startswith("file:") else path


def is_local(path: str) -> bool:
    return urlparse(path).scheme in ("", "file")


def _hadoop(path: str):
    """Hadoop's file system and path; needs an active session."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError(f"{path} needs an active Spark session")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark._jvm, at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(path: str) -> bool:
    """Whether there is a file or directory, on any file system Spark knows."""
    if is_local(path):
        return os.path.exists(local(path))
    _, fs, at = _hadoop(path)
    return bool(fs.exists(at))


def status(path: str) -> tuple[int, int]:
    """Size and modification time in nanoseconds, on any file system Spark knows; raises OSError without the file."""
    if is_local(path):
        s = os.stat(local(path))
        return s.st_size, s.st_mtime_ns
    _, fs, at = _hadoop(path)
    if not fs.exists(at):
        raise FileNotFoundError(path)
    s = fs.getFileStatus(at)
    return s.getLen(), s.getModificationTime() * 1_000_000


def names(directory: str) -> list[str]:
    """Names in a directory, sorted; none where it doesn't exist."""
    if not exists(directory):
        return []
    if is_local(directory):
        return sorted(os.listdir(local(directory)))
    _, fs, at = _hadoop(directory)
    return sorted(s.getPath().getName() for s in fs.listStatus(at))


def write_text(path: str, text: str) -> None:
    """Write a small file, in place of another, on any file system Spark knows."""
    if is_local(path):
        os.makedirs(os.path.dirname(local(path)), exist_ok=True)
        with open(f"{local(path)}.new", "w") as f:
            f.write(text)
        os.replace(f"{local(path)}.new", local(path))
    else:
        _, fs, at = _hadoop(path)
        out = fs.create(at, True)
        out.write(bytearray(text.encode()))
        out.close()


class _Remote(io.RawIOBase):
    """A file of another file system, read in ranges."""

    def __init__(self, path: str):
        self._stream, self._size, self._at = None, status(path)[0], 0
        self._jvm, fs, at = _hadoop(path)
        self._stream = fs.open(at)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._at

    def seek(self, offset: int, whence: int = 0) -> int:
        self._at = (0, self._at, self._size)[whence] + offset
        return self._at

    def read(self, n: int = -1) -> bytes:
        n = max(0, self._size - self._at) if n is None or n < 0 else max(0, min(n, self._size - self._at))
        self._stream.seek(self._at)
        got = bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(self._stream, n)) if n else b""
        self._at += len(got)
        return got

    def close(self) -> None:
        if not self.closed and self._stream is not None:
            self._stream.close()
        super().close()


def opened(path: str) -> io.RawIOBase | io.BufferedReader:
    """A file for reading: local, or by Hadoop's file system."""
    return open(local(path), "rb") if is_local(path) else _Remote(path)


def file_set(paths: Iterable[str]) -> tuple[str, ...]:
    """Absolute, distinct, in ordinal order; blank entries are dropped and an empty set is an error."""
    found = sorted({absolute(p) for p in paths if p and p.strip()})
    if not found:
        raise ValueError("at least one file is needed")
    return tuple(found)


def list_directory(spark: SparkSession, directory: str, pattern: str = "*.parquet", recursive: bool = True) -> tuple[str, ...]:
    """Files below a directory whose name matches; names that begin with _ or . are not data."""
    jvm, found = spark._jvm, []
    root = jvm.org.apache.hadoop.fs.Path(absolute(directory))
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    walk = [root]
    while walk:
        at = walk.pop()
        for s in fs.listStatus(at):
            name = s.getPath().getName()
            if name.startswith(("_", ".")):
                continue
            if s.isDirectory():
                if recursive:
                    walk.append(s.getPath())
            elif fnmatch.fnmatch(name, pattern):
                uri = s.getPath().toString()
                found.append(local(uri) if not urlparse(directory).scheme else uri)
    return file_set(found)


def partition_values(path: str) -> dict[str, str]:
    """``k=v`` of the parent directories, keys folded to lower case; later directories win."""
    out: dict[str, str] = {}
    for part in path.replace("\\", "/").split("/")[:-1]:
        key, sep, value = part.partition("=")
        if sep and key:
            out[key.lower()] = unquote(value)
    return out


def _root(path: str) -> str | None:
    """The directory above the first ``k=v`` directory."""
    parts = path.split("/")
    for i, p in enumerate(parts[:-1]):
        if "=" in p and not p.startswith("="):
            return "/".join(parts[:i]) or "/"
    return None


def read_files(spark: SparkSession, paths: Iterable[str], options: Mapping[str, str] | None = None, schema: StructType | None = None) -> DataFrame:
    """One scan of all files; partition columns of their paths are injected."""
    by_root: dict[str | None, list[str]] = {}
    for p in paths:
        by_root.setdefault(_root(p), []).append(p)
    out: DataFrame | None = None
    for root, files in by_root.items():
        reader = spark.read.options(**dict(options or {}))
        if schema is not None:
            reader = reader.schema(schema)
        if root is not None:
            reader = reader.option("basePath", root)
        part = reader.parquet(*files)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    assert out is not None
    return out


def default_factory(spark: SparkSession, paths: list[str], options: Mapping[str, str]) -> DataFrame:
    return read_files(spark, paths, options)


def by_file(df: DataFrame) -> DataFrame:
    """How many rows of ``df`` each file has."""
    return df.groupBy(F.col("_metadata.file_path").alias("file")).count()


def in_file_order(df: DataFrame) -> DataFrame:
    """Rows by file and position. Only first and paging ask for it: it sorts."""
    return df.orderBy(F.col("_metadata.file_path"), F.col("_metadata.row_index"))


def leaf_paths(schema: StructType, prefix: str = "") -> list[tuple[str, object]]:
    """Leaf columns by slashed path with their types; arrays and maps are leaves."""
    out: list[tuple[str, object]] = []
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        if isinstance(f.dataType, StructType):
            out += leaf_paths(f.dataType, path + "/")
        else:
            out.append((path, f.dataType))
    return out
