"""Shared helpers: the cluster's shared folder, token rules and residue hashes."""

from __future__ import annotations

import gc
import time
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a regular-expression class body.
BLANK = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent (tests, one machine) a folder under the
    warehouse directory is used and recorded in the session.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.siftlake.shared.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        at = "file://" + tempfile.mkdtemp(prefix="siftlake-")
        spark.conf.set("spark.siftlake.shared.dir", at)
    return at.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/siftlake-{what}-{uuid.uuid4().hex[:12]}"


def mounted(uri: str) -> str:
    """The local path of a shared folder that is mounted on every machine."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a mounted shared folder, not {uri}")
    return parts.path


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._siftlake_path = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete tables made by :func:`written` that no later step reads."""
    for t in tables:
        path = getattr(t, "_siftlake_path", None)
        if path:
            jvm = t.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished steps, which otherwise stay until the driver's garbage is collected.

    The last query is held until another one has run. The JVM drops what
    Python no longer refers to a moment after Python does, and the cleaner
    works beside, so each gets that moment.
    """
    spark.range(1).write.format("noop").mode("overwrite").save()
    gc.collect()
    time.sleep(0.5)
    spark._jvm.System.gc()
    time.sleep(0.5)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def residue(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus

