"""Run a query's conditions and projection over a directory as files arrive.

The pull of rows one by one is ``Query.to_iterator``; this is its
counterpart for directories that grow. It keeps no state: filters and
projections only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftlake.operators.query import Query


def follow(query: Query, directory: str, files_a_trigger: int = 1000) -> DataFrame:
    """A streaming DataFrame of the rows of new files that match ``query``."""
    spark: SparkSession = query.spark
    pushed, _, _ = query._split()
    for p in pushed:
        if hasattr(p, "check"):
            p.check()
    df = spark.readStream.schema(query.source().schema).option("maxFilesPerTrigger", files_a_trigger).parquet(directory)
    for p in (*query.filter.predicates, *query.conditions):
        df = df.where(p.to_column())
    return query._projected(df)
