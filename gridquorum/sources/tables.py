"""Parquet tables by path patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def existing(spark: SparkSession, patterns: Sequence[str]) -> list[str]:
    """Paths that the patterns match, on any file system Spark knows; a pattern without a match is skipped."""
    out = []
    for pattern in patterns:
        path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        out += sorted(str(f.getPath()) for f in (found or []))
    return list(dict.fromkeys(out))


def load(spark: SparkSession, patterns: Sequence[str], schema: str) -> DataFrame:
    """One table of all files that the patterns match; empty if there are none."""
    paths = existing(spark, patterns)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
