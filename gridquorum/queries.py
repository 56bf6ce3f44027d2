"""All registered queries of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import queries_catalog, queries_cells, queries_jobs, queries_values, queries_views  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["region_union_6h"](spark, sf_dir)
