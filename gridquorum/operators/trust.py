"""Receipts, sampled audits, fraud and manifest heads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def audit_sample(requests: DataFrame, trusted: DataFrame, first: int = 3, rate: float = 0.05) -> DataFrame:
    """One decision for each (holder, chunk): the first of each holder (n is their place) and a hash sample of the rest; trusted holders are skipped."""
    one = requests.groupBy("holder", "chunk").agg(F.min("seq").alias("seq")).join(trusted, "holder", "left_anti")
    # the first of each of 64 parts of a holder first, so no task sorts a whole holder
    order = ("seq", "chunk")
    part = Window.partitionBy("holder", F.pmod(F.xxhash64("chunk"), F.lit(64))).orderBy(*order)
    near = one.withColumn("n", F.row_number().over(part)).where(F.col("n") <= first)
    top = near.withColumn("n", F.row_number().over(Window.partitionBy("holder").orderBy(*order))).where(F.col("n") <= first)
    dice = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("/", "holder", "chunk")), 1, 8), 16, 10).cast("long"), F.lit(10_000))
    return one.join(top.select("holder", "chunk", "n"), ["holder", "chunk"], "left").where(F.col("n").isNotNull() | (dice < int(rate * 10_000)))


def verify_receipts(receipts: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Receipts whose hash is not that of the verified chunk."""
    return receipts.join(truth.select(*keys, F.col("h").alias("true_h")), keys).where("h <> true_h")


def untainted(receipts: DataFrame, frauds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Receipts of holders without fraud, and the tainted rest."""
    bad = frauds.select("holder").distinct()
    return receipts.join(bad, "holder", "left_anti"), receipts.join(bad, "holder", "left_semi")


def head_faults(heads: DataFrame) -> DataFrame:
    """Rollbacks (a sequence number below one seen before) and equivocations (two roots of one number)."""
    by = Window.partitionBy("node", "grid").orderBy("seen")
    before = F.max("seq").over(by.rowsBetween(Window.unboundedPreceding, -1))
    back = heads.withColumn("before", before).where(F.col("seq") < F.col("before")).select("node", "grid", "seq", F.lit("rollback").alias("fault"))
    two = heads.groupBy("node", "grid", "seq").agg(F.countDistinct("root").alias("roots")).where("roots > 1").select("node", "grid", "seq", F.lit("equivocation").alias("fault"))
    return back.unionByName(two)
