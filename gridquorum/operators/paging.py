"""Content-defined pages of a manifest, for delta sync and range reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pages(entries: DataFrame, by: list[str], order: list[str], key: str, fan_out: int = 64) -> DataFrame:
    """Entries with page numbers: a page ends at each entry whose key hash is 0 modulo fan_out.

    Ends depend on keys alone, so a change touches the page it falls in.
    """
    ends = (F.pmod(F.conv(F.substring(F.md5(F.col(key)), 1, 8), 16, 10).cast("long"), F.lit(fan_out)) == 0).cast("int")
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return entries.withColumn("page", F.coalesce(F.sum(ends).over(w), F.lit(0)))


def page_table(paged: DataFrame, by: list[str], key: str, content: str) -> DataFrame:
    """Hash, size and key range of each page."""
    lines = F.array_sort(F.collect_list(F.concat_ws("=", F.col(key), F.col(content))))
    return paged.groupBy(*by, "page").agg(F.count("*").alias("entries"), F.min(key).alias("first"), F.max(key).alias("last"), F.md5(F.concat_ws(",", lines)).alias("hash"))


def unseen(pages_now: DataFrame, pages_known: DataFrame) -> DataFrame:
    """Pages to fetch: those whose content is not known yet."""
    return pages_now.join(pages_known.select("hash").distinct(), "hash", "left_anti")


def range_read(entries: DataFrame, by: list[str], at: str, lo: int, hi: int) -> DataFrame:
    """Entries with lo <= at < hi, read from the pages whose range of ``at`` overlaps the request.

    entries: with page numbers.  The list of pages is joined by broadcast only if it is small.
    """
    ends = entries.groupBy(*by, "page").agg(F.min(at).alias("_lo"), F.max(at).alias("_hi")).where((F.col("_lo") < hi) & (F.col("_hi") >= lo))
    return entries.join(ends.select(*by, "page"), [*by, "page"], "left_semi").where((F.col(at) >= lo) & (F.col(at) < hi))


def tree(table: DataFrame, by: list[str], fan_out: int = 64, most: int = 16) -> DataFrame:
    """Levels of a page table up to one root for each group: by, level, page, entries (nodes below), first, last, hash.

    The pages of a level are the entries of the next and are cut by their own hashes, so a changed
    entry changes one page of each level.  Each level has fan_out times fewer pages.
    """
    now = table.select(*by, F.lit(0).alias("level"), "page", "entries", "first", "last", "hash")
    out = now
    for level in range(1, most):
        if now.groupBy(*by).count().where("count > 1").isEmpty():
            break
        paged = pages(now.withColumn("_p", F.col("page")).drop("page"), by, ["_p"], "hash", fan_out)
        lines = F.array_sort(F.collect_list(F.struct("_p", "hash")))
        now = paged.groupBy(*by, "page").agg(F.count("*").alias("entries"), F.min("first").alias("first"), F.max("last").alias("last"), F.md5(F.array_join(F.transform(lines, lambda x: x["hash"]), ",")).alias("hash"))
        now = now.select(*by, F.lit(level).alias("level"), "page", "entries", "first", "last", "hash")
        out = out.unionByName(now)
    return out
