"""Merging replicas: votes, gap filling, intervals and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grid


def gap_fill(rows: DataFrame, priority: Sequence[str], keys: Sequence[str] = ("var", "g", "x")) -> DataFrame:
    """Union of replicas; where several hold a cell, the first holder of ``priority`` counts.

    A hash aggregate with map-side combine in place of a window: no sort, no hot key.
    """
    rank = F.array_position(F.array(*[F.lit(h) for h in priority]), F.col("holder"))
    return rows.where(rank > 0).groupBy(*keys).agg(F.min_by(F.struct("holder", "cents", "value"), rank).alias("best")).select(*keys, "best.*")


def vote(chunks: DataFrame, trusted: Sequence[str] = ()) -> DataFrame:
    """The winning value of each chunk: var, layout, c, t, vcid, src, votes, nvalid, status.

    Values are ranked by trusted votes, holders and most samples.  An unbroken tie is
    ``contested`` and names no value; a tie that only samples break is ``rival``.
    """
    keys = ["var", "layout", "c", "t"]
    mine = F.col("holder").isin(*trusted) if trusted else F.lit(False)
    values = chunks.groupBy(*keys, "vcid").agg(F.sum(mine.cast("int")).alias("trust"), F.count("*").alias("votes"), F.max("nvalid").alias("nvalid"), F.array_sort(F.collect_set("holder")).alias("src"))
    ranked = values.groupBy(*keys).agg(F.reverse(F.array_sort(F.collect_list(F.struct("trust", "votes", "nvalid", "vcid", "src")))).alias("v"))
    # equal scores: the first value id in order stands for them
    top, second = F.element_at("v", 1), F.try_element_at("v", F.lit(2))
    even = (top["trust"] == second["trust"]) & (top["votes"] == second["votes"])
    status = F.when(F.size("v") == 1, "accepted").when(even & (top["nvalid"] == second["nvalid"]), "contested").when(even, "rival").otherwise("accepted")
    out = ranked.select(*keys, status.alias("status"), top.alias("top"))
    open_ = F.col("status") != "contested"
    return out.select(*keys, "status", F.when(open_, F.col("top.vcid")).alias("vcid"), F.when(open_, F.array_join("top.src", "+")).alias("src"), F.col("top.votes").alias("votes"), F.col("top.nvalid").alias("nvalid"))


def family_vote(arrays: DataFrame) -> DataFrame:
    """The value family of each variable: a single authority's, else the most common, ties by order; several authorities drop it."""
    by = arrays.groupBy("var", "vfid").agg(F.count("*").alias("votes"), F.max("authority").alias("authority"))
    out = by.groupBy("var").agg(
        F.sum(F.col("authority").cast("int")).alias("authorities"),
        F.min(F.when(F.col("authority"), F.col("vfid"))).alias("chosen"),
        F.min(F.struct((-F.col("votes")).alias("v"), "vfid")).alias("mode"),
    )
    return out.where("authorities <= 1").select("var", F.coalesce("chosen", F.col("mode.vfid")).alias("vfid"), "authorities")


def majority(rows: DataFrame, by: Sequence[str], value: str, own: str | None = None, last_wins: bool = False) -> DataFrame:
    """The most common value of each group, its votes and the number of different values.

    own: a flag column; a flagged value counts before any majority.  Ties go to the smallest value, or to the largest.
    """
    mine = F.max(F.col(own).cast("int")) if own else F.max(F.lit(0))
    counted = rows.groupBy(*by, value).agg(F.count("*").alias("votes"), mine.alias("_own"))
    score = F.struct("_own", "votes", value) if last_wins else F.struct((-F.col("_own")).alias("o"), (-F.col("votes")).alias("v"), value)
    best = (F.max_by if last_wins else F.min_by)(F.struct(value, "votes"), score)
    return counted.groupBy(*by).agg(best.alias("_b"), F.count("*").alias("values")).select(*by, f"_b.{value}", "_b.votes", "values")


def assemble(rows: DataFrame, by: Sequence[str], place: Column, size: int, value: str) -> DataFrame:
    """values: an array of ``size`` places for each group, null where no row has the place (the fill of an absent source)."""
    held = rows.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(place.cast("int").alias("p"), F.col(value).alias("v")))).alias("_m"))
    return held.select(*by, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda p: F.try_element_at("_m", p)).alias("values"))


def islands(spans: DataFrame, keys: Sequence[str], lo: str = "g0", hi: str = "g1", bucket: int = 4096) -> DataFrame:
    """Union of half-open intervals by key, as maximal runs.

    Spans are cut at the bounds of buckets and joined inside each bucket first; what is left, a run or
    so for each bucket, is joined by key, so no task sorts all spans of a key.
    """
    spots = F.sequence(grid.floor_div(F.col(lo), bucket), grid.floor_div(F.greatest(F.col(hi) - 1, F.col(lo)), bucket))
    cut = spans.select(*keys, lo, hi, F.explode(spots).alias("_b"))
    cut = cut.select(*keys, "_b", F.greatest(lo, F.col("_b") * bucket).alias(lo), F.least(hi, (F.col("_b") + 1) * bucket).alias(hi))
    return _runs(_runs(cut, [*keys, "_b"], lo, hi).drop("_b"), keys, lo, hi)


def _runs(spans: DataFrame, keys: Sequence[str], lo: str, hi: str) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(lo, hi)
    reach = F.max(hi).over(by.rowsBetween(Window.unboundedPreceding, -1))
    broken = spans.withColumn("_new", (reach.isNull() | (F.col(lo) > reach)).cast("int"))
    runs = broken.withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy(*keys, "_run").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_run")


def sample_runs(rows: DataFrame, keys: Sequence[str], step: int = 1) -> DataFrame:
    """Runs of samples step quanta apart, by key: distinct samples first, so copies cost nothing."""
    spans = rows.select(*keys, F.col("g").alias("g0"), (F.col("g") + step).alias("g1")).distinct()
    return islands(spans, keys)


def intersect(a: DataFrame, b: DataFrame, keys: Sequence[str], bucket: int) -> DataFrame:
    """Overlaps of the intervals (g0, g1) of a and b by key; an equi-join on time buckets, not a nested loop."""

    def cut(df, name):
        spots = F.sequence(grid.floor_div(F.col("g0"), bucket), grid.floor_div(F.col("g1") - 1, bucket))
        return df.select(*keys, F.col("g0").alias(f"{name}0"), F.col("g1").alias(f"{name}1"), F.explode(spots).alias("_b"))

    lo, hi = F.greatest("a0", "b0"), F.least("a1", "b1")
    both = cut(a, "a").join(cut(b, "b"), [*keys, "_b"]).where(lo < hi)
    # an overlap counts in the bucket where it starts
    return both.where(grid.floor_div(lo, bucket) == F.col("_b")).select(*keys, lo.alias("g0"), hi.alias("g1"))


def subtract(request: DataFrame, held: DataFrame, keys: Sequence[str], bucket: int = 168) -> DataFrame:
    """Parts of each request interval that no held interval covers; held intervals are disjoint runs.

    Both sides are cut at the bounds of time buckets and meet by bucket, so a request meets only the runs near it.
    """

    def cut(df: DataFrame) -> DataFrame:
        spots = F.sequence(grid.floor_div(F.col("g0"), bucket), grid.floor_div(F.col("g1") - 1, bucket))
        parts = df.where("g0 < g1").select(*keys, "g0", "g1", F.explode(spots).alias("_b"))
        return parts.select(*keys, "_b", F.greatest("g0", F.col("_b") * bucket).alias("g0"), F.least("g1", (F.col("_b") + 1) * bucket).alias("g1"))

    asked = cut(request).select(*keys, "_b", F.col("g0").alias("r0"), F.col("g1").alias("r1"))
    inside = cut(held).join(asked, [*keys, "_b"]).where("g0 < r1 and g1 > r0")
    gone = inside.select(*keys, "r0", "r1", F.greatest("g0", "r0").alias("g0"), F.least("g1", "r1").alias("g1"))
    ends = asked.select(*keys, "r0", "r1", F.col("r1").alias("g0"), F.col("r1").alias("g1"))
    by = Window.partitionBy(*keys, "r0", "r1").orderBy("g0", "g1")
    before = F.coalesce(F.max("g1").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.col("r0"))
    left = gone.unionByName(ends).withColumn("from", before).where(F.col("from") < F.col("g0")).select(*keys, F.col("from").alias("g0"), F.col("g0").alias("g1"))
    # parts that touch at a bucket's bound are one again
    return islands(left.distinct(), list(keys))


def coverage(chunks: DataFrame, request: tuple[Column, Column], stride: int, offset, x: tuple[int, int]) -> DataFrame:
    """Requested, covered and missing lattice samples by variable.

    A time chunk of a layout counts if all tiles of the box [x0, x1) are there, as far as
    its samples go; then the union of such chunks is clipped and counted on the lattice.
    """
    lo, hi = request
    tiles = grid.floor_div(F.lit(x[1] - 1), F.col("tile")) - grid.floor_div(F.lit(x[0]), F.col("tile")) + 1
    near = chunks.where((F.col("t") * F.col("tile") < x[1]) & ((F.col("t") + 1) * F.col("tile") > x[0]))
    whole = near.groupBy("var", "layout", "holder", "c", "stride", "tile").agg(F.count("*").alias("tiles"), F.max("g0").alias("g0"), F.min("g1").alias("g1")).where(F.col("tiles") == tiles)
    # one group of a time chunk is complete where its tiles overlap; a coarser layout counts on its own lattice only
    fits = grid.complete_for(F.col("stride"), F.lit(0), F.lit(stride), offset)
    runs = islands(whole.where(fits & (F.col("g0") < F.col("g1"))).select("var", "g0", "g1").distinct(), ["var"])
    clipped = runs.select("var", F.greatest("g0", lo).alias("g0"), F.least("g1", hi).alias("g1")).where("g0 < g1")
    covered = clipped.groupBy("var").agg(F.sum(grid.samples_in("g0", "g1", F.lit(stride), offset)).alias("covered"))
    asked = grid.samples_in(lo, hi, F.lit(stride), offset)
    return covered.select("var", asked.alias("requested"), "covered", (asked - F.col("covered")).alias("missing"))


def prefix_growth(old: DataFrame, new: DataFrame, tolerance: float) -> DataFrame:
    """Whether each chunk of new keeps the known cells of old: a later version wins only if it does."""
    keys = ["var", "c", "g", "x"]
    both = old.select(*keys, F.col("value").alias("a")).join(new.select(*keys, F.col("value").alias("b")), keys, "left")
    same = F.abs(F.col("a") - F.col("b")) <= tolerance
    return both.groupBy("var", "c").agg(F.count("*").alias("known"), F.sum(F.when(same, 0).otherwise(1)).alias("broken")).withColumn("verdict", F.when(F.col("broken") == 0, "grown").otherwise("contested"))


def outer_merge(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Full outer join of parts on their shared coordinates."""
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, list(keys), "full")
    return out


def key_changes(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """New and changed keys of after, and keys that are gone; null is a value like any other."""
    a, b = (df.select(*keys, F.struct(value).alias(name)) for df, name in ((before, "_a"), (after, "_b")))
    both = a.join(b, list(keys), "full")
    change = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "gone").when(~F.col(f"_a.{value}").eqNullSafe(F.col(f"_b.{value}")), "changed")
    return both.select(*keys, change.alias("change")).where("change is not null")
