"""The replica catalogue: cells, replicas, chunks, layouts and holders as DataFrames.

``cells`` are long rows (var, g, x, value); a replica row adds holder, layout and the
layout's stride, offset, chunk length and tile width.  Chunks are aggregates of
replica rows, so everything at chunk level comes from one hash aggregate with map-side
combine, and time predicates reach the scan through the derived timestamps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import grid

HOUR = 3600

#: holder, layout, stride, offset, samples in a chunk, tile width
LAYOUTS = [("A", "24x8+0", 1, 0, 24, 8), ("B", "4x8+0s6o0", 6, 0, 4, 8), ("C", "168x4+0", 1, 0, 168, 4), ("D", "24x8+0", 1, 0, 24, 8)]


def event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sums of events by type and user class; cents keep the sums exact in any order."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = grid.quantum("ts", HOUR).alias("g")
    cents = F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")
    return events.groupBy(F.col("event_type").alias("var"), at, (F.col("user_id") % 8).cast("int").alias("x")).agg(cents).withColumn("value", F.col("cents") / 100.0)


def layouts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LAYOUTS, "holder string, layout string, stride long, soff long, ct long, tile int")


def replicas(cells: DataFrame) -> DataFrame:
    """Four partial copies of the cells: A early hours, B late six-hourly, C gappy, D a copy of A with false noons."""
    first = F.broadcast(cells.agg(F.min("g").alias("g0")))
    held = cells.crossJoin(first)
    early, late, gappy = F.col("g") < F.col("g0") + 480, (F.col("g") >= F.col("g0") + 240) & (F.pmod("g", F.lit(6)) == 0), F.pmod("g", F.lit(5)) != 0
    holders = F.filter(F.array(F.when(early, "A"), F.when(late, "B"), F.when(gappy, "C"), F.when(early, "D")), lambda h: h.isNotNull())
    rows = held.select("var", "g", "x", "cents", F.explode(holders).alias("holder"))
    false = (F.col("holder") == "D") & (F.pmod("g", F.lit(24)) == 0)
    rows = rows.withColumn("cents", F.when(false, F.col("cents") + 100000).otherwise(F.col("cents")))
    rows = rows.join(F.broadcast(layouts(cells.sparkSession)), "holder")  # four rows
    return rows.select("holder", "layout", "stride", "soff", "ct", "tile", "var", "g", "x", "cents", (F.col("cents") / 100.0).alias("value"))


def with_chunks(rows: DataFrame) -> DataFrame:
    """Adds c, the time chunk, and tile number t."""
    return rows.withColumns({"c": grid.chunk_index("g", F.col("ct"), F.col("stride"), F.col("soff")), "t": grid.floor_div(F.col("x"), F.col("tile")).cast("int")})


def chunks(rows: DataFrame) -> DataFrame:
    """One row for each chunk: cells, samples, sums, extent, size and value id."""
    keys = ["holder", "layout", "var", "c", "t"]
    out = with_chunks(rows).groupBy(*keys, "stride", "soff", "ct", "tile").agg(
        F.count("*").alias("n"), F.countDistinct("g").alias("nvalid"), F.sum("cents").alias("cents"),
        F.min("g").alias("g0"), (F.max("g") + 1).alias("g1"),
        # a chunk has at most ct * tile cells
        F.array_sort(F.collect_list(F.struct("g", "x", "cents"))).alias("cells"),
    )
    text = F.concat_ws(",", F.transform("cells", lambda p: F.concat_ws(":", p["g"], p["x"], p["cents"])))
    return out.withColumns({"vcid": F.md5(text), "size": F.col("n") * 8}).drop("cells")


def holders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as holders: site and rate (account balance, at least 1)."""
    supplier, nation = spark.read.parquet(f"{sf_dir}/supplier.parquet"), spark.read.parquet(f"{sf_dir}/nation.parquet")
    rate = F.greatest(F.col("s_acctbal"), F.lit(1.0))
    return supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select(F.col("s_suppkey").alias("holder"), F.col("n_name").alias("site"), F.col("n_regionkey").alias("region"), rate.alias("rate"), "s_acctbal")


def search(index: DataFrame, tag: str) -> DataFrame:
    """Grids under a tag: all variables, distinct seeders and the time range. Tags match in any case."""
    found = index.where(F.lower("tag") == tag.lower())
    return found.groupBy("grid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("vars")))).alias("vars"), F.countDistinct("node").alias("seeders"), F.min("t0").alias("t0"), F.max("t1").alias("t1"))


def upper_median(values: str) -> Column:
    """Element len // 2 of the sorted values, which median() is not."""
    return F.element_at(F.array_sort(F.collect_list(values)), (F.floor(F.count(values) / 2) + 1).cast("int"))


def resolve_names(names: DataFrame) -> DataFrame:
    """The target with the highest sequence number of each name of each key."""
    return names.groupBy("pk", "name").agg(F.max_by("target", "seq").alias("target"), F.max("seq").alias("seq"))


def valid_records(records: DataFrame, now: int, ttl: int = 3600, skew: int = 300) -> DataFrame:
    """Newest record of each node that is neither expired nor from the future."""
    good = records.where((F.col("ts") >= now - ttl) & (F.col("ts") <= now + skew))
    return good.groupBy("node").agg(F.max("ts").alias("ts"), F.max_by("addr", "ts").alias("addr"))


def piece_map(spans: DataFrame, width: int, lo, hi) -> DataFrame:
    """For each of width bins of the time extent: most holders of a chunk, and chunks that overlap it.

    spans: var, g0, g1, holders (number).  Overlap is an equi-join on bin: each span lists its bins.
    """
    ext = spans.groupBy("var").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"))
    binned = spans.join(F.broadcast(ext), "var")  # one row for each variable
    size = F.col("hi") - F.col("lo")
    first = grid.floor_div((F.col(lo) - F.col("lo")) * width, size)
    last = grid.floor_div((F.col(hi) - 1 - F.col("lo")) * width, size)
    return binned.select("var", "holders", F.explode(F.sequence(first, last)).alias("bin")).groupBy("var", "bin").agg(F.max("holders").alias("holders"), F.count("*").alias("chunks"))


def evict(index: DataFrame, limit: int, keep: float = 0.9) -> DataFrame:
    """Blobs that go: least recently used first until the rest is at most keep * limit.

    Byte-identical blobs count once; seeded and parity blobs stay.
    """
    blobs = index.groupBy("cid").agg(F.max("size").alias("size"), F.max("last_use").alias("last_use"), F.max("pinned").alias("pinned"))
    # running sums over days first: the ordered window inside a day has that day's blobs only
    day = grid.floor_div(F.col("last_use"), 86400).alias("day")
    free = blobs.where(~F.col("pinned")).withColumn("day", day)
    per_day = free.groupBy("day").agg(F.sum("size").alias("day_size"))
    later = per_day.withColumn("after", F.coalesce(F.sum("day_size").over(Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    pinned = F.broadcast(blobs.where("pinned").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("pinned_size")))
    inside = Window.partitionBy("day").orderBy(F.desc("last_use"), F.desc("cid")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = free.join(later.select("day", "after"), "day").crossJoin(pinned).withColumn("held", F.sum("size").over(inside) + F.col("after") + F.col("pinned_size"))
    total = F.broadcast(blobs.agg(F.sum("size").alias("total")))
    return held.crossJoin(total).where((F.col("total") > limit) & (F.col("held") > F.lit(int(keep * limit)))).select("cid", "size", "last_use")


def numbered(rows: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """rows with a dense number from 0 over (by, order): counts of each ``by`` first, then places inside it, so no window has all rows."""
    inside = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    per = rows.groupBy(by).agg(F.count("*").alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("_j", inside).join(F.broadcast(per.select(by, before.alias("_before"))), by)  # one row for each value of by
    return placed.withColumn(name, (F.col("_j") + F.col("_before")).cast("long")).drop("_j", "_before")


def stored_blobs(blobs: DataFrame, cid: str = "cid", payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Blobs for a content-addressed table, each cid once, and those whose content is not what their cid says."""
    good = F.sha2(F.col(payload).cast("binary"), 256) == F.col(cid)
    return blobs.where(good).dropDuplicates([cid]), blobs.where(~F.coalesce(good, F.lit(False)))


def accepted_manifests(manifests: DataFrame, grids: DataFrame, most: int) -> DataFrame:
    """manifests with ``reason``: null if signed (sig_ok), of at most ``most`` bytes and of a known grid."""
    known = manifests.join(grids.select("grid").distinct().withColumn("_known", F.lit(True)), "grid", "left")
    reason = F.when(~F.coalesce("sig_ok", F.lit(False)), "signature").when(F.col("size") > most, "size").when(F.col("_known").isNull(), "grid")
    return known.withColumn("reason", reason).drop("_known")


def relayed_rates(holders: DataFrame, relays: DataFrame) -> DataFrame:
    """holders (holder, relay, rate) with ``capped``: holders behind a relay share its capacity in proportion to their rates.

    relays: relay, capacity; a holder without a relay keeps its rate.
    """
    asked = holders.where("relay is not null").groupBy("relay").agg(F.sum("rate").alias("_asked")).join(relays, "relay")
    share = F.least(F.lit(1.0), F.col("capacity") / F.col("_asked"))
    return holders.join(asked, "relay", "left").withColumn("capped", F.col("rate") * F.coalesce(share, F.lit(1.0))).drop("_asked", "capacity")


def data_variable(name) -> Column:
    """A variable of the grid, not a parity or value-parity pseudo-variable."""
    return ~F.col(name).rlike("#[pv]")
