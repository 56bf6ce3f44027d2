"""Queries over cells and replicas: unions, selections, coverage, votes, re-chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import grid
from .operators import catalog, merge
from .registry import query
from .sqltext import CELLS, CHUNKS, ISLANDS, REPLICAS, UNION, VOTE, with_


def _replicas(spark, d) -> DataFrame:
    return catalog.replicas(catalog.event_cells(spark, d))


PRIORITY = ["A", "C", "B"]


def _merged(spark, d) -> DataFrame:
    return merge.gap_fill(_replicas(spark, d), PRIORITY)


@query(with_(UNION) + """
SELECT var, CAST(floor(g / 6::DOUBLE) AS BIGINT) AS window, count(*) AS cells, CAST(sum(cents) AS BIGINT) / 100::DOUBLE / count(*) AS mean
FROM merged WHERE g >= epoch(TIMESTAMP '2024-01-03') / 3600 AND g < epoch(TIMESTAMP '2024-01-25') / 3600 GROUP BY 1, 2""")
def region_union_6h(spark, d):
    """Six-hourly means of the union over a labelled date range."""
    lo, hi = grid.label_bounds(F.lit("2024-01-03"), F.lit("2024-01-24"), catalog.HOUR)
    rows = _merged(spark, d).where((F.col("g") >= lo) & (F.col("g") < hi))
    return rows.groupBy("var", grid.floor_div(F.col("g"), 6).alias("window")).agg(F.count("*").alias("cells"), (F.sum("cents") / 100.0 / F.count("*")).alias("mean"))


@query(with_(UNION) + " SELECT holder, var, count(*) AS cells, CAST(sum(cents) AS BIGINT) AS cents FROM merged GROUP BY 1, 2")
def union_sources(spark, d):
    """Which replica each cell of the union comes from."""
    return _merged(spark, d).groupBy("holder", "var").agg(F.count("*").alias("cells"), F.sum("cents").alias("cents"))


@query(with_(REPLICAS) + ISLANDS.format(keys="holder, var", spans="SELECT DISTINCT holder, var, g AS g0, g + stride AS g1 FROM replicas"))
def interval_islands(spark, d):
    """Covered time ranges of each holder and variable."""
    spans = _replicas(spark, d).select("holder", "var", F.col("g").alias("g0"), (F.col("g") + F.col("stride")).alias("g1")).distinct()
    return merge.islands(spans, ["holder", "var"])


_HELD = with_(REPLICAS) + ", runs AS (" + ISLANDS.format(keys="holder, var", spans="SELECT DISTINCT holder, var, g AS g0, g + stride AS g1 FROM replicas") + ")"


def _runs(spark, d, holder):
    return interval_islands(spark, d).where(F.col("holder") == holder).drop("holder")


@query(_HELD + """
SELECT a.var, greatest(a.g0, b.g0) AS g0, least(a.g1, b.g1) AS g1 FROM runs a JOIN runs b USING (var)
WHERE a.holder = 'A' AND b.holder = 'C' AND a.g0 < b.g1 AND b.g0 < a.g1""")
def interval_intersect(spark, d):
    """Time ranges that A and C both hold."""
    return merge.intersect(_runs(spark, d, "A"), _runs(spark, d, "C"), ["var"], bucket=24)


@query(_HELD + """,
req AS (SELECT DISTINCT var, g0 AS r0, g0 + 720 AS r1 FROM cells, g0),
pts AS (SELECT var, unnest(range(r0, r1)) AS g FROM req),
miss AS (SELECT var, g AS g0, g + 1 AS g1 FROM pts p WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.holder = 'C' AND r.var = p.var AND p.g >= r.g0 AND p.g < r.g1))
""" + ISLANDS.format(keys="var", spans="SELECT * FROM miss"))
def interval_subtract(spark, d):
    """Parts of a 30-day request that C does not hold."""
    first = F.broadcast(catalog.event_cells(spark, d).agg(F.min("g").alias("g0")))
    request = catalog.event_cells(spark, d).select("var").distinct().crossJoin(first).select("var", "g0", (F.col("g0") + 720).alias("g1"))
    return merge.subtract(request, _runs(spark, d, "C"), ["var"])


@query(with_(CHUNKS) + """,
whole AS (
  SELECT var, layout, holder, c, tile, stride, max(g0) AS g0, min(g1) AS g1, count(*) AS tiles FROM chunks
  WHERE t * tile < 6 AND (t + 1) * tile > 2 GROUP BY ALL HAVING count(*) = 5 // tile - 2 // tile + 1),
ok AS (SELECT var, g0, g1 FROM whole WHERE g0 < g1 AND 6 % stride = 0),
runs AS (""" + ISLANDS.format(keys="var", spans="SELECT DISTINCT var, g0, g1 FROM ok") + """),
clipped AS (SELECT var, greatest(g0, 473400) AS g0, least(g1, 474000) AS g1 FROM runs)
SELECT var, CAST(100 AS BIGINT) AS requested, CAST(sum(ceil(g1 / 6::DOUBLE) - ceil(g0 / 6::DOUBLE)) AS BIGINT) AS covered,
  CAST(100 - sum(ceil(g1 / 6::DOUBLE) - ceil(g0 / 6::DOUBLE)) AS BIGINT) AS missing
FROM clipped WHERE g0 < g1 GROUP BY var""")
def sample_coverage(spark, d):
    """Requested, covered and missing six-hourly samples of a box."""
    return merge.coverage(catalog.chunks(_replicas(spark, d)), (F.lit(473400).cast("long"), F.lit(474000).cast("long")), 6, F.lit(0).cast("long"), (2, 6))


_WON = " SELECT var, layout, c, t, status, CASE WHEN status <> 'contested' THEN vcid END AS vcid, CASE WHEN status <> 'contested' THEN src END AS src, votes, nvalid FROM won"


@query(with_(CHUNKS) + VOTE.format(trust="0") + _WON)
def value_vote(spark, d):
    """Winning value of each chunk."""
    return merge.vote(catalog.chunks(_replicas(spark, d)))


@query(with_(CHUNKS) + VOTE.format(trust="CASE WHEN holder = 'A' THEN 1 ELSE 0 END") + _WON)
def trusted_vote(spark, d):
    """The same vote with A as a trusted publisher."""
    return merge.vote(catalog.chunks(_replicas(spark, d)), ["A"])


@query("SELECT var, layout, c, count(*) AS tiles FROM (" + with_(CHUNKS) + VOTE.format(trust="0") + _WON + ") WHERE status = 'contested' GROUP BY ALL")
def contested_chunks(spark, d):
    """Time chunks that a contested tile takes out of coverage."""
    return value_vote(spark, d).where("status = 'contested'").groupBy("var", "layout", "c").agg(F.count("*").alias("tiles"))


@query("""
WITH arrays AS (
  SELECT event_type AS var, user_id % 3 AS vfid_no, 'f' || (user_id % 3) AS vfid, user_id AS node, event_type = 'click' AND user_id = 4 AS authority
  FROM events GROUP BY ALL),
v AS (SELECT var, vfid, count(*) AS votes, bool_or(authority) AS authority FROM arrays GROUP BY ALL)
SELECT var, coalesce(min(vfid) FILTER (authority), arg_min(vfid, -votes * 1000 + CAST(substr(vfid, 2) AS INTEGER))) AS vfid, count(*) FILTER (authority) AS authorities
FROM v GROUP BY var HAVING count(*) FILTER (authority) <= 1""")
def family_vote(spark, d):
    """Value family of each variable by authority or majority."""
    events = spark.read.parquet(f"{d}/events.parquet")
    arrays = events.select(F.col("event_type").alias("var"), F.concat(F.lit("f"), F.col("user_id") % 3).alias("vfid"), F.col("user_id").alias("node")).distinct()
    return merge.family_vote(arrays.withColumn("authority", (F.col("var") == "click") & (F.col("node") == 4)))


@query(with_(REPLICAS) + """,
o AS (SELECT var, c, g, x, value FROM replicas WHERE holder = 'A' AND g % 24 < 18),
n AS (SELECT var, c, g, x, value FROM replicas WHERE holder = 'D'),
b AS (SELECT o.var, o.c, CASE WHEN abs(o.value - n.value) <= 0.5 THEN 0 ELSE 1 END AS bad FROM o LEFT JOIN n USING (var, c, g, x))
SELECT var, c, count(*) AS known, CAST(sum(bad) AS BIGINT) AS broken, CASE WHEN sum(bad) = 0 THEN 'grown' ELSE 'contested' END AS verdict FROM b GROUP BY 1, 2""")
def prefix_growth(spark, d):
    """Does D's version of each chunk keep the cells A knew."""
    rows = catalog.with_chunks(_replicas(spark, d))
    old = rows.where((F.col("holder") == "A") & (F.pmod("g", F.lit(24)) < 18))
    return merge.prefix_growth(old, rows.where("holder = 'D'"), 0.5)


@query(with_(REPLICAS) + """
SELECT a.var, a.g, a.x, a.value AS hourly, b.value AS sixhourly FROM replicas a JOIN replicas b ON a.var = b.var AND a.g = b.g AND a.x = b.x
WHERE a.holder = 'A' AND b.holder = 'B'""")
def lattice_align(spark, d):
    """An hourly and a six-hourly replica on their common lattice, an equi-join on g."""
    rows = _replicas(spark, d)
    a, b = rows.where("holder = 'A'").select("var", "g", "x", F.col("value").alias("hourly")), rows.where("holder = 'B'").select("var", "g", "x", F.col("value").alias("sixhourly"))
    return a.where(grid.on_lattice("g", F.lit(6), F.lit(0))).join(b, ["var", "g", "x"])


@query(with_(UNION) + """
SELECT var, CAST(floor(g / 48::DOUBLE) AS BIGINT) AS c, x // 2 AS t, count(*) AS cells, md5(string_agg(g || ':' || x || ':' || cents, ',' ORDER BY g, x)) AS vcid FROM merged GROUP BY 1, 2, 3""")
def rechunk_tiles(spark, d):
    """The union in chunks of 48 hours by 2 tiles."""
    rows = _merged(spark, d).withColumns({"c": grid.floor_div(F.col("g"), 48), "t": grid.floor_div(F.col("x"), 2).cast("int")})
    line = F.transform(F.array_sort(F.collect_list(F.struct("g", "x", "cents"))), lambda p: F.concat_ws(":", p["g"], p["x"], p["cents"]))
    return rows.groupBy("var", "c", "t").agg(F.count("*").alias("cells"), F.md5(F.concat_ws(",", line)).alias("vcid"))


@query(with_(UNION) + " SELECT var, g, x, cents / 100::DOUBLE AS value FROM merged, g0 WHERE x >= 2 AND x < 5 AND g >= g0 + 24 AND g < g0 + 48")
def bbox_isel(spark, d):
    """An index box of one day; replicas are cut to it before they are merged."""
    first = F.broadcast(catalog.event_cells(spark, d).agg(F.min("g").alias("g0")))
    rows = _replicas(spark, d).crossJoin(first).where("x >= 2 and x < 5 and g >= g0 + 24 and g < g0 + 48")
    return merge.gap_fill(rows, PRIORITY).select("var", "g", "x", "value")


@query(with_(UNION) + """,
lat AS (SELECT unnest(range(8)) AS x, 50 - 5 * unnest(range(8)) AS lat)
SELECT var, lat, count(*) AS cells, CAST(sum(cents) AS BIGINT) AS cents FROM merged JOIN lat USING (x) WHERE lat BETWEEN 25 AND 40 GROUP BY 1, 2""")
def bbox_sel(spark, d):
    """A coordinate box; the bounds may come in either order."""
    lat = spark.range(8).select(F.col("id").cast("int").alias("x"), (50 - 5 * F.col("id")).alias("lat"))
    lo, hi = sorted((40, 25))
    return _merged(spark, d).join(F.broadcast(lat), "x").where(F.col("lat").between(lo, hi)).groupBy("var", "lat").agg(F.count("*").alias("cells"), F.sum("cents").alias("cents"))


@query(with_(UNION) + " SELECT var, g, CAST(sum(cents) AS BIGINT) AS cents FROM merged, g0 WHERE (g - (g0 + 3)) % 6 = 0 AND g >= g0 + 3 GROUP BY 1, 2")
def strided_view(spark, d):
    """Every sixth sample from the start of the request."""
    first = F.broadcast(catalog.event_cells(spark, d).agg((F.min("g") + 3).alias("o")))
    rows = _replicas(spark, d).crossJoin(first).where((F.col("g") >= F.col("o")) & grid.on_lattice("g", F.lit(6), "o"))
    return merge.gap_fill(rows, PRIORITY).groupBy("var", "g").agg(F.sum("cents").alias("cents"))


@query(with_(REPLICAS) + """
SELECT coalesce(a.var, b.var) AS var, coalesce(a.g, b.g) AS g, coalesce(a.x, b.x) AS x, coalesce(a.cents, b.cents) AS cents
FROM (SELECT * FROM replicas WHERE holder = 'B') a FULL JOIN (SELECT * FROM replicas WHERE holder = 'C') b ON a.var = b.var AND a.g = b.g AND a.x = b.x""")
def combine_first(spark, d):
    """The first copy that has a cell wins."""
    rows = _replicas(spark, d)
    a, b = (rows.where(F.col("holder") == h).select("var", "g", "x", F.col("cents").alias(h)) for h in "BC")
    return merge.outer_merge([a, b], ["var", "g", "x"]).select("var", "g", "x", F.coalesce("B", "C").alias("cents"))


@query(with_(CELLS) + """
SELECT coalesce(a.g, b.g) AS g, coalesce(a.x, b.x) AS x, a.cents AS click, b.cents AS purchase
FROM (SELECT * FROM cells WHERE var = 'click') a FULL JOIN (SELECT * FROM cells WHERE var = 'purchase') b ON a.g = b.g AND a.x = b.x""")
def outer_merge(spark, d):
    """Two variables on their outer-joined coordinates."""
    cells = catalog.event_cells(spark, d)
    parts = [cells.where(F.col("var") == v).select("g", "x", F.col("cents").alias(v)) for v in ("click", "purchase")]
    return merge.outer_merge(parts, ["g", "x"])


@query(with_(REPLICAS) + """
SELECT coalesce(a.var, b.var) AS var, coalesce(a.g, b.g) AS g, coalesce(a.x, b.x) AS x,
  CASE WHEN a.var IS NULL THEN 'new' WHEN b.var IS NULL THEN 'gone' ELSE 'changed' END AS change
FROM (SELECT * FROM replicas WHERE holder = 'A') a FULL JOIN (SELECT * FROM replicas WHERE holder = 'D' AND g % 7 <> 0) b ON a.var = b.var AND a.g = b.g AND a.x = b.x
WHERE a.cents IS DISTINCT FROM b.cents""")
def key_diff(spark, d):
    """New, changed and gone keys between two versions."""
    rows = _replicas(spark, d)
    return merge.key_changes(rows.where("holder = 'A'"), rows.where("holder = 'D' and pmod(g, 7) <> 0"), ["var", "g", "x"], "cents")


@query(with_(CHUNKS) + """
SELECT var, c, t, count(*) AS n FROM chunks a WHERE holder = 'A' AND EXISTS (SELECT 1 FROM chunks b WHERE b.holder = 'D' AND b.var = a.var AND b.c = a.c AND b.t = a.t AND b.vcid = a.vcid) GROUP BY 1, 2, 3""")
def semi_local(spark, d):
    """Chunks of A that the local copy D serves with the same value."""
    chunks = catalog.chunks(_replicas(spark, d))
    local = chunks.where("holder = 'D'").select("var", "c", "t", "vcid")
    return chunks.where("holder = 'A'").join(local, ["var", "c", "t", "vcid"], "left_semi").groupBy("var", "c", "t").agg(F.count("*").alias("n"))


@query(with_(CHUNKS) + """
SELECT var, c, t, size FROM chunks a WHERE holder = 'A' AND NOT EXISTS (SELECT 1 FROM chunks b WHERE b.holder = 'D' AND b.var = a.var AND b.c = a.c AND b.t = a.t AND b.vcid = a.vcid)""")
def anti_missing(spark, d):
    """Chunks of A that have to be fetched."""
    chunks = catalog.chunks(_replicas(spark, d))
    local = chunks.where("holder = 'D'").select("var", "c", "t", "vcid")
    return chunks.where("holder = 'A'").join(local, ["var", "c", "t", "vcid"], "left_anti").select("var", "c", "t", "size")


@query(with_(REPLICAS) + """,
d AS (SELECT var, g, lead(g) OVER (PARTITION BY var ORDER BY g) - g AS gap FROM (SELECT DISTINCT var, g FROM replicas WHERE holder = 'B'))
SELECT var, CAST(list_reduce(list(gap), lambda a, b: gcd(a, b)) AS BIGINT) AS stride FROM d WHERE gap IS NOT NULL GROUP BY var""")
def natural_stride(spark, d):
    """Greatest common divisor of the gaps between samples."""
    g = _replicas(spark, d).where("holder = 'B'").select("var", "g").distinct()
    gaps = g.withColumn("gap", F.lead("g").over(Window.partitionBy("var").orderBy("g")) - F.col("g")).where("gap is not null")
    # few distinct gaps, whatever the length of the axis; Euclid's steps are bounded by the bits of a gap
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(pair(s["b"], s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])))
    gcd = lambda a, b: F.aggregate(F.sequence(F.lit(1), F.lit(64)), pair(a, b), step)["a"]
    return gaps.groupBy("var").agg(F.array_sort(F.collect_set("gap")).alias("gaps")).select("var", F.aggregate("gaps", F.lit(0).cast("long"), gcd).alias("stride"))


@query(with_(REPLICAS) + """,
d AS (SELECT holder, var, g - lag(g) OVER (PARTITION BY holder, var ORDER BY g) AS step FROM (SELECT DISTINCT holder, var, g FROM replicas))
SELECT holder, var, count(*) AS gaps, min(step) AS step, bool_and(step = 1 OR step = 6) AND min(step) = max(step) AS regular FROM d WHERE step IS NOT NULL GROUP BY 1, 2""")
def regularity(spark, d):
    """Is the time axis regular."""
    g = _replicas(spark, d).select("holder", "var", "g").distinct()
    step = F.col("g") - F.lag("g").over(Window.partitionBy("holder", "var").orderBy("g"))
    out = g.withColumn("step", step).where("step is not null").groupBy("holder", "var")
    return out.agg(F.count("*").alias("gaps"), F.min("step").alias("step"), (F.min("step") == F.max("step")).alias("regular"))


@query(with_(CELLS) + """
SELECT var, x, g, CAST(xor(cents, coalesce(lag(cents) OVER (PARTITION BY var, x ORDER BY g), 0)) AS BIGINT) AS delta FROM cells""")
def temporal_xor(spark, d):
    """Each sample XORed with the one before it."""
    before = F.coalesce(F.lag("cents").over(Window.partitionBy("var", "x").orderBy("g")), F.lit(0))
    return catalog.event_cells(spark, d).select("var", "x", "g", F.col("cents").bitwiseXOR(before).alias("delta"))


@query(with_(CELLS) + " SELECT var, x, g, cents FROM cells")
def temporal_xor_inverse(spark, d):
    """The running XOR gives the samples back."""
    w = Window.partitionBy("var", "x").orderBy("g").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return temporal_xor(spark, d).select("var", "x", "g", F.bit_xor("delta").over(w).alias("cents"))


@query("""
WITH t AS (SELECT DISTINCT CAST(round(l_quantity) AS BIGINT) AS v FROM lineitem),
d AS (SELECT v, coalesce(v - lag(v) OVER (ORDER BY v), 0) AS gap FROM t)
SELECT v, CAST(sum(gap) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS BIGINT) AS code FROM d""")
def running_codes(spark, d):
    """Integer codes as the running sum of gaps of the distinct values (at most a quantity's range of them)."""
    v = spark.read.parquet(f"{d}/lineitem.parquet").select(F.round("l_quantity").cast("long").alias("v")).distinct()
    w = Window.orderBy("v")
    gap = F.coalesce(F.col("v") - F.lag("v").over(w), F.lit(0))
    return v.withColumn("gap", gap).select("v", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("code"))


@query("""
WITH s AS (SELECT event_type AS var, CAST(floor(epoch(ts) / 3600) AS BIGINT) % 24 AS hour, count(*) AS n FROM events GROUP BY 1, 2)
SELECT var, round(atan2(sum(n * sin(2 * pi() * hour / 24)), sum(n * cos(2 * pi() * hour / 24))), 6) AS phase FROM s GROUP BY var""")
def circular_phase(spark, d):
    """Circular mean of the hour of day."""
    hour = (F.pmod(grid.quantum("ts", 3600), F.lit(24))).alias("hour")
    s = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("event_type").alias("var"), hour).agg(F.count("*").alias("n"))
    angle = 2 * F.pi() * F.col("hour") / 24
    return s.groupBy("var").agg(F.round(F.atan2(F.sum(F.col("n") * F.sin(angle)), F.sum(F.col("n") * F.cos(angle))), 6).alias("phase"))


@query("""
WITH b AS (SELECT min(CAST(floor(epoch(ts) / 3600) AS BIGINT)) AS lo, max(CAST(floor(epoch(ts) / 3600) AS BIGINT)) AS hi FROM events),
g AS (SELECT unnest(range(lo, hi + 1, 6)) AS g FROM b)
SELECT g, make_timestamp(g * 3600 * 1000000) AS ts FROM g""")
def time_coordinate(spark, d):
    """The synthesised time coordinate of a six-hourly view."""
    ext = spark.read.parquet(f"{d}/events.parquet").agg(F.min(grid.quantum("ts", 3600)).alias("lo"), F.max(grid.quantum("ts", 3600)).alias("hi"))
    return ext.select(F.explode(F.sequence("lo", "hi", F.lit(6).cast("long"))).alias("g")).select("g", grid.quantum_time("g", 3600).cast("timestamp_ntz").alias("ts"))


@query(with_(UNION) + """,
m AS (SELECT var, max(g) AS gmax FROM merged GROUP BY var)
SELECT var, g, x, cents FROM merged JOIN m USING (var) WHERE g > gmax - 12""")
def follow_window(spark, d):
    """The newest twelve hours of each variable that anyone holds."""
    rows = _replicas(spark, d).where(F.col("holder").isin(PRIORITY))
    newest = rows.groupBy("var").agg(F.max("g").alias("gmax"))
    return merge.gap_fill(rows.join(F.broadcast(newest), "var").where("g > gmax - 12"), PRIORITY).select("var", "g", "x", "cents")  # one row for each variable


@query(with_(UNION) + " SELECT var, CAST(floor(g / 24::DOUBLE) AS BIGINT) AS day, x, max(cents) - min(cents) AS span, count(*) AS n FROM merged GROUP BY 1, 2, 3")
def resample_day(spark, d):
    """Facade resampling: daily range of the union."""
    rows = _merged(spark, d)
    return rows.groupBy("var", grid.floor_div(F.col("g"), 24).alias("day"), "x").agg((F.max("cents") - F.min("cents")).alias("span"), F.count("*").alias("n"))


@query(with_(UNION) + """
SELECT var, x, g, CAST(sum(cents) OVER (PARTITION BY var, x ORDER BY g RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS BIGINT) AS rolled FROM merged""")
def rolling_sum(spark, d):
    """Facade rolling window over six hours of the axis, gaps included."""
    w = Window.partitionBy("var", "x").orderBy("g").rangeBetween(-5, 0)
    return _merged(spark, d).select("var", "x", "g", F.sum("cents").over(w).alias("rolled"))


@query("SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_windows(spark, d):
    """Built-in event-time windows."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    return e.groupBy("event_type", F.window("at", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
