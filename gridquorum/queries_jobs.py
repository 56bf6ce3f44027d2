"""Queries over jobs, scans, verification and experiments."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import grid
from .operators import catalog, merge, parity
from .queries_catalog import _chunks
from .queries_cells import _replicas
from .registry import query
from .sqltext import CHUNKS, REPLICAS, with_


@query("""
WITH files AS (SELECT o_orderkey AS key, CAST(round_even(o_totalprice, 0) AS BIGINT) AS size, CAST(epoch(o_orderdate) AS BIGINT) AS mtime FROM orders),
cache AS (SELECT key, CASE WHEN key % 9 = 0 THEN size + 1 ELSE size END AS size, mtime FROM files WHERE key % 4 <> 0)
SELECT key, size, mtime FROM files f WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE c.key = f.key AND c.size = f.size AND c.mtime = f.mtime)""")
def scan_worklist(spark, d):
    """Files whose size or time is not that of the scan cache; the others are not read again."""
    files = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("key"), F.rint("o_totalprice").cast("long").alias("size"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("mtime"))
    cache = files.where("key % 4 <> 0").withColumn("size", F.when(F.col("key") % 9 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return files.join(cache, ["key", "size", "mtime"], "left_anti")


@query("""
SELECT p_partkey AS key, substr(p_name, 3, 5) AS part, substr(p_name, length(p_name) - 3) AS tail, substr(p_name, 8) AS rest FROM part""")
def byte_ranges(spark, d):
    """Range, offset and suffix reads."""
    name = F.encode("p_name", "UTF-8")
    text = lambda b: F.decode(b, "UTF-8")
    return spark.read.parquet(f"{d}/part.parquet").select(
        F.col("p_partkey").alias("key"), text(F.substring(name, 3, 5)).alias("part"), text(F.substring(name, F.length(name) - 3, F.lit(4))).alias("tail"), text(F.substring(name, F.lit(8), F.length(name))).alias("rest")
    )


@query(with_(CHUNKS) + """,
s AS (SELECT var, c, list_sort(list(DISTINCT ascii(holder) % 8)) AS used FROM chunks GROUP BY 1, 2)
SELECT var, c, CAST(list_min(list_filter(range(0, 8), lambda r: NOT list_contains(used, r))) AS BIGINT) AS free FROM s""")
def free_parity_row(spark, d):
    """The first parity row of a stripe that nobody has made."""
    used = _chunks(spark, d).groupBy("var", "c").agg(F.collect_set(F.ascii("holder") % 8).alias("used"))
    return used.select("var", "c", F.array_min(F.array_except(F.sequence(F.lit(0), F.lit(7)), "used")).cast("long").alias("free"))


@query(with_(CHUNKS) + """,
v AS (SELECT var, layout, c, t, vcid, list(holder) AS src FROM chunks GROUP BY ALL)
SELECT var, count(*) FILTER (list_has_any(src, ['A', 'B'])) AS local, count(*) AS pieces FROM v GROUP BY var""")
def local_holders(spark, d):
    """Pieces that one of the local holders has."""
    src = _chunks(spark, d).groupBy("var", "layout", "c", "t", "vcid").agg(F.collect_set("holder").alias("src"))
    mine = F.arrays_overlap("src", F.array(F.lit("A"), F.lit("B")))
    return src.groupBy("var").agg(F.count(F.when(mine, 1)).alias("local"), F.count("*").alias("pieces"))


@query(with_(CHUNKS) + """
SELECT a.var, a.c, a.t, a.vcid AS expected, d.vcid AS received FROM chunks a JOIN chunks d USING (var, layout, c, t) WHERE a.holder = 'A' AND d.holder = 'D' AND a.vcid <> d.vcid""")
def quarantine(spark, d):
    """Received chunks whose value id is not the expected one."""
    chunks = _chunks(spark, d)
    key = ["var", "layout", "c", "t"]
    want, got = chunks.where("holder = 'A'").select(*key, F.col("vcid").alias("expected")), chunks.where("holder = 'D'").select(*key, F.col("vcid").alias("received"))
    return want.join(got, key).where("expected <> received").drop("layout")


@query("""
SELECT l_suppkey AS holder, l_orderkey AS batch, l_linenumber AS part, CAST(sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity ROWS UNBOUNDED PRECEDING) AS BIGINT) AS bytes FROM lineitem""")
def batch_eta(spark, d):
    """Bytes a holder has sent up to each batch."""
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("holder"), F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("part"), F.sum("l_quantity").over(w).cast("long").alias("bytes"))


@query("""
WITH j AS (SELECT o_custkey % 30 AS grid, o_orderstatus AS s, CAST(round(o_totalprice) AS BIGINT) AS bytes FROM orders),
t AS (SELECT grid, CAST(sum(bytes) FILTER (s = 'F') AS BIGINT) AS done, CAST(sum(bytes) AS BIGINT) AS total, count(*) FILTER (s = 'P') AS waiting FROM j GROUP BY grid)
SELECT grid, done, total, CASE WHEN done = total THEN 'done' WHEN waiting > 5 THEN 'stalled' ELSE 'partial' END AS state FROM t""")
def job_rollup(spark, d):
    """Progress and state of the jobs of each grid."""
    j = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_custkey") % 30).alias("grid"), F.col("o_orderstatus").alias("s"), F.round("o_totalprice").cast("long").alias("bytes"))
    t = j.groupBy("grid").agg(F.sum(F.when(F.col("s") == "F", F.col("bytes"))).alias("done"), F.sum("bytes").alias("total"), F.count(F.when(F.col("s") == "P", 1)).alias("waiting"))
    return t.select("grid", "done", "total", F.when(F.col("done") == F.col("total"), "done").when(F.col("waiting") > 5, "stalled").otherwise("partial").alias("state"))


@query("""
WITH h AS (SELECT s_suppkey AS holder, n_regionkey AS region, CASE WHEN s_suppkey % 3 = 0 THEN greatest(s_acctbal, 1.0) END AS measured, CASE WHEN s_suppkey % 3 = 1 THEN greatest(s_acctbal, 1.0) END AS hint FROM supplier JOIN nation ON s_nationkey = n_nationkey),
m AS (SELECT region, list_sort(list(measured))[count(measured) // 2 + 1] AS med FROM h WHERE measured IS NOT NULL GROUP BY region)
SELECT holder, round(coalesce(measured, 0.8 * hint, med), 6) AS rate FROM h LEFT JOIN m USING (region)""")
def holder_rates(spark, d):
    """Measured rate, else a discounted hint, else the region's upper median."""
    h = catalog.holders(spark, d)
    measured, hint = F.when(F.col("holder") % 3 == 0, F.col("rate")), F.when(F.col("holder") % 3 == 1, F.col("rate"))
    rows = h.select("holder", "region", measured.alias("measured"), hint.alias("hint"))
    median = rows.where("measured is not null").groupBy("region").agg(catalog.upper_median("measured").alias("med"))
    return rows.join(median, "region", "left").select("holder", F.round(F.coalesce("measured", F.col("hint") * 0.8, "med"), 6).alias("rate"))


@query(with_(CHUNKS) + """,
n AS (SELECT var, layout, count(*) AS n, min(stride) AS stride FROM chunks GROUP BY 1, 2)
SELECT var, arg_max(layout, CASE WHEN 6 = stride THEN 1000000 ELSE 0 END + n) AS layout, count(*) AS layouts FROM n GROUP BY var""")
def native_layout(spark, d):
    """The layout of a six-hourly view: same spacing first, then most chunks."""
    n = _chunks(spark, d).groupBy("var", "layout").agg(F.count("*").alias("n"), F.min("stride").alias("stride"))
    return n.groupBy("var").agg(F.max_by("layout", F.struct((F.col("stride") == 6).cast("int").alias("same"), "n", "layout")).alias("layout"), F.count("*").alias("layouts"))


@query(with_(REPLICAS) + """
SELECT var, c, list_transform(list(cents ORDER BY g, x)[3:10], lambda v: v + 0) AS cut FROM replicas WHERE holder = 'A' GROUP BY var, c""")
def hyperslab(spark, d):
    """A slice of a chunk's values in C order."""
    rows = catalog.with_chunks(_replicas(spark, d)).where("holder = 'A'")
    cells = F.array_sort(F.collect_list(F.struct("g", "x", "cents")))
    return rows.groupBy("var", "c").agg(F.slice(cells, 3, 8).alias("s")).select("var", "c", F.transform("s", lambda v: v["cents"]).alias("cut"))


@query(with_(CHUNKS) + """,
e AS (SELECT var, max(g1) AS gmax FROM chunks WHERE holder = 'A' GROUP BY var),
p AS (SELECT var, c, t, least(g1, g0 + nvalid) - g0 AS used, c * 24 AS start FROM chunks WHERE holder = 'A')
SELECT var, c, t, used, start + used > gmax AS padded FROM p JOIN e USING (var)""")
def valid_prefix(spark, d):
    """Logical samples of a growing chunk, padding left out."""
    a = _chunks(spark, d).where("holder = 'A'")
    ends = a.groupBy("var").agg(F.max("g1").alias("gmax"))
    used = F.least("g1", F.col("g0") + F.col("nvalid")) - F.col("g0")
    return a.join(F.broadcast(ends), "var").select("var", "c", "t", used.alias("used"), (grid.chunk_start("c", 24) + used > F.col("gmax")).alias("padded"))  # one row for each variable


@query(with_(CHUNKS) + """,
k AS (SELECT var, layout, c, t, list_sort(list(holder)) AS h, any_value(size) AS size FROM chunks GROUP BY ALL),
s AS (SELECT var, c, h[1] AS single, h[1 + c % len(h)] AS spread, size FROM k)
SELECT single, spread, count(*) AS pieces, CAST(sum(size) AS BIGINT) AS bytes FROM s GROUP BY 1, 2""")
def holder_policies(spark, d):
    """One holder for all, or holders in turn."""
    k = _chunks(spark, d).groupBy("var", "layout", "c", "t").agg(F.array_sort(F.collect_list("holder")).alias("h"), F.min("size").alias("size"))
    turn = F.element_at("h", (1 + F.pmod("c", F.size("h").cast("long"))).cast("int"))
    return k.select(F.col("h")[0].alias("single"), turn.alias("spread"), "size").groupBy("single", "spread").agg(F.count("*").alias("pieces"), F.sum("size").alias("bytes"))


@query("""
WITH c AS (SELECT p_brand AS variable, p_size % 3 AS version, 'K' AS units, p_partkey AS id FROM part),
w AS (SELECT * FROM (VALUES (1, 'K')) v(version, units))
SELECT variable, count(*) AS bound FROM c JOIN w USING (version, units) GROUP BY variable""")
def contract_binding(spark, d):
    """Contracts whose version and units are those of the grid."""
    c = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("variable"), F.struct((F.col("p_size") % 3).alias("version"), F.lit("K").alias("units")).alias("head"))
    return c.where(F.col("head") == F.struct(F.lit(1).alias("version"), F.lit("K").alias("units"))).groupBy("variable").agg(F.count("*").alias("bound"))


def median_ranks(n: int, resamples: int = 10_000) -> list[tuple[int, int]]:
    """(r, rank): the middle one or two of n draws from n sorted values, for each resample r of the bootstrap.

    The k-th smallest of n even draws is Beta(k, n - k + 1), the next one the least of the n - k draws above it.
    """
    if not n:
        return []
    rng, k = np.random.default_rng(0), (n + 1) // 2
    low = rng.beta(k, n - k + 1, resamples)
    ends = [low] if n % 2 else [low, low + (1 - low) * rng.beta(1, n - k, resamples)]
    return [(r, min(int(x * n), n - 1)) for end in ends for r, x in enumerate(end.tolist())]


@query()
def bootstrap_ratio(spark, d):
    """Median of all paired ratios and its bootstrap interval of 10,000 resamples, drawn as ranks of the sorted ratios."""
    a = F.greatest("s_acctbal", F.lit(1.0))
    pairs = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("i"), (a / (a * 0.5 + 100)).alias("ratio")).where("ratio is not null")
    pairs = pairs.withColumn("bucket", F.floor(F.col("ratio") * 4096))  # ratios are from 0 to 2
    sizes = pairs.groupBy("bucket").agg(F.count("*").alias("n"))
    before = sizes.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))  # at most 8,192 rows
    n = pairs.count()
    # resample -1 is the sample itself
    ranks = median_ranks(n) + [(-1, k) for k in sorted({(n - 1) // 2, n // 2}) if n]
    draws = spark.createDataFrame(ranks, "r long, rank long")
    within = F.row_number().over(Window.partitionBy("bucket").orderBy("ratio", "i")) - 1
    ranked = pairs.withColumn("within", within).join(F.broadcast(before), "bucket").select((F.col("before") + F.col("within")).alias("rank"), "ratio")
    medians = ranked.join(F.broadcast(draws), "rank").groupBy("r").agg(F.avg("ratio").alias("ratio"))  # 20,002 rows at most
    drawn = F.when(F.col("r") >= 0, F.col("ratio"))
    return medians.agg(F.percentile(drawn, F.lit(0.025)).alias("lo"), F.max(F.when(F.col("r") < 0, F.col("ratio"))).alias("mid"), F.percentile(drawn, F.lit(0.975)).alias("hi"))


@query(with_(CHUNKS) + """,
k AS (SELECT var, layout, c, t, vcid, list(holder) AS src FROM chunks GROUP BY ALL),
i AS (SELECT *, row_number() OVER (ORDER BY var, layout, c, t, vcid) - 1 AS i, count(*) OVER () AS n FROM k),
s AS (SELECT *, i % CAST(ceil(n / 5::DOUBLE) AS BIGINT) AS stripe FROM i),
tr AS (SELECT unnest(range(0, 50)) AS trial),
gone AS (SELECT trial, h, ('0x' || substr(md5(trial || '/' || h), 1, 8))::BIGINT % 5 = 0 AS gone FROM tr, (SELECT unnest(['A', 'B', 'C', 'D', 'P0', 'P1', 'P2']) AS h)),
live AS (SELECT s.*, tr.trial, EXISTS (SELECT 1 FROM gone g WHERE g.trial = tr.trial AND NOT g.gone AND list_contains(src, g.h)) AS ok FROM s, tr),
st AS (SELECT trial, stripe, count(*) FILTER (NOT ok) AS lost, count(*) AS n FROM live GROUP BY 1, 2),
r AS (SELECT st.*, CASE WHEN lost <= (SELECT count(*) FROM gone g WHERE g.trial = st.trial AND NOT g.gone AND g.h IN ('P' || stripe % 3, 'P' || (stripe + 1) % 3)) THEN 0 ELSE lost END AS still FROM st)
SELECT trial, round(1 - sum(lost) / CAST(sum(n) AS DOUBLE), 9) AS available, round(1 - sum(still) / CAST(sum(n) AS DOUBLE), 9) AS with_parity FROM r GROUP BY trial""")
def availability(spark, d):
    """Monte Carlo share of chunks that survive when a fifth of the holders go, and with two parity rows for each stripe of five."""
    chunks = _chunks(spark, d).groupBy("var", "layout", "c", "t", "vcid").agg(F.collect_set("holder").alias("src"))
    striped = parity.stripes(catalog.numbered(chunks, "var", ["layout", "c", "t", "vcid"], "i"), 5, "i")
    gone = lambda h: F.pmod(F.conv(F.substring(F.md5(F.concat_ws("/", F.col("trial").cast("string"), h)), 1, 8), 16, 10).cast("long"), F.lit(5)) == 0
    trials = striped.select("stripe", "src", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long"))).alias("trial"))
    lost = trials.groupBy("trial", "stripe").agg(F.sum(F.forall("src", gone).cast("int")).alias("lost"), F.count("*").alias("n"))
    rows = [F.concat(F.lit("P"), (F.pmod(F.col("stripe") + k, F.lit(3))).cast("string")) for k in (0, 1)]
    live = sum((~gone(h)).cast("int") for h in rows)
    still = F.when(F.col("lost") <= live, 0).otherwise(F.col("lost"))
    share = lambda x: F.round(1 - F.sum(x) / F.sum("n").cast("double"), 9)
    return lost.groupBy("trial").agg(share("lost").alias("available"), share(still).alias("with_parity"))


@query(with_(CHUNKS) + """,
s AS (SELECT var, c, t, count(*) AS pieces, count(*) FILTER (holder = 'A') AS got FROM chunks WHERE layout = '24x8+0' GROUP BY 1, 2, 3)
SELECT var, CASE WHEN sum(got) = count(*) THEN 'done' WHEN sum(got) = 0 THEN 'none' ELSE 'partial' END AS state, count(*) AS chunks FROM s GROUP BY var""")
def region_state(spark, d):
    """A13, 3.1: a region request is done only if every chunk is there."""
    s = _chunks(spark, d).where("layout = '24x8+0'").groupBy("var", "c", "t").agg(F.count(F.when(F.col("holder") == "A", 1)).alias("got"))
    n = F.count("*")
    return s.groupBy("var").agg(F.when(F.sum("got") == n, "done").when(F.sum("got") == 0, "none").otherwise("partial").alias("state"), n.alias("chunks"))


@query(with_(CHUNKS) + """
SELECT var, min(g0) AS g0, max(g1) AS g1, max(g1) - min(g0) >= 480 AS whole FROM chunks WHERE holder = 'A' GROUP BY var""")
def range_covered(spark, d):
    """Does one run of A's samples cover the request."""
    runs = merge.islands(_chunks(spark, d).where("holder = 'A'").select("var", "g0", "g1"), ["var"])
    return runs.groupBy("var").agg(F.min("g0").alias("g0"), F.max("g1").alias("g1")).withColumn("whole", F.col("g1") - F.col("g0") >= 480)
