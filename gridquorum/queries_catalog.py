"""Queries over the catalogue: chunks, layouts, holders, names, records, trust, pages and cache."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import grid
from .operators import catalog, paging, trust
from .queries_cells import _replicas
from .registry import query
from .sqltext import CHUNKS, with_


def _chunks(spark, d):
    return catalog.chunks(_replicas(spark, d))


@query(with_(CHUNKS) + " SELECT holder, var, layout, c, t, n, nvalid, cents, g0, g1, vcid FROM chunks")
def chunk_stats(spark, d):
    """Sums, counts, extents and value ids of all chunks."""
    return _chunks(spark, d).select("holder", "var", "layout", "c", "t", "n", "nvalid", "cents", "g0", "g1", "vcid")


@query(with_(CHUNKS) + " SELECT var, layout, count(*) AS chunks, CAST(sum(size) AS BIGINT) AS bytes, count(DISTINCT holder) AS holders, min(g0) AS g0, max(g1) AS g1 FROM chunks GROUP BY 1, 2")
def layout_totals(spark, d):
    """Chunks, bytes and extent of each layout."""
    return _chunks(spark, d).groupBy("var", "layout").agg(F.count("*").alias("chunks"), F.sum("size").alias("bytes"), F.countDistinct("holder").alias("holders"), F.min("g0").alias("g0"), F.max("g1").alias("g1"))


@query(with_(CHUNKS) + " SELECT var, min(g0) AS gmin, max(g1) AS gmax FROM chunks GROUP BY var")
def extent(spark, d):
    """Extent of each variable over all replicas."""
    return _replicas(spark, d).groupBy("var").agg(F.min("g").alias("gmin"), (F.max("g") + 1).alias("gmax"))


@query(with_(CHUNKS) + " SELECT holder, count(*) AS chunks, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(n) AS BIGINT) AS cells FROM chunks GROUP BY holder")
def status_totals(spark, d):
    """Totals of each holder."""
    return _chunks(spark, d).groupBy("holder").agg(F.count("*").alias("chunks"), F.sum("size").alias("bytes"), F.sum("n").alias("cells"))


@query(with_(CHUNKS) + """,
w AS (SELECT var, c, unnest(h) AS holder FROM (SELECT var, layout, c, t, vcid, list(holder) AS h FROM chunks GROUP BY ALL))
SELECT holder, count(*) AS chunks FROM w GROUP BY holder""")
def peers_by_chunks(spark, d):
    """Holders by the number of value groups they serve."""
    src = _chunks(spark, d).groupBy("var", "layout", "c", "t", "vcid").agg(F.collect_list("holder").alias("src"))
    return src.select(F.explode("src").alias("holder")).groupBy("holder").agg(F.count("*").alias("chunks"))


@query(with_(CHUNKS) + """,
s AS (SELECT var, layout, c, t, vcid, min(g0) AS g0, max(g1) AS g1, count(*) AS holders FROM chunks GROUP BY ALL),
e AS (SELECT var, min(g0) AS lo, max(g1) AS hi FROM s GROUP BY var),
b AS (SELECT s.var, holders, unnest(range((g0 - lo) * 40 // (hi - lo), (g1 - 1 - lo) * 40 // (hi - lo) + 1)) AS bin FROM s JOIN e USING (var))
SELECT var, CAST(bin AS BIGINT) AS bin, max(holders) AS holders, count(*) AS chunks FROM b GROUP BY 1, 2""")
def piece_map(spark, d):
    """A10: the time extent in 40 bins, with the most holders of a chunk in each."""
    spans = _chunks(spark, d).groupBy("var", "layout", "c", "t", "vcid").agg(F.min("g0").alias("g0"), F.max("g1").alias("g1"), F.count("*").alias("holders"))
    return catalog.piece_map(spans, 40, "g0", "g1")


@query(with_(CHUNKS) + """,
cheap(layout, cost) AS (VALUES ('24x8+0', 1), ('4x8+0s6o0', 2), ('168x4+0', 3)),
d AS (SELECT DISTINCT var, layout, holder FROM chunks)
SELECT var, layout, count(*) AS holders, CAST(sum(ascii(holder)) AS BIGINT) AS rate FROM d JOIN cheap USING (layout) GROUP BY 1, 2""")
def layout_rate(spark, d):
    """The sum of the rates of a layout's distinct holders."""
    served = _replicas(spark, d).select("var", "layout", "holder").distinct()
    return served.groupBy("var", "layout").agg(F.count("*").alias("holders"), F.sum(F.ascii("holder")).cast("long").alias("rate"))


@query("""
WITH h AS (SELECT s_suppkey AS holder, n_name AS site, n_regionkey AS region, greatest(s_acctbal, 1.0) AS rate FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT region, list_sort(list(rate))[count(*) // 2 + 1] AS median_rate, count(*) AS holders FROM h GROUP BY region""")
def median_rate(spark, d):
    """Upper median of the holders' rates."""
    return catalog.holders(spark, d).groupBy("region").agg(catalog.upper_median("rate").alias("median_rate"), F.count("*").alias("holders"))


@query("""
WITH RECURSIVE o AS (SELECT o_custkey % 50 AS holder, o_totalprice AS rate, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS i FROM orders),
e AS (SELECT holder, i, rate AS ewma FROM o WHERE i = 1 UNION ALL SELECT o.holder, o.i, 0.5 * e.ewma + 0.5 * o.rate FROM e JOIN o ON o.holder = e.holder AND o.i = e.i + 1)
SELECT holder, round(arg_max(ewma, i), 4) AS ewma, max(i) AS samples FROM e GROUP BY holder""")
def ewma_rate(spark, d):
    """Exponentially weighted rate, first sample as it is, then halves.

    A fold in order; only the newest 64 samples can show in a double, so a hot holder keeps that many.
    """
    o = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_custkey") % 50).alias("holder"), "o_orderkey", "o_totalprice")
    n = o.groupBy("holder").agg(F.count("*").alias("samples"))
    w = Window.partitionBy("holder").orderBy(F.desc("o_orderkey"))
    last = o.withColumn("r", F.row_number().over(w)).where("r <= 64").groupBy("holder").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("s"))
    fold = F.aggregate(F.slice("s", 2, 64), F.col("s")[0]["o_totalprice"], lambda acc, x: acc * 0.5 + x["o_totalprice"] * 0.5)
    return last.join(n, "holder").select("holder", F.round(fold, 4).alias("ewma"), "samples")


@query("""
WITH e AS (SELECT lower(event_type) AS tag, 'grid' || (user_id % 5) AS grid, user_id AS node, event_type AS var, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS g FROM events),
i AS (SELECT tag, grid, node, list(DISTINCT var) AS vars, min(g) AS t0, max(g) AS t1 FROM e GROUP BY ALL)
SELECT grid, array_to_string(list_sort(list_distinct(flatten(list(vars)))), ',') AS vars, count(DISTINCT node) AS seeders, min(t0) AS t0, max(t1) AS t1 FROM i WHERE tag = 'click' GROUP BY grid""")
def search_index(spark, d):
    """Search by tag in any case."""
    e = spark.read.parquet(f"{d}/events.parquet")
    rows = e.select(F.col("event_type").alias("tag"), F.concat(F.lit("grid"), F.col("user_id") % 5).alias("grid"), F.col("user_id").alias("node"), F.col("event_type").alias("var"), grid.quantum("ts", 3600).alias("g"))
    index = rows.groupBy("tag", "grid", "node").agg(F.collect_set("var").alias("vars"), F.min("g").alias("t0"), F.max("g").alias("t1"))
    return catalog.search(index, "CLICK").withColumn("vars", F.array_join("vars", ","))


@query("""
WITH n AS (SELECT o_custkey % 20 AS pk, 'name' || (o_orderkey % 7) AS name, 'grid' || o_orderkey AS target, o_orderkey AS seq FROM orders)
SELECT pk, name, arg_max(target, seq) AS target, max(seq) AS seq FROM n GROUP BY 1, 2""")
def name_resolve(spark, d):
    """The newest record of each published name."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    names = o.select((F.col("o_custkey") % 20).alias("pk"), F.concat(F.lit("name"), F.col("o_orderkey") % 7).alias("name"), F.concat(F.lit("grid"), F.col("o_orderkey")).alias("target"), F.col("o_orderkey").alias("seq"))
    return catalog.resolve_names(names)


@query("""
WITH r AS (SELECT user_id AS node, CAST(floor(epoch(ts)) AS BIGINT) AS ts, 'addr' || event_id AS addr FROM events),
now AS (SELECT CAST(epoch(TIMESTAMP '2024-01-15') AS BIGINT) AS t)
SELECT node, max(ts) AS ts, arg_max(addr, ts) AS addr FROM r, now WHERE ts >= t - 7200 AND ts <= t + 300 GROUP BY node""")
def live_records(spark, d):
    """Records that are neither expired nor from the future, newest of each publisher."""
    e = spark.read.parquet(f"{d}/events.parquet")
    rows = e.select(F.col("user_id").alias("node"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), F.concat(F.lit("addr"), "event_id").alias("addr"))
    return catalog.valid_records(rows, now=1705276800, ttl=7200)


@query("""
WITH a AS (SELECT s_suppkey AS node, s_name AS addr FROM supplier WHERE s_suppkey % 2 = 0), b AS (SELECT s_suppkey AS node, s_name AS addr FROM supplier WHERE s_suppkey % 3 = 0)
SELECT DISTINCT node, addr FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def peer_union(spark, d):
    """Records from peers, each node once."""
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("node"), F.col("s_name").alias("addr"))
    return s.where("node % 2 = 0").unionByName(s.where("node % 3 = 0")).dropDuplicates(["node"])


@query("""
WITH h AS (SELECT s_suppkey AS holder, s_nationkey % 3 = 0 AS trusted, s_suppkey % 4 AS failures, greatest(s_acctbal, 1.0) AS bw, l_partkey % 50 AS chunk FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT chunk, arg_max(holder, CAST(trusted AS INTEGER) * 1000000 - failures * 100000 + bw) AS holder, count(DISTINCT holder) AS holders FROM h GROUP BY chunk""")
def best_holder(spark, d):
    """Holder of each chunk by trust, failures, then rate."""
    s = spark.read.parquet(f"{d}/supplier.parquet")
    li = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("s_suppkey"), (F.col("l_partkey") % 50).alias("chunk")).distinct()
    score = F.struct((F.col("s_nationkey") % 3 == 0).alias("trusted"), (-(F.col("s_suppkey") % 4)).alias("failures"), F.greatest("s_acctbal", F.lit(1.0)).alias("bw"))
    return li.join(s, "s_suppkey").groupBy("chunk").agg(F.max_by("s_suppkey", score).alias("holder"), F.countDistinct("s_suppkey").alias("holders"))


@query(with_(CHUNKS) + """
SELECT var, layout, c, t, count(*) AS holders FROM chunks GROUP BY ALL ORDER BY holders, var, layout, c, t LIMIT 50""")
def rarest_first(spark, d):
    """The fifty chunks with fewest holders (a top-k report)."""
    counts = _chunks(spark, d).groupBy("var", "layout", "c", "t").agg(F.count("*").alias("holders"))
    return counts.orderBy("holders", "var", "layout", "c", "t").limit(50)


@query("""
WITH n AS (SELECT s_suppkey AS node, ('0x' || substr(md5(CAST(s_suppkey AS VARCHAR)), 1, 15))::BIGINT AS id FROM supplier)
SELECT node, id, xor(id, 81985529216486895) AS distance FROM n ORDER BY distance LIMIT 8""")
def closest_nodes(spark, d):
    """The eight nodes closest to a key by XOR distance (a top-k report)."""
    s = spark.read.parquet(f"{d}/supplier.parquet")
    node = F.conv(F.substring(F.md5(F.col("s_suppkey").cast("string")), 1, 15), 16, 10).cast("long")
    near = s.select(F.col("s_suppkey").alias("node"), node.alias("id"))
    return near.withColumn("distance", F.col("id").bitwiseXOR(F.lit(0x0123456789ABCDEF))).orderBy("distance").limit(8)


@query("""
WITH q AS (SELECT l_suppkey % 20 AS holder, l_partkey AS chunk, min(l_orderkey) AS seq FROM lineitem WHERE l_suppkey % 20 NOT IN (3, 7) GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY holder ORDER BY seq, chunk) AS n FROM q)
SELECT holder, min(n) AS first, count(*) FILTER (n <= 3) AS always FROM n WHERE n <= 3 GROUP BY holder""")
def audit_first(spark, d):
    """The first three requests of each holder are always audited; trusted holders never."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_suppkey") % 20).alias("holder"), F.col("l_partkey").alias("chunk"), F.col("l_orderkey").alias("seq"))
    trusted = spark.createDataFrame([(3,), (7,)], "holder long")
    return trust.audit_sample(li, trusted, first=3, rate=0.0).groupBy("holder").agg(F.min("n").cast("long").alias("first"), F.count("*").alias("always"))


@query("""
WITH q AS (SELECT l_suppkey % 20 AS holder, l_partkey AS chunk, min(l_orderkey) AS seq FROM lineitem WHERE l_suppkey % 20 NOT IN (3, 7) GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY holder ORDER BY seq, chunk) AS n FROM q)
SELECT holder, chunk, seq, CASE WHEN n <= 3 THEN n END AS n FROM n WHERE n <= 3 OR ('0x' || substr(md5(holder || '/' || chunk), 1, 8))::BIGINT % 10000 < 500""")
def audit_sample(spark, d):
    """With the five per cent sample of the rest."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_suppkey") % 20).alias("holder"), F.col("l_partkey").alias("chunk"), F.col("l_orderkey").alias("seq"))
    return trust.audit_sample(li, spark.createDataFrame([(3,), (7,)], "holder long")).withColumn("n", F.col("n").cast("long"))


_RECEIPTS = """
WITH tr AS (SELECT p_partkey AS chunk, md5(p_name) AS h FROM part),
r AS (SELECT l_suppkey AS holder, l_partkey AS chunk, CASE WHEN l_suppkey % 37 = 5 AND l_linenumber = 1 THEN md5('x') ELSE md5(p_name) END AS h FROM lineitem JOIN part ON l_partkey = p_partkey),
bad AS (SELECT r.holder, r.chunk FROM r JOIN tr USING (chunk) WHERE r.h <> tr.h)"""


def _receipts(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("chunk"), F.md5("p_name").alias("true"))
    li = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("holder"), F.col("l_partkey").alias("chunk"), "l_linenumber")
    false = (F.col("holder") % 37 == 5) & (F.col("l_linenumber") == 1)
    receipts = li.join(part, "chunk").select("holder", "chunk", F.when(false, F.md5(F.lit("x"))).otherwise(F.col("true")).alias("h"))
    return receipts, part.select("chunk", F.col("true").alias("h"))


@query(_RECEIPTS + " SELECT holder, count(*) AS frauds FROM bad GROUP BY holder")
def receipt_audit(spark, d):
    """Receipts that do not match the verified chunk."""
    receipts, truth = _receipts(spark, d)
    return trust.verify_receipts(receipts, truth, ["chunk"]).groupBy("holder").agg(F.count("*").alias("frauds"))


@query(_RECEIPTS + " SELECT holder, count(*) AS tainted FROM r WHERE holder IN (SELECT holder FROM bad) GROUP BY holder")
def fraud_taint(spark, d):
    """Everything a fraudulent holder served is tainted."""
    receipts, truth = _receipts(spark, d)
    _, tainted = trust.untainted(receipts, trust.verify_receipts(receipts, truth, ["chunk"]))
    return tainted.groupBy("holder").agg(F.count("*").alias("tainted"))


@query("""
WITH h AS (SELECT o_custkey % 40 AS node, o_custkey % 3 AS grid, o_orderkey AS seen, CAST(floor(o_orderkey / 50) AS BIGINT) - CASE WHEN o_orderkey % 97 = 0 THEN 20 ELSE 0 END AS seq, o_orderkey % 53 = 0 AS odd FROM orders),
b AS (SELECT *, max(seq) OVER (PARTITION BY node, grid ORDER BY seen ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h)
SELECT node, grid, seq, 'rollback' AS fault FROM b WHERE seq < before
UNION ALL SELECT node, grid, seq, 'equivocation' FROM h GROUP BY node, grid, seq HAVING count(DISTINCT odd) > 1""")
def head_faults(spark, d):
    """Manifest heads that go back or fork."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    seq = grid.floor_div(F.col("o_orderkey"), 50) - F.when(F.col("o_orderkey") % 97 == 0, 20).otherwise(0)
    heads = o.select((F.col("o_custkey") % 40).alias("node"), (F.col("o_custkey") % 3).alias("grid"), F.col("o_orderkey").alias("seen"), seq.alias("seq"), (F.col("o_orderkey") % 53 == 0).alias("root"))
    return trust.head_faults(heads)


_BLOBS = """
WITH i AS (SELECT md5(p_type || (p_partkey % 700)) AS cid, p_size * 1000 AS size, (p_partkey * 7919) % 1000000 AS last_use, p_partkey % 41 = 0 AS pinned FROM part),
b AS (SELECT cid, CAST(max(size) AS BIGINT) AS size, max(last_use) AS last_use, bool_or(pinned) AS pinned FROM i GROUP BY cid),
p AS (SELECT coalesce(sum(size) FILTER (pinned), 0) AS pinned_size, sum(size) AS total FROM b),
h AS (SELECT b.*, sum(size) OVER (ORDER BY last_use DESC, cid DESC ROWS UNBOUNDED PRECEDING) + pinned_size AS held, total FROM b, p WHERE NOT pinned)"""


@query(_BLOBS + " SELECT cid, size, last_use FROM h WHERE total > 20000000 AND held > 18000000")
def lru_evict(spark, d):
    """Blobs to evict, least recently used first, down to 90 % of the limit."""
    part = spark.read.parquet(f"{d}/part.parquet")
    cid = F.md5(F.concat("p_type", F.col("p_partkey") % 700))
    index = part.select(cid.alias("cid"), (F.col("p_size").cast("long") * 1000).alias("size"), (F.col("p_partkey") * 7919 % 1000000).alias("last_use"), (F.col("p_partkey") % 41 == 0).alias("pinned"))
    return catalog.evict(index, 20_000_000)


@query("""
WITH r AS (SELECT user_id % 20 AS reader, event_id AS seq, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS c FROM events),
s AS (SELECT reader, seq, c, c - lag(c) OVER (PARTITION BY reader ORDER BY seq) = 1 AS next FROM r)
SELECT reader, c, c + 1 AS ahead0, c + 4 AS ahead1 FROM s WHERE next GROUP BY ALL""")
def readahead(spark, d):
    """After two chunks in order the next four are read ahead."""
    r = spark.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 20).alias("reader"), F.col("event_id").alias("seq"), grid.quantum("ts", 3600).alias("c"))
    next_ = F.col("c") - F.lag("c").over(Window.partitionBy("reader").orderBy("seq")) == 1
    return r.withColumn("next", next_).where("next").select("reader", "c", (F.col("c") + 1).alias("ahead0"), (F.col("c") + 4).alias("ahead1")).distinct()


_KEYS = with_(CHUNKS) + """,
k AS (SELECT var, c, t, var || '/' || c || '.' || t AS key, vcid FROM chunks WHERE holder = 'A'),
s AS (SELECT *, ('0x' || substr(md5(key), 1, 8))::BIGINT % 8 = 0 AS ends FROM k)"""

_PAGES = """ AS (SELECT *, coalesce(sum(CAST(ends AS INTEGER)) OVER (PARTITION BY var ORDER BY c, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS page FROM s)"""
_TABLE = " (SELECT var, CAST(page AS BIGINT) AS page, count(*) AS entries, min(key) AS first, max(key) AS last, md5(string_agg(key || '=' || vcid, ',' ORDER BY key || '=' || vcid)) AS hash FROM {} GROUP BY 1, 2)"


def _paged(spark, d):
    """Entries of A's manifest with page numbers."""
    k = _chunks(spark, d).where("holder = 'A'").select("var", "c", "t", F.concat_ws("/", "var", F.concat_ws(".", "c", "t")).alias("key"), "vcid")
    return paging.pages(k, ["var"], ["c", "t"], "key", 8)


@query(_KEYS + ", p" + _PAGES + " SELECT * FROM" + _TABLE.format("p"))
def manifest_pages(spark, d):
    """Content-defined pages of a manifest."""
    return paging.page_table(_paged(spark, d), ["var"], "key", "vcid")


@query(_KEYS + ", p" + _PAGES + """,
old AS (SELECT p.* FROM p JOIN (SELECT var, max(c) AS last FROM p GROUP BY var) USING (var) WHERE c < last)
SELECT * FROM""" + _TABLE.format("p") + " WHERE hash NOT IN (SELECT hash FROM" + _TABLE.format("old") + ")")
def manifest_delta(spark, d):
    """Pages that are new when one day is appended."""
    paged = _paged(spark, d)
    last = paged.groupBy("var").agg(F.max("c").alias("last"))
    before = paged.join(F.broadcast(last), "var").where("c < last")  # one row for each variable
    table = lambda p: paging.page_table(p, ["var"], "key", "vcid")
    return paging.unseen(table(paged), table(before))


@query("""
WITH j AS (SELECT l_partkey % 100 AS chunk, l_suppkey % 10 AS holder, CAST(round(l_quantity) AS BIGINT) AS size FROM lineitem WHERE l_linenumber = 1)
SELECT max(load / CAST(holder + 1 AS DOUBLE)) AS makespan, count(*) AS holders, CAST(sum(load) AS BIGINT) AS bytes FROM (SELECT holder, CAST(sum(size) AS BIGINT) AS load FROM j GROUP BY holder)""")
def makespan(spark, d):
    """The slowest holder's load over its rate."""
    j = spark.read.parquet(f"{d}/lineitem.parquet").where("l_linenumber = 1").select((F.col("l_suppkey") % 10).alias("holder"), F.round("l_quantity").cast("long").alias("size"))
    load = j.groupBy("holder").agg(F.sum("size").alias("load"))
    return load.agg(F.max(F.col("load") / (F.col("holder") + 1).cast("double")).alias("makespan"), F.count("*").alias("holders"), F.sum("load").alias("bytes"))


@query("""
WITH l AS (SELECT l_suppkey AS holder, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY 1),
r AS (SELECT v, row_number() OVER (ORDER BY v, holder) AS i, count(*) OVER () AS n, sum(v) OVER () AS s FROM l)
SELECT round(CAST(sum((2 * i - n - 1) * v) AS DOUBLE) / (max(n) * max(s)), 9) AS gini, max(n) AS holders FROM r""")
def gini(spark, d):
    """Inequality of the holders' loads; one sorted pass over holders."""
    load = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("holder")).agg(F.sum(F.round("l_quantity").cast("long")).alias("v"))
    total = F.broadcast(load.agg(F.count("*").alias("n"), F.sum("v").alias("s")))
    # rank of a load: how many are smaller; equal loads may share a rank, their weights add up to the same
    counts = load.groupBy("v").agg(F.count("*").alias("k"))
    below = F.coalesce(F.sum("k").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = counts.withColumn("below", below).crossJoin(total).select("n", "s", (F.col("v") * F.col("k") * (2 * F.col("below") + F.col("k") - F.col("n"))).alias("w"))
    return part.agg(F.round(F.sum("w").cast("double") / (F.max("n") * F.max("s")), 9).alias("gini"), F.max("n").alias("holders"))


@query("""
WITH u AS (SELECT DISTINCT source AS node, lang AS tag FROM documents)
SELECT tag, count(*) AS nodes, string_agg(node, ',' ORDER BY node) AS who FROM u GROUP BY tag""")
def announce_tags(spark, d):
    """One index record for each tag of each node."""
    u = spark.read.parquet(f"{d}/documents.parquet").select(F.col("source").alias("node"), F.col("lang").alias("tag")).distinct()
    return u.groupBy("tag").agg(F.count("*").alias("nodes"), F.array_join(F.array_sort(F.collect_list("node")), ",").alias("who"))


@query("""
SELECT key, CASE WHEN ok THEN split_part(split_part(key, '@', 2), '/', 1) END AS layout, CASE WHEN ok THEN CAST(split_part(split_part(split_part(key, '@', 2), '/', 2), '.', 1) AS BIGINT) END AS c FROM (
  SELECT key, regexp_full_match(key, '[^@/]+@[^@/]+/-?[0-9]+(\\.-?[0-9]+)*') AS ok FROM (
    SELECT p_brand || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '@24x8+0/' || (p_partkey - 50) || '.' || p_size END AS key FROM part))""")
def parse_keys(spark, d):
    """S14, 2.9: chunk keys taken apart; malformed ones are null."""
    part = spark.read.parquet(f"{d}/part.parquet")
    key = F.concat("p_brand", F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.concat(F.lit("@24x8+0/"), F.col("p_partkey") - 50, F.lit("."), "p_size")))
    parsed = grid.parse_key(F.col("key"))
    return part.select(key.alias("key")).select("key", parsed["layout"].alias("layout"), parsed["coord"][0].alias("c"))


@query("""
SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 86400 WHEN 1 THEN 3600 WHEN 2 THEN 60 ELSE 1 END * (s_suppkey + 1) AS seconds,
  CASE WHEN CASE s_suppkey % 4 WHEN 0 THEN 86400 WHEN 1 THEN 3600 WHEN 2 THEN 60 ELSE 1 END * (s_suppkey + 1) % 86400 = 0 THEN 86400
    WHEN CASE s_suppkey % 4 WHEN 0 THEN 86400 WHEN 1 THEN 3600 WHEN 2 THEN 60 ELSE 1 END * (s_suppkey + 1) % 3600 = 0 THEN 3600
    WHEN CASE s_suppkey % 4 WHEN 0 THEN 86400 WHEN 1 THEN 3600 WHEN 2 THEN 60 ELSE 1 END * (s_suppkey + 1) % 60 = 0 THEN 60 ELSE 1 END AS quantum
FROM supplier""")
def durations(spark, d):
    """2.9: durations such as 7d, 12h, 30m, and the time quantum of a step."""
    unit = F.element_at(F.array(*[F.lit(u) for u in ("d", "h", "m", "s")]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("id"), grid.duration_seconds(F.concat(F.col("s_suppkey") + 1, unit)).alias("seconds"))
    return s.withColumn("quantum", grid.best_quantum("seconds"))


@query(with_(CHUNKS) + """,
f AS (SELECT var, c, t, holder, greatest(least(g1, g0 + 12) - g0, 0) / CAST(24 AS DOUBLE) * 0.25 AS fraction FROM chunks WHERE layout = '24x8+0')
SELECT var, c, t, round(sum(fraction), 9) AS demand, sum(fraction) > 0.2 AS whole FROM f GROUP BY 1, 2, 3""")
def demand_fraction(spark, d):
    """Slices of a chunk add up; beyond the threshold the whole chunk is cheaper."""
    f = _chunks(spark, d).where("layout = '24x8+0'").withColumn("fraction", F.greatest(F.least("g1", F.col("g0") + 12) - F.col("g0"), F.lit(0)) / F.lit(24.0) * 0.25)
    return f.groupBy("var", "c", "t").agg(F.round(F.sum("fraction"), 9).alias("demand"), (F.sum("fraction") > 0.2).alias("whole"))


@query("""
SELECT l_partkey % 200 AS key, min(l_linenumber) AS lo0, max(l_linenumber) + 1 AS hi0, CAST(min(l_quantity) AS BIGINT) AS lo1, CAST(max(l_quantity) AS BIGINT) + 1 AS hi1, count(*) AS slices FROM lineitem GROUP BY 1""")
def bbox_coalesce(spark, d):
    """The bounding box of the slices wanted from each chunk."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.groupBy((F.col("l_partkey") % 200).alias("key")).agg(
        F.min("l_linenumber").alias("lo0"), (F.max("l_linenumber") + 1).alias("hi0"), F.min("l_quantity").cast("long").alias("lo1"), (F.max("l_quantity").cast("long") + 1).alias("hi1"), F.count("*").alias("slices")
    )


@query(with_(CHUNKS) + """,
v AS (SELECT DISTINCT var, holder FROM chunks WHERE holder <> 'D')
SELECT k.var, k.layout, k.c, k.t, count(*) AS copies, min(k.holder) AS first FROM chunks k JOIN v USING (var, holder) GROUP BY ALL""")
def manifest_merge(spark, d):
    """Chunks of eligible holders, by a semi-join before the merge."""
    chunks = _chunks(spark, d)
    eligible = _replicas(spark, d).select("var", "holder").distinct().where("holder <> 'D'")
    return chunks.join(eligible, ["var", "holder"], "left_semi").groupBy("var", "layout", "c", "t").agg(F.count("*").alias("copies"), F.min("holder").alias("first"))


@query(with_(CHUNKS) + """,
idx AS (SELECT var, c, t, vcid, holder FROM chunks WHERE holder IN ('A', 'D')),
newest AS (SELECT var, c, t, arg_max(vcid, holder) AS vcid, count(*) AS versions FROM idx GROUP BY 1, 2, 3)
SELECT * FROM newest""")
def cache_upsert(spark, d):
    """Index upsert, the newest version of each chunk stays."""
    idx = _chunks(spark, d).where("holder in ('A', 'D')")
    return idx.groupBy("var", "c", "t").agg(F.max_by("vcid", "holder").alias("vcid"), F.count("*").alias("versions"))


