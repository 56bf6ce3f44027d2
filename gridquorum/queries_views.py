"""Queries over views, manifests, contracts, parity across layouts and further votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import grid
from .operators import catalog, identity, merge, paging, parity
from .queries_catalog import _KEYS, _PAGES, _TABLE, _chunks, _paged
from .queries_cells import PRIORITY, _replicas
from .query import VirtualStore, mean_of, open_dataset, open_view, open_views
from . import queries_values  # noqa: F401  (registers progressive_mean)
from .registry import SQL, query
from .sources import tables
from .sqltext import CELLS, CHUNKS, REPLICAS, UNION, with_


@query("""
SELECT 'nation' AS source, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region""")
def glob_sources(spark, d):
    """Tables by path patterns; a pattern without a match is skipped."""
    found = tables.load(spark, [f"{d}/nat*.parquet", f"{d}/region.parquet", f"{d}/no-such-*.parquet"], "n_name string, r_name string")
    source = F.when(F.col("n_name").isNotNull(), "nation").otherwise("region")
    return found.groupBy(source.alias("source")).agg(F.count("*").alias("n"))


@query(with_(CHUNKS) + " SELECT holder, var, layout, c, t, vcid, size, nvalid FROM chunks")
def manifest_documents(spark, d):
    """Signed manifests as one JSON document for each holder and variable, read back in full."""
    keys, schema = ["holder", "var"], "array<struct<layout:string,c:bigint,t:int,vcid:string,size:bigint,nvalid:bigint>>"
    entry = F.struct("layout", "c", "t", "vcid", "size", "nvalid")
    documents = _chunks(spark, d).groupBy(*keys).agg(F.count("*").alias("n"), F.to_json(F.array_sort(F.collect_list(entry))).alias("body"))
    read = documents.select(*keys, "n", F.from_json("body", schema).alias("entries")).where(F.size("entries") == F.col("n"))
    return read.select(*keys, F.inline("entries"))


@query(_KEYS + ", p" + _PAGES + ", b AS (SELECT min(c) + 4 AS lo, min(c) + 9 AS hi FROM p) SELECT var, c, t, vcid FROM p, b WHERE c >= lo AND c < hi")
def manifest_range(spark, d):
    """The entries of five days, from the pages that overlap them."""
    paged = _paged(spark, d)
    first = paged.agg(F.min("c")).first()[0] or 0
    return paging.range_read(paged, ["var"], "c", first + 4, first + 9).select("var", "c", "t", "vcid")


@query(_KEYS + ", p" + _PAGES + ", l0 AS " + _TABLE.format("p") + """,
s1 AS (SELECT *, ('0x' || substr(md5(hash), 1, 8))::BIGINT % 4 = 0 AS ends FROM l0),
p1 AS (SELECT *, coalesce(sum(CAST(ends AS INTEGER)) OVER (PARTITION BY var ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS up FROM s1),
l1 AS (SELECT var, CAST(up AS BIGINT) AS page, count(*) AS entries, min(first) AS first, max(last) AS last, md5(string_agg(hash, ',' ORDER BY page)) AS hash FROM p1 GROUP BY var, up)
SELECT var, 0 AS level, page, entries, first, last, hash FROM l0 UNION ALL SELECT var, 1, page, entries, first, last, hash FROM l1""")
def manifest_tree(spark, d):
    """The two lowest levels of the page tree, each cut by its own hashes."""
    return paging.tree(paging.page_table(_paged(spark, d), ["var"], "key", "vcid"), ["var"], 4, most=2)


@query(with_(UNION) + """,
k AS (SELECT var, CAST(floor(g / 12::DOUBLE) AS BIGINT) AS c, x // 4 AS t, (g % 12) * 4 + x % 4 AS p, cents FROM merged),
d AS (SELECT DISTINCT var, c, t FROM k),
f AS (SELECT d.var, d.c, d.t, q.p, k.cents FROM d CROSS JOIN (SELECT unnest(range(0, 48)) AS p) q LEFT JOIN k ON k.var = d.var AND k.c = d.c AND k.t = d.t AND k.p = q.p)
SELECT var, c, CAST(t AS BIGINT) AS t, string_agg(coalesce(CAST(cents AS VARCHAR), '-'), ',' ORDER BY p) AS cells FROM f GROUP BY 1, 2, 3""")
def virtual_chunks(spark, d):
    """Chunks of a layout that nobody holds, with fill where no replica has the cell."""
    out = VirtualStore(open_dataset(_replicas(spark, d), PRIORITY), 12, 4).chunks()
    text = F.transform("values", lambda v: F.coalesce(F.round(v * 100).cast("long").cast("string"), F.lit("-")))
    return out.select("var", "c", "t", F.array_join(text, ",").alias("cells"))


@query(with_(UNION) + " SELECT var AS grid, count(*) AS cells, min(g) AS g0, max(g) AS g1, var = 'purchase' AS first FROM merged WHERE var IN ('purchase', 'click') GROUP BY var")
def view_links(spark, d):
    """All grids of a composite link, and the first one."""
    rows = _replicas(spark, d).withColumn("grid", F.col("var"))
    first = open_view(rows, "purchase+click", PRIORITY).cells.select(F.col("var").alias("grid")).distinct().withColumn("_f", F.lit(True))
    parts = [ds.cells.groupBy(F.lit(name).alias("grid")).agg(F.count("*").alias("cells"), F.min("g").alias("g0"), F.max("g").alias("g1")) for name, ds in open_views(rows, "purchase+click", PRIORITY).items()]
    return parts[0].unionByName(parts[1]).join(first, "grid", "left").select("grid", "cells", "g0", "g1", F.coalesce("_f", F.lit(False)).alias("first"))


@query(SQL["progressive_mean"].replace("WHERE k = 1", "WHERE k = 1 AND var = 'view'").replace("/ 12::DOUBLE", "/ 24::DOUBLE").replace("sum(cents) AS BIGINT) AS s", "sum(cents) AS BIGINT) / 100::DOUBLE AS s"))
def mean_report(spark, d):
    """Q04: the mean command on one variable."""
    r = mean_of(open_dataset(_replicas(spark, d), PRIORITY), "view", "vdc", rel_err=0.05)
    return spark.createDataFrame([("view", round(r["mean"], 6), None if r["chunks"] < 2 else round(r["ci95"], 6), r["chunks"], r["of"], r["exact"])], "var string, mean double, ci95 double, chunks long, of long, exact boolean")


@query("""
WITH c AS (SELECT 'grid' || p_size % 4 AS grid, p_brand AS variable, p_size % 3 AS version, CASE WHEN p_partkey % 11 = 0 THEN 'mm' ELSE 'K' END AS units, p_partkey % 13 <> 0 AS sig_ok, p_size / 100.0 AS step, CASE WHEN p_partkey % 7 = 0 THEN p_size / 100.0 ELSE p_size / 250.0 END AS max_error FROM part),
g AS (SELECT 'grid' || (i % 3) AS grid, b AS variable, 1 AS version, 'K' AS units FROM (SELECT DISTINCT p_brand AS b FROM part), (SELECT unnest(range(0, 3)) AS i)),
r AS (SELECT CASE WHEN g.version IS NULL THEN 'grid' WHEN c.version <> g.version THEN 'version' WHEN c.units <> g.units THEN 'units' WHEN NOT sig_ok THEN 'signature' WHEN NOT (step > 0 AND max_error > 0 AND max_error < step / 2) THEN 'step' END AS reason
  FROM c LEFT JOIN g USING (grid, variable))
SELECT coalesce(reason, 'bound') AS verdict, count(*) AS contracts FROM r GROUP BY 1""")
def contract_verdicts(spark, d):
    """Contracts against the table of grids: version, variable, units, signature, step."""
    part = spark.read.parquet(f"{d}/part.parquet")
    size = F.col("p_size").cast("double")
    contracts = part.select(F.concat(F.lit("grid"), F.col("p_size") % 4).alias("grid"), F.col("p_brand").alias("variable"), (F.col("p_size") % 3).alias("version"), F.when(F.col("p_partkey") % 11 == 0, "mm").otherwise("K").alias("units"), (F.col("p_partkey") % 13 != 0).alias("sig_ok"), (size / 100).alias("step"), F.when(F.col("p_partkey") % 7 == 0, size / 100).otherwise(size / 250).alias("max_error"))
    names = F.explode(F.array(*[F.lit(f"grid{k}") for k in range(3)])).alias("grid")
    grids = part.select(F.col("p_brand").alias("variable")).distinct().select("variable", names, F.lit(1).alias("version"), F.lit("K").alias("units"))
    return identity.bound_contracts(contracts, grids).groupBy(F.coalesce("reason", F.lit("bound")).alias("verdict")).agg(F.count("*").alias("contracts"))


@query("""
WITH c AS (SELECT DISTINCT 'grid' || s_nationkey % 4 AS grid, 'v' || s_nationkey AS variable, s_nationkey * 10 AS origin FROM supplier)
SELECT grid, '[' || string_agg('{"variable":"' || variable || '","origin":' || origin || '}', ',' ORDER BY variable) || ']' AS document FROM c GROUP BY grid""")
def contract_documents(spark, d):
    """The contracts of each grid as one JSON document."""
    c = spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("grid"), F.col("s_nationkey") % 4).alias("grid"), F.concat(F.lit("v"), "s_nationkey").alias("variable"), (F.col("s_nationkey") * 10).alias("origin")).distinct()
    return identity.export_contracts(c)


@query(with_(REPLICAS) + """,
s AS (SELECT DISTINCT var, layout, c, g FROM replicas WHERE holder IN ('A', 'B')),
t AS (SELECT DISTINCT var, g, g * 3600 AS canonical FROM replicas WHERE holder = 'C')
SELECT s.var, layout, c, count(*) AS samples, count(*) FILTER (canonical IS NULL) AS missing, min(canonical) AS first FROM s LEFT JOIN t USING (var, g) GROUP BY 1, 2, 3""")
def time_catalogue(spark, d):
    """Canonical times of the samples of each chunk; missing keys are told."""
    rows = catalog.with_chunks(_replicas(spark, d))
    samples = rows.where("holder in ('A', 'B')").select("var", "layout", "c", "g").distinct()
    times = rows.where("holder = 'C'").select("var", "g", (F.col("g") * 3600).alias("canonical")).distinct()
    return identity.catalogued(samples, times, ["var"], "g").groupBy("var", "layout", "c").agg(F.count("*").alias("samples"), F.sum(F.col("missing").cast("long")).alias("missing"), F.min("canonical").alias("first"))


@query("""
WITH n AS (SELECT CASE WHEN p_partkey % 6 = 0 THEN p_brand || '#p5x3o0r' || p_size % 3 WHEN p_partkey % 6 = 1 THEN p_brand || '#v5x3o0r0' ELSE p_brand || '#' || p_size END AS name FROM part)
SELECT name, count(*) AS n FROM n WHERE NOT regexp_matches(name, '#[pv]') GROUP BY name""")
def data_variables(spark, d):
    """Variables without parity and value-parity names."""
    k = F.col("p_partkey") % 6
    name = F.when(k == 0, F.concat("p_brand", F.lit("#p5x3o0r"), F.col("p_size") % 3)).when(k == 1, F.concat("p_brand", F.lit("#v5x3o0r0"))).otherwise(F.concat("p_brand", F.lit("#"), "p_size"))
    return spark.read.parquet(f"{d}/part.parquet").select(name.alias("name")).where(catalog.data_variable("name")).groupBy("name").agg(F.count("*").alias("n"))


@query(with_(CHUNKS) + """,
k AS (SELECT var, c, t, row_number() OVER (ORDER BY var, c, t) - 1 AS i, count(*) OVER () AS n FROM chunks WHERE holder = 'A'),
s AS (SELECT *, i % CAST(ceil(n / 5::DOUBLE) AS BIGINT) AS stripe FROM k),
m AS (SELECT stripe, count(*) AS members, count(*) FILTER (NOT EXISTS (SELECT 1 FROM chunks h WHERE h.holder = 'C' AND h.var = s.var AND h.c = s.c // 7 AND h.t = s.t AND h.g0 <= s.c * 24)) AS lost FROM s GROUP BY stripe)
SELECT stripe, members, lost, 1 + stripe % 2 AS rows, lost <= 1 + stripe % 2 AS restorable FROM m""")
def stripe_members(spark, d):
    """Parity stripes joined with the members that are still held, and whether their rows can restore the rest."""
    chunks = _chunks(spark, d)
    striped = parity.stripes(catalog.numbered(chunks.where("holder = 'A'").select("var", "c", "t"), "var", ["c", "t"], "i"), 5, "i").withColumn("week", grid.floor_div(F.col("c"), 7))
    held = chunks.where("holder = 'C'").select("var", F.col("c").alias("week"), "t", F.col("g0").alias("from"))
    have = striped.join(held, ["var", "week", "t"], "left").withColumn("lost", F.coalesce(F.col("from") > F.col("c") * 24, F.lit(True)).cast("long"))
    out = have.groupBy("stripe").agg(F.count("*").alias("members"), F.sum("lost").alias("lost")).withColumn("rows", F.pmod("stripe", F.lit(2)) + 1)
    return out.withColumn("restorable", F.col("lost") <= F.col("rows"))


@query(with_(CELLS) + """,
k AS (SELECT var, CAST(floor(g / 48::DOUBLE) AS BIGINT) AS c, x // 4 AS t, string_agg(g || ':' || x || ':' || cents, ',' ORDER BY g, x) AS body FROM cells, g0 WHERE g < g0 + 480 GROUP BY 1, 2, 3)
SELECT var, c, CAST(t AS INTEGER) AS t, md5(body) AS hash FROM k""")
def value_parity(spark, d):
    """Parity over values in a layout of their own: chunks of another layout restore what the parity rows lack, and ids check them."""
    def cut(holder):
        rows = _replicas(spark, d).where(F.col("holder") == holder).withColumns({"c": grid.floor_div(F.col("g"), 48), "t": grid.floor_div(F.col("x"), 4).cast("int")})
        line = F.transform(F.array_sort(F.collect_list(F.struct("g", "x", "cents"))), lambda p: F.concat_ws(":", p["g"], p["x"], p["cents"]))
        return rows.groupBy("var", "c", "t").agg(F.array_join(line, ",").alias("body"))

    numbered = parity.stripes(catalog.numbered(cut("A"), "var", ["c", "t"], "i"), 5, "i")
    members = numbered.select("stripe", F.col("member").cast("int").alias("member"), F.encode("body", "UTF-8").alias("payload"))
    rows = parity.encode_stripes(members, 0, 1)
    left = members.where(F.pmod(F.col("member") + F.col("stripe"), F.lit(5)) > 1)
    back = parity.restore_stripes(left, rows, members.select("stripe", "member", F.length("payload").alias("size")), 5)
    named = numbered.select("stripe", F.col("member").cast("int").alias("member"), "var", "c", "t", F.md5(F.encode("body", "UTF-8")).alias("vcid"))
    return named.join(back, ["stripe", "member"]).where(F.md5("payload") == F.col("vcid")).select("var", "c", "t", F.md5("payload").alias("hash"))


@query(with_(CHUNKS) + """
SELECT var, count(DISTINCT c || '/' || t || '/' || vcid) AS by_value, count(DISTINCT layout || '/' || CAST(holder IN ('A', 'D') AS VARCHAR) || '/' || c || '/' || t || '/' || vcid) AS by_bytes FROM chunks GROUP BY var""")
def identity_ablation(spark, d):
    """Chunk identities by value, and with the encoding as a part of them."""
    place = [F.col("c").cast("string"), F.col("t").cast("string"), F.col("vcid")]
    encoding = [F.col("layout"), F.col("holder").isin("A", "D").cast("string")]
    return _chunks(spark, d).groupBy("var").agg(F.countDistinct(F.concat_ws("/", *place)).alias("by_value"), F.countDistinct(F.concat_ws("/", *encoding, *place)).alias("by_bytes"))


@query("""
WITH j AS (SELECT o_custkey % 60 AS job, CAST(round(sum(o_totalprice)) AS BIGINT) AS total, count(*) FILTER (o_orderstatus = 'P') AS waiting FROM orders GROUP BY 1)
SELECT job, total, CASE WHEN waiting > 8 THEN 'stalled' WHEN waiting > 0 THEN 'partial' ELSE 'done' END AS state,
  row_number() OVER (ORDER BY CASE WHEN waiting > 8 THEN 0 WHEN waiting > 0 THEN 1 ELSE 2 END, total DESC, job) AS place FROM j ORDER BY place LIMIT 25""")
def job_order(spark, d):
    """Jobs as they are shown: stalled first, then partial, then done, largest first (a top-k report)."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    j = o.groupBy((F.col("o_custkey") % 60).alias("job")).agg(F.round(F.sum("o_totalprice")).cast("long").alias("total"), F.sum((F.col("o_orderstatus") == "P").cast("int")).alias("waiting"))
    rank = F.when(F.col("waiting") > 8, 0).when(F.col("waiting") > 0, 1).otherwise(2)
    top = j.select("job", "total", rank.alias("_r")).orderBy("_r", F.desc("total"), "job").limit(25)
    shown = top.agg(F.array_sort(F.collect_list(F.struct("_r", (-F.col("total")).alias("n"), "job", "total"))).alias("s")).select(F.posexplode("s").alias("p", "x"))
    state = F.element_at(F.array(F.lit("stalled"), F.lit("partial"), F.lit("done")), F.col("x._r") + 1)
    return shown.select("x.job", "x.total", state.alias("state"), (F.col("p") + 1).cast("long").alias("place"))


@query("""
WITH f AS (SELECT DISTINCT event_type AS var, user_id, user_id % 4 AS layout, 'f' || user_id % 6 AS fid, user_id % 17 = 3 AS own FROM events),
v AS (SELECT var, layout, fid, count(*) AS votes, max(CAST(own AS INTEGER)) AS own FROM f GROUP BY 1, 2, 3),
a AS (SELECT *, row_number() OVER (PARTITION BY var, layout ORDER BY own DESC, votes DESC, fid) AS k, count(*) OVER (PARTITION BY var, layout) AS "values" FROM v)
SELECT var, CAST(layout AS VARCHAR) AS layout, fid, votes, "values" FROM a WHERE k = 1""")
def layout_vote(spark, d):
    """The encoding of each layout: the own one, else the most common, ties by name."""
    u = F.col("user_id")
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("var"), (u % 4).cast("string").alias("layout"), F.concat(F.lit("f"), u % 6).alias("fid"), (u % 17 == 3).alias("own"), u).distinct()
    return merge.majority(rows, ["var", "layout"], "fid", own="own")


@query("""
WITH f AS (SELECT DISTINCT event_type AS var, user_id, CASE WHEN user_id % 2 = 0 THEN 2 ELSE 3 END AS format FROM events),
v AS (SELECT var, format, count(*) AS votes FROM f GROUP BY 1, 2),
a AS (SELECT *, row_number() OVER (PARTITION BY var ORDER BY votes DESC, format DESC) AS k, count(*) OVER (PARTITION BY var) AS "values" FROM v)
SELECT var, format, votes, "values" FROM a WHERE k = 1""")
def format_vote(spark, d):
    """The store format of most holders; a tie goes to version 3."""
    rows = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("var"), "user_id", F.when(F.col("user_id") % 2 == 0, 2).otherwise(3).alias("format")).distinct()
    return merge.majority(rows, ["var"], "format", last_wins=True)


@query("""
WITH h AS (SELECT s_suppkey AS holder, n_regionkey AS region, greatest(s_acctbal, 1.0) AS rate, CASE WHEN s_suppkey % 3 = 0 THEN n_regionkey END AS relay FROM supplier JOIN nation ON s_nationkey = n_nationkey),
a AS (SELECT relay, sum(rate) AS asked, 2000.0 * (relay + 1) AS capacity FROM h WHERE relay IS NOT NULL GROUP BY relay)
SELECT holder, round(rate * coalesce(least(1.0, capacity / asked), 1.0), 6) AS capped FROM h LEFT JOIN a USING (relay)""")
def relay_rates(spark, d):
    """Holders behind a relay share its capacity."""
    h = catalog.holders(spark, d).withColumn("relay", F.when(F.col("holder") % 3 == 0, F.col("region")))
    relays = h.select("relay", ((F.col("relay") + 1) * 2000.0).alias("capacity")).where("relay is not null").distinct()
    return catalog.relayed_rates(h.select("holder", "relay", "rate"), relays).select("holder", F.round("capped", 6).alias("capped"))


@query("""
WITH m AS (SELECT s_suppkey AS node, s_nationkey % 5 AS grid, s_suppkey % 7 <> 0 AS sig_ok, CAST(greatest(s_acctbal, 0) AS BIGINT) AS size FROM supplier)
SELECT CASE WHEN NOT sig_ok THEN 'signature' WHEN size > 8000 THEN 'size' WHEN grid > 3 THEN 'grid' ELSE 'accepted' END AS verdict, count(*) AS n FROM m GROUP BY 1""")
def manifest_verdicts(spark, d):
    """Manifests by signature, size bound and grid."""
    m = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("node"), (F.col("s_nationkey") % 5).cast("long").alias("grid"), (F.col("s_suppkey") % 7 != 0).alias("sig_ok"), F.floor(F.greatest("s_acctbal", F.lit(0))).alias("size"))
    out = catalog.accepted_manifests(m, spark.range(4).select(F.col("id").alias("grid")), 8000)
    return out.groupBy(F.coalesce("reason", F.lit("accepted")).alias("verdict")).agg(F.count("*").alias("n"))


@query("""
WITH b AS (SELECT sha256(CASE WHEN p_partkey % 19 = 0 THEN 'false' ELSE p_type END) AS cid, p_type AS payload FROM part)
SELECT payload AS kind, count(DISTINCT cid) FILTER (cid = sha256(payload)) AS stored, count(*) FILTER (cid <> sha256(payload)) AS rejected FROM b GROUP BY 1""")
def blob_store(spark, d):
    """Blobs under the hash of their content, each once; false ones are rejected."""
    b = spark.read.parquet(f"{d}/part.parquet").select(F.sha2(F.when(F.col("p_partkey") % 19 == 0, "false").otherwise(F.col("p_type")), 256).alias("cid"), F.col("p_type").alias("payload"))
    good, bad = catalog.stored_blobs(b)
    kinds = good.select(F.col("payload").alias("kind"), F.lit(1).alias("stored"), F.lit(0).alias("rejected")).unionByName(bad.select(F.col("payload").alias("kind"), F.lit(0).alias("stored"), F.lit(1).alias("rejected")))
    return kinds.groupBy("kind").agg(F.sum("stored").alias("stored"), F.sum("rejected").alias("rejected"))


@query(with_(CHUNKS) + """
SELECT a.var, count(*) AS chunks, count(*) FILTER (d.vcid = a.vcid AND d.nvalid = a.nvalid AND d.layout = a.layout) AS usable FROM chunks a LEFT JOIN chunks d ON d.holder = 'D' AND d.var = a.var AND d.c = a.c AND d.t = a.t
WHERE a.holder = 'A' GROUP BY a.var""")
def family_fit(spark, d):
    """Local chunks that fit a family: layout, valid samples and value id all agree."""
    keys, chunks = ["var", "layout", "c", "t", "nvalid", "vcid"], _chunks(spark, d)
    local = chunks.where("holder = 'D'").select(*keys).withColumn("_l", F.lit(1))
    return chunks.where("holder = 'A'").join(local, keys, "left").groupBy("var").agg(F.count("*").alias("chunks"), F.count("_l").alias("usable"))
