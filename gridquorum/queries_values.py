"""Queries over values: approximate means, identity, contracts, parity, covers and plans."""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import grid
from .operators import aqp, catalog, identity, merge, parity
from .plans import planner
from .queries_cells import _merged, _replicas
from .registry import query
from .sqltext import CELLS, CHUNKS, UNION, VOTE, with_

_STATS = with_(UNION) + """,
stats AS (SELECT var, CAST(floor(g / 12::DOUBLE) AS BIGINT) AS c, CAST(sum(cents) AS BIGINT) AS s, count(*) AS n FROM merged GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY var ORDER BY c) - 1 AS i, greatest(length(bin(count(*) OVER (PARTITION BY var) - 1)), 1) AS bits FROM stats),
spread AS (SELECT *, list_sum(list_transform(range(0, bits), lambda b: ((i >> b) & 1) << (bits - 1 - b))) AS vdc FROM placed),
vdc AS (SELECT *, row_number() OVER (PARTITION BY var ORDER BY vdc) AS pos FROM spread)"""


def _stats(spark, d):
    return _merged(spark, d).groupBy("var", grid.floor_div(F.col("g"), 12).alias("c")).agg(F.sum("cents").alias("s"), F.count("*").alias("n"))


@query(_STATS + " SELECT var, c, CAST(vdc AS BIGINT) AS vdc, pos FROM vdc")
def vdc_order(spark, d):
    """Chunks in bit-reversed order."""
    return aqp.van_der_corput(_stats(spark, d), ["var"], ["c"]).select("var", "c", "vdc", F.col("pos").cast("long").alias("pos"))


_T = "(1.96 + (1.96**3 + 1.96) / 4 / v + (5 * 1.96**5 + 16 * 1.96**3 + 3 * 1.96) / 96 / v**2 + (3 * 1.96**7 + 19 * 1.96**5 + 17 * 1.96**3 - 15 * 1.96) / 384 / v**3)"


_PREFIXES = _STATS + """,
m AS (
  SELECT var, pos, count(*) OVER (PARTITION BY var) AS "of", sum(s::DOUBLE) OVER w AS y, sum(n::DOUBLE) OVER w AS x, sum(s::DOUBLE * s) OVER w AS yy, sum(s::DOUBLE * n) OVER w AS xy, sum(n::DOUBLE * n) OVER w AS xx
  FROM vdc WINDOW w AS (PARTITION BY var ORDER BY pos ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, y / x AS mean, greatest(yy - 2 * (y / x) * xy + (y / x) * (y / x) * xx, 0) / (pos - 1) AS spread, greatest(pos - 1, 1)::DOUBLE AS v FROM m),
h AS (SELECT *, """ + _T + """ * sqrt(greatest(1 - pos / "of"::DOUBLE, 0) * spread / (pos * (x / pos) ** 2)) AS half FROM r)"""


@query(_PREFIXES + """
SELECT var, pos, round(mean, 6) AS mean, CASE WHEN pos > 1 THEN round(half, 6) END AS half FROM h""")
def ratio_mean(spark, d):
    """Ratio estimate and half-width over every prefix."""
    out = aqp.ratio_prefixes(aqp.van_der_corput(_stats(spark, d), ["var"], ["c"]), ["var"])
    return out.select("var", F.col("pos").cast("long").alias("pos"), F.round("mean", 6).alias("mean"), F.round("half", 6).alias("half"))


@query(_PREFIXES + """,
stops AS (SELECT *, row_number() OVER (PARTITION BY var ORDER BY pos) AS k FROM h WHERE (pos >= 8 AND half <= 0.05 * abs(mean)) OR pos = "of")
SELECT var, round(mean, 6) AS mean, CASE WHEN pos > 1 THEN round(half, 6) END AS ci95, pos AS chunks, "of", pos = "of" AS exact FROM stops WHERE k = 1""")
def progressive_mean(spark, d):
    """First prefix of eight chunks or more within five per cent."""
    out = aqp.progressive_mean(_stats(spark, d), ["var"], ["c"], rel_err=0.05)
    return out.select("var", F.round("mean", 6).alias("mean"), F.round("ci95", 6).alias("ci95"), F.col("chunks").cast("long").alias("chunks"), "of", "exact")


@query(_STATS + """,
st AS (SELECT var, c, s / n::DOUBLE AS mean, ntile(4) OVER (PARTITION BY var ORDER BY c) AS stratum FROM stats),
pick AS (SELECT *, row_number() OVER (PARTITION BY var, stratum ORDER BY (c * 7919) % 1009, c) AS turn FROM st),
hh AS (SELECT var, stratum, count(*) FILTER (turn <= 5) AS n, avg(mean) FILTER (turn <= 5) AS m, var_samp(mean) FILTER (turn <= 5) AS s2, count(*) AS size FROM pick GROUP BY 1, 2),
w AS (SELECT *, size / sum(size) OVER (PARTITION BY var)::DOUBLE AS wt FROM hh),
v AS (SELECT *, wt * wt * greatest(1 - n / size::DOUBLE, 0) * s2 / n AS va FROM w),
t AS (SELECT var, sum(wt * m) AS mean, sum(va) AS var_, greatest(CASE WHEN sum(va * va / (n - 1)) > 0 THEN sum(va) ** 2 / sum(va * va / (n - 1)) ELSE 1e9 END, 1) AS v, CAST(sum(n) AS BIGINT) AS chunks FROM v GROUP BY var)
SELECT var, round(mean, 6) AS mean, round(CASE WHEN v > 1e6 THEN 1.96 ELSE """ + _T + """ END * sqrt(var_), 6) AS half, chunks FROM t""")
def vas_pilot(spark, d):
    """Stratified mean of a pilot of five chunks a stratum."""
    means = _stats(spark, d).withColumn("mean", F.col("s") / F.col("n").cast("double"))
    dealt = aqp.strata_of(means, ["var"], ["c"], 4)
    turn = F.row_number().over(Window.partitionBy("var", "stratum").orderBy(F.col("c") * 7919 % 1009, "c"))
    sizes = dealt.groupBy("var", "stratum").agg(F.count("*").alias("size"))
    out = aqp.stratified(dealt.withColumn("turn", turn).where("turn <= 5"), sizes, ["var"])
    return out.select("var", F.round("mean", 6).alias("mean"), F.round("half", 6).alias("half"), "chunks")


@query()
def vas_mean(spark, d):
    """Q02, Q03: adaptive stratified mean of one variable."""
    means = _stats(spark, d).where("var = 'view'").select("c", (F.col("s") / F.col("n")).alias("mean"))
    r = aqp.mean_vas(means, ["c"], rel_err=0.05)
    return spark.createDataFrame([(r["mean"], r["ci95"], r["chunks"], r["of"], r["exact"])], "mean double, ci95 double, chunks long, of long, exact boolean")


@query(with_(CELLS) + """
SELECT var, g, x, CAST(round_even((cents / 100::DOUBLE - 0.0) / 0.25, 0) AS BIGINT) AS code,
  abs(cents / 100::DOUBLE - (0.0 + round_even((cents / 100::DOUBLE - 0.0) / 0.25, 0) * 0.25)) <= 0.1 AS accepted FROM cells""")
def contract_codes(spark, d):
    """Codes under a declared packing, and which values it accepts."""
    code, ok = identity.contract_codes("value", 0.0, 0.25, 0.1)
    return catalog.event_cells(spark, d).select("var", "g", "x", code.cast("long").alias("code"), ok.alias("accepted"))


@query(with_(CELLS) + """
SELECT var, CAST(floor(g / 24::DOUBLE) AS BIGINT) AS day, count(*) AS cells, sha256(string_agg(g || ':' || x || ':' || cents, ',' ORDER BY g, x)) AS vcid FROM cells GROUP BY 1, 2""")
def exact_identity(spark, d):
    """Exact value ids of days."""
    rows = catalog.event_cells(spark, d).withColumn("day", grid.floor_div(F.col("g"), 24))
    return identity.exact_id(rows, ["var", "day"], ["g", "x"], "cents")


@query(with_(CELLS) + """
SELECT CAST(floor(g / 240::DOUBLE) AS BIGINT) AS c, true AS same, false AS altered, false AS moved FROM cells WHERE var = 'view' GROUP BY 1""")
def lattice_identity(spark, d):
    """Ids of ten days in two encodings of the same codes agree; an altered cell and moved cells are told."""
    rows = catalog.event_cells(spark, d).withColumn("c", grid.floor_div(F.col("g"), 240)).where("var = 'view'")
    # few codes, so that neighbours stand next to each other
    level, first = F.pmod("cents", F.lit(40)) / 8.0 + 250.0, F.row_number().over(Window.partitionBy("c").orderBy("g", "x")) == 1
    rows = rows.withColumn("_first", first)
    copies = {"a": level, "b": level + 1e-7, "c": F.when(F.col("_first"), level + 1000).otherwise(level), "d": level + 1000}
    ids = {k: identity.lattice_ids(rows.withColumn("v", v), ["c"], "c", ["g", "x"], "v").alias(k) for k, v in copies.items()}
    out = ids["a"]
    for k in "bcd":
        out = out.join(ids[k], F.col("a.c") == F.col(f"{k}.c"))
    return out.select("a.c", *[identity.same_lattice("a", k).alias(name) for k, name in (("b", "same"), ("c", "altered"), ("d", "moved"))])


@query("""
SELECT p_partkey AS id, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_size * 0.01 + 3 END AS value FROM part""")
def packed_decode(spark, d):
    """1.2: CF packing, scale and offset with a fill value."""
    part = spark.read.parquet(f"{d}/part.parquet")
    stored = F.when(F.col("p_size") % 10 == 0, -32767).otherwise(F.col("p_size"))
    return part.select(F.col("p_partkey").alias("id"), (F.nullif(stored, F.lit(-32767)) * 0.01 + 3).alias("value"))


@query(with_(CHUNKS) + """,
k AS (SELECT var, c, t, n, row_number() OVER (ORDER BY var, c, t) - 1 AS i, count(*) OVER () AS total FROM chunks WHERE holder = 'A'),
s AS (SELECT *, CAST(ceil(total / 5::DOUBLE) AS BIGINT) AS dd FROM k)
SELECT var, c, i % dd AS stripe, CAST(floor(i / dd::DOUBLE) AS BIGINT) % 5 AS member FROM s""")
def stripe_map(spark, d):
    """Interleaved stripes of five members."""
    return _striped(spark, d).select("var", "c", "stripe", "member")


def _striped(spark, d):
    chunks = catalog.chunks(_replicas(spark, d)).where("holder = 'A'")
    return parity.stripes(catalog.numbered(chunks, "var", ["c", "t"], "i"), 5, "i")


@query(with_(CHUNKS) + """,
k AS (SELECT cents, row_number() OVER (ORDER BY var, c, t) - 1 AS i, count(*) OVER () AS total FROM chunks WHERE holder = 'A')
SELECT i % CAST(ceil(total / 5::DOUBLE) AS BIGINT) AS stripe, CAST(bit_xor(cents) AS BIGINT) AS parity, count(*) AS members FROM k GROUP BY 1""")
def xor_parity(spark, d):
    """Plain XOR parity of the stripes."""
    return parity.xor_stripes(_striped(spark, d), "cents")


@query("""
SELECT vec_id // 5 AS stripe, CAST(vec_id % 5 AS INTEGER) AS member, array_to_string(list_transform(embedding, lambda v: CAST(CAST(floor(v * 1000) AS BIGINT) AS VARCHAR)), ',') AS payload FROM embeddings""")
def gf_restore(spark, d):
    """Two members of each stripe are lost and come back from two parity rows."""
    text = F.array_join(F.transform("embedding", lambda v: F.floor(v.cast("double") * 1000).cast("string")), ",")
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(grid.floor_div(F.col("vec_id"), 5).alias("stripe"), (F.col("vec_id") % 5).cast("int").alias("member"), F.encode(text, "UTF-8").alias("payload"))
    rows_of_parity = parity.encode_stripes(rows, 0, 1)
    left = rows.where(F.pmod(F.col("member") - F.col("stripe"), F.lit(5)) > 1)
    back = parity.restore_stripes(left, rows_of_parity, rows.select("stripe", "member", F.length("payload").alias("size")), 5)
    return back.select("stripe", "member", F.decode("payload", "UTF-8").alias("payload"))


_PIECES = with_(CHUNKS) + VOTE.format(trust="CASE WHEN holder = 'A' THEN 1 ELSE 0 END") + """,
win AS (SELECT g0 + 120 AS lo, g0 + 360 AS hi FROM g0),
facts AS (
  SELECT k.var, k.layout, k.c, k.t, any_value(tile) AS tile, min(g0) AS a, max(g1) AS b, max(size) AS size FROM chunks k JOIN won w USING (var, layout, c, t, vcid), win
  WHERE w.status <> 'contested' GROUP BY 1, 2, 3, 4, lo, hi HAVING min(g0) < hi AND max(g1) > lo),
fam AS (SELECT var, max(a) AS a, min(b) AS b, sum(size) AS size FROM facts GROUP BY var, layout, c, tile HAVING count(*) = 8 // tile AND max(a) < min(b)),
f AS (SELECT var, greatest(a, lo) AS a, least(b, hi) AS b, size FROM fam, win),
ends AS (SELECT var, a AS g FROM f UNION SELECT var, b FROM f UNION SELECT var, lo FROM f, win UNION SELECT var, hi FROM f, win),
marks AS (SELECT var, g, row_number() OVER (PARTITION BY var ORDER BY g) - 1 AS i, lead(g) OVER (PARTITION BY var ORDER BY g) AS next FROM ends),
cut AS (SELECT f.var, x.i AS ia, y.i AS ib, size FROM f JOIN marks x ON x.var = f.var AND x.g = f.a JOIN marks y ON y.var = f.var AND y.g = f.b),
cell AS (
  SELECT m.var, m.i, ceil(next / 6::DOUBLE) - ceil(g / 6::DOUBLE) AS n, EXISTS (SELECT 1 FROM cut WHERE cut.var = m.var AND ia <= m.i AND ib > m.i) AS held
  FROM marks m WHERE next IS NOT NULL),
step AS (
  SELECT c.var, c.i + 1 AS i, NOT held OR n = 0 AS free, (SELECT list({'ia': ia, 'size': size}) FROM cut WHERE cut.var = c.var AND cut.ib = c.i + 1) AS ps FROM cell c),
path AS (
  SELECT var, CAST(0 AS BIGINT) AS i, [CAST(0 AS DOUBLE)] AS dist FROM marks WHERE i = 0
  UNION ALL
  SELECT s.var, s.i, list_append(p.dist, least(
    CASE WHEN s.free THEN p.dist[s.i] ELSE 1e300 END,
    coalesce(list_min(list_transform(s.ps, lambda q: q.size + list_min(p.dist[q.ia + 1 : s.i]))), 1e300)))
  FROM path p JOIN step s ON s.var = p.var AND s.i = p.i + 1),
least_bytes AS (SELECT var, CAST(arg_max(dist[len(dist)], i) AS BIGINT) AS bytes FROM path GROUP BY var),
covered AS (SELECT var, CAST(sum(n) FILTER (held) AS BIGINT) AS samples FROM cell GROUP BY var)"""
_PIECES = _PIECES.replace("WITH ", "WITH RECURSIVE ", 1)


def _families(spark, d):
    """Chunks that a ten-day request at six hours touches: window and winning values first, then holders of one value together."""
    cells = catalog.event_cells(spark, d)
    chunks = catalog.chunks(_replicas(spark, d))
    first = F.broadcast(cells.agg(F.min("g").alias("_g0")))
    keys = ["var", "layout", "c", "t", "vcid"]
    won = merge.vote(chunks, ["A"]).where("status <> 'contested'").select(*keys, "src")
    facts = chunks.groupBy(*keys).agg(F.min("tile").alias("tile"), F.min("g0").alias("g0"), F.max("g1").alias("g1"), F.max("size").alias("size"))
    near = facts.crossJoin(first).select("*", (F.col("_g0") + 120).alias("lo"), (F.col("_g0") + 360).alias("hi")).where("g0 < hi and g1 > lo")
    return near.join(won, keys).select("var", "layout", "c", "t", "tile", "g0", "g1", "size", "src", "lo", "hi")


def _cover(spark, d, choose, schema):
    """choose(families, lo, hi) by variable; only catalogue rows of the window reach the planner."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(pdf.itertuples(), key=lambda r: (r.layout, r.c, r.t))
        pieces = [(f"{r.layout}/{r.c}", planner.Piece(f"{r.layout}/{r.c}.{r.t}", int(r.g0), int(r.g1), float(r.size), tuple(r.src.split("+")))) for r in rows]
        needed = {f"{r.layout}/{r.c}": 8 // int(r.tile) for r in rows}
        lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
        found = choose(planner.families(pieces, needed), lo, hi)
        return pd.DataFrame({"var": [pdf["var"].iloc[0]]} | {k: [v] for k, v in found.items()})

    return _families(spark, d).groupBy("var").applyInPandas(one, f"var string, {schema}")


def _samples(cover, lo, hi):
    """Six-hourly samples of the request under a cover."""
    return len({g for f in cover for g in range(max(f.start, lo), min(f.end, hi)) if g % 6 == 0})


@query(_PIECES + " SELECT var, bytes, samples FROM least_bytes JOIN covered USING (var)")
def min_byte_cover(spark, d):
    """Fewest bytes that cover the request, and the samples they cover."""

    def choose(fams, lo, hi):
        cover = planner.cheapest_cover(fams, lo, hi, lambda f: f.size, 6)
        return {"bytes": int(sum(f.size for f in cover)), "samples": _samples(cover, lo, hi)}

    return _cover(spark, d, choose, "bytes long, samples long")


_RATES = {"A": 1e5, "B": 4e5, "C": 2e5, "D": 1e5}


@query(_PIECES + " SELECT var, bytes AS least_bytes, samples, true AS enough, true AS in_time FROM least_bytes JOIN covered USING (var)")
def joint_cover(spark, d):
    """Cover chosen with its makespan in view: as complete as the one of fewest bytes, no smaller, and no slower."""

    def choose(fams, lo, hi):
        least = planner.cheapest_cover(fams, lo, hi, lambda f: f.size, 6)
        cover, holder, seconds = planner.joint_plan(fams, lo, hi, _RATES, 6)
        extra = planner.OVERHEAD * sorted(_RATES.values())[len(_RATES) // 2]
        plain, _ = planner.assign([replace(p, size=p.size + extra) for f in least for p in f.tiles], _RATES, client=planner.RECEIVER)
        size = sum(f.size for f in least)
        return {"least_bytes": int(size), "samples": _samples(cover, lo, hi), "enough": sum(f.size for f in cover) >= size, "in_time": seconds <= (1 + planner.SLACK) * plain}

    return _cover(spark, d, choose, "least_bytes long, samples long, enough boolean, in_time boolean")


@query("""
WITH li AS (SELECT l_partkey AS chunk, list_sort(list(DISTINCT l_suppkey % 6)) AS holders, CAST(sum(l_quantity) AS DOUBLE) AS size FROM lineitem GROUP BY 1),
sets AS (SELECT list_filter(range(0, 6), lambda h: (m >> h) & 1 = 1) AS who FROM (SELECT unnest(range(1, 64)) AS m)),
q AS (SELECT who, coalesce((SELECT sum(size) FROM li WHERE list_has_all(who, holders)), 0) / list_sum(list_transform(who, lambda h: h + 1)) AS seconds FROM sets)
SELECT round(max(seconds), 4) AS planned, (SELECT count(*) FROM li) AS chunks, (SELECT round(sum(size), 4) FROM li) AS bytes, true AS kept FROM q""")
def makespan_plan(spark, d):
    """The least makespan of all chunks, and whether the chunks as dealt out keep to it.

    Chunks with the same holders are one group, so the flow runs on at most 2^6 rows; chunks
    of a group then go to its holders in proportion, by hash, without leaving Spark: a holder's
    load differs from its share by the chance of the deal, here by four deviations at most.
    """
    li = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_partkey").alias("chunk")).agg(F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey") % 6)), ",").alias("holders"), F.sum("l_quantity").alias("size"))
    groups = [(tuple(r[0].split(",")), float(r[1])) for r in li.groupBy("holders").agg(F.sum("size")).orderBy("holders").collect()]
    seconds, amounts = planner.split(groups, {str(h): float(h + 1) for h in range(6)})
    shares = []
    for g, (sig, total) in enumerate(groups):
        low = 0.0
        for h in sig:
            high = low + amounts.get((g, h), 0.0) / total
            shares.append((",".join(sig), h, low, 1.0 + 1e-9 if h == sig[-1] else high))
            low = high
    table = spark.createDataFrame(shares, "holders string, holder string, low double, high double")
    dice = F.crc32(F.col("chunk").cast("string")) / float(1 << 32)
    p = F.least("high", F.lit(1.0)) - F.col("low")
    dealt = li.withColumn("dice", dice).join(F.broadcast(table), "holders").withColumn("mine", (F.col("dice") >= F.col("low")) & (F.col("dice") < F.col("high")))
    loads = dealt.groupBy("holder").agg(
        F.sum(F.when(F.col("mine"), F.col("size")).otherwise(0)).alias("load"), F.sum(F.col("mine").cast("long")).alias("n"),
        F.sum(F.col("size") * p).alias("share"), F.sqrt(F.sum(F.col("size") * F.col("size") * p * (1 - p))).alias("deviation"),
    )
    kept = (F.col("share") <= float(seconds) * (F.col("holder").cast("int") + 1) * (1 + 1e-6)) & (F.abs(F.col("load") - F.col("share")) <= 4 * F.col("deviation") + 1e-6)
    return loads.agg(F.round(F.lit(float(seconds)), 4).alias("planned"), F.sum("n").alias("chunks"), F.round(F.sum("load"), 4).cast("double").alias("bytes"), F.bool_and(kept).alias("kept"))
