"""Benchmark decontamination: SimHash of item-sized windows, exact check of the candidates.

All native DataFrame operations.  Words are runs of letters and digits in lower
case, shingles are ``WIDTH`` words (an item of fewer words is one shingle), a
window of an item has as many shingles as the item.  A window leaks an item if
the weighted Jaccard similarity of their shingles, each weighted by its number of
repeats, is at least ``ALIKE``.

1. Shingles of the texts meet the benchmark's shingles in an equi-join.  Similarity
   ALIKE needs ALIKE / (1 + ALIKE) of the shingles of item and window together, so only
   windows that hold so many hits for an item can leak it, and other documents are let go.
2. Each such window gets its SimHash.  Counters of sixteen bits, four to a long, add up
   the bits of the shingle hashes; windows of over 65,535 shingles take counters of 32 bits.
3. Multi-index Hamming: fingerprints are cut into ``BLOCKS`` blocks; fingerprints
   within ``RADIUS`` differ in at most RADIUS / BLOCKS bits in one of them, so
   items are listed under all block values that near, and windows meet them by equality.
   No fingerprint within the radius is missed.
4. Candidates within the radius are compared shingle by shingle.

Scale.  Only hits are shuffled, by document and item; texts join them once.  The
item tables are broadcast while the benchmark has at most ``SMALL`` shingles, and
joined by shuffle beyond that.

Cases.  Null and empty texts and items have no shingle and leak nothing; a document
shorter than an item is one window; very long texts are read whole; the windows that an item of m
shingles needs in a text that leaks it grow with m, so long items cost the square of their length; equal rows and items each get their rows, also texts that share a null doc_id;
a null doc_id or item_id stays null in the result; columns other than doc_id and text
are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Work, named_rows

WIDTH, ALIKE, RADIUS, BLOCKS, SMALL = 5, 0.8, 20, 7, 200_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(w: Column, width: int) -> Column:
    """Hashes of the width-word shingles in order; none if there are fewer words."""
    last = F.size(w) - width + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, width)))).otherwise(F.array().cast("array<long>"))


def _lanes(hashes: Column, width: int) -> Column:
    """SimHash of hashes with counters of width bits in longs: lane k of counter j counts bit width * k + j."""
    shift = lambda name, x, n: F.call_function(name, x, n)
    zero = F.array_repeat(F.lit(0).cast("long"), width)
    counters = F.sequence(F.lit(0), F.lit(width - 1))
    low = F.lit(sum(1 << width * k for k in range(64 // width)))
    sums = F.aggregate(hashes, zero, lambda acc, h: F.zip_with(acc, counters, lambda a, j: a + shift("shiftrightunsigned", h, j).bitwiseAND(low)))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")

    def bits(s: Column) -> Column:
        count = lambda b: shift("shiftrightunsigned", s[b % width], b - b % width).bitwiseAND(F.lit((1 << width) - 1))
        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), none, lambda acc, b: acc.bitwiseOR(F.when(count(b) * 2 > F.size(hashes), shift("shiftleft", one, b)).otherwise(none)))

    return F.transform(F.array(sums), bits)[0]


def simhash(hashes: Column) -> Column:
    """Bit b of the result is 1 if more than half of the hashes have it."""
    return F.when(F.size(hashes) < 1 << 16, _lanes(hashes, 16)).otherwise(_lanes(hashes, 32))


def _blocks() -> list[tuple[int, int]]:
    """(first bit, width) of each block."""
    cuts = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def block_values(fp: Column) -> Column:
    """(block, value) of the fingerprint's blocks."""
    return F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1)).cast("int").alias("value")) for k, (first, width) in enumerate(_blocks())])


def flips(spark: SparkSession) -> DataFrame:
    """(block, flip): the changes of RADIUS / BLOCKS bits or fewer in each block; a fixed table."""
    rows = [(k, sum(1 << b for b in c)) for k, (_, width) in enumerate(_blocks()) for r in range(RADIUS // BLOCKS + 1) for c in combinations(range(width), r)]
    return spark.createDataFrame(rows, "block int, flip int")


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two lists of shingles: both sorted together, and a fold over runs of equal ones."""
    side = lambda x, k: F.transform(x, lambda h: F.struct(h.alias("h"), F.lit(k).alias("k")))
    state = "struct<h:bigint,a:int,b:int,both:int>"
    none = F.struct(F.lit(None).cast("long").alias("h"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("both")).cast(state)

    def step(acc: Column, x: Column) -> Column:
        same = acc["h"].eqNullSafe(x["h"])
        n_a, n_b = (F.when(same, acc[c]).otherwise(F.lit(0)) + (x["k"] == k).cast("int") for c, k in (("a", 0), ("b", 1)))
        more = F.when(same, F.least(n_a, n_b) - F.least(acc["a"], acc["b"])).otherwise(F.lit(0))
        return F.struct(x["h"].alias("h"), n_a.alias("a"), n_b.alias("b"), (acc["both"] + more).alias("both")).cast(state)

    both = F.aggregate(F.array_sort(F.concat(side(a, 0), side(b, 1))), none, step, lambda acc: acc["both"])
    return both / (F.size(a) + F.size(b) - both)


def starts(places: Column, need: Column, m: Column, last: Column) -> Column:
    """Starts, up to last, of the windows of m shingles that hold ``need`` of the places or more."""
    p = F.array_sort(places)
    first = F.sequence(F.lit(1), F.greatest(F.size(p) - need + 1, F.lit(1)))

    def around(i: Column) -> Column:
        """Starts of the windows that hold places i to i + need - 1."""
        a, b = F.element_at(p, i), F.element_at(p, F.least(i + need - 1, F.size(p)).cast("int"))
        lo, hi = F.greatest(b - m + 1, F.lit(0)), F.least(a, last)
        return F.when((F.size(p) >= need) & (lo <= hi), F.sequence(lo, F.greatest(lo, hi))).otherwise(F.array().cast("array<int>"))

    return F.array_distinct(F.flatten(F.transform(first, around)))


def _items(benchmark: DataFrame) -> DataFrame:
    """item, item_id, width, m (shingles), hashes, fp of each item that has words; item numbers the rows."""
    w = words(F.col("text"))
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), w.alias("w")).where(F.size("w") > 0)
    rows = rows.select(F.monotonically_increasing_id().alias("item"), "item_id", F.least(F.size("w"), F.lit(WIDTH)).alias("width"), "w")
    hashes = F.coalesce(*[F.when(F.col("width") == k, shingles(F.col("w"), k)) for k in range(1, WIDTH + 1)])
    rows = rows.select("item", "item_id", "width", hashes.alias("hashes"))
    return rows.select("*", F.size("hashes").alias("m"), simhash(F.col("hashes")).alias("fp"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start (shingle at which the best window starts), similarity, hamming: a row for each document and item it leaks."""
    work = Work(docs.sparkSession, "leaks")
    items = work.save(_items(benchmark), "items")
    # at most five widths
    widths = [r[0] for r in items.select("width").distinct().orderBy("width").collect()]
    n = items.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    small = (lambda df: F.broadcast(df)) if n <= SMALL else (lambda df: df)
    wanted = items.select("item", "width", "m", F.explode(F.array_distinct("hashes")).alias("hash"))

    rows = named_rows(docs.select("doc_id", "text"), work)
    key = ["_llm_id", "_llm_tk"]
    lists = F.array(*[F.struct(F.lit(k).alias("width"), shingles(F.col("w"), k).alias("hashes")) for k in widths or [WIDTH]])
    told = rows.select(*key, words(F.col("text")).alias("w")).select(*key, F.explode(lists).alias("x"))
    said = told.select(*key, F.col("x.width").alias("width"), F.size("x.hashes").alias("n"), F.posexplode("x.hashes").alias("pos", "hash"))
    hits = said.join(small(wanted), ["width", "hash"]).groupBy(*key, "item", "width", "m").agg(F.collect_set("pos").alias("places"), F.min("n").alias("n"))
    # a text shorter than the item is one window of n shingles
    need = F.ceil(ALIKE / (1 + ALIKE) * (F.col("m") + F.least("m", "n")) - 1e-9).cast("int")
    begun = hits.where(F.size("places") >= need).select(*key, "width", "m", starts(F.col("places"), need, F.col("m"), F.greatest(F.col("n") - F.col("m"), F.lit(0))).alias("starts"))
    near = begun.where(F.size("starts") > 0).groupBy(*key, "width", "m").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))
    near = work.save(near, "near")

    texts = rows.dropDuplicates(key).select(*key, words(F.col("text")).alias("w"))
    whole = F.coalesce(*[F.when(F.col("width") == k, shingles(F.col("w"), k)) for k in widths or [WIDTH]])
    pairs = near.join(texts, key).select(*key, "width", "m", "starts", whole.alias("all"))
    # the windows are cut before the explode, so that no row carries the whole text
    cuts = F.transform("starts", lambda s: F.struct(s.alias("start"), F.slice("all", s + 1, F.col("m")).alias("window")))
    windows = pairs.select(*key, "width", "m", F.explode(cuts).alias("x")).select(*key, "width", "m", "x.start", "x.window")
    windows = work.save(windows.select("*", simhash(F.col("window")).alias("fp")), "windows")

    blocks = items.select("item", "width", "m", F.col("fp").alias("item_fp"), F.explode(block_values(F.col("fp"))).alias("b")).select("item", "width", "m", "item_fp", "b.block", "b.value")
    listed = blocks.join(F.broadcast(flips(work.spark)), "block").select("item", "width", "m", "item_fp", "block", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
    probes = windows.select(*key, "width", "m", "start", "fp", F.explode(block_values(F.col("fp"))).alias("b")).select(*key, "width", "m", "start", "fp", "b.block", "b.value")
    hamming = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    met = probes.join(small(listed), ["width", "m", "block", "value"]).select(*key, "start", "item", "width", "m", hamming.alias("hamming")).where(F.col("hamming") <= RADIUS).distinct()
    checked = met.join(windows.select(*key, "width", "m", "start", "window"), [*key, "width", "m", "start"]).join(small(items.select("item", "item_id", "hashes")), "item")
    alike = checked.select(*key, "item", "item_id", "start", "hamming", similarity(F.col("hashes"), F.col("window")).alias("similarity")).where(F.col("similarity") >= ALIKE)
    best = alike.groupBy(*key, "item", "item_id").agg(F.max(F.struct("similarity", (-F.col("hamming")).alias("h"), (-F.col("start")).alias("s"))).alias("x"))
    best = work.save(best.select(*key, "item_id", (-F.col("x.s")).alias("start"), "x.similarity", (-F.col("x.h")).alias("hamming")), "best")
    return rows.select("doc_id", *key).join(best, key).select(F.col("doc_id").cast("long").alias("doc_id"), "item_id", "start", "similarity", "hamming")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that leak no item; rows without an id stay."""
    bad = leaks(docs, benchmark).where("doc_id is not null").select(F.col("doc_id").alias("id")).distinct()
    # in a struct no other column can clash with a name used here
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(bad, "id", "left_anti").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
