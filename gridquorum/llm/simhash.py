"""SimHash near-duplicates over a Gray-ordered hierarchical index.

Fingerprints.  A-Z is lower-cased, words are runs without ASCII white space, and
shingles of three words (repeats count) are hashed by XXH64 with seed 42; a bit is
1 if more than half of the hashes have it.

Index.  An index node is a bit mask and the pattern its fingerprints share under
it.  The four top masks are 16-bit blocks: two fingerprints that differ in at most
three bits agree on one of them.  A node of more than ``NODE`` fingerprints is
replaced by four below it, each with a quarter of the bits that were free added to
the mask; the same argument holds for them, so no link is lost, and once few bits
are free a node cannot be large.  Inside a node, fingerprints are sorted by Gray
rank and factored eight by eight into groups that keep their common bits as a
masked pattern; pairs of groups are followed downwards and dropped whole when the
differences under both masks exceed the radius.  A node answers with a
spanning star of each linked set, not with all pairs.

Scale.  Equal fingerprints are one index entry (a hash aggregate with map-side
combine), so a group of copies is one row however large it is.  Components are
found by alternating large and small stars on written tables.  All shingles are counted, in
compressed blobs; the ``COMMON`` most common at most are collected, for the order of the sets.

Near copies.  ``keep_first`` asks for a five-word Jaccard similarity of 0.8.  Fingerprints of
the shingle sets meet in the index above, and its links are checked on all shingles.  A near
copy is often more than three bits off, so texts that the index has not linked
meet on shingles too: sets are in one order, common shingles last, and of two near copies the first fifths
share a shingle.  A bucket of texts with such a shingle gives its pairs; one of more than ``CROWD``
gives the pairs with its smallest text.  A bit map of each set, in which each shingle flips a
bit, bounds from below in how many shingles a pair differs; pairs that differ in too many go.
Of the others, each text is compared with the smallest of its partners on all shingles,
then those pairs that are not linked to one text yet.  In buckets of more than CROWD that
still have several components, the bit maps of all members meet, in blocks of ``BLOCK``;
the members with a possible partner bring their shingles to the same blocks, which compare
pairs until their members are linked and return the links that join two components, not
the pairs.  So no link is lost, and copies, however many, cost a comparison each.

Cases.  Null and empty texts have fingerprint zero and link like any other; null
ids are ignored when the smallest id is chosen, and a component with null ids only
has a null id; equal rows stay and share their component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Work, arrow, exchange, mix, pack, partitions, run_starts, text_column, unpack

RADIUS, NODE, FAN = 3, 1024, 8
_FULL = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprint(raw: bytes, hash64, width: int) -> int:
    words = raw.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        hashes = [hash64(b" ".join(words), 42)]
    else:
        line = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes) - 1
        starts = (ends - sizes + 1)[: len(words) - width + 1].tolist()
        hashes = [hash64(line[s:e], 42) for s, e in zip(starts, ends[width - 1 :].tolist())]
    return majority(np.array(hashes, np.uint64))


def majority(h: np.ndarray) -> int:
    """The fingerprint of hashes: the bits that more than half of them have."""
    ones = np.zeros(64, np.int64)
    for s in range(0, len(h), 1 << 16):
        part = h[s : s + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) for each row of docs; fp is the fingerprint as a signed long."""

    def run(batches):
        import xxhash

        for batch in batches:
            offsets, data = text_column(batch.column("text"))
            view = memoryview(data)
            fps = [_fingerprint(bytes(view[s:e]), xxhash.xxh64_intdigest, width) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(arrow, run, "doc_id long, fp long")


def _below(mask: int) -> list[int]:
    """Masks of the four nodes below: the free bits in four parts, one added to each."""
    free = [b for b in range(63, -1, -1) if not mask >> b & 1]
    parts = [free[len(free) * i // (RADIUS + 1) : len(free) * (i + 1) // (RADIUS + 1)] for i in range(RADIUS + 1)]
    return [mask | sum(1 << b for b in part) for part in parts]


def _nodes(rows: DataFrame, masks: list[int]) -> DataFrame:
    """rows (tab, fp) under each mask: (tab, mask, pattern, fp)."""
    each = F.explode(F.array(*[F.lit(_signed(m)) for m in masks]))
    return rows.select("tab", "fp", each.alias("mask")).select(*NODE_KEY[:2], F.col("fp").bitwiseAND(F.col("mask")).alias("pattern"), "fp")


def gray_rank(x: np.ndarray) -> np.ndarray:
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def linked(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (i, j) of the fingerprints of one node, which are sorted by Gray rank."""
    levels = [(fps, np.full(len(fps), _FULL, np.uint64))]
    while len(levels[-1][0]) > FAN:
        pattern, mask = levels[-1]
        at = np.arange(0, len(pattern), FAN)
        common = np.bitwise_and.reduceat(mask, at)
        first = np.repeat(pattern[at], np.diff(np.append(at, len(pattern))))
        common &= ~np.bitwise_or.reduceat(pattern ^ first, at)
        levels.append((pattern[at] & common, common))
    top = len(levels[-1][0])
    a, b = np.triu_indices(top)
    while True:
        pattern, mask = levels.pop()
        near = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= RADIUS
        a, b = a[near], b[near]
        if not levels:
            break
        n = len(levels[-1][0])
        kids = np.arange(FAN)
        a, b = (np.repeat(a * FAN, FAN * FAN) + np.tile(np.repeat(kids, FAN), len(a))), (np.repeat(b * FAN, FAN * FAN) + np.tile(np.tile(kids, FAN), len(b)))
        fits = (a < n) & (b < n) & (a <= b)
        a, b = a[fits], b[fits]
    a, b = a[a < b], b[a < b]
    label = np.arange(len(fps))
    while len(a):
        before = label.copy()
        np.minimum.at(label, b, label[a])
        np.minimum.at(label, a, label[b])
        label = label[label]
        if np.array_equal(before, label):
            break
    other = np.flatnonzero(label != np.arange(len(fps)))
    return other, label[other]


def _search():
    """Links inside each node of a partition that is sorted by node."""

    def find(tab, mask, pattern, fp):
        order = np.lexsort((gray_rank(fp), pattern, mask, tab))
        tab, mask, pattern, fp = tab[order], mask[order], pattern[order], fp[order]
        starts = run_starts(tab, mask, pattern)
        sizes = np.diff(np.append(starts, len(fp)))
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        node = np.repeat(np.arange(len(starts)), sizes)
        small = np.repeat(sizes <= FAN, sizes)
        for step in range(1, min(FAN, len(fp))):
            i = np.flatnonzero(small[: len(fp) - step] & (node[: len(fp) - step] == node[step:]))
            i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= RADIUS]
            us.append(i)
            vs.append(i + step)
        for s, n in zip(starts[sizes > FAN].tolist(), sizes[sizes > FAN].tolist()):
            i, j = linked(fp[s : s + n])
            us.append(s + i)
            vs.append(s + j)
        i, j = np.concatenate(us), np.concatenate(vs)
        u, v = fp[i].view(np.int64), fp[j].view(np.int64)
        return pa.record_batch([pa.array(tab[i].astype(np.int32)), pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["tab", "u", "v"])

    def run(batches):
        rest = None
        for batch in batches:
            now = [batch.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in (*NODE_KEY, "fp")]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now)]
            starts = run_starts(*now[:3])
            cut = starts[-1] if len(starts) else 0
            if cut:
                yield find(*(x[:cut] for x in now))
            rest = [x[cut:] for x in now]
        if rest is not None and len(rest[0]):
            yield find(*rest)

    return run


NODE_KEY = ("tab", "mask", "pattern")


def links(fps: DataFrame, work: Work) -> DataFrame:
    """(tab, u, v), u > v, from fps (tab, fp): they connect what all links at RADIUS or fewer bits in one table connect."""
    n, masks = partitions(work.spark), _below(0)
    rows, found, depth = fps.select("tab", "fp"), [], 0
    while True:
        nodes = work.save(_nodes(rows, masks), f"nodes{depth}") if depth == 0 else rows
        wide = work.save(nodes.groupBy(*NODE_KEY).count().where(F.col("count") > NODE).select(*NODE_KEY), f"wide{depth}")
        none = wide.isEmpty()
        settled = nodes if none else nodes.join(wide, list(NODE_KEY), "left_anti")
        found.append(work.save(settled.repartition(n, *NODE_KEY).sortWithinPartitions(*NODE_KEY).transform(arrow, _search(), "tab int, u long, v long"), f"links{depth}"))
        if none:
            break
        # fixed size: at most 4 ** depth masks
        down = work.spark.createDataFrame([(_signed(m), [_signed(x) for x in _below(m)]) for m in masks], "mask long, lower array<long>")
        split = nodes.join(wide, list(NODE_KEY), "left_semi").join(F.broadcast(down), "mask").select("tab", "fp", F.explode("lower").alias("mask"))
        masks = [x for m in masks for x in _below(m)]
        depth += 1
        rows = work.save(split.select("tab", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("pattern"), "fp").distinct(), f"nodes{depth}")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return work.save(out.distinct(), "links")


def components(edges: DataFrame, work: Work, name: str = "") -> DataFrame:
    """(u, v): v is the smallest node of u's component, for each u that is not the smallest itself."""
    turn = 0

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    def star(e: DataFrame, large: bool, step: str) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = work.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}least{step}")
        near = both.join(least, "u")
        if large:
            out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return work.save(out.where("u <> v").distinct(), f"{name}stars{step}")

    now = state(edges)
    while now[0]:
        edges = star(star(edges, True, f"{turn}a"), False, f"{turn}b")
        before, now = now, state(edges)
        work.drop(*[f"{name}{x}" for x in (f"least{turn}a", f"stars{turn}a", f"least{turn}b", *([f"stars{turn - 1}b"] if turn else []))])
        turn += 1
        if before == now:
            break
    return edges


#: Most fingerprints, and least rows of one, whose components rows get by broadcast.
HOT, HOT_ROWS = 1000, 10_000


def grouped(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs."""
    work = Work(docs.sparkSession, "simhash")
    rows = work.save(fingerprints(docs, width), "rows")
    fps = work.save(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "fps")
    roots = components(links(fps.withColumn("tab", F.lit(0)), work).select("u", "v"), work)
    labelled = work.save(fps.join(roots.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")), "labelled")
    names = work.save(labelled.groupBy("root").agg(F.min("first").alias("component_id")), "names")
    named = work.save(labelled.join(names, "root").select("fp", "n", "component_id"), "named")
    # rows of the most common fingerprints, such as that of empty texts, do not meet in one task
    hot = work.save(named.where(F.col("n") >= HOT_ROWS).orderBy(F.desc("n"), "fp").limit(HOT).select("fp", F.struct("component_id").alias("hot")), "hot")
    told = rows.join(F.broadcast(hot), "fp", "left")
    rare = told.where("hot is null").select("doc_id", "fp").join(named.select("fp", "component_id"), "fp")
    return told.where("hot is not null").select("doc_id", "fp", "hot.component_id").unionByName(rare.select("doc_id", "fp", "component_id"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id for each row of docs."""
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near copies: words of a shingle, least similarity, most texts of a bucket whose pairs are written out, texts of a block.
WORDS, ALIKE, CROWD, BLOCK = 5, 0.8, 16, 4096
#: A common shingle is in OFTEN texts or more; at most COMMON of them are told apart; shingles counted at once; parts of a bucket.
OFTEN, COMMON, COUNTED, PARTS = 16, 500_000, 1 << 21, 16
#: Most ids of superfluous texts that rows get by broadcast.
GONE = 500_000
#: Bits of the map of a shingle set; most shingles of a block; buckets that a set knows itself to be in.
MAP, HELD, LOW = 2048, 1 << 22, 32


def _hashes(words: list[bytes], hash64, width: int) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    width = min(width, len(words))
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[: len(words) - width + 1].tolist()
    return np.array([hash64(line[s:e], 42) for s, e in zip(starts, ends[width - 1 :].tolist())], np.uint64)


def shingle_set(raw: bytes) -> tuple[int, np.ndarray]:
    """Name and sorted hashes of a text's shingle set; texts of one set share the name, and an empty set has that of its text."""
    import xxhash

    s = np.unique(mix(_hashes(raw.lower().split(), xxhash.xxh64_intdigest, WORDS)).view(np.int64))
    name = xxhash.xxh64_intdigest(s.tobytes(), 11) if len(s) else xxhash.xxh64_intdigest(raw, 7)
    return name - (1 << 64) if name >> 63 else name, s


def _texts(batch):
    offsets, data = text_column(batch.column("text"))
    view = memoryview(data)
    return (bytes(view[s:e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()))


def _key(shingles: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, part and 32 more bits of each shingle, under which it is counted; shingles that agree in them count as one, which only moves them in the order."""
    t = shingles.view(np.uint64)
    rest = t // np.uint64(buckets)
    return (t % np.uint64(buckets)).astype(np.int32), (rest % np.uint64(PARTS)).astype(np.int32), ((rest // np.uint64(PARTS)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _named(buckets: int):
    """(id, name, fp) of each text, and blobs of the shingles of about COUNTED with the number of texts that have them; fp is null for an empty set."""

    def blobs(held):
        found, n = np.unique(np.concatenate(held), return_counts=True)
        bucket, part, rest = _key(found, buckets)
        order = np.lexsort((rest, part, bucket))
        bucket, part, rest, n = bucket[order], part[order], rest[order], np.minimum(n[order], 0xFFFF).astype(np.uint16)
        first = run_starts(bucket, part)
        ends = np.append(first[1:], len(order))
        # sorted numbers are stored as their differences, which compress
        rows = [pack(step=np.diff(rest[a:b], prepend=np.uint32(0)), n=n[a:b]) for a, b in zip(first.tolist(), ends.tolist())]
        none = pa.nulls(len(rows), pa.int64())
        return pa.record_batch([none, none, none, pa.array(part[first]), pa.array(bucket[first]), pa.array(rows, pa.binary())], names=["id", "name", "fp", "kind", "bucket", "blob"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            names, fps = [], []
            for raw in _texts(batch):
                name, s = shingle_set(raw)
                names.append(name)
                fps.append(_signed(majority(s.view(np.uint64))) if len(s) else None)
                held.append(s)
                size += len(s)
                if size > COUNTED:
                    yield blobs(held)
                    held, size = [], 0
            none = pa.nulls(len(names), pa.int32())
            yield pa.record_batch([batch.column("id"), pa.array(names, pa.int64()), pa.array(fps, pa.int64()), none, none, pa.nulls(len(names), pa.binary())], names=["id", "name", "fp", "kind", "bucket", "blob"])
        if size:
            yield blobs(held)

    return run


def _often(buckets: int):
    """(key, n) of the shingles that OFTEN texts have, from the blobs of a partition that is sorted by part; bucket b is partition b."""

    def run(batches):
        from pyspark import TaskContext

        bucket, part, steps = TaskContext.get().partitionId(), None, []

        def counted():
            rest, n = (np.concatenate(x) for x in zip(*steps))
            order = np.argsort(rest, kind="stable")
            first = run_starts(rest[order])
            total = np.add.reduceat(n[order].astype(np.int64), first)
            many = total >= OFTEN
            key = (rest[order][first][many].astype(np.uint64) * np.uint64(PARTS) + np.uint64(part)) * np.uint64(buckets) + np.uint64(bucket)
            return pa.record_batch([pa.array(key.view(np.int64)), pa.array(total[many])], names=["key", "n"])

        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob")):
                if kind != part and steps:
                    yield counted()
                    steps = []
                part = kind
                x = unpack(blob.as_buffer())
                steps.append((np.cumsum(x["step"], dtype=np.uint32), x["n"]))
        if steps:
            yield counted()

    return run


def least_shared(n: np.ndarray | int):
    """Shingles that a set of n has at least in common with a near copy."""
    return np.ceil(ALIKE * n - 1e-9).astype(np.int64)


def _prefixes(common: np.ndarray, buckets: int):
    """(token, name, n): of each set the shingles of which a near copy has one, those with a key in the sorted array common last."""

    def run(batches):
        seen = set()
        for batch in batches:
            tokens, names, sizes = [np.zeros(0, np.int64)], [], []
            for raw in _texts(batch):
                name, s = shingle_set(raw)
                if name in seen or not len(s):
                    continue
                seen.add(name)
                if len(common):
                    bucket, part, rest = _key(s, buckets)
                    key = (rest.astype(np.uint64) * np.uint64(PARTS) + part.astype(np.uint64)) * np.uint64(buckets) + bucket.astype(np.uint64)
                    s = s[np.argsort(common[np.minimum(np.searchsorted(common, key), len(common) - 1)] == key, kind="stable")]
                tokens.append(s[: len(s) - int(least_shared(len(s))) + 1])
                names.append(name)
                sizes.append(len(s))
            counts = [len(x) for x in tokens[1:]]
            yield pa.record_batch([pa.array(np.concatenate(tokens)), pa.array(np.repeat(np.array(names, np.int64), counts)), pa.array(np.repeat(np.array(sizes, np.int32), counts))], names=["token", "name", "n"])

    return run


def _meet(token: np.ndarray, name: np.ndarray, n: np.ndarray):
    """(u, v, nu, nv, c): pairs of sets with c tokens in common; c = 0: token u is crowded and set v has it."""
    order = np.lexsort((name, token))
    at = order[run_starts(token[order], name[order])]
    token, name, n = token[at], name[at], n[at]
    starts = run_starts(token)
    sizes = np.diff(np.append(starts, len(token)))
    crowded = np.flatnonzero(np.repeat(sizes > CROWD, sizes))
    after = np.repeat(starts + sizes, sizes) - 1 - np.arange(len(token))
    i = np.flatnonzero((after > 0) & np.repeat(sizes <= CROWD, sizes))
    us, vs, step = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 1
    while len(i):
        fits = np.minimum(n[i], n[i + step]) >= least_shared(np.maximum(n[i], n[i + step]))
        us.append(i[fits])
        vs.append(i[fits] + step)
        step += 1
        i = i[after[i] >= step]
    v, u = np.concatenate(us), np.concatenate(vs)  # names rise within a bucket
    order = np.lexsort((name[v], name[u]))
    u, v = u[order], v[order]
    first = run_starts(name[u], name[v])
    count = np.diff(np.append(first, len(u)))
    u, v, none = u[first], v[first], np.zeros(len(crowded), np.int64)
    columns = ((name[u], token[crowded]), (name[v], name[crowded]), (n[u], none), (n[v], none), (count, none))
    return pa.record_batch([pa.array(np.concatenate(x).astype(np.int64)) for x in columns], names=["u", "v", "nu", "nv", "c"])


def _buckets(batches):
    """Pairs of the buckets of a partition that is sorted by token."""
    held, size, most = [], 0, 1 << 18
    for batch in batches:
        held.append([batch.column(c).to_numpy() for c in ("token", "name", "n")])
        size += batch.num_rows
        if size >= most:
            now = [np.concatenate(x) for x in zip(*held)]
            cut = run_starts(now[0])[-1]
            if cut:
                yield _meet(*(x[:cut] for x in now))
            held, size = [[x[cut:] for x in now]], len(now[0]) - cut
            most = max(1 << 18, 2 * size)
    if size:
        yield _meet(*(np.concatenate(x) for x in zip(*held)))


def bit_map(s: np.ndarray) -> bytes:
    """A bit for each MAP-th part of the hashes: 1 if an odd number of the shingles fall there."""
    count = np.bincount((s.view(np.uint64) >> np.uint64(65 - MAP.bit_length())).astype(np.int64), minlength=MAP)
    return np.packbits(count & 1).tobytes()


def _sets(batches):
    for batch in batches:
        found = [shingle_set(raw) for raw in _texts(batch)]
        sets = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(s) for _, s in found])).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *(s for _, s in found)])))
        columns = [pa.array([name for name, _ in found], pa.int64()), pa.array([len(s) for _, s in found], pa.int64()), pa.array([bit_map(s) for _, s in found], pa.binary()), sets]
        yield pa.record_batch(columns, names=["name", "n", "bits", "shingles"])


def _split(column) -> list[np.ndarray]:
    """The arrays of a list column."""
    values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[s:e] for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def _possible(batches):
    """(u, v) of the pairs (u, v, nu, nv, bu, bv) that can be near copies: sets that share h shingles differ in nu + nv - 2 h, and in as many bits at most."""
    for batch in batches:
        maps = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("bu", "bv")]
        both = batch.column("nu").to_numpy() + batch.column("nv").to_numpy()
        differ = np.bitwise_count(maps[0] ^ maps[1]).sum(axis=1, dtype=np.int64)
        yield batch.select(["u", "v"]).filter(pa.array(differ <= both - 2 * np.ceil(ALIKE / (1 + ALIKE) * both - 1e-9)))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two shingle sets are near copies."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) >= ALIKE


def _verified(batches):
    """(u, v) of the pairs (u, v, su, sv) whose sets are near copies."""
    for batch in batches:
        same = [alike(a, b) for a, b in zip(_split(batch.column("su")), _split(batch.column("sv")))]
        yield batch.select(["u", "v"]).filter(pa.array(same, pa.bool_()))


def _beside(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """pairs (u, v) with columns of the sets of both, under the column's first letter and u or v."""
    side = lambda x: sets.select(F.col("name").alias(x), *[F.col(c).alias(f"{c[0]}{x}") for c in columns])
    # many pairs may share v, the smallest of a group, so they meet it before their own sets come along
    return pairs.join(side("v"), "v").join(side("u"), "u")


def _met(rows, exact: bool):
    """Of a block pair, the members with a possible partner of another label; exact: the links (u, v) that join labels.

    A pair meets in the first bucket that both know of, whatever others they share.
    """
    block, name, label, n = (np.concatenate(x) for x in list(zip(*rows))[:4])
    maps = np.frombuffer(b"".join(b for r in rows for b in r[4]), np.uint64).reshape(len(name), -1)
    low, sets = ([s for r in rows for s in r[c]] for c in (5, 6))
    bucket, i, j = rows[0][7]
    low = [{x for x in own.tolist() if x < bucket} for own in low]
    order = np.argsort(n, kind="stable")
    block, name, label, n, maps = (x[order] for x in (block, name, label, n, maps))
    _, group = np.unique(label, return_inverse=True)
    hit, us, vs = np.zeros(len(name), bool), [], []
    for k in range(len(name)):
        # larger sets up to those that are too large
        at = np.arange(k + 1, np.searchsorted(n, n[k] / ALIKE + 1e-9, "right"))
        at = at[(group[at] != group[k]) & ((i == j) | (block[at] != block[k]))]
        most = n[k] + n[at] - 2 * np.ceil(ALIKE / (1 + ALIKE) * (n[k] + n[at]) - 1e-9)
        for words in (slice(0, 4), slice(0, None)):  # a part of the map first
            fits = np.bitwise_count(maps[at, words] ^ maps[k, words]).sum(axis=1, dtype=np.int64) <= most
            at, most = at[fits], most[fits]
        at = np.array([m for m in at.tolist() if low[order[k]].isdisjoint(low[order[m]])], np.int64)
        if exact:
            for m in at.tolist():
                if group[m] != group[k] and alike(sets[order[k]], sets[order[m]]):
                    us.append(name[k])
                    vs.append(name[m])
                    group[group == group[m]] = group[k]
        elif len(at):
            hit[k] = True
            hit[at] = True
    if exact:
        u, v = np.array(us, np.int64), np.array(vs, np.int64)
        return pa.record_batch([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])
    held = int(hit.sum())
    return pa.record_batch([pa.array(np.full(held, x)) for x in (bucket, i, j)] + [pa.array(x[hit]) for x in (block, name, label)], names=["bucket", "i", "j", "block", "name", "label"])


def _blocks(exact: bool):
    """_met of each block pair in a partition that is sorted by (bucket, i, j).

    Rows (bucket, i, j, block, name, label, n, bits, low, and shingles if exact): members of blocks i and j, which meet each other.
    """

    def run(batches):
        key, rows = None, []
        for batch in batches:
            bucket, i, j = (batch.column(c).to_numpy() for c in ("bucket", "i", "j"))
            first = run_starts(bucket, i, j)
            for a, b in zip(first.tolist(), np.append(first[1:], batch.num_rows).tolist()):
                now = (bucket[a], i[a], j[a])
                if now != key and rows:
                    yield _met(rows, exact)
                    rows = []
                key = now
                part = batch.slice(a, b - a)
                sets = _split(part.column("shingles")) if exact else []
                rows.append((*(part.column(c).to_numpy() for c in ("block", "name", "label", "n")), part.column("bits").to_pylist(), _split(part.column("low")), sets, now))
        if rows:
            yield _met(rows, exact)

    return run


def indexed(heads: DataFrame, work: Work) -> DataFrame:
    """(u, v) of the sets (name, fp) that the index links: each with the smallest of its fingerprint, and those with each other."""
    fps = work.save(heads.groupBy("fp").agg(F.min("name").alias("least")), "fps")
    same = heads.join(fps, "fp").where("name <> least").select(F.col("name").alias("u"), F.col("least").alias("v"))
    side = lambda x: fps.select(F.col("fp").alias(x), F.col("least").alias(f"of_{x}"))
    near = links(fps.select(F.lit(0).alias("tab"), "fp"), work).join(side("u"), "u").join(side("v"), "v")
    return same.unionByName(near.select(F.col("of_u").alias("u"), F.col("of_v").alias("v"))).distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """(id) of the rows of docs (id, text) that an earlier one makes superfluous.

    Texts are near copies at a WORDS-word Jaccard similarity of ALIKE.
    """
    work, n = Work(docs.sparkSession, "nearcopies"), partitions(docs.sparkSession)
    docs = docs.select("id", "text")
    told = work.save(docs.transform(arrow, _named(n), "id long, name long, fp long, kind int, bucket int, blob binary"), "told")
    rows = work.save(told.where("blob is null").select("id", "name", "fp"), "rows")
    often = exchange(told.where("blob is not null").select("kind", "bucket", "blob"), n).transform(arrow, _often(n), "key long, n long")
    # at most COMMON numbers; any set of them gives the same pairs
    with work.saving():
        common = np.sort(np.array([r[0] for r in often.orderBy(F.desc("n"), "key").limit(COMMON).select("key").collect()], np.int64).view(np.uint64))
    work.drop("told")
    tokens = docs.transform(arrow, _prefixes(common, n), "token long, name long, n int")
    met = work.save(tokens.repartition(n, "token").sortWithinPartitions("token").transform(arrow, _buckets, "u long, v long, nu long, nv long, c long"), "met")

    # what two prefixes do not share of an overlap lies behind one of them
    need = F.ceil(ALIKE / (1 + ALIKE) * (F.col("nu") + F.col("nv")) - 1e-9) - F.ceil(ALIKE * F.greatest("nu", "nv") - 1e-9) + 1
    pairs = met.where("c > 0").groupBy("u", "v", "nu", "nv").agg(F.sum("c").alias("c")).where(F.col("c") >= need).select("u", "v")
    crowds = met.where("c = 0").select(F.col("u").alias("bucket"), F.col("v").alias("name"))
    least = work.save(crowds.groupBy("bucket").agg(F.min("name").alias("least"), F.count("*").alias("size")), "crowds")
    stars = crowds.join(least, "bucket").where("name <> least").select(F.col("name").alias("u"), F.col("least").alias("v"))
    pairs = work.save(pairs.unionByName(stars).distinct(), "pairs")
    heads = work.save(rows.groupBy("name").agg(F.min("id").alias("first"), F.min("fp").alias("fp")), "heads")
    index = work.save(indexed(heads.where("fp is not null").select("name", "fp"), work), "indexed")
    work.keep("rows", "met", "pairs", "heads", "indexed")
    both = pairs.unionByName(index)
    names = both.select(F.col("u").alias("name")).unionByName(both.select(F.col("v").alias("name"))).distinct()
    wanted = work.save(heads.join(names, "name", "left_semi"), "wanted")
    texts = docs.join(wanted.select(F.col("first").alias("id")).distinct(), "id", "left_semi")
    sets = texts.transform(arrow, _sets, "name long, n long, bits binary, shingles array<long>").join(wanted.select("name"), "name", "left_semi")
    sets = work.save(sets.dropDuplicates(["name"]), "sets")
    work.drop("wanted")

    def checked(pairs: DataFrame, table: str) -> DataFrame:
        return work.save(_beside(pairs, sets, "shingles").select("u", "v", "su", "sv").transform(arrow, _verified, "u long, v long"), table)

    def label(x: str, of: DataFrame) -> DataFrame:
        return of.select(F.col("u").alias(x), F.col("v").alias(f"of_{x}"))

    def apart_in(of: DataFrame, pairs: DataFrame) -> DataFrame:
        return pairs.join(label("u", of), "u", "left").join(label("v", of), "v", "left").where(F.coalesce("of_u", "u") != F.coalesce("of_v", "v")).select("u", "v")

    near = checked(index, "near")
    pairs = apart_in(components(near, work, "near"), pairs)
    possible = _beside(pairs, sets, "n", "bits").select("u", "v", "nu", "nv", "bu", "bv").transform(arrow, _possible, "u long, v long")
    possible = work.save(possible.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "possible")
    # a group of copies has few members and many pairs: most are linked to one text once each met the smallest of its partners
    first = checked(possible.groupBy("u").agg(F.min("v").alias("v")), "first")
    edges = work.save(near.unionByName(first).unionByName(checked(apart_in(first, possible), "second")).distinct(), "edges")
    roots = components(edges, work, "found")
    work.keep("rows", "met", "heads", "sets", "edges", *[t for t in work.tables if t.startswith("foundstars")])

    # crowded buckets with several components: bit maps of all members, block by block
    held = crowds.join(roots.select(F.col("u").alias("name"), F.col("v").alias("root")), "name", "left").select("bucket", "name", F.coalesce("root", "name").alias("label"))
    mixed = held.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("bucket")
    open_ = work.save(held.join(mixed, "bucket", "left_semi").join(sets.select("name", "n", "bits"), "name"), "open")
    work.drop("met")
    blocks = open_.groupBy("bucket").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / HELD)).cast("int").alias("blocks"))
    low = open_.groupBy("name").agg(F.slice(F.array_sort(F.collect_set("bucket")), 1, LOW).alias("low"))
    placed = open_.join(blocks, "bucket").join(low, "name").withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    member = ["block", "name", "label", "n", "bits", "low"]
    dealt = placed.select("bucket", *member, other.alias("k")).select("bucket", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), *member)
    place = ["bucket", "i", "j"]
    meeting = lambda rows, exact, kind: rows.repartition(n, *place).sortWithinPartitions(*place).transform(arrow, _blocks(exact), kind)
    few = work.save(meeting(dealt, False, "bucket long, i int, j int, block int, name long, label long"), "few")
    late = work.save(meeting(few.join(sets, "name").join(low, "name").select(*place, *member, "shingles"), True, "u long, v long").distinct(), "late")
    work.drop("sets", "open", "few")
    if not late.isEmpty():
        roots = components(work.save(edges.unionByName(late).distinct(), "all"), work, "all")

    named = roots.select(F.col("u").alias("name"), F.col("v").alias("root"))
    labelled = work.save(heads.join(named, "name", "left").select("name", "first", F.coalesce("root", "name").alias("root")), "labelled")
    kept = labelled.join(labelled.groupBy("root").agg(F.min("first").alias("kept")), "root").select("name", "kept")
    gone = work.save(rows.join(kept, "name").where("id <> kept").select("id").distinct(), "gone")
    work.keep("gone")  # a stage that follows has the disk for itself
    return gone


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without near copies: of each group the row with the smallest id stays; rows without an id stay, and all with a kept id."""
    # in a struct no other column can clash with a name used here
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), "text")
    gone = near_copies(rows.where("id is not null").select("id", "text"))
    # few enough ids go by broadcast: else every text is shuffled, and lies on disk until the driver collects its garbage
    gone = F.broadcast(gone) if gone.count() <= GONE else gone
    kept = rows.join(gone, "id", "left_anti")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
