"""Exact 50-byte substring dedup by prefix-free parsing.

Parsing.  Each window of ``SPAN`` bytes picks the 16-byte gram in it with the
smallest rolling hash, its trigger; consecutive windows with one trigger form a
phrase.  Phrases depend on nearby bytes only.  A phrase is extended by SPAN-1 bytes,
so every window that starts in it lies in it whole: equal extended phrases have
equal windows and need no neighbours (the prefix-free property).

Dictionary and parse.  The first pass ships (trigger, phrase, document): a phrase
that also occurs in a document with a smaller id is removed whole.  What is left,
one owner document for each distinct phrase, is the dictionary.  A window that two
different dictionary phrases share has the same trigger in both, and 16 bytes or more
of it to the left or to the right of the trigger.  So only phrases go on that share with
another one their trigger and, by 16 bits of its hash, the gram on one side of it.

Suffix order.  The second pass ranks the dictionary suffixes that are left by
their first SPAN bytes.  Ranks are made by prefix doubling (1, 2, 4, ... bytes),
with hashed names in place of dense ones so that tasks need not agree on them;
sorting the ranks brings equal suffixes together, and the smallest document of
each class is its first place in corpus order.

Scale.  Entries travel as compressed blobs by hash bucket, answers by document
bucket.  Before anything is shipped, a task keeps only the smallest document of
each phrase or window it has seen; the rest is settled in place, so a passage in a third of all
documents costs one entry for each task.  A trigger with many phrases (a common
line among ever other words) is crowded: a task ships two of its phrases as a sign
and its suffixes travel by their own names, each to its own place.  All other
suffixes travel as the bytes of their phrase, by trigger.  Nothing is collected, and every step that follows a shuffle reads
written tables.

Cases.  Null text counts as empty; texts under SPAN bytes are kept whole; rows
with the same id never remove each other's bytes; a null id counts as the
largest; other columns are ignored.  Memory is bounded by the longest text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLOBS, Work, arrow, bucket_rows, by_bucket, exchange, mix, named_rows, numbers, pack, partitions, ranges, run_starts, slabs, text_column

SPAN, GRAM = 50, 16
FLUSH, PIECE = 500_000, 1 << 19
#: Distinct phrases of a trigger from which it is crowded: in one flush of a task, and over all tasks.
CROWD_HERE, CROWD = 64, 4096
PHRASE, WINDOW, SETTLED, CONTEXT = 0, 1, 2, 3
REMOVED, CANDIDATE = 0, 1
#: Added to the length of a candidate phrase whose trigger is crowded.
CROWDED = 64

_U = np.uint64
_BYTE = mix((np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95)) ^ _U(0x2545F4914F6CDD1D))
_ODD = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD)]


def _join(left: np.ndarray, right: np.ndarray, step: int) -> np.ndarray:
    return mix(left * _ODD[step] + (right ^ (right >> _U(27))))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Name of the 16 bytes at each place, by doubling."""
    h, size, step = _BYTE[data], 1, 0
    while size < GRAM:
        h, size, step = _join(h[:-size], h[size:], step), size * 2, step + 1
    return h


def window_hashes(data: np.ndarray) -> np.ndarray:
    """Name of the SPAN = 32 + 16 + 2 bytes at each place, by doubling."""
    names, h, size, step = {}, _BYTE[data], 1, 0
    while size < 32:
        h, size, step = _join(h[:-size], h[size:], step), size * 2, step + 1
        if size in (2, 16, 32):
            names[size] = h
    n = len(data) - SPAN + 1
    return _join(_join(names[32][:n], names[16][32 : 32 + n], 5), names[2][48 : 48 + n], 4)


def phrases(data: np.ndarray, ends: np.ndarray):
    """Phrases: first window, one past the last, trigger hash, document, hashes of the grams on either side of the trigger.

    ends: end of each document in data.  Windows that cross an end are left out.
    """
    none = np.zeros(0, np.int64)
    if len(data) < SPAN:
        return none, none, np.zeros(0, np.uint64), none, np.zeros(0, np.uint32)
    grams = gram_hashes(data)
    low = (grams & _U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while size < 32:
        low, size = np.minimum(low[:-size], low[size:]), size * 2
    extra = SPAN - GRAM + 1 - size
    low = np.minimum(low[:-extra], low[extra:])
    place = (low & _U(0xFFFFFFFF)).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    windows = ranges(starts, np.maximum(ends - starts - SPAN + 1, 0))
    if not len(windows):
        return none, none, np.zeros(0, np.uint64), none, np.zeros(0, np.uint32)
    doc = np.repeat(np.arange(len(ends)), np.maximum(ends - starts - SPAN + 1, 0))
    first = run_starts(place[windows], doc)
    last = np.append(first[1:], len(windows)) - 1
    trigger = place[windows[first]]
    # beyond the ends of a document no window needs them, so any value does
    left, right = (grams[np.clip(trigger + step, 0, len(grams) - 1)] >> _U(48) for step in (-GRAM, GRAM))
    return windows[first], windows[last] + 1, grams[trigger], doc[first], (left << _U(16) | right).astype(np.uint32)


class _Held:
    """Entry arrays gathered until there are enough for one flush."""

    def __init__(self):
        self.parts, self.n = [], 0

    def add(self, **arrays):
        self.parts.append(arrays)
        self.n += len(next(iter(arrays.values())))

    def take(self) -> dict[str, np.ndarray]:
        out = {k: np.concatenate([p[k] for p in self.parts]) for k in self.parts[0]}
        self.parts, self.n = [], 0
        return out


def _rows(rows) -> pa.RecordBatch:
    rows = list(rows)
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["kind", "bucket", "blob"])


def _smallest(doc: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys, and for each place of that order the smallest document of its class."""
    order = np.lexsort(keys[::-1])
    starts = run_starts(*(k[order] for k in keys))
    least = np.minimum.reduceat(doc[order], starts) if len(starts) else doc[:0]
    return order, np.repeat(least, np.diff(np.append(starts, len(order))))


def _at(e: dict, where: np.ndarray) -> dict:
    return {k: v[where] for k, v in e.items()}


def _answer(buckets: int, kind: int, e: dict):
    """Ranges of places (doc, tk, a, n) as blobs by document."""
    if len(e["doc"]):
        by = (mix(e["doc"].view(np.uint64) ^ e["tk"].astype(np.uint64)) % _U(buckets)).astype(np.int32)
        yield from bucket_rows(kind, by, {k: e[k] for k in ("doc", "tk", "a", "n")})


def _settled(buckets: int, kind: int, e: dict):
    """As _answer, but on the way of the entries: the blob that holds an answer goes through as it is."""
    for _, bucket, blob in _answer(buckets, kind, e):
        yield SETTLED, bucket, pack(kind=np.array([kind], np.int32), bucket=np.array([bucket], np.int32), blob=np.array([blob], object))


def _shared(h: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries sorted by (h, name): number of names of h, less one, and rank of the name in h."""
    group = run_starts(h)
    sizes = np.diff(np.append(group, len(h)))
    rank = np.zeros(len(h), np.int64)
    rank[run_starts(h, name)] = 1
    rank = np.cumsum(rank)
    rank -= np.repeat(rank[group], sizes)
    return np.repeat(rank[np.append(group[1:], len(h)) - 1], sizes), rank


def _parse(buckets: int):
    def flush(held: _Held):
        e = held.take()
        order, least = _smallest(e["doc"], e["h"], e["name"])
        e = _at(e, order)
        later = e["doc"] > least
        yield from _settled(buckets, REMOVED, _at(e, later))
        e, order = _at(e, ~later), order[~later]
        more, rank = _shared(e["h"], e["name"])
        crowd = more >= CROWD_HERE
        hot = _at(e, crowd)
        yield from _settled(buckets, CANDIDATE, hot | {"n": hot["n"] + np.uint8(CROWDED)})
        e["n"] = np.where(crowd, e["n"] + np.uint8(CROWDED), e["n"])
        ship = np.flatnonzero(~crowd | (rank < 2))
        ship = _at(e, ship[np.argsort(order[ship])])  # by place, which compresses
        yield from bucket_rows(PHRASE, (ship["h"] % _U(buckets)).astype(np.int32), ship | {"h": (ship["h"] >> _U(32)).astype(np.uint32)})

    def run(batches):
        held = _Held()
        for batch in batches:
            ids, tks = numbers(batch.column("_llm_id")), numbers(batch.column("_llm_tk"))
            for i, j, offsets, data in slabs(batch, limit=PIECE):
                a, b, h, d, side = phrases(data, offsets[1:])
                if not len(a):
                    continue
                w = window_hashes(data)
                name = _join(w[a], w[b - 1], 0) + (b - a).astype(np.uint64)
                held.add(h=h, name=name, doc=ids[i:j][d], tk=tks[i:j][d], a=(a - offsets[d]).astype(np.int32), n=(b - a).astype(np.uint8), side=side)
                if held.n >= FLUSH:
                    yield _rows(flush(held))
        if held.n:
            yield _rows(flush(held))

    return run


def _beside(e: dict) -> np.ndarray:
    """Whether another phrase has the trigger and a gram beside it, for entries sorted by (h, name)."""
    out = np.zeros(len(e["h"]), bool)
    at = np.flatnonzero(_shared(e["h"], e["name"])[0] > 0)
    if not len(at):
        return out
    for side in (e["side"][at] >> np.uint32(16), e["side"][at] & np.uint32(0xFFFF)):
        key = e["h"][at].astype(np.uint64) << _U(16) | side
        order = np.argsort(key, kind="stable")  # names stay in order
        out[at[order]] |= _shared(key[order], e["name"][at[order]])[0] > 0
    return out


def _settle(buckets: int):
    """Answers of one bucket: later copies of a phrase, and phrases that share their trigger."""

    def run(batches):
        for kind, e in by_bucket(batches):
            if kind == SETTLED:
                yield _rows(zip(e["kind"].tolist(), e["bucket"].tolist(), e["blob"]))
                continue
            order, least = _smallest(e["doc"], e["h"], e["name"])
            e = _at(e, order)
            group = run_starts(e["h"])
            sizes = np.diff(np.append(group, len(order)))
            sign = e["n"] >= CROWDED
            hot = np.repeat(np.logical_or.reduceat(sign, group), sizes)
            e["n"] = np.where(sign, e["n"] - np.uint8(CROWDED), e["n"])
            first = e["doc"] == least
            go = first & (_beside(e) | hot)
            hot |= np.repeat(np.add.reduceat(go.astype(np.int64), group) > CROWD, sizes)
            flagged = np.where(hot, e["n"] + np.uint8(CROWDED), e["n"])
            yield _rows([*_answer(buckets, REMOVED, _at(e, ~first)), *_answer(buckets, CANDIDATE, _at(e | {"n": flagged}, go))])

    return run


def _ranges(whole: bool):
    """One row for each document of a bucket: its ranges of places, joined where they touch unless ``whole``."""

    def run(batches):
        for _, e in by_bucket(batches):
            a, n = e["a"].astype(np.int64), e["n"].astype(np.int64)
            order = np.lexsort((n, a, e["tk"], e["doc"]))
            doc, tk, a, n = e["doc"][order], e["tk"][order], a[order], n[order]
            new = np.ones(len(a), bool)
            if whole:
                # one phrase, several answers: crowded if one of them says so
                new[:-1] = (doc[1:] != doc[:-1]) | (tk[1:] != tk[:-1]) | (a[1:] != a[:-1])
                doc, tk, a, b = doc[new], tk[new], a[new], n[new]
                docs = run_starts(doc, tk)
                at = np.append(docs, len(a))
            else:
                docs = run_starts(doc, tk)
                which = np.repeat(np.arange(len(docs)), np.diff(np.append(docs, len(doc))))
                reach = np.maximum.accumulate(a + n + (which << 40)) - (which << 40)
                new[1:] = (which[1:] != which[:-1]) | (a[1:] > reach[:-1])
                first = np.flatnonzero(new)
                a, b = a[first], reach[np.append(first[1:], len(reach)) - 1]
                at = np.append(np.searchsorted(first, docs), len(first))
            lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (a, b)]
            yield pa.record_batch([pa.array(doc[docs]), pa.array(tk[docs]), *lists], names=["_llm_id", "_llm_tk", "_llm_a", "_llm_b"])

    return run


def _by_doc(answers: DataFrame, kind: int, n: int, name: str) -> DataFrame:
    out = exchange(answers.where(F.col("kind") == kind), n).transform(arrow, _ranges(kind == CANDIDATE), "_llm_id long, _llm_tk long, _llm_a array<int>, _llm_b array<int>")
    return out.withColumnsRenamed({"_llm_a": f"{name}a", "_llm_b": f"{name}b"})


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _windows(buckets: int):
    def flush(crowd: _Held, held: _Held):
        if crowd.n:
            e = crowd.take()
            order, least = _smallest(e["doc"], e["h"])
            e = _at(e, order)
            later = e["doc"] > least
            yield from _settled(buckets, REMOVED, _joined(_at(e, later)))
            e = _at(e, ~later)
            yield from bucket_rows(WINDOW, (e["h"] % _U(buckets)).astype(np.int32), e | {"h": e["h"] // _U(buckets)})
        if held.n:
            parts = [p.pop("bytes") for p in held.parts]
            e = held.take()
            size = e["n"].astype(np.int64) + SPAN - 1
            place, data = np.cumsum(size) - size, np.concatenate(parts)
            order, least = _smallest(e["doc"], e["h"], e["name"])
            e, place, size = _at(e, order), place[order], size[order]
            later = e["doc"] > least
            yield from _settled(buckets, REMOVED, _at(e, later))
            e, place, size = _at(e, ~later), place[~later], size[~later]
            raw = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32)), pa.py_buffer(data[ranges(place, size)])])
            yield from bucket_rows(CONTEXT, (e["h"] % _U(buckets)).astype(np.int32), {"doc": e["doc"], "tk": e["tk"], "a": e["a"], "bytes": raw})

    def run(batches):
        crowd, held = _Held(), _Held()
        for batch in batches:
            ids, tks = numbers(batch.column("_llm_id")), numbers(batch.column("_llm_tk"))
            at, a = _lists(batch.column("_llm_ca"))
            _, n = _lists(batch.column("_llm_cb"))
            for i, j, offsets, data in slabs(batch, limit=PIECE):
                s, e = at[i], at[j]
                if s == e or len(data) < SPAN:
                    continue
                doc = np.repeat(np.arange(j - i), np.diff(at[i : j + 1]))
                place, size, names = a[s:e] + offsets[doc], n[s:e], window_hashes(data)
                hot = size >= CROWDED
                if hot.any():
                    long = size[hot] - CROWDED
                    places, of = ranges(place[hot], long), np.repeat(doc[hot], long)
                    crowd.add(h=names[places], doc=ids[i:j][of], tk=tks[i:j][of], a=(places - offsets[of]).astype(np.int32))
                if not hot.all():
                    place, size, doc = place[~hot], size[~hot], doc[~hot]
                    h = trigger_of(gram_hashes(data), place)
                    name = _join(names[place], names[place + size - 1], 0) + size.astype(np.uint64)
                    held.add(h=h, name=name, doc=ids[i:j][doc], tk=tks[i:j][doc], a=(place - offsets[doc]).astype(np.int32), n=size.astype(np.uint8), bytes=data[ranges(place, size + SPAN - 1)])
                if crowd.n >= FLUSH or held.n >= FLUSH // 4:
                    yield _rows(flush(crowd, held))
        if crowd.n or held.n:
            yield _rows(flush(crowd, held))

    return run


def trigger_of(grams: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Hash of the trigger of the windows at the places."""
    out = np.empty(len(place), np.uint64)
    inside = np.arange(SPAN - GRAM + 1)
    for s in range(0, len(place), 1 << 15):
        near = grams[place[s : s + (1 << 15), None] + inside]
        out[s : s + (1 << 15)] = near[np.arange(len(near)), np.argmin(near >> _U(32), axis=1)]
    return out


def _suffixes(e: dict) -> dict:
    """The suffixes of the phrases of a bucket: name, document, place."""
    raw = e["bytes"]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    start = np.cumsum(size) - size
    count = size - SPAN + 1
    of = np.repeat(np.arange(len(raw)), count)
    return {"h": window_hashes(np.frombuffer(b"".join(raw), np.uint8))[ranges(start, count)], "doc": e["doc"][of], "tk": e["tk"][of], "a": ranges(e["a"], count).astype(np.int32)}


def _joined(e: dict) -> dict:
    """Single places as ranges."""
    order = np.lexsort((e["a"], e["tk"], e["doc"]))
    doc, tk, a = e["doc"][order], e["tk"][order], e["a"][order]
    first = run_starts(doc, tk, a - np.arange(len(a)))
    return {"doc": doc[first], "tk": tk[first], "a": a[first], "n": np.diff(np.append(first, len(a))).astype(np.int32)}


def _ranked(buckets: int):
    """Places whose suffix class starts in an earlier document."""

    def run(batches):
        for kind, e in by_bucket(batches):
            if kind == SETTLED:
                yield _rows(zip(e["kind"].tolist(), e["bucket"].tolist(), e["blob"]))
                continue
            if kind == CONTEXT:
                e = _suffixes(e)
            order, least = _smallest(e["doc"], e["h"])
            later = order[e["doc"][order] > least]
            yield _rows(_answer(buckets, REMOVED, _joined(_at(e, later))))

    return run


def repeats(docs: DataFrame, work: Work) -> DataFrame:
    """One row (_llm_id, _llm_tk, _llm_ra, _llm_rb) for each document with bytes to remove.

    docs: named rows.
    _llm_ra, _llm_rb: ranges of places at which a SPAN-byte string starts that also starts
    in a document with a smaller doc_id.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    buckets = parts
    keyed = docs.select("_llm_id", "_llm_tk", "text")
    answers = work.save(exchange(keyed.transform(arrow, _parse(buckets), BLOBS), parts).transform(arrow, _settle(buckets), BLOBS), "answers")
    found = keyed.join(_by_doc(answers, CANDIDATE, parts, "_llm_c"), ["_llm_id", "_llm_tk"]).transform(arrow, _windows(buckets), BLOBS)
    shared = work.save(exchange(found, parts).transform(arrow, _ranked(buckets), BLOBS), "shared")
    removed = work.save(_by_doc(answers.unionByName(shared), REMOVED, parts, "_llm_r"), "removed")
    work.drop("answers", "shared")
    return removed


def covered(length: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte runs under the windows that start in the given ranges."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(a, kind="stable")
    a, e = a[order], np.maximum.accumulate(b[order] + SPAN - 1)
    new = np.flatnonzero(np.concatenate([[True], a[1:] > e[:-1]]))
    return a[new], np.minimum(e[np.append(new[1:], len(a)) - 1], length)


def _digests(batches):
    for batch in batches:
        offsets, data = text_column(batch.column("text"))
        raw = data.tobytes() if len(offsets) < 2 else data[offsets[0] : offsets[-1]].tobytes()
        base = int(offsets[0])
        at, a = _lists(batch.column("_llm_ra"))
        _, b = _lists(batch.column("_llm_rb"))
        out = []
        for k in range(len(offsets) - 1):
            s, e = int(offsets[k]) - base, int(offsets[k + 1]) - base
            starts, ends = covered(e - s, a[at[k] : at[k + 1]], b[at[k] : at[k + 1]])
            kept, p = hashlib.sha256(), s
            for x, y in zip(starts.tolist(), ends.tolist()):
                kept.update(raw[p : s + x])
                p = s + y
            kept.update(raw[p:e])
            out.append((e - s, int((ends - starts).sum()), len(starts), kept.hexdigest()))
        cols = list(zip(*out)) if out else [(), (), (), ()]
        yield pa.record_batch([batch.column("doc_id"), *(pa.array(cols[c], pa.int64()) for c in range(3)), pa.array(cols[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs."""
    work = Work(docs.sparkSession, "substring")
    rows = named_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work)
    marked = rows.join(repeats(rows, work), ["_llm_id", "_llm_tk"], "left").select("doc_id", "text", "_llm_ra", "_llm_rb")
    return marked.transform(arrow, _digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _cut_texts(batches):
    for batch in batches:
        at, a = _lists(batch.column("_llm_ra"))
        _, b = _lists(batch.column("_llm_rb"))
        texts = []
        for k, text in enumerate(batch.column("text").to_pylist()):
            if at[k] != at[k + 1] and text is not None:
                raw = np.frombuffer(text.encode(), np.uint8)
                gone = np.zeros(len(raw) + 1, np.int64)
                starts, ends = covered(len(raw), a[at[k] : at[k + 1]], b[at[k] : at[k + 1]])
                np.add.at(gone, starts, 1)
                np.add.at(gone, ends, -1)
                gone = np.cumsum(gone[:-1]) > 0
                lead = np.flatnonzero((raw & 0xC0) != 0x80)
                if len(lead):  # a character goes if all its bytes do
                    gone = np.repeat(np.logical_and.reduceat(gone, lead), np.diff(np.append(lead, len(raw))))
                text = raw[~gone].tobytes().decode()
            texts.append(text)
        yield pa.record_batch([batch.column("rest"), pa.array(texts, pa.string())], names=["rest", "text"])


def cut(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes out of each text; a character goes if all its bytes do.

    Every column stays; n_chars, where there is one, is made anew.
    """
    work = Work(docs.sparkSession, "substring")
    others = [c for c in docs.columns if c != "text"]
    # in a struct no other column can clash with a name used here
    rows = named_rows(docs.select(F.struct(*others).alias("rest"), "doc_id", "text"), work)
    marked = rows.join(repeats(rows, work), ["_llm_id", "_llm_tk"], "left").select("rest", "text", "_llm_ra", "_llm_rb")
    kind = T.StructType([T.StructField("rest", marked.schema["rest"].dataType), T.StructField("text", T.StringType())])
    out = marked.transform(arrow, _cut_texts, kind).select(*[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


SQL = """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(n - 49)) AS p FROM n WHERE n >= 50)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
r AS (SELECT DISTINCT w.doc_id, p FROM w JOIN f USING (s) WHERE first < doc_id),
i AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM i),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY doc_id, run),
ends AS (SELECT doc_id, a, b FROM runs UNION ALL SELECT doc_id, n, n FROM n),
kept AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS x, a AS y FROM ends),
texts AS (SELECT k.doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS h FROM kept k JOIN n USING (doc_id) GROUP BY k.doc_id)
SELECT n.doc_id, n.n AS n_bytes, CAST(n.n - length(t.h) // 2 AS BIGINT) AS n_removed, count(r.a) AS n_spans, sha256(unhex(t.h)) AS kept_sha256
FROM n JOIN texts t USING (doc_id) LEFT JOIN runs r USING (doc_id) GROUP BY n.doc_id, n.n, t.h
"""
