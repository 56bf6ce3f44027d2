"""SentencePiece encoding and decoding over a relational lattice.

Text is cut before each space and around each line end; a space becomes U+2581 and
each text starts with one.

Lattice.  ``encode_words`` takes distinct words in DataFrame operations: their substrings
of at most ``LONGEST`` characters are exploded and meet the piece table in an equi-join, the
matches are the edges of a word's lattice, grouped by word, and a higher-order aggregate
folds over their ends, keeping the best path to each place (Viterbi).

Corpus.  ``encoded`` counts the words of all texts and gives the ``VOCABULARY`` most frequent
ones of at most ``SHORT`` characters to encode_words; that table is bounded by those two
numbers and is broadcast.  Words repeat, so it has most of a corpus.  The others, for which
edge rows and a join back to every word of every document would be shuffled, take the
same lattice inside Arrow batches: each slab of texts is reduced to its distinct words, and
the fold runs over all of them at once.  Both folds add the same numbers in the same
order, so it does not matter which one a word takes.

Scores.  A piece's score is the logarithm of a Zipf frequency of its rank in the model
(the model lists pieces in order of frequency; its own scores are ranks and do not add
up along a path).  A character without a piece becomes its UTF-8 byte pieces at
``UNKNOWN`` under the lowest score.  Of equal paths the one with the longer last piece
wins.  So this is the most likely segmentation for those scores, not the merge order of
a pair-merging encoder; decoding gives back every text exactly.

Cases.  Null and empty texts have no pieces; U+2581 in a text goes as bytes, so that
spaces stay apart from it; a very long text is a slab of its own, which bounds memory; equal
rows stay; a null doc_id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Work, arrow, mix, partitions, ranges, slabs

LONGEST, UNKNOWN, SLAB, SCALAR = 16, 10.0, 2 << 20, 256
SPACE, LITERAL = 0x2581, 0x110000
#: Words that take the relational lattice, their characters, and the uses in a slab from which a word is counted.
VOCABULARY, SHORT, OFTEN = 1 << 17, 32, 4
_B = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The piece table: pieces, scores and byte pieces of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n = model.get_piece_size()
        self.texts = [model.id_to_piece(i) for i in range(self.n)]
        self.byte = np.zeros(256, np.int32)
        self.usable = np.zeros(self.n, bool)
        for i, t in enumerate(self.texts):
            if model.is_byte(i):
                self.byte[int(t[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or "▁" in t[1:] or len(t) > LONGEST):
                self.usable[i] = True
        self.scores = np.append(-np.log(np.arange(self.n) + 2.0), 0.0)
        self.unknown = float(self.scores[: self.n].min() - UNKNOWN)
        self.keys, self.ids, self.seen = {}, {}, {}
        usable = np.flatnonzero(self.usable)
        for size in range(1, LONGEST + 1):
            ids = np.array([i for i in usable.tolist() if len(self.texts[i]) == size], np.int32)
            chars = np.array([[ord(c) for c in self.texts[i]] for i in ids.tolist()], np.uint64).reshape(-1, size)
            h = np.zeros(len(ids), np.uint64)
            for k in range(size):
                h = h * _B + chars[:, k]
            h = mix(h)
            order = np.argsort(h)
            self.keys[size], self.ids[size] = h[order], ids[order]
            self.seen[size] = np.zeros(1 << 18, bool)
            self.seen[size][(h >> np.uint64(46)).astype(np.int64)] = True
        raw = [bytes([int(t[3:5], 16)]) if i in set(self.byte.tolist()) else b"" for i, t in enumerate(self.texts)]
        for i in usable.tolist():
            raw[i] = self.texts[i].replace("▁", " ").encode()
        sizes = np.array([len(x) for x in raw], np.int64)
        self.raw, self.raw_at, self.raw_size = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes, sizes


@lru_cache(2)
def opened(path: str) -> Pieces:
    """One piece table for each Python worker."""
    return Pieces(path)


def _edges(pieces: Pieces, chars: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Piece at each place and length, -1 for none, pieces.n for a character that goes as bytes.

    room: characters from a place to the end of its word.
    """
    out = np.full((LONGEST + 1, len(chars)), -1, np.int32)
    h = np.zeros(len(chars), np.uint64)
    for size in range(1, LONGEST + 1):
        n = len(chars) - size + 1
        if n < 1:
            break
        h = h[:n] * _B + chars[size - 1 :]
        at = np.flatnonzero(room[:n] >= size)
        key = mix(h[at])
        near = pieces.seen[size][(key >> np.uint64(46)).astype(np.int64)]
        at, key = at[near], key[near]
        if len(pieces.keys[size]):
            found = np.minimum(np.searchsorted(pieces.keys[size], key), len(pieces.keys[size]) - 1)
            hit = pieces.keys[size][found] == key
            out[size, at[hit]] = pieces.ids[size][found[hit]]
    out[1, out[1] < 0] = pieces.n
    return out


def _paths(pieces: Pieces, chars: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of the words (sizes in characters, joined in chars) and their number for each."""
    start = np.cumsum(size) - size
    room = np.repeat(start + size, size) - np.arange(len(chars))
    edge = _edges(pieces, chars, room)
    # index pieces.n is a character that goes as bytes, index -1 no edge
    score = np.append(pieces.scores, -np.inf)
    score[pieces.n] = pieces.unknown
    order = np.argsort(-size, kind="stable")
    by_size = size[order]
    slot = start + np.arange(len(size))
    best, back = np.full(len(chars) + len(size), -np.inf), np.zeros(len(chars) + len(size), np.int32)
    best[slot] = 0.0
    long = int(np.searchsorted(-by_size, -SCALAR, "left"))
    for w in order[:long].tolist():
        s, b = int(start[w]), int(slot[w])
        own, ways = [0.0], [0]
        rows = score[edge[:, s : s + int(size[w])].T].tolist()
        for j in range(1, int(size[w]) + 1):
            top, way = -np.inf, 0
            for n in range(1, min(LONGEST, j) + 1):
                v = own[j - n] + rows[j - n][n]
                if v >= top:
                    top, way = v, n
            own.append(top)
            ways.append(way)
        back[b : b + len(ways)] = ways
    words = order[long:]
    short = by_size[long:]
    for j in range(1, int(short[0]) + 1 if len(short) else 0):
        live = words[: int(np.searchsorted(-short, -j, "right"))]
        s, b = start[live] + j, slot[live] + j
        top, way = np.full(len(live), -np.inf), np.zeros(len(live), np.int32)
        for n in range(1, min(LONGEST, j) + 1):
            v = best[b - n] + score[edge[n, s - n]]
            better = v >= top
            top, way = np.where(better, v, top), np.where(better, n, way)
        best[b], back[b] = top, way
    chosen = np.full(len(chars), -1, np.int32)
    place, live = size.copy(), np.arange(len(size))
    live = live[place > 0]
    while len(live):
        way = back[slot[live] + place[live]]
        place[live] -= way
        at = start[live] + place[live]
        chosen[at] = edge[way, at]
        live = live[place[live] > 0]
    at = np.flatnonzero(chosen >= 0)
    return _with_bytes(pieces, chosen[at], chars[at], np.bincount(np.repeat(np.arange(len(size)), size)[at], minlength=len(size)))


def _with_bytes(pieces: Pieces, ids: np.ndarray, chars: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    odd = np.flatnonzero(ids == pieces.n)
    if not len(odd):
        return ids, count
    raw = [chr(SPACE if c == LITERAL else c).encode("utf-8", "surrogatepass") for c in chars[odd].tolist()]
    sizes = np.ones(len(ids), np.int64)
    sizes[odd] = [len(x) for x in raw]
    out = np.repeat(ids, sizes)
    out[ranges(np.cumsum(sizes)[odd] - sizes[odd], sizes[odd])] = pieces.byte[np.frombuffer(b"".join(raw), np.uint8)]
    word = np.repeat(np.arange(len(count)), count)
    return out, np.bincount(word, sizes, minlength=len(count)).astype(np.int64)


@dataclass
class Vocabulary:
    """Encoded words: sorted names, the words' characters and ids, flat with starts and sizes."""

    names: np.ndarray
    chars: np.ndarray
    at: np.ndarray
    size: np.ndarray
    ids: np.ndarray
    ids_at: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, words: list[str], ids: list[list[int]]) -> Vocabulary:
        size, count = np.array([len(w) for w in words], np.int64), np.array([len(x) for x in ids], np.int64)
        chars, at = np.array([ord(c) for w in words for c in w], np.uint64), np.cumsum(size) - size
        names = _hashes(chars, at, size) if len(words) else np.zeros(0, np.uint64)
        order = np.argsort(names)
        flat = np.array([i for x in ids for i in x], np.int32)
        return cls(names[order], chars, at[order], size[order], flat, (np.cumsum(count) - count)[order], count[order])

    def find(self, names: np.ndarray, chars: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Place of each word, -1 where it is not there; names are followed by a comparison of all characters."""
        if not len(self.names):
            return np.full(len(names), -1)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        same = (self.names[at] == names) & (self.size[at] == size)
        k = np.flatnonzero(same)
        if len(k):
            differ = chars[ranges(start[k], size[k])] != self.chars[ranges(self.at[at[k]], size[k])]
            same[k] = np.add.reduceat(differ, np.cumsum(size[k]) - size[k], dtype=np.int64) == 0
        return np.where(same, at, -1)


NOTHING = Vocabulary(*[np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int32, np.int64, np.int64)])


def slab_words(offsets: np.ndarray, data: np.ndarray):
    """Words of concatenated texts: all characters, start and size of each word, its text."""
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    at = lead[offsets]
    raw = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
    full = np.flatnonzero(np.diff(at))
    # one leading space for each text that is not empty
    chars = np.full(len(raw) + len(full), ord(" "), np.uint64)
    begin = at[full] + np.arange(len(full))
    inner = np.ones(len(chars), bool)
    inner[begin] = False
    chars[inner] = raw
    line = chars == 0x0A
    head = (chars == 0x20) | line
    head[1:] |= line[:-1]
    head[begin] = True
    chars[chars == SPACE] = LITERAL
    chars[chars == 0x20] = SPACE
    start = np.flatnonzero(head)
    return chars, start, np.diff(np.append(start, len(chars))), full[np.searchsorted(begin, start, "right") - 1] if len(start) else start


def encode_slab(pieces: Pieces, offsets: np.ndarray, data: np.ndarray, known: Vocabulary = NOTHING) -> tuple[np.ndarray, np.ndarray]:
    """Ids of concatenated texts and their number for each."""
    chars, start, size, text = slab_words(offsets, data)
    n = len(offsets) - 1
    if not len(start):
        return np.zeros(0, np.int32), np.zeros(n, np.int64)
    name, plain = _names(chars, start, size)
    name, first, which = np.unique(name, return_index=True, return_inverse=True)
    found = known.find(name, chars, start[first], size[first]) if plain else np.full(len(first), -1)
    rest = np.flatnonzero(found < 0)
    of_rest = first[rest]
    ids, count = _paths(pieces, chars[ranges(start[of_rest], size[of_rest])], size[of_rest]) if len(rest) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    at, counts = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
    at[rest], counts[rest] = len(known.ids) + np.cumsum(count) - count, count
    hit = np.flatnonzero(found >= 0)
    at[hit], counts[hit] = known.ids_at[found[hit]], known.count[found[hit]]
    out = np.concatenate([known.ids, ids])[ranges(at[which], counts[which])]
    return out, np.bincount(text, counts[which], minlength=n).astype(np.int64)


def _hashes(chars: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    powers = np.cumprod(np.full(int(size.max()), _B, np.uint64))
    within = np.arange(len(chars)) - np.repeat(start, size)
    return mix(np.add.reduceat(mix(chars) * powers[within], start)) + size.astype(np.uint64)


def _names(chars: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, bool]:
    """A number for each word, equal for equal words only, and whether the numbers are the words' hashes."""
    name = _hashes(chars, start, size)
    _, first, which = np.unique(name, return_index=True, return_inverse=True)
    same = size[first][which] == size
    if same.all() and np.array_equal(chars, chars[ranges(start[first][which], size)]):
        return name, True
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(chars[s : s + n].tobytes(), len(seen)) for s, n in zip(start.tolist(), size.tolist())], np.uint64), False


def decode_slab(pieces: Pieces, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of the texts; the leading space goes."""
    size = pieces.raw_size[ids]
    data = pieces.raw[ranges(pieces.raw_at[ids], size)]
    text = np.repeat(np.arange(len(count)), count)
    length = np.bincount(text, size, minlength=len(count)).astype(np.int64)
    start = np.cumsum(length) - length
    keep = np.ones(len(data), bool)
    keep[start[length > 0]] = False
    return np.concatenate([[0], np.cumsum(np.maximum(length - 1, 0))]), data[keep]


def _list(ids: np.ndarray, count: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(ids, pa.int32()))


def _frequent(batches):
    """(word, n): the short words that stand OFTEN times or more in a slab."""
    for batch in batches:
        for _, _, offsets, data in slabs(batch, limit=SLAB):
            chars, start, size, _ = slab_words(offsets, data)
            if not len(start):
                continue
            name, _ = _names(chars, start, size)
            _, first, n = np.unique(name, return_index=True, return_counts=True)
            odd = np.add.reduceat(chars == LITERAL, start, dtype=np.int64)[first] > 0
            often = (n >= OFTEN) & (size[first] <= SHORT) & ~odd
            words = ["".join(map(chr, chars[s : s + k].tolist())) for s, k in zip(start[first[often]].tolist(), size[first[often]].tolist())]
            yield pa.record_batch([pa.array(words, pa.string()), pa.array(n[often].astype(np.int64))], names=["word", "n"])


def vocabulary(docs: DataFrame, model: str, work: Work) -> Vocabulary:
    """The VOCABULARY most frequent words of docs (text) by the relational lattice."""
    counted = docs.select("text").transform(arrow, _frequent, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = work.save(counted.orderBy(F.desc("n"), "word").limit(VOCABULARY).select("word"), "words")
    pieces = opened(model)
    words = words.repartition(partitions(docs.sparkSession), "word")  # few bytes, but many edges
    got = encode_words(words, piece_table(docs.sparkSession, model), pieces.byte.tolist(), pieces.unknown).toArrow()
    return Vocabulary.of(got["word"].to_pylist(), got["ids"].to_pylist())


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, restored (decoding gave the text back), ids for each row of docs.

    model: path of the model file, which every executor has.
    """
    work = Work(docs.sparkSession, "pieces")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(docs, model, work))  # at most VOCABULARY words of SHORT characters
    work.close()

    def run(batches):
        pieces = opened(model)
        for batch in batches:
            for i, j, offsets, data in slabs(batch, limit=SLAB):
                ids, count = encode_slab(pieces, offsets, data, shared.value)
                back_at, back = decode_slab(pieces, ids, count)
                if np.array_equal(back_at, offsets) and np.array_equal(back, data):
                    same = np.ones(j - i, bool)
                else:
                    same = np.array([np.array_equal(back[back_at[k] : back_at[k + 1]], data[offsets[k] : offsets[k + 1]]) for k in range(j - i)])
                yield pa.record_batch([batch.column("doc_id").slice(i, j - i), pa.array(count), pa.array(same), _list(ids, count)], names=["doc_id", "n_pieces", "restored", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.transform(arrow, run, "doc_id long, n_pieces long, restored boolean, ids array<int>")


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """doc_id and text from rows (doc_id, ids); a text of no pieces is empty."""

    def run(batches):
        pieces = opened(model)
        for batch in batches:
            lists = batch.column("ids")
            count = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
            at, data = decode_slab(pieces, lists.flatten().to_numpy(zero_copy_only=False), count)
            texts = pa.Array.from_buffers(pa.large_string(), len(count), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data.tobytes())])
            yield pa.record_batch([batch.column("doc_id"), texts.cast(pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").transform(arrow, run, "doc_id long, text string")


def piece_table(spark: SparkSession, model: str) -> DataFrame:
    """piece, id, score of the pieces that edges may use."""
    p = Pieces(model)
    return spark.createDataFrame([(p.texts[i], i, float(p.scores[i])) for i in np.flatnonzero(p.usable).tolist()], "piece string, id int, score double")


def encode_words(words: DataFrame, table: DataFrame, byte: list[int], unknown: float) -> DataFrame:
    """word and ids for each distinct word of words (column word), in DataFrame operations only.

    Substrings explode, meet the piece table by equality, group by word, and the fold
    goes through a word's edges in order of their ends.
    byte: piece of each byte value.
    """
    each = words.select("word").distinct().where("word <> ''")
    ends = F.sequence(F.lit(1), F.length("word"))
    spans = each.select("word", F.explode(ends).alias("at")).select("word", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("word") - F.col("at") + 1))).alias("size"))
    parts = spans.select("word", "at", "size", F.substring("word", F.col("at"), F.col("size")).alias("piece"))
    # the piece table is a fixed vocabulary file
    edges = parts.join(F.broadcast(table), "piece", "left").where("id is not null or size = 1")
    raw = F.transform(F.split(F.regexp_replace(F.hex(F.encode("piece", "UTF-8")), "(..)(?=.)", "$1 "), " "), lambda x: F.element_at(F.array(*[F.lit(b) for b in byte]), F.conv(x, 16, 10).cast("int") + 1))
    ids = F.when(F.col("id").isNotNull(), F.array("id")).otherwise(raw)
    edge = F.struct((F.col("at") + F.col("size")).alias("end"), "size", F.coalesce("score", F.lit(unknown)).alias("score"), ids.alias("ids"))
    lattice = edges.groupBy("word").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    state = "struct<best:double,ids:array<int>>"
    start = F.array(F.struct(F.lit(0.0).alias("best"), F.array().cast("array<int>").alias("ids"))).cast(f"array<{state}>")

    def step(acc, e):
        # acc[k] is the best path to place k; edges come by end, so the path to an edge's start is known
        before = F.element_at(acc, (e["end"] - e["size"]).cast("int"))
        path = F.struct((before["best"] + e["score"]).alias("best"), F.concat(before["ids"], e["ids"]).alias("ids")).cast(state)
        known = F.size(acc) >= e["end"]
        now = F.when(known, F.element_at(acc, F.least(e["end"], F.size(acc)))).otherwise(path)
        new = F.when(known & (now["best"] > path["best"]), now).otherwise(path)
        return F.concat(F.slice(acc, 1, e["end"] - 1), F.array(new))

    return lattice.select("word", F.element_at(F.aggregate("edges", start, step), -1)["ids"].alias("ids"))
