"""Token-id output as Re-Pair grammars, with random access.

Encoding.  Words between ASCII white space are encoded once for each batch and
their ids put together; the tokenizer drops white space before it looks at words,
so this gives the ids of the whole text.  The end id closes each document.

File format.  Documents are dealt to parts by ranges of doc_id and sorted, so parts
and shards follow ascending doc_id (null first, equal ids by text).  A shard is a run
of whole documents of about ``SHARD`` ids and a table row: part, shard, first (ids of
the part before it), n_tokens and a payload with a header ``RPG1``, the document ids
and lengths, the rules, the expansion length of each rule, and the start symbols in
three byte planes.

Grammar.  In each round all pairs of neighbouring symbols that stand ``LEAST`` times or
more in the shard become nonterminals together; where occurrences overlap the more
frequent pair wins, and runs of one symbol pair up from even places.  Rounds go on until
no pair is frequent.  A pair of old symbols never grows more frequent, so after the first
round only pairs with a new symbol and those left over that were frequent are counted.

Reading.  A shard expands with one gather from the table of rule expansions.  For
ids m to n of a shard, sums of expansion lengths find the symbols that cover them
and only these expand.

Cases.  Null and empty texts are documents of the end id alone; equal rows stay; an
empty table gives no rows; a document longer than a shard is a shard of its own.
"""

from __future__ import annotations

import json
import struct
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, arrow, numbers, partitions, ranges, run_starts

SHARD, LEAST = 1 << 19, 12
END, TERMINALS = 2, 1 << 17
BATCH_BYTES = 16 << 20
_HEAD = struct.Struct("<4sIIII")
#: A stop or comma after letters is a word of its own to the tokenizer.  Of Latin and Cyrillic letters all but
#: U+0130 stay single letters when it normalises them.
STOPPED = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f\u0400-\u0481\u048a-\u052f]+[.,]$"


def _hashed(pairs: np.ndarray) -> np.ndarray:
    return ((pairs * np.int64(0x9E3779B97F4A7C1)) >> np.int64(40)) & 0xFFFFF


def compress(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Start symbols, rules (left, right) and the number of rules after each round."""
    seq = ids.astype(np.int64)
    rules, ends, count = [], [], 0
    at, maybe = np.arange(max(len(seq) - 1, 0)), np.zeros(1 << 20, bool)
    while len(at):
        # at: places of all pairs that can be frequent
        code = (seq[at] << 24) | seq[at + 1]
        ordered = np.sort(code)
        first = run_starts(ordered)
        often = np.diff(np.append(first, len(ordered)))
        frequent = np.flatnonzero(often >= LEAST)
        if not len(frequent):
            break
        pairs, often = ordered[first[frequent]], often[frequent]
        rank = np.empty(len(pairs), np.int64)
        rank[np.lexsort((pairs, -often))] = np.arange(len(pairs))
        # a cheap test by hash leaves few places for the binary search
        maybe[_hashed(pairs)] = True
        near = np.flatnonzero(maybe[_hashed(code)])
        maybe[_hashed(pairs)] = False
        found = np.minimum(np.searchsorted(pairs, code[near]), len(pairs) - 1)
        hit = pairs[found] == code[near]
        place, found = at[near[hit]], found[hit]
        key = np.full(len(seq) + 1, 1 << 40, np.int64)
        key[place + 1] = rank[found] * 2 + (place & 1)
        wins = (key[place + 1] < key[place]) & (key[place + 1] < key[place + 2])
        # the most frequent pair wins half of its places or more, so each round takes one pair at least
        kept = np.bincount(found[wins], minlength=len(pairs)) >= LEAST // 3
        taken = wins & kept[found]
        number, left, place = np.cumsum(kept) - 1, place[~taken], place[taken]
        rules.append(np.stack([pairs[kept] >> 24, pairs[kept] & 0xFFFFFF], axis=1))
        seq[place] = TERMINALS + count + number[found[taken]]
        stay = np.ones(len(seq), bool)
        stay[place + 1] = False
        shift = np.cumsum(stay) - 1
        seq, place, left = seq[stay], shift[place], shift[left]
        marked = np.zeros(len(seq), bool)
        marked[place] = marked[np.maximum(place - 1, 0)] = marked[left] = True
        at = np.flatnonzero(marked[:-1])
        count += int(kept.sum())
        ends.append(count)
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64), ends


def expansions(rules: np.ndarray, ends: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat expansions, and where each symbol's starts and how long it is; terminals stand for themselves."""
    start, size = np.arange(TERMINALS), np.ones(TERMINALS, np.int64)
    flat, begin = np.arange(TERMINALS, dtype=np.int32), 0
    for end in ends:
        both = rules[begin:end]
        lengths = size[both].sum(axis=1)
        flat = np.concatenate([flat, flat[ranges(start[both].ravel(), size[both].ravel())]])
        start = np.concatenate([start, len(flat) - lengths.sum() + np.cumsum(lengths) - lengths])
        size = np.concatenate([size, lengths])
        begin = end
    return flat, start, size


def write_shard(ids: np.ndarray, docs: np.ndarray, null: np.ndarray, lengths: np.ndarray) -> bytes:
    seq, rules, ends = compress(ids)
    sizes = expansions(rules, ends)[2][TERMINALS:]
    planes = [((seq >> s) & 0xFF).astype(np.uint8) for s in (0, 8, 16)]
    parts = [np.array(ends, "<u4"), docs.astype("<i8"), null.astype(np.uint8), lengths.astype("<u4"), rules.astype("<u4").ravel(), sizes.astype("<u4"), *planes]
    return _HEAD.pack(b"RPG1", len(docs), len(rules), len(ends), len(seq)) + b"".join(p.tobytes() for p in parts)


class Shard:
    """A payload opened for reading."""

    def __init__(self, payload: bytes):
        magic, n_docs, n_rules, n_rounds, n_symbols = _HEAD.unpack_from(payload)
        if magic != b"RPG1":
            raise ValueError("not a token grammar shard")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        self.ends = take("<u4", n_rounds).tolist()
        self.docs, self.null, self.lengths = take("<i8", n_docs), take("u1", n_docs).astype(bool), take("<u4", n_docs).astype(np.int64)
        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2).astype(np.int64)
        self.sizes = take("<u4", n_rules).astype(np.int64)
        self.symbols = sum(take("u1", n_symbols).astype(np.int64) << s for s in (0, 8, 16))

    def ids(self) -> np.ndarray:
        flat, start, size = expansions(self.rules, self.ends)
        return flat[ranges(start[self.symbols], size[self.symbols])]

    def part(self, first: int, n: int) -> np.ndarray:
        """ids first to first + n, from the symbols that cover them."""
        sizes = np.where(self.symbols < TERMINALS, 1, self.sizes[np.maximum(self.symbols - TERMINALS, 0)] if len(self.sizes) else 1)
        ends = np.cumsum(sizes)
        i, j = int(np.searchsorted(ends, first, "right")), int(np.searchsorted(ends, first + n, "left")) + 1
        skip, out = first - int(ends[i - 1] if i else 0), []
        stack = self.symbols[i:j][::-1].tolist()
        while stack and len(out) < skip + n:
            s = stack.pop()
            if s < TERMINALS:
                out.append(s)
            else:
                stack += self.rules[s - TERMINALS][::-1].tolist()
        return np.array(out[skip : skip + n], np.int64)


class WordCoder:
    """Ids of whole texts from ids of their words, each word encoded once while it is remembered.

    Words are remembered as Arrow strings, so they are compared whole.
    """

    def __init__(self, path: str, remember: int = 2_000_000):
        from tokenizers import Tokenizer

        self.full = self._encoder(Tokenizer.from_file(path))
        # lower-case Latin letters pass the normaliser and the word splitter as they are
        with open(path, encoding="utf-8") as f:
            bare = json.load(f)
        bare |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}
        self.bare = self._encoder(Tokenizer.from_str(json.dumps(bare)))
        self.remember = remember
        self._forget()

    @staticmethod
    def _encoder(tokenizer):
        return getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)

    def _forget(self):
        self.known, self.place, self.size = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    def _learn(self, words: pa.Array) -> None:
        plain = pc.match_substring_regex(words, "^[a-z\u00df-\u00f6\u00f8-\u00ff]+$").to_numpy(zero_copy_only=False)
        found: list = [None] * len(words)
        for encode, which in ((self.bare, plain), (self.full, ~plain)):
            for i, e in zip(np.flatnonzero(which).tolist(), encode(words.filter(pa.array(which)).to_pylist(), add_special_tokens=False)):
                found[i] = e.ids
        size = np.fromiter(map(len, found), np.int64, len(found))
        total = int(size.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.int32)])
        self.pool[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), np.int32, total)
        self.known = pa.concat_arrays([self.known, words])
        self.place = np.concatenate([self.place, self.used + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.used += total

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number for each of the words.

        The tokenizer lowers case itself, so ASCII words are lowered before they are
        looked up; strings of special tokens are left alone.
        """
        plain = pc.and_(pc.string_is_ascii(words), pc.invert(pc.match_substring(words, "<|")))
        coded = pc.if_else(plain, pc.ascii_lower(words), words).dictionary_encode()
        if len(self.known) > self.remember:
            self._forget()
        found = pc.index_in(coded.dictionary, value_set=self.known)
        new = found.is_null().to_numpy(zero_copy_only=False)
        at = pc.fill_null(found, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if new.any():
            at[new] = len(self.known) + np.arange(int(new.sum()))
            self._learn(coded.dictionary.filter(pa.array(new)))
        index = at[coded.indices.to_numpy(zero_copy_only=False)] if len(at) else at
        return self.pool[ranges(self.place[index], self.size[index])], self.size[index]

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts with the end id after each, and the number of ids of each."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        per_text = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        stopped = pc.match_substring_regex(coded.dictionary, STOPPED).to_numpy(zero_copy_only=False)
        cut = pc.if_else(pa.array(stopped), pc.utf8_slice_codeunits(coded.dictionary, 0, -1), coded.dictionary)
        stops = pc.utf8_slice_codeunits(coded.dictionary.filter(pa.array(stopped)), -1)
        flat, sizes = self.words(pa.concat_arrays([cut, stops]))
        starts = np.cumsum(sizes) - sizes
        n = len(coded.dictionary)
        stop = np.full(n, -1)
        stop[stopped] = n + np.arange(int(stopped.sum()))
        # words of each dictionary entry: itself and perhaps its stop; one more word, the end id, closes each text
        flat, starts, sizes = np.append(flat, np.int32(END)), np.append(starts, len(flat)), np.append(sizes, 1)
        total = per_text + 1
        last = np.cumsum(total) - 1
        index = np.full(int(total.sum()), len(sizes) - 1, np.int64)
        inner = np.ones(len(index), bool)
        inner[last] = False
        index[inner] = coded.indices.to_numpy(zero_copy_only=False)
        extra = np.append(np.append(stop, np.full(len(sizes) - 1 - n, -1)), -1)[index]
        two = 1 + (extra >= 0)
        at = np.cumsum(two) - two
        pieces = np.empty(int(two.sum()), np.int64)
        pieces[at] = index
        pieces[at[extra >= 0] + 1] = extra[extra >= 0]
        ids = flat[ranges(starts[pieces], sizes[pieces])]
        ends = np.cumsum(sizes[pieces])[(at + two - 1)[last]] if len(last) else last
        return ids, np.diff(np.concatenate([[0], ends]))


@lru_cache(2)
def coder(path: str) -> WordCoder:
    """One coder for each Python worker, so that its tasks share the words they remember."""
    return WordCoder(path)


def write(docs: DataFrame, path: str, tokenizer: str, parts: int) -> None:
    """Write the grammar table of docs to path."""

    def run(batches):
        import os

        from pyspark import TaskContext
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        model, part = coder(tokenizer), TaskContext.get().partitionId()
        shard, first, held, n = 0, 0, [], 0

        def row():
            nonlocal shard, first, held, n
            ids, doc, null, lengths = (np.concatenate(x) for x in zip(*held))
            out = [part, shard, first, len(ids), write_shard(ids, doc, null, lengths)]
            shard, first, held, n = shard + 1, first + len(ids), [], 0
            return pa.record_batch([pa.array([x]) for x in out], names=["part", "shard", "first", "n_tokens", "payload"]).cast(schema)

        for batch in batches:
            text = batch.column("text")
            size = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = [0, *(np.flatnonzero(np.diff(size // BATCH_BYTES)) + 1).tolist(), batch.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                ids, lengths = model.texts(text.slice(s, e - s))
                doc, null = numbers(batch.column("doc_id").slice(s, e - s)), batch.column("doc_id").slice(s, e - s).is_null().to_numpy(zero_copy_only=False)
                ends = np.cumsum(lengths)
                i = 0
                while i < len(lengths):
                    before = int(ends[i - 1]) if i else 0
                    j = max(i + 1, int(np.searchsorted(ends, before + SHARD - n, "right")))
                    held.append((ids[before : int(ends[j - 1])], doc[i:j], null[i:j], lengths[i:j]))
                    n, i = n + int(ends[j - 1]) - before, j
                    if n >= SHARD or j < len(lengths):
                        yield row()
        if held:
            yield row()

    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ordered.transform(arrow, run, FORMAT).write.option("compression", "zstd").parquet(path)


FORMAT = "part int, shard int, first long, n_tokens long, payload binary"


def _documents(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            shard = Shard(batch.column("payload")[i].as_py())
            raw = shard.ids().astype("<u4").tobytes()
            ends = np.cumsum(shard.lengths)
            starts = ends - shard.lengths
            sums = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
            n = len(ends)
            yield pa.record_batch(
                [
                    pa.array(shard.docs, mask=shard.null), pa.array(np.full(n, batch.column("part")[i].as_py(), np.int32)),
                    pa.array(starts + batch.column("first")[i].as_py()), pa.array(shard.lengths), pa.array(sums, pa.int64()),
                ],
                names=["doc_id", "part", "start", "n_tokens", "ids_crc32"],
            )


def read_documents(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files."""
    table = spark.read.schema(FORMAT).parquet(path)
    before, starts = 0, []
    # one row for each part; their number is the setting spark.sql.shuffle.partitions
    for part, n in sorted(map(tuple, table.groupBy("part").agg(F.sum("n_tokens")).collect())):
        starts.append((part, before))
        before += n
    bases = spark.createDataFrame(starts, "part int, base long")
    rows = table.transform(arrow, _documents, "doc_id long, part int, start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write docs, read the files back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = Work(spark, "tokens").path("grammar")
    write(docs, path, tokenizer, partitions(spark))
    return read_documents(spark, path)
