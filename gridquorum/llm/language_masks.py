"""Language identification by a bit-sliced Bloom filter over character n-grams.

Training.  From documents that a fold rule admits (text and non-null lang), up to an
expected ``SAMPLE`` of each language are taken by a hash of doc_id; the character
``GRAM``-grams of their words (letters, lower-cased, with word edges) are counted by
language, each under its own 64-bit hash.  A gram belongs to a language if it was seen
``LEAST`` times in it and its share there is at least ``KEEP`` of its largest share in
any language.

Filter.  Each of ``SLOTS`` slots holds a mask with one bit for each language, so one
lookup of a gram, the AND of the masks at its ``HASHES`` slots, returns all languages
that contain it.  Languages beyond 64 take further mask words.  The masks are made in
Spark; the driver gets SLOTS rows at most for each 64 languages, and no counts.

Decision.  For each language the popcount over the document's grams is corrected for
false positives: with fill rate f of its bit slice, p = f ** HASHES, and (hits - n p) /
(1 - p) grams are expected to be real.  The largest count wins, ties go to the
smaller language name; the score is the winner's part of the sum of the corrected
counts.  A text with letters but no known gram gets the language of the most training
documents, with their share as its score.

Cases.  Null text, text without a letter, or no training row at all: ``und`` with score 0.
Texts are read in slabs, a very long one as one slab.  Equal rows stay, a null id stays
null, other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, arrow, mix, run_starts, slabs

GRAM, HASHES, SAMPLE, LEAST, KEEP = 4, 2, 3000, 3, 0.5
SLOTS, PIECE, HELD = 1 << 21, 1 << 20, 1 << 21


def _letter_table() -> np.ndarray:
    """Lower-case code point of each letter, 0 for other characters."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_LETTERS: list[np.ndarray] = []


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the grams of concatenated texts, their document, and whether each document has a letter."""
    if not _LETTERS:
        _LETTERS.append(_letter_table())
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    ends = lead[offsets[1:]]
    code = _LETTERS[0][chars]
    doc = np.searchsorted(ends, np.arange(len(code)), "right")
    lettered = np.bincount(doc[code > 0], minlength=len(ends)) > 0
    n = len(code) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), lettered
    h = np.zeros(n, np.uint64)
    inner = np.ones(n, bool)
    for k in range(GRAM):
        part = code[k : k + n]
        h = h * np.uint64(0x100000001B3) + part
        if 0 < k < GRAM - 1:
            inner &= part > 0  # a word edge may stand first or last only
    inner &= (doc[:n] == doc[GRAM - 1 :]) & ((code[:n] > 0) | (code[GRAM - 1 :] > 0))
    return mix(h[inner] + np.uint64(1)), doc[:n][inner], lettered


@dataclass
class Masks:
    """A trained filter: masks (SLOTS x words), false-positive rates, and the language and share of the most documents."""

    langs: list[str]
    masks: np.ndarray
    wrong: np.ndarray
    usual: int = 0
    share: float = 0.0


def _counted(index: dict[str, int]):
    """(gram, lang, n) of the rows of a partition, the grams of about HELD characters at a time."""

    def run(batches):
        held, size = [], 0

        def counts():
            nonlocal held, size
            h, lang = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((h, lang))
            first = run_starts(h[order], lang[order])
            n = np.diff(np.append(first, len(order)))
            held, size = [], 0
            return pa.record_batch([pa.array(h[order][first].view(np.int64)), pa.array(lang[order][first]), pa.array(n.astype(np.int64))], names=["gram", "lang", "n"])

        for batch in batches:
            langs = np.array([index[x] for x in batch.column("lang").to_pylist()], np.int32)
            for i, j, offsets, data in slabs(batch, limit=PIECE):
                h, doc, _ = grams(data, offsets)
                held.append((h, langs[i:j][doc]))
                size += len(h)
                if size > HELD:
                    yield counts()
        if size:
            yield counts()

    return run


def _set_bits(batches):
    """(slot, word, mask) for each gram and its languages."""
    for batch in batches:
        h = batch.column("gram").to_numpy().view(np.uint64)
        lang = batch.column("lang").to_numpy()
        slot = np.concatenate(_slots(h))
        lang = np.concatenate([lang] * HASHES)
        yield pa.record_batch([pa.array(slot), pa.array(lang // 64), pa.array((np.uint64(1) << (lang % 64).astype(np.uint64)).view(np.int64))], names=["slot", "word", "mask"])


def train(docs: DataFrame, sample: int = SAMPLE) -> Masks:
    """The filter of docs (doc_id, text, lang)."""
    rows = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    langs = sorted(sizes)
    masks = np.zeros((SLOTS, max(1, (len(langs) + 63) // 64)), np.uint64)
    if not langs:
        return Masks([], masks, np.zeros(0))
    place = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    part = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, sample / sizes[lang]))])
    chosen = rows.where(place < part[F.col("lang")]).select("text", "lang")
    work = Work(docs.sparkSession, "languages")
    seen = chosen.transform(arrow, _counted({lang: k for k, lang in enumerate(langs)}), "gram long, lang int, n long")
    seen = work.save(seen.groupBy("gram", "lang").agg(F.sum("n").alias("n")), "seen")
    total = dict(map(tuple, seen.groupBy("lang").agg(F.sum("n")).collect()))  # one row for each language
    per = F.element_at(F.array(*[F.lit(float(max(total.get(k, 0), 1))) for k in range(len(langs))]), F.col("lang") + 1)
    shares = seen.select("gram", "lang", "n", (F.col("n") / per).alias("share"))
    most = shares.groupBy("gram").agg(F.max("share").alias("most"))
    member = shares.join(most, "gram").where((F.col("n") >= LEAST) & (F.col("share") >= KEEP * F.col("most"))).select("gram", "lang")
    bits = member.transform(arrow, _set_bits, "slot long, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask"))
    got = bits.toArrow()  # SLOTS rows at most for each mask word
    masks[got["slot"].to_numpy(), got["word"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    work.close()
    fill = np.array([((masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(langs))])
    usual = max(range(len(langs)), key=lambda k: (sizes[langs[k]], -k))
    return Masks(langs, masks, fill**HASHES, usual, sizes[langs[usual]] / sum(sizes.values()))


def _slots(h: np.ndarray) -> list[np.ndarray]:
    out = []
    for k in range(HASHES):
        out.append((mix(h * np.uint64(2 * k + 3) + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64))
    return out


def predict(docs: DataFrame, model: Masks) -> DataFrame:
    """docs (doc_id, text, and other columns that stay) with lang_pred and score in place of text."""
    kept = [c for c in docs.columns if c != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS words of 8 bytes for each 64 languages

    def run(batches):
        m = shared.value
        for batch in batches:
            names, scores = [], []
            for i, j, offsets, data in slabs(batch, limit=PIECE):
                h, doc, lettered = grams(data, offsets)
                if not m.langs:
                    names += ["und"] * (j - i)
                    scores.append(np.zeros(j - i))
                    continue
                a, *rest = _slots(h)
                mask = m.masks[a]
                for b in rest:
                    mask &= m.masks[b]
                n = np.bincount(doc, minlength=j - i)
                hits = np.stack([np.bincount(doc, (mask[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1), minlength=j - i) for k in range(len(m.langs))], axis=1)
                real = np.maximum((hits - n[:, None] * m.wrong) / (1 - np.minimum(m.wrong, 0.999)), 0)
                total = real.sum(axis=1)
                best = np.where(total > 0, real.argmax(axis=1), m.usual)
                score = np.where(total > 0, real.max(axis=1) / np.maximum(total, 1e-300), m.share)
                names += [m.langs[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist())]
                scores.append(np.where(lettered, score, 0.0))
            arrays = [batch.column(c) for c in kept] + [pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))]
            yield pa.record_batch(arrays, names=[*kept, "lang_pred", "score"])

    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*kept, "text").transform(arrow, run, schema)


def held_out(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learnt where crc32(doc_id) mod 3 is not 1."""
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", fold.alias("held_out"))
    return predict(rows.select("doc_id", "held_out", "text"), train(rows.where("not held_out")))
