"""Base quality rules and a hashed n-gram likelihood-ratio verdict.

Words are runs without ASCII white space.  A trusted target multinomial comes from
the documents labelled of good quality and not toxic, a raw multinomial from all
documents; both count word unigrams and bigrams (lower-cased A-Z) in ``BINS`` hash
bins with add-one smoothing.  A document's score is the sum over its n-grams of
log(target / raw), divided by their number.  The verdict keeps every document whose
score is at least ``SPREADS`` standard deviations below the mean score of the
trusted documents: no sampling, so equal texts always get equal verdicts.

Counting covers every document and every labelled document: each task adds its
texts to two vectors of BINS counts and sends those, so what is shipped is bounded
by tasks, not by texts or hot words.

Cases.  Null text has no words; n-grams of empty documents: score 0; without any
trusted document the verdict keeps all; several labels of one document: it is trusted
if none says bad or toxic and one says good; equal rows stay.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, arrow, mix, word_hashes, word_slabs

BINS, SPREADS = 1 << 14, 4.0
SYMBOLS = b"#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEAT = 8, 20, 30


def gram_bins(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the unigrams and bigrams of words, which stand in document order, and their documents."""
    pair = doc[1:] == doc[:-1]
    bigram = mix(words[:-1][pair] * np.uint64(0xC2B2AE3D27D4EB4F) + words[1:][pair])
    return (np.concatenate([words, bigram]) >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64), np.concatenate([doc, doc[1:][pair]])


def counts(texts: DataFrame) -> np.ndarray:
    """Number of n-grams of all texts in each bin."""

    def run(batches):
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            for _, _, _, data, start, end, doc in word_slabs(batch):
                total += np.bincount(gram_bins(word_hashes(data, start, end), doc)[0], minlength=BINS)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bin", "n"])

    out = np.zeros(BINS)
    # BINS rows at most
    for b, n in texts.select("text").transform(arrow, run, "bin int, n long").groupBy("bin").agg(F.sum("n")).collect():
        out[b] = n
    return out


def weights(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    return np.log((target + 1) / (target.sum() + BINS)) - np.log((raw + 1) / (raw.sum() + BINS))


def repeated_words(words: np.ndarray) -> int:
    """Words under a WINDOW-word window that is found twice or more in the text; exact.

    words: numbers of the text's words.  Windows get dense numbers by doubling: pairs of
    words, pairs of pairs, and so on, as in the building of a suffix array.
    """
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    names, size = words.astype(np.int64), 1
    while size < WINDOW:
        code = names[:-size] * (len(words) + 1) + names[size:]
        names, size = np.unique(code, return_inverse=True)[1], size * 2
    often = np.bincount(names)[names] > 1
    if not often.any():
        return 0
    gone = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(gone, at, 1)
    np.add.at(gone, at + WINDOW, -1)
    return int((np.cumsum(gone[:-1]) > 0).sum())


def _text_facts(raw: bytes) -> tuple[int, int]:
    seen, duplicates = set(), 0
    for line in raw.split(b"\n"):
        if line.strip(b" \t\n\x0b\x0c\r"):
            duplicates += line in seen
            seen.add(line)
    return duplicates, sum(raw.count(SYMBOLS[k : k + 1]) for k in range(len(SYMBOLS)))


def _scores(weight: np.ndarray):
    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score")}
            for i, j, at, data, start, end, doc in word_slabs(batch):
                n = j - i
                hashes = word_hashes(data, start, end)
                bins, of = gram_bins(hashes, doc)
                grams = np.bincount(of, minlength=n)
                score = np.bincount(of, weight[bins], minlength=n) / np.maximum(grams, 1)
                lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                words = np.bincount(doc, minlength=n)
                chars = np.bincount(doc, lead[end] - lead[start], minlength=n).astype(np.int64)
                bounds = np.concatenate([[0], np.cumsum(words)])
                whole = data.tobytes()
                repeats, facts = np.zeros(n, np.int64), []
                for k in range(n):
                    raw = whole[at[k] : at[k + 1] - 1]
                    facts.append(_text_facts(raw))
                    a, b = int(bounds[k]), int(bounds[k + 1])
                    if b - a > WINDOW:
                        # windows found twice have equal hashes; only then are the words themselves compared
                        h = hashes[a:b]
                        eight = h[: len(h) - 7].copy()
                        for s in range(1, WINDOW):
                            eight = eight * np.uint64(0x9E3779B97F4A7C15) + h[s : len(h) - 7 + s]
                        eight.sort()
                        if (eight[1:] == eight[:-1]).any():
                            numbers_of: dict[bytes, int] = {}
                            repeats[k] = repeated_words(np.array([numbers_of.setdefault(w, len(numbers_of)) for w in raw.split()], np.int64))
                for name, values in (("n_words", words), ("word_chars", chars), ("n_symbols", [f[1] for f in facts]), ("n_dup_lines", [f[0] for f in facts]), ("n_repeat_words", repeats), ("score", score)):
                    out[name].append(np.asarray(values))
            arrays = {k: np.concatenate(v) if v else np.zeros(0) for k, v in out.items()}
            kinds = [pa.array(arrays[k].astype(np.float64 if k == "score" else np.int64)) for k in out]
            yield pa.record_batch([batch.column("doc_id"), *kinds], names=["doc_id", *out])

    return run


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score."""
    work = Work(docs.sparkSession, "rules")
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 and t = 0 and doc_id is not null").select("doc_id")
    good = work.save(good, "good")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    raw, target = counts(rows), counts(rows.join(good, "doc_id", "left_semi"))
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"
    # figures without the labels, so that no text is shuffled
    facts = work.save(rows.transform(arrow, _scores(weights(target, raw)), schema), "facts")
    mean, spread = facts.join(good, "doc_id", "left_semi").where("n_words > 0").agg(F.avg("score"), F.stddev_pop("score")).first()
    least = -math.inf if mean is None else mean - SPREADS * spread
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return facts.withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("score") >= F.lit(least))).alias("kept"), "score"
    )
