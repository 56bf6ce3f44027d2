"""The document operators against brute force, on rows that are null, empty, long, repeated, tied or absent."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from gridquorum.llm import cotraining, language_masks, piece_lattice, quality_rules, simhash, substring_dedup, token_grammar
from gridquorum.llm.common import Work, unpack, word_spans
from gridquorum.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _llm_id string, fp string, score double"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed: int = 1, n: int = 40) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8))) for _ in range(150)]
    say = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, base = say(30), say(60)
    texts = [say(rng.randint(1, 80)) for _ in range(n)]
    texts += [base, base, base + " tail", base.upper(), f"{say(9)}. {passage} {say(9)}", f"{say(5)}\n{passage}\n{passage}"]
    texts += ["", None, " \t\n", "word", "a b", "same same " * 300, "x" * 5000, say(4000), "# $ % | <b>\nline\nline\n\nline", "日本語 テキスト ▁   \x00 é"]
    rows = [(i * 3 % 101, t) for i, t in enumerate(texts)]
    rows += [rows[3], rows[-1], (rows[5][0], say(12)), (None, base), (None, None)]
    return [(d, t, "en", "s", None if t is None else len(t), "clash", "clash", 1.0) for d, t in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 3: substring dedup


def cut_brute(rows):
    last = (1 << 63) - 1
    first: dict[bytes, int] = {}
    for d, t, *_ in rows:
        raw, d = (t or "").encode(), last if d is None else d
        for p in range(len(raw) - 49):
            w = raw[p : p + 50]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, t, *_ in rows:
        raw, key = (t or "").encode(), last if d is None else d
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < key:
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return Counter(out)


def test_substrings(docs, rows, empty):
    assert Counter(map(tuple, substring_dedup.digest(docs).collect())) == cut_brute(rows)
    assert substring_dedup.digest(empty).count() == 0


def test_a_crowded_trigger(spark):
    rng = random.Random(4)
    line = "this very common line of fifty bytes and a few stands in all of them"
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(70)) + line + "".join(rng.choice("abcdefgh ") for _ in range(70))) for i in range(200)]
    got = substring_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert Counter(map(tuple, got)) == cut_brute(rows)


def test_texts_of_one_id_are_told_apart(spark):
    # two texts whose 64-bit hashes agree in 31 bits, under one null id
    a, b = "text 10917", "text 36592"
    assert (xxhash.xxh64_intdigest(a, 42) ^ xxhash.xxh64_intdigest(b, 42)) & 0x7FFFFFFF == 0
    names = substring_dedup.named_rows(spark.createDataFrame([(None, a), (None, b), (4, a), (4, a)], "doc_id long, text string"), Work(spark, "names")).collect()
    assert len({(r["_llm_id"], r["_llm_tk"]) for r in names}) == 3

    rng = random.Random(14)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line = say(65)
    rows = [(1, line)] + [(None, say(40) + line + say(k)) for k in range(30, 60)]
    got = substring_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == cut_brute(rows)


def test_long_texts_are_cut(spark):
    rng = random.Random(15)
    base = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    rows = [(1, base), (2, base[100_000:] + "xyz" * 50), (3, "z" + base[:50]), (4, base[:49])]
    got = substring_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == cut_brute(rows)


def test_cut_keeps_columns_and_characters(docs):
    out = substring_dedup.cut(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("n_chars <> length(text)").count() == 0


# 5: SimHash


def fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    said = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in said]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, rows, empty):
    fps = [fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    want = Counter((r[0], f"{fps[i]:016x}", least.get(find(i))) for i, r in enumerate(rows))
    assert Counter(map(tuple, simhash.digest(docs).collect())) == want
    assert simhash.digest(empty).count() == 0


def test_near_copies_go(spark, docs, rows, empty):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    first: dict[str, int] = {}
    for d, t, *_ in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    assert None in ids and ids <= {None, *first.values()}
    assert simhash.keep_first(empty).count() == 0

    rng = random.Random(8)
    say = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]
    texts, copies = [say(300) for _ in range(60)], {}
    for k in range(40):
        words = list(texts[k])
        for _ in range(2):  # two changed words of 300: similarity of about 0.93
            words[rng.randrange(300)] = "changed"
        copies[len(texts)] = k
        texts.append(words)
    near = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    left = {r["doc_id"] for r in simhash.keep_first(near).collect()}
    assert left >= set(range(60)) and len(left - set(range(60))) <= 1


def test_index_finds_every_link():
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 4)).astype(np.uint64)) for _ in range(400)], np.uint64)
    fps = np.unique(np.concatenate([seeds, seeds[rng.integers(0, 40, 400)] ^ flips]))
    fps = fps[np.argsort(simhash.gray_rank(fps))]
    i, j = simhash.linked(fps)
    label = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    for _ in range(len(fps)):
        label = np.where(near, label[None, :], len(fps)).min(axis=1)
    mine = np.arange(len(fps))
    mine[i] = j
    assert np.array_equal(mine, label)


def test_masks_below_cover_all_bits():
    for mask in simhash._below(0):
        parts = simhash._below(mask)
        assert len(parts) == 4 and (parts[0] | parts[1] | parts[2] | parts[3]) == (1 << 64) - 1


# 1: token files


def test_token_files(docs, rows, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    coder = Tokenizer.from_file(path)
    got = sorted(map(tuple, token_grammar.digest(docs, path).collect()), key=lambda r: r[1])
    ids = {t: [*coder.encode(t or "", add_special_tokens=False).ids, 2] for _, t, *_ in rows}
    want = Counter((d, len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes())) for d, t, *_ in rows)
    assert Counter((r[0], r[2], r[3]) for r in got) == want
    place = 0
    for r in got:
        assert r[1] == place
        place += r[2]
    order = [-1 if r[0] is None else r[0] for r in got]
    assert order == sorted(order)
    assert token_grammar.digest(empty, path).count() == 0


def test_shards_read_anywhere():
    rng = np.random.default_rng(0)
    ids = np.concatenate([np.tile(rng.integers(0, 49408, 50), 60), rng.integers(0, 30, 3000), np.zeros(999, int)])
    payload = token_grammar.write_shard(ids, np.array([1, 2]), np.array([False, True]), np.array([10, len(ids) - 10]))
    shard = token_grammar.Shard(payload)
    assert np.array_equal(shard.ids(), ids) and len(shard.symbols) < len(ids) / 2
    for first, n in ((0, 1), (17, 300), (len(ids) - 5, 5), (2990, 40)):
        assert np.array_equal(shard.part(first, n), ids[first : first + n])


def test_nothing_frequent_is_left():
    rng = np.random.default_rng(4)
    phrase = rng.integers(0, 49408, 700)
    ids = np.concatenate([np.concatenate([phrase, rng.integers(0, 49408, rng.integers(1, 9))]) for _ in range(90)] + [np.zeros(5000, int)])
    seq, rules, ends = token_grammar.compress(ids)
    flat, start, size = token_grammar.expansions(rules, ends)
    assert np.array_equal(flat[token_grammar.ranges(start[seq], size[seq])], ids)
    pairs, n = np.unique(np.stack([seq[:-1], seq[1:]], axis=1), axis=0, return_counts=True)
    # a run of one symbol holds half as many pairs as neighbours
    assert all(k < token_grammar.LEAST for (a, b), k in zip(pairs.tolist(), n.tolist()) if a != b)
    assert len(seq) < len(ids) / 50 and size.max() >= 700


def test_words_are_cut_as_the_tokenizer_cuts_them():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    full, mine = Tokenizer.from_file(path), token_grammar.WordCoder(path)
    letters = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000 and (chr(c).isalpha() or c < 0x3000)]
    texts = ["\u0130.", "hello, \u0130STANBUL\u0130.", *(f"{c}. a{c}, {c}b." for c in letters)]
    ids, sizes = mine.texts(pa.array(texts))
    want = [[*e.ids, 2] for e in full.encode_batch(texts, add_special_tokens=False)]
    ends = np.cumsum(sizes)
    wrong = [t for t, w, s, e in zip(texts, want, (ends - sizes).tolist(), ends.tolist()) if ids[s:e].tolist() != w]
    assert not wrong


# 2: languages


def test_languages_are_told_apart(spark):
    rng = random.Random(3)
    words = {"aa": ["bona", "rema", "tola", "lami"], "bb": ["strick", "krund", "schwel", "pfort"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(rng.randint(3, 60))), k) for i in range(240) for k in [rng.choice(["aa", "bb"])]]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 !!", "aa"), (903, "bona rema tola", None), (None, "krund schwel", "bb"), (0, *rows[0][1:])]
    got = language_masks.held_out(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(240))
    assert sum(by[i]["lang_pred"] == k for i, _, k in rows[:240]) >= 238
    assert [by[i]["lang_pred"] for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "aa", "bb"]
    assert all(0 <= r["score"] <= 1 for r in got)

    model = language_masks.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = [(1, "zzqq xxvv", 5), (2, "\U0001f600\U0001f601\U0001f602", 5), (3, "\U00020000\U00020001", 5), (4, "bona " * 300_000, 5), (5, "\u0301 12", 5), (6, None, 5)]
    told = {r["doc_id"]: r for r in language_masks.predict(spark.createDataFrame(odd, "doc_id long, text string, fp int"), model).collect()}
    usual = max(("aa", "bb"), key=lambda k: (sum(x == k and t is not None for _, t, x in rows), k == "aa"))
    assert [told[i]["lang_pred"] for i in range(1, 7)] == [usual, "und", usual, "aa", "und", "und"]
    assert all(r["fp"] == 5 for r in told.values())


def test_many_languages(spark):
    rng = random.Random(30)
    names = [f"l{k:03d}" for k in range(90)]  # more than one mask word
    words = {k: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for k in names}
    rows = [(i, " ".join(rng.choice(words[names[i % 90]]) for _ in range(30)), names[i % 90]) for i in range(900)]
    got = language_masks.held_out(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sum(r["lang_pred"] == names[r["doc_id"] % 90] for r in got) >= 890


def test_no_languages(spark):
    rows = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in language_masks.held_out(rows).collect()] == ["und"]
    assert language_masks.held_out(rows.limit(0)).count() == 0


# 10: rules


def test_rules(spark, docs, rows, empty):
    labels = spark.createDataFrame([(3, 1, 0), (6, 1, 0), (6, 1, None), (9, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.judged(docs, labels)
    want = []
    for d, t, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        often, under, seen, twice = Counter(windows), set(), set(), 0
        for i, x in enumerate(windows):
            if often[x] > 1:
                under.update(range(i, i + 8))
        for line in t.split("\n"):
            if WORD.search(line):
                twice += line in seen
                seen.add(line)
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), twice, len(under), len(w) < 20 or 100 * len(under) > 30 * len(w)))
    fields = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert Counter(tuple(r[f] for f in fields) for r in got.collect()) == Counter(want)
    assert got.where("base_failed and kept").count() == 0
    assert quality_rules.judged(empty, labels).count() == 0
    assert quality_rules.judged(docs, labels.limit(0)).where("not base_failed and not kept").count() == 0


def test_the_verdict(spark, docs, rows):
    """The likelihood ratio in plain Python, over words in place of bins."""
    rng = random.Random(31)
    good, bad = [["".join(rng.choice(letters) for _ in range(5)) for _ in range(60)] for letters in ("abcdefghij", "klmnopqrst")]
    own = [(i, " ".join(rng.choice(bad if i % 5 == 4 else good) for _ in range(rng.randint(25, 90)))) for i in range(300)] + [(300, None), (301, good[0]), (2, "word " * 30)]
    marks = [(i, 1, 1 if i == 11 else 0) for i in range(0, 150, 3) if i % 5 != 4] + [(21, 0, 0), (4, 1, 1), (9, None, None)]
    d, labels = spark.createDataFrame(own, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")

    def bins(t):
        data = np.frombuffer((t or "").encode(), np.uint8)
        w = [(t or "").encode().split()[k].lower() for k in range(len((t or "").split()))]
        h = [int(quality_rules.word_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0]) for x in w]
        assert len(w) <= len(data)
        mixed = lambda x: int(quality_rules.mix(np.array([x], np.uint64))[0])
        pairs = [mixed((a * 0xC2B2AE3D27D4EB4F + b) % (1 << 64)) for a, b in zip(h, h[1:])]
        return [x >> 50 for x in h + pairs]

    by_id: dict[int, list] = {}
    for i, q, t in marks:
        by_id.setdefault(i, []).append((q, t))
    trusted = {i for i, v in by_id.items() if min([q for q, _ in v if q is not None], default=0) == 1 and max(t or 0 for _, t in v) == 0}
    grams = [(i, bins(t)) for i, t in own]
    raw, target = Counter(), Counter()
    for i, g in grams:
        raw.update(g)
        if i in trusted:
            target.update(g)
    n = quality_rules.BINS
    value = lambda b: np.log((target[b] + 1) / (target.total() + n)) - np.log((raw[b] + 1) / (raw.total() + n))
    scores = [(i, sum(map(value, g)) / len(g) if g else 0.0) for i, g in grams]
    own_scores = [s for (i, s), (_, t) in zip(scores, own) if i in trusted and t]
    least = np.mean(own_scores) - quality_rules.SPREADS * np.std(own_scores)
    got = quality_rules.judged(d, labels).collect()
    want = Counter((i, round(s, 9), len((t or "").split()) >= 20 and s >= least) for (i, s), (_, t) in zip(scores, own) if t != "word " * 30)
    assert Counter((r["doc_id"], round(r["score"], 9), r["kept"]) for r in got if not (r["doc_id"] == 2 and r["n_repeat_words"])) == want
    assert 0 < sum(k for _, _, k in want) < 280


def test_ratio_counts_match_words():
    data = np.frombuffer(b"The cat THE  cat\nsat", np.uint8)
    start, end = word_spans(data)
    h = quality_rules.word_hashes(data, start, end)
    assert len(h) == 5 and h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 3
    bins, of = quality_rules.gram_bins(h, np.array([0, 0, 0, 0, 1]))
    assert len(bins) == 5 + 3 and np.bincount(of).tolist() == [7, 1]


# 7: co-training


def test_classifier(spark, docs, empty):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(10, 60))]
        rows.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words[:3] * 9), "en", "s1" if good else rng.choice(["s1", "s2"])))
        if i % 2:
            labels.append((i, int(good)))
    d, known = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r["doc_id"]: r for r in cotraining.scored(d, known).collect()}
    assert sum(got[i]["kept"] == ("!!" not in t) for i, t, *_ in rows) >= 396
    assert cotraining.keep_good(d, known).columns == d.columns
    assert cotraining.scored(docs, known).count() == docs.count()
    assert cotraining.scored(empty, known).count() == 0
    flat = cotraining.scored(d, known.where("quality = 1")).select("score", "kept").distinct().collect()
    assert [tuple(r) for r in flat] == [(0.5, True)]


def test_pseudo_labels_help():
    """Words that no labelled document has are learnt from the metadata, and are all that the last documents have."""
    rng = np.random.default_rng(5)

    def rows(n, bins, source):
        good = rng.random(n) < 0.6
        text = rng.normal(0, 0.02, (n, cotraining.TEXT))
        for b, sign in bins:
            text[:, cotraining.SHAPES + b] += np.where(good, sign, -sign) * 0.1
        meta = [(None, None, None) if not source else (s, "en", (s, "en")) for s in np.where(good ^ (rng.random(n) < 0.02), "clean", "spam")]
        return text, meta, good.astype(float)

    labelled, pool, last = rows(400, [(0, 1), (1, -1)], True), rows(1500, [(0, 1), (1, -1), (2, 1), (3, -1)], True), rows(500, [(2, 1), (3, -1)], False)
    # the text view learns no bin that stands still in its labelled rows
    text = np.concatenate([labelled[0], pool[0]])
    meta, label = labelled[1] + pool[1], np.concatenate([labelled[2], np.full(1500, np.nan)])
    right = {}
    for rounds in (0, cotraining.ROUNDS):
        model = cotraining.Model(text, meta, label, rounds)
        right[rounds] = ((model.scores(last[0], last[1])[0] >= 0.5) == last[2]).mean()
    assert right[0] < 0.6 and right[cotraining.ROUNDS] > 0.85 and min(model.given) > 100


def test_a_view_that_tells_nothing_gives_nothing():
    rng = np.random.default_rng(6)
    label = np.append((rng.random(600) < 0.7).astype(float), np.full(600, np.nan))
    text = rng.normal(0, 1, (1200, cotraining.TEXT))
    text[:, 0] = np.where(np.isnan(label), rng.choice([-3, 3], 1200), np.where(label == 1, 3, -3))
    model = cotraining.Model(text, [("s", "en", ("s", "en"))] * 1200, label)
    assert model.given[1] == 0 and model.given[0] > 0


# 4: pieces


@pytest.fixture(scope="module")
def pieces():
    return piece_lattice.Pieces(tokenizer_path("piece_bpe_32k.model"))


def path_brute(pieces, known, text):
    chars = [" ", *text] if text else []
    best, back = [0.0] + [None] * len(chars), [None] * (len(chars) + 1)
    for j in range(1, len(chars) + 1):
        for n in range(1, min(16, j) + 1):
            part = chars[j - n : j]
            if " " in part[1:]:
                continue
            name = "".join("▁" if c == " " else "\0\0" if c == "▁" else c for c in part)
            piece = known.get(name)
            if piece is None and n > 1:
                continue
            value = best[j - n] + (pieces.unknown if piece is None else pieces.scores[piece])
            if best[j] is None or value >= best[j]:
                best[j], back[j] = value, (n, piece)
    out, j = [], len(chars)
    while j:
        n, piece = back[j]
        out = ([int(pieces.byte[b]) for b in chars[j - 1].encode()] if piece is None else [piece]) + out
        j -= n
    return out


def test_pieces(docs, rows, empty, pieces):
    known = {pieces.texts[i]: i for i in np.flatnonzero(pieces.usable).tolist()}
    out = piece_lattice.encoded(docs, tokenizer_path("piece_bpe_32k.model")).cache()
    assert out.where("not restored").count() == 0
    want = Counter((d, tuple(path_brute(pieces, known, t or ""))) for d, t, *_ in rows)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in out.collect()) == want
    back = piece_lattice.decoded(out, tokenizer_path("piece_bpe_32k.model"))
    assert Counter(map(tuple, back.collect())) == Counter((d, t or "") for d, t, *_ in rows)
    assert piece_lattice.encoded(empty, tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_both_lattices_give_a_word_the_same_pieces(spark, pieces, monkeypatch):
    rng = random.Random(16)
    words = ["".join(rng.choice("etaoinsé日 ▁\n") for _ in range(rng.randint(1, 12))) for _ in range(120)]
    rows = [(i, " ".join(rng.choices(words, range(120, 0, -1), k=rng.randint(1, 300)))) for i in range(60)] + [(70, "x" * 3000 + " " + "ab" * 40), (71, "▁ ▁▁"), (None, None), (72, "")]
    docs, path = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, word int"), tokenizer_path("piece_bpe_32k.model")
    known = piece_lattice.vocabulary(docs, path, Work(spark, "words"))
    assert 50 < len(known.names)
    alone = {(r["doc_id"], tuple(r["ids"])) for r in piece_lattice.encoded(docs, path).collect()}
    monkeypatch.setattr(piece_lattice, "vocabulary", lambda *_: piece_lattice.NOTHING)
    assert alone == {(r["doc_id"], tuple(r["ids"])) for r in piece_lattice.encoded(docs, path).collect()}
    every = {pieces.texts[i]: i for i in np.flatnonzero(pieces.usable).tolist()}
    assert alone == {(d, tuple(path_brute(pieces, every, t or ""))) for d, t in rows}


def test_the_relational_lattice_agrees(spark, pieces):
    words = ["▁the", "▁tokenizers", "▁naïve", "▁日本語", "▁xq😀z", "▁aaaaaaaaaaaaaaaaaaaaaaaaa"]
    table = piece_lattice.piece_table(spark, tokenizer_path("piece_bpe_32k.model"))
    got = {r["word"]: r["ids"] for r in piece_lattice.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), table, pieces.byte.tolist(), pieces.unknown).collect()}
    known = {pieces.texts[i]: i for i in np.flatnonzero(pieces.usable).tolist()}
    assert got == {w: path_brute(pieces, known, w[1:]) for w in words}


def kept_brute(texts):
    """Ids that stay: the smallest of each group of texts linked at a five-word Jaccard similarity of 0.8."""
    sets = []
    for t in texts:
        w = t.lower().split()
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)})
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return set(root)


def left_of(spark, texts):
    return {r["doc_id"] for r in simhash.keep_first(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}


def test_copies_that_a_smallest_id_hides(spark):
    rng = random.Random(11)
    say = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]
    # all have the fingerprint of the line; only the last two are near copies
    line, tail = " ".join(say(9) * 60), say(120)
    texts = [f"{line} {' '.join(say(120))}", f"{line} {' '.join(tail)}", f"{line} {' '.join(tail[:-4] + say(4))}"]
    assert kept_brute(texts) == {0, 1} == left_of(spark, texts)


def test_large_families(spark):
    rng = random.Random(12)
    say = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]
    texts = []
    for size in (150, 40, 3):
        base = say(100)
        for _ in range(size):  # pairs that differ in two words or fewer are linked
            words = list(base)
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(100)] = say(1)[0]
            texts.append(" ".join(words))
    rng.shuffle(texts)
    want = kept_brute(texts)
    assert 3 < len(want) < len(texts) and left_of(spark, texts) == want


def test_similarity_is_exact(spark):
    rng = random.Random(13)
    say = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]
    texts = []
    for k in range(40):  # shingle sets of 1000 and shared parts of 876 to 902: similarity of 0.78 to 0.82
        base, new = say(1004), 98 + 26 * (k % 2)
        texts += [" ".join(base), " ".join(base[:-new] + say(new))]
    want = kept_brute(texts)
    assert len(want) == 60 and left_of(spark, texts) == want


def test_passages_that_share_a_short_gram_are_not_shipped():
    rng = random.Random(5)
    word = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    grams, passage = [word(20) for _ in range(200)], word(70)
    texts = ["".join(word(80) + rng.choice(grams) for _ in range(20)) for _ in range(100)] + [word(60) + passage + word(60), word(61) + passage + word(59)]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int64()), pa.array(texts)], names=["_llm_id", "_llm_tk", "text"])
    sent = sorted((r for b in substring_dedup._parse(4)([batch]) for r in b.to_pylist()), key=lambda r: (r["kind"], r["bucket"]))
    out = [r for b in substring_dedup._settle(4)([pa.RecordBatch.from_pylist([r], pa.schema({"kind": pa.int32(), "bucket": pa.int32(), "blob": pa.binary()})) for r in sent]) for r in b.to_pylist()]
    candidates = Counter(d for r in out if r["kind"] == substring_dedup.CANDIDATE for d in unpack(pa.py_buffer(r["blob"]))["doc"].tolist())
    removed = {d for r in out if r["kind"] == substring_dedup.REMOVED for d in unpack(pa.py_buffer(r["blob"]))["doc"].tolist()}
    # only the passage of 70 bytes can hold a string of 50 twice
    assert sum(n for d, n in candidates.items() if d < 100) < 40
    assert {100, 101} <= candidates.keys() | removed


def test_members_of_crowded_buckets_return_links_not_pairs(spark, monkeypatch):
    rng, rows, save = random.Random(13), {}, Work.save
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(5, 9))) for _ in range(n))
    parts = [say(1300) for _ in range(8)]
    # any two share four of six parts at most, but their bit maps are too full to tell
    texts = [" ".join(parts[i] for i in of) for of in itertools.combinations(range(8), 5)]

    def counted(work, df, table):
        out = save(work, df, table)
        rows[table] = out.count()
        return out

    monkeypatch.setattr(Work, "save", counted)
    assert len(left_of(spark, texts)) == len(texts)
    assert rows["late"] <= len(texts)


def test_near_copies_meet_in_the_index(spark, monkeypatch):
    rng, found, links = random.Random(14), [], simhash.links
    say = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]
    texts = [say(600) for _ in range(20)]
    copies = [" ".join([*w[:300], "changed", *w[301:]]) for w in texts]

    def kept(fps, work):
        out = links(fps, work)
        found.append(out.count())
        return out

    monkeypatch.setattr(simhash, "links", kept)
    texts = [" ".join(w) for w in texts] + copies
    assert left_of(spark, texts) == kept_brute(texts) == set(range(20))
    assert len(found) == 1 and found[0] > 0


def test_a_bucket_without_a_shared_trigger():
    e = {"h": np.array([1, 2], np.uint32), "name": np.array([5, 6], np.uint64), "side": np.zeros(2, np.uint32)}
    assert substring_dedup._beside(e).tolist() == [False, False]
