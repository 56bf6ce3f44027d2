"""The DataFrame-only operators and the pipeline."""

from __future__ import annotations

import importlib.util
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from sqlcheck import compare, connect

from gridquorum.llm import conversations, decontaminate, licenses
from gridquorum.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    compare(QUERIES[name](spark, SF), connect(SF), SQL[name])


def leaks_brute(rows, items):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for d, t in rows:
        w = words(t)
        for k, item in items:
            i = words(item)
            if not i:
                continue
            width = min(5, len(i))
            a = Counter(tuple(i[p : p + width]) for p in range(len(i) - width + 1))
            b = [tuple(w[p : p + width]) for p in range(len(w) - width + 1)]
            m = sum(a.values())
            best = 0.0
            for s in range(max(1, len(b) - m + 1)):
                c = Counter(b[s : s + m])
                both = sum((a & c).values())
                best = max(best, both / (m + sum(c.values()) - both)) if b else 0.0
            if best >= 0.8:
                out.add((d, k, round(best, 6)))
    return out


def test_leaks(spark):
    rng = random.Random(6)
    say = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(n))
    items = [(k, say(rng.randint(15, 40))) for k in range(12)] + [(50, "one two"), (51, ""), (52, None), (53, items_ := say(20)), (54, items_)]
    rows = []
    for d in range(60):
        item = items[rng.randrange(12)][1].split()
        if d % 3 == 0:
            rows.append((d, f"{say(20)} {' '.join(item)} {say(15)}"))
        elif d % 3 == 1:
            item[rng.randrange(len(item))] = "changed"
            rows.append((d, f"{say(5)}. {' '.join(item).upper()}! {say(30)}"))
        else:
            rows.append((d, say(60)))
    rows += [(100, None), (101, ""), (102, "One, two."), (103, items[0][1]), (103, items[0][1]), (None, items[1][1]), (104, say(3000) + " " + items_)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, similarity string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(docs, bench)
    assert {(r["doc_id"], r["item_id"], round(r["similarity"], 6)) for r in got.collect()} == leaks_brute(rows, items)
    assert got.where("doc_id = 103 and item_id = 0").count() == 2
    kept = decontaminate.keep_clean(docs, bench)
    bad = {d for d, _, _ in leaks_brute(rows, items)} - {None}
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(d for d, _ in rows if d not in bad)
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_leaks_under_one_null_id(spark):
    # the texts' hashes agree in 31 bits
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(None, "text 10917"), (None, "text 36592"), (None, item), (None, item + " twelve"), (7, item)]
    items = [(1, item), (2, "text 36592"), (3, "text 10917")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r["doc_id"], r["item_id"], round(r["similarity"], 6)) for r in decontaminate.leaks(docs, bench).collect())
    assert got == Counter({(None, 1, 1.0): 2, (None, 2, 1.0): 1, (None, 3, 1.0): 1, (7, 1, 1.0): 1})


def test_long_items(spark):
    rng = random.Random(21)
    hashes = [rng.getrandbits(64) - (1 << 63) for _ in range(900)] * 80  # 72,000, more than sixteen bits count
    want = sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hashes) > len(hashes))
    got = spark.createDataFrame([(hashes,)], "h array<long>").select(decontaminate.simhash(F.col("h"))).first()[0]
    assert got % (1 << 64) == want
    words = [f"w{k}" for k in range(2_000)]
    docs = spark.createDataFrame([(1, "before " * 9000 + " ".join(words) + " after" * 9000), (2, " ".join(words[:1_700])), (3, " ".join(words[:1_500]))], "doc_id long, text string")
    leaked = decontaminate.leaks(docs, spark.createDataFrame([(5, " ".join(words))], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["start"], round(r["similarity"], 3)) for r in sorted(leaked)] == [(1, 9000, 1.0), (2, 0, 0.85)]


def test_block_values_and_flips(spark):
    rng = random.Random(22)
    by_block = {}
    for r in decontaminate.flips(spark).collect():
        by_block.setdefault(r["block"], set()).add(r["flip"])
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, decontaminate.RADIUS)):
            b ^= 1 << bit
        met = [((a ^ b) >> first) & ((1 << width) - 1) in by_block[k] for k, (first, width) in enumerate(decontaminate._blocks())]
        assert any(met)


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "no"), (3, 1, "assistant", "no"), (4, 0, "user", "hi"), (4, 1, "assistant", "yes")]
    rows += [(5, None, None, None), (None, 0, "user", "other"), (None, 3, "user", "hi"), (None, 0, "user", "again"), (None, 0, "user", "again"), (6, 0, "user", "x" * 1_500_000)]
    rows += [(7, 0, "user", "a\n<|end|>\n<|user|>\nb"), (8, 0, "user", "a"), (8, 1, "user", "b"), (9, 0, "a|b", "<||")]
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], "conv_id long, turn long, role string, text string, rendered string, i int")
    out = conversations.rendered(df).collect()
    got = {r["conv_id"]: r for r in out if r["conv_id"] is not None}
    assert set(got) == {1, 3, 5, 6, 7, 8, 9} and got[1]["n_copies"] == 2 and got[3]["n_turns"] == 2
    assert got[1]["rendered"] == "<|user|>\nhi\n<|end|>\n<|assistant|>\nyes\n<|end|>\n" and got[5]["rendered"] == "<|unknown|>\n\n<|end|>\n"
    assert got[7]["rendered"] == "<|user|>\na\n<||end|>\n<||user|>\nb\n<|end|>\n" != got[8]["rendered"]
    assert got[9]["rendered"] == "<|a||b|>\n<|||\n<|end|>\n"
    # rows without an id: "hi" begins other conversations, equal rows are one
    assert sorted((r["rendered"], r["n_turns"]) for r in out if r["conv_id"] is None) == [("<|user|>\nagain\n<|end|>\n", 1), ("<|user|>\nother\n<|end|>\n", 1)]
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    compare(conversations.rendered(df), con, SQL["op8_maximal_chats"])
    assert conversations.rendered(df.limit(0)).count() == 0


def dice_brute(rows, templates):
    grams = lambda t: (lambda w: {f"{a} {b}" for a, b in zip(w, w[1:])})(re.findall(r"[^\W_]+", t.lower()))
    out = Counter()
    for d, t in rows:
        units = {frozenset(grams(u)) for u in (t or "").split("\n") + re.split(r"\n[ \t\r]*\n\s*", t or "") + [t or ""]}
        best = {}
        for name, template in templates:
            g = grams(template)
            for u in units:
                dice = 2 * len(u & g) / (len(u) + len(g)) if u and g else 0
                if dice >= licenses.ALIKE:
                    best.setdefault(name, {}).setdefault(u, []).append(dice)
        out.update((d, name, round(max(max(x) for x in v.values()), 9), len(v)) for name, v in best.items())
    return out


def test_licenses(spark):
    rng = random.Random(23)
    rows = [(1, "Text.\nReleased under the MIT license!\nmore"), (2, "Licensed under CC BY-NC 4.0"), (3, None), (4, ""), (5, "word"), (6, "released under a tree by the lake"), (None, licenses.TEMPLATES[4][1])]
    rows += [(7, licenses.TEMPLATES[4][1])] * 2 + [(8, "so " * 400_000 + "\n" + licenses.TEMPLATES[0][1])]
    for k in range(150):  # altered templates on both sides of the bound, some between other lines
        words = rng.choice(licenses.TEMPLATES)[1].split()
        for _ in range(rng.randint(0, max(1, len(words) // 5))):
            p = rng.randrange(len(words))
            words[p : p + rng.randint(0, 1)] = rng.choice([[], ["other"], ["permission", "granted"]])
        text = " ".join(words)
        rows.append((100 + k, rng.choice([text, f"First line.\n{text}\nlast", f"A paragraph.\n\n{text}\n \nAnother one of the same.", text.upper()])))
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, license string, a int")
    got = Counter((r["doc_id"], r["license"], round(r["dice"], 9), r["n_units"]) for r in licenses.scan(docs).collect())
    assert got == dice_brute(rows, licenses.TEMPLATES) and len(got) > 80
    assert licenses.scan(docs.limit(0)).count() == 0


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not there")
def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = [{r["doc_id"] for r in docs.collect()}]
    for name, stage in p.STAGES[:-1]:
        before, docs = docs.columns, stage(spark, docs, SF).cache()
        assert docs.columns == before, name
        ids.append({r["doc_id"] for r in docs.collect()})
        assert ids[-1] <= ids[-2]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(labels[d] == (d in ids[1]) for d in labels) >= 0.97 * len(labels)
    assert ids[3] == ids[2]
    out = p.run(spark, SF)
    assert {r["doc_id"] for r in out.where("restored").collect()} == ids[-1] and out.count() == len(ids[-1])


def test_documents_shorter_than_an_item(spark):
    rng = random.Random(7)
    say = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(n))
    items = [(k, say(n)) for k, n in enumerate((24, 38, 59))]
    # cut copies of items with 20, 34 and 55 shingles
    cut = lambda k, n: " ".join(items[k][1].split()[: n + 4])
    rows = list(enumerate(cut(k, n) for k, sizes in enumerate(((15, 16, 17, 18), (27, 28, 30, 31), (43, 44, 48, 50))) for n in sizes))
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = leaks_brute(rows, items)
    assert len(want) == 9 and {(r["doc_id"], r["item_id"], round(r["similarity"], 6)) for r in got.collect()} == want
