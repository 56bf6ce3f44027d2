"""The pipeline's stages against brute force, and on null, empty and missing rows."""

from __future__ import annotations

import importlib.util
import os

import pytest
from pyspark.sql import functions as F
from test_documents import kept_brute

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not there")

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, clash string"


@pytest.fixture(scope="module")
def pipeline():
    import corpus_pipeline

    return corpus_pipeline


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def tables(spark, path, documents, labels, benchmark):
    for name, rows, schema in (("documents", documents, DOCUMENTS), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", benchmark, "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_empty_tables(spark, pipeline, tmp_path):
    assert pipeline.run(spark, tables(spark, tmp_path, [], [], [])).count() == 0


def test_null_and_odd_rows(spark, pipeline, tmp_path):
    long = " ".join(f"word{k}" for k in range(60_000))
    rows = [(None, None, None, None, None, None), (None, "", "en", "s", 0, "c"), (1, None, "en", "s", None, "c"), (2, "", None, "s", 0, "c"), (3, "one two", "en", None, 7, "c"), (3, "one two", "en", None, 7, "c")]
    rows += [(4, long, "en", "s", len(long), "c"), (5, long + " end", "en", "s", len(long) + 4, "c"), (6, "日本語 \x00 é", "ja", "s", 8, "c")]
    path = tables(spark, tmp_path, rows, [(1, 1, None), (None, 0, 0), (9, None, 1)], [(1, None), (None, "alone here"), (2, "")])
    out = pipeline.run(spark, path).collect()
    # 5 is a near copy of 4; 1 and 2 have the same empty text; rows without an id stay
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out) == [(False, 1), (False, 3), (False, 3), (False, 4), (False, 6), (True, 0), (True, 0)]
    assert all(r["restored"] for r in out)


def test_quality_keeps_what_the_scores_say(spark, pipeline, docs):
    from gridquorum.llm import cotraining

    kept = {r["doc_id"] for r in cotraining.scored(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()}
    assert {r["doc_id"] for r in pipeline.quality(spark, docs, SF).collect()} == kept


def test_near_duplicates_against_all_pairs(spark, pipeline):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id is not null").orderBy("doc_id").collect()
    ids = [r["doc_id"] for r in table]
    want = {ids[k] for k in kept_brute([r["text"] or "" for r in table])}
    got = {r["doc_id"] for r in pipeline.near_duplicates(spark, spark.createDataFrame(table), SF).collect()}
    assert got == want and len(want) < len(ids)


def test_near_duplicates_leave_the_disk_to_the_next_stage(spark, pipeline, docs):
    from gridquorum.llm.common import Work

    before = list(Work.live)
    out = pipeline.near_duplicates(spark, docs, SF)
    left = [t for w in Work.live if w not in before for t in os.listdir(w.root.removeprefix("file://"))]
    assert left == ["gone"] and 0 < out.count() < docs.count()


def test_near_duplicates_go_with_and_without_a_shuffle_of_the_texts(spark, pipeline, monkeypatch):
    from gridquorum.llm import simhash

    text = " ".join(f"word{k}" for k in range(50))
    rows = spark.createDataFrame([(7, text), (3, text), (None, text), (5, "other words"), (5, None)], "doc_id long, text string")
    want = [(False, 3), (False, 5), (False, 5), (True, 0)]
    for most, join in ((simhash.GONE, "BroadcastHashJoin"), (0, "SortMergeJoin")):
        monkeypatch.setattr(simhash, "GONE", most)
        if not most:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        try:
            out = pipeline.near_duplicates(spark, rows, SF)
            assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect()) == want
            assert join in out._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_repeated_text_against_all_strings(spark, pipeline, docs):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    first: dict[bytes, int] = {}
    for d, t in rows:
        raw = t.encode()
        for p in range(len(raw) - 49):
            first[raw[p : p + 50]] = min(first.get(raw[p : p + 50], d), d)
    want = {}
    for d, t in rows:
        raw = t.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < d:
                gone[p : p + 50] = b"\1" * 50
        out, at = [], 0
        for c in t:
            n = len(c.encode())
            if not all(gone[at : at + n]):
                out.append(c)
            at += n
        want[d] = "".join(out)
    got = {r["doc_id"]: (r["text"] or "", r["n_chars"]) for r in pipeline.repeated_text(spark, docs.withColumn("text", F.col("text")), SF).collect()}
    assert got == {d: (t, len(t)) for d, t in want.items()} and any(want[d] != t for d, t in rows)
