"""Views, votes, contracts, interval differences, page trees and Zarr codecs on small cases."""

from __future__ import annotations

import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridquorum import query
from gridquorum.operators import catalog, identity, merge, paging
from gridquorum.sources import tables, zarr
from gridquorum.streaming import feeds


def test_views_are_built_anew_when_a_holder_changes_or_time_is_up():
    now, built = [0.0], []
    views = query.Views(lambda name, snapshot: built.append((name, dict(snapshot))) or len(built), 30, lambda: now[0])
    assert [views.get("v", {"a": "1"}), views.get("v", {"a": "1"}), views.get("w", {"a": "1"})] == [1, 1, 2]
    assert views.get("v", {"a": "2"}) == 3
    now[0] = 29.0
    assert views.get("v", {"a": "2"}) == 3
    now[0] = 30.0
    assert views.get("v", {"a": "2"}) == 4 and built[-1] == ("v", {"a": "2"})


def test_null_is_a_value_and_not_an_absent_key(spark):
    a = spark.createDataFrame([(1, 5), (2, None), (3, 7), (4, None), (5, 1)], "k int, v int")
    b = spark.createDataFrame([(1, None), (2, 6), (3, 7), (4, None), (6, None)], "k int, v int")
    got = {r["k"]: r["change"] for r in merge.key_changes(a, b, ["k"], "v").collect()}
    assert got == {1: "changed", 2: "changed", 5: "gone", 6: "new"}


def test_subtract_over_bucket_bounds(spark):
    rng = np.random.default_rng(2)
    held, asked = [], []
    for var in "pqr":
        at = np.sort(rng.choice(900, 60, replace=False)) - 300
        held += [(var, int(x), int(y)) for x, y in zip(at[::2], at[1::2])]
        asked.append((var, -320 + int(rng.integers(0, 50)), 500))
    frame = lambda rows: spark.createDataFrame(rows, "var string, g0 long, g1 long")
    got = {(r["var"], g) for r in merge.subtract(frame(asked), frame(held), ["var"], 100).collect() for g in range(r["g0"], r["g1"])}
    want = {(v, g) for v, a, b in asked for g in range(a, b)} - {(v, g) for v, a, b in held for g in range(a, b)}
    assert got == want
    runs = merge.subtract(frame([("z", -250, 250)]), frame([("p", 0, 1)]), ["var"], 100).collect()
    assert [tuple(r) for r in runs] == [("z", -250, 250)]


def test_majorities(spark):
    rows = spark.createDataFrame([("v", "b", False), ("v", "b", False), ("v", "a", False), ("v", "a", False), ("w", "x", False), ("w", "x", False), ("w", "y", True)], "var string, fid string, own boolean")
    tell = lambda **kw: {r["var"]: (r["fid"], r["votes"], r["values"]) for r in merge.majority(rows, ["var"], "fid", **kw).collect()}
    assert tell() == {"v": ("a", 2, 2), "w": ("x", 2, 2)}
    assert tell(last_wins=True)["v"] == ("b", 2, 2) and tell(own="own")["w"] == ("y", 1, 2)


def test_relays_share_their_capacity(spark):
    holders = spark.createDataFrame([(1, "r", 6.0), (2, "r", 2.0), (3, None, 9.0), (4, "s", 1.0)], "holder int, relay string, rate double")
    relays = spark.createDataFrame([("r", 4.0), ("s", 4.0)], "relay string, capacity double")
    assert {r["holder"]: r["capped"] for r in catalog.relayed_rates(holders, relays).collect()} == {1: 3.0, 2: 1.0, 3: 9.0, 4: 1.0}


def test_contracts_are_bound_or_told_why_not(spark):
    grids = spark.createDataFrame([("g", "t", 2, "K")], "grid string, variable string, version int, units string")
    rows = [("g", "t", 2, "K", True, 0.1, 0.04), ("g", "t", 1, "K", True, 0.1, 0.04), ("g", "t", 2, None, True, 0.1, 0.04), ("g", "t", 2, "K", None, 0.1, 0.04), ("g", "t", 2, "K", True, 0.1, 0.05), ("g", "t", 2, "K", True, 0.0, 0.04), ("g", "u", 2, "K", True, 0.1, 0.04)]
    made = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "i int, grid string, variable string, version int, units string, sig_ok boolean, step double, max_error double")
    assert [r["reason"] for r in identity.bound_contracts(made, grids).orderBy("i").collect()] == [None, "version", "units", "signature", "step", "step", "grid"]


def test_page_trees_end_in_one_root_and_change_along_one_path(spark):
    rows = [("v", k, f"v/{k:05d}", f"id{k}") for k in range(600)]
    schema = "var string, c long, key string, vcid string"

    def nodes(rows):
        paged = paging.pages(spark.createDataFrame(rows, schema), ["var"], ["c"], "key", 4)
        return paging.tree(paging.page_table(paged, ["var"], "key", "vcid"), ["var"], 4).collect()

    a, b = nodes(rows), nodes([*rows[:300], (*rows[300][:3], "other"), *rows[301:]])
    top = max(r["level"] for r in a)
    assert top > 2 and [(r["first"], r["last"]) for r in a if r["level"] == top] == [("v/00000", "v/00599")]
    for level in range(1, top + 1):
        assert sum(r["entries"] for r in a if r["level"] == level) == sum(r["level"] == level - 1 for r in a)
    known = {r["hash"] for r in a}
    assert 1 <= sum(r["hash"] not in known for r in b if r["level"] == 0) <= 2
    assert sum(r["hash"] not in known for r in b) < len(b) / 4


def test_globs_skip_what_is_not_there(spark, tmp_path):
    for name in ("one", "two"):
        spark.range(3).write.parquet(str(tmp_path / name))
    assert tables.load(spark, [f"{tmp_path}/o*", f"{tmp_path}/none*", f"{tmp_path}/two", f"{tmp_path}/t*"], "id long").count() == 6
    assert tables.load(spark, [f"{tmp_path}/none*"], "id long").count() == 0


def cells(spark):
    rows = [("A", "t", g, x, g * 10 + x, float(g * 10 + x)) for g in range(-5, 20) for x in range(3) if (g, x) != (2, 1)]
    return spark.createDataFrame(rows, "holder string, var string, g long, x int, cents long, value double")


def test_virtual_chunks(spark):
    store = query.VirtualStore(query.open_dataset(cells(spark), ["A"]), 4, 2)
    assert store.get("t", 0, 0).first()["values"] == [0.0, 1.0, 10.0, 11.0, 20.0, None, 30.0, 31.0]
    assert store.get("t", -2, 1).first()["values"] == [None, None, None, None, None, None, -48.0, None]
    assert store.get("t", 9, 0).count() == 0 and store.chunks().count() == 14


def test_means(spark):
    ds = query.open_dataset(cells(spark), ["A"])
    for method in ("vdc", "vas"):
        r = query.mean_of(ds, "t", method, rel_err=0.0, samples=5)
        assert r["exact"] and r["chunks"] == r["of"] == 5
    assert query.mean_of(ds, "none")["chunks"] == 0
    with pytest.raises(ValueError):
        query.mean_of(ds, "t", "guess")


def test_a_stopped_stream_goes_on_where_it_was(spark, tmp_path):
    table, schema = feeds.VersionedTable(spark, str(tmp_path / "table")), "var string, g long, value double"

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return feeds.keep_current(stream, table, ["var", "g"], str(tmp_path / "state"))

    for n in range(3):
        spark.createDataFrame([("v", n, float(n))], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))
    paused = run()
    paused.stop()  # perhaps between two batches
    run().awaitTermination()
    assert sorted(r["g"] for r in table.read().collect()) == [0, 1, 2]
    before = table.versions()
    run().awaitTermination()
    assert table.versions() == before


def test_logs_are_folded(spark, tmp_path):
    table, schema = feeds.VersionedTable(spark, str(tmp_path / "table"), ["g"], most=3), "g long, value double, status string"
    for n in range(8):
        table.fold(n)
        table.write(spark.createDataFrame([(n % 3, float(n), "accepted"), (10 + n, 0.0, "accepted")], schema), n)
    assert {r["g"]: r["value"] for r in table.read().collect() if r["g"] < 3} == {0: 6.0, 1: 7.0, 2: 5.0}
    assert table.read().count() == 11 and table.versions() == [5, 6, 7]
    assert {r["g"]: r["value"] for r in table.read(before=7).collect() if r["g"] < 3} == {0: 6.0, 1: 4.0, 2: 5.0}


def test_follow_keeps_the_newest_window(spark, tmp_path):
    table, schema = feeds.VersionedTable(spark, str(tmp_path / "table")), "var string, g long, value double"
    for n, rows in enumerate([[("v", 1, 1.0), ("v", 5, 5.0), ("w", 2, 2.0)], [("v", 7, 7.0), ("v", 5, 9.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        feeds.follow(stream, str(tmp_path / "out"), 4, str(tmp_path / "state"), table, ["var", "g"]).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out" / "v=1")).collect())
    assert got == [("v", 5, 5.0, "contested"), ("v", 7, 7.0, "accepted"), ("w", 2, 2.0, "accepted")]


@pytest.mark.parametrize("place", ["start", "end"])
def test_shards_and_transposed_chunks(spark, tmp_path, place):
    values = np.arange(8 * 6, dtype="<i4").reshape(8, 6)
    var = tmp_path / "g" / "t"
    (var / "c" / "0").mkdir(parents=True)
    inner = [{"name": "transpose", "configuration": {"order": [1, 0]}}, {"name": "bytes", "configuration": {"endian": "big"}}, {"name": "gzip"}]
    shard = {"chunk_shape": [2, 3], "codecs": inner, "index_codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}], "index_location": place}
    doc = {"zarr_format": 3, "node_type": "array", "shape": [7, 6], "data_type": "int32", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [4, 6]}}, "fill_value": -1, "codecs": [{"name": "sharding_indexed", "configuration": shard}], "dimension_names": ["time", "x"]}
    (var / "zarr.json").write_text(json.dumps(doc))
    import gzip

    for s in range(2):
        index, body, head = [], b"", 68 if place == "start" else 0
        for r in range(2):
            for c in range(2):
                if (s, r, c) == (1, 0, 1):
                    index += [(1 << 64) - 1] * 2
                    continue
                raw = gzip.compress(values[4 * s + 2 * r : 4 * s + 2 * r + 2, 3 * c : 3 * c + 3].T.astype(">i4").tobytes())
                index += [head + len(body), len(raw)]
                body += raw
        table = np.array(index, "<u8").tobytes() + b"crc!"
        path = var / "c" / str(s) / "0"
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(table + body if place == "start" else body + table)
    got = {tuple(r["idx"]): r["value"] for r in zarr.read_cells(spark, str(tmp_path / "g")).collect()}
    want = {(i, j): float(-1 if 4 <= i < 6 and j > 2 else values[i, j]) for i in range(7) for j in range(6)}
    assert got == want


def test_value_ids_do_not_depend_on_the_codec(spark, tmp_path):
    values = np.array([[1.5, -2.0], [0.0, 9.0]])
    for name, codec, order, raw in (("plain", None, "C", values.tobytes()), ("packed", {"id": "zlib"}, "F", zlib.compress(values.T.tobytes()))):
        var = tmp_path / name / "t"
        var.mkdir(parents=True)
        (var / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [2, 2], "chunks": [2, 2], "dtype": "<f8", "compressor": codec, "fill_value": 0, "order": order, "filters": None}))
        (var / "0.0").write_bytes(raw)
    a, b = (zarr.chunk_ids(spark, str(tmp_path / name)).first() for name in ("plain", "packed"))
    assert a["vcid"] == b["vcid"] and a["cid"] != b["cid"] and a["coord"] == [0, 0] and a["size"] == 32


def test_false_blobs_are_rejected(spark):
    rows = spark.createDataFrame([("a", b"x"), ("b", b"y"), ("b", b"y")], "k string, payload binary").withColumn("cid", F.when(F.col("k") == "a", F.sha2(F.lit("z"), 256)).otherwise(F.sha2("payload", 256)))
    good, bad = catalog.stored_blobs(rows)
    assert [r["k"] for r in good.collect()] == ["b"] and [r["k"] for r in bad.collect()] == ["a"]
