"""Time and layout arithmetic, facade, streaming, Zarr and small catalogue cases."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridquorum import query
from gridquorum.functions import grid
from gridquorum.operators import catalog, merge, trust
from gridquorum.sources import zarr
from gridquorum.streaming import feeds


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_floor_arithmetic(spark):
    assert one(spark, grid.floor_div(F.lit(-7), 2), grid.ceil_div(F.lit(-7), 2), grid.floor_div(F.lit(7), 2), grid.samples_in(F.lit(-1), F.lit(5), 2, F.lit(1))) == (-4, -3, 3, 3)


def test_labels(spark):
    lo, hi = grid.label_bounds(F.lit("2024-01-01"), F.lit("2024-01-01"), 3600)
    _, exact = grid.label_bounds(F.lit("2024-01-01"), F.lit("2024-01-01T05:00:00"), 3600)
    a, b, c = one(spark, lo, hi, exact)
    assert b - a == 24 and c - a == 6


def test_text_functions(spark):
    got = one(spark, grid.duration_seconds(F.lit("7d")), grid.duration_seconds(F.lit("90")), grid.duration_seconds(F.lit("x")), grid.layout_id(F.array(F.lit("24"), F.lit("4")), F.lit(0), F.lit(6), F.lit(2)), grid.parse_link(F.lit("a+b")), grid.time_unit_seconds(F.lit("Hours since 1950-01-01")))
    assert got == (604800, 90, None, "24x4+0s6o2", ["a", "b"], 3600)


def test_coverage_counts(spark):
    rows = [("v", "l", "A", c, t, 1, 2, c * 2, c * 2 + 2) for c in (0, 1) for t in (0, 1)]
    schema = "var string, layout string, holder string, c long, t int, stride long, tile int, g0 long, g1 long"
    ask = (F.lit(-1).cast("long"), F.lit(5).cast("long"))
    count = lambda r: merge.coverage(spark.createDataFrame(r, schema), ask, 1, F.lit(0).cast("long"), (0, 4)).first()
    assert tuple(count(rows)) == ("v", 6, 4, 2)
    assert tuple(count(rows[:-1])) == ("v", 6, 2, 4)
    short = [r if r[4] else (*r[:8], r[7] + 1) if r[3] else r for r in rows]
    assert tuple(count(short)) == ("v", 6, 3, 3)


def test_votes(spark):
    schema = "holder string, var string, layout string, c long, t int, vcid string, nvalid long"
    chunk = lambda *v: spark.createDataFrame([(h, "v", "l", 0, 0, x, n) for h, x, n in v], schema)
    tell = lambda df, *trusted: tuple(merge.vote(df, trusted).select("status", "vcid").first())
    assert tell(chunk(("A", "x", 4))) == ("accepted", "x")
    assert tell(chunk(("A", "x", 4), ("B", "y", 4))) == ("contested", None)
    assert tell(chunk(("A", "x", 4), ("B", "y", 5))) == ("rival", "y")
    assert tell(chunk(("A", "x", 4), ("B", "y", 4), ("C", "y", 4))) == ("accepted", "y")
    assert tell(chunk(("A", "x", 4), ("B", "y", 4), ("C", "y", 4)), "A") == ("accepted", "x")


def test_union_is_order_invariant(spark):
    rows = spark.createDataFrame([(h, "v", g, 0, g * 10 + ord(h), float(g)) for h in "AB" for g in range(6) if (h, g) != ("A", 2)], "holder string, var string, g long, x int, cents long, value double")
    a = sorted(map(tuple, merge.gap_fill(rows, ["A", "B"]).collect()))
    b = sorted(map(tuple, merge.gap_fill(rows.orderBy(F.rand(3)), ["A", "B"]).collect()))
    assert a == b and [r[3] for r in a] == ["A", "A", "B", "A", "A", "A"]


def test_heads(spark):
    rows = spark.createDataFrame([("n", "g", i, s, r) for i, (s, r) in enumerate([(5, "a"), (4, "b"), (5, "a"), (5, "c")])], "node string, grid string, seen long, seq long, root string")
    assert sorted((r["seq"], r["fault"]) for r in trust.head_faults(rows).collect()) == [(4, "rollback"), (5, "equivocation")]


def test_upper_median(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (9.0,)], "r double")
    assert rows.agg(catalog.upper_median("r")).first()[0] == 3.0


def cells(spark):
    rows = [("A", "t2m", g, x, (g * 10 + x) * 100, float(g * 10 + x)) for g in range(48) for x in range(3)]
    return spark.createDataFrame(rows, "holder string, var string, g long, x int, cents long, value double")


def test_facade(spark):
    lat = spark.createDataFrame([(0, 50.0), (1, 55.0), (2, 60.0)], "i int, value double")
    ds = query.open_dataset(cells(spark), ["A"], coords={"x": lat})
    assert ds.variables == ["t2m"]
    assert ds.sel(time=("1970-01-01", "1970-01-01")).cells.count() == 72
    assert ds.sel(x=(60, 55)).cells.select("x").distinct().count() == 2
    assert ds.isel(x=0).step(6 * 3600).cells.count() == 8
    assert ds.isel(x=(1, 2)).mean("time").first()["value"] == np.mean([g * 10 + 1 for g in range(48)])
    assert ds.resample(86400).cells.count() == 6 and ds.rolling(3).cells.count() == 144
    assert ds.groupby("hour").count() == 72 and ds["t2m"].dropna().cells.count() == 144
    assert ds.progressive_mean(rel_err=0.5, min_chunks=1, samples=12).first()["of"] == 4
    with pytest.raises(ValueError):
        ds.step(1800)
    with pytest.raises(ValueError):
        ds.sel(x=(70, 80))


def test_growing_source(spark, tmp_path):
    source, keys = tmp_path / "in", ["var", "g"]
    schema = "var string, g long, value double"
    put = lambda rows, n: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / f"b{n}"))
    table, seen = feeds.VersionedTable(spark, str(tmp_path / "table")), []

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source))
        q = feeds.keep_current(stream, table, keys, str(tmp_path / "state"), lambda c, n: seen.append({r["g"]: r["change"] for r in c.collect()}))
        q.awaitTermination()

    put([("v", 1, 1.0), ("v", 2, 2.0)], 0)
    run()
    put([("v", 3, 3.0), ("v", 1, 9.0)], 1)
    run()
    assert seen == [{1: "new", 2: "new"}, {3: "new"}]
    now = {r["g"]: (r["value"], r["status"]) for r in table.read().collect()}
    assert now == {1: (1.0, "contested"), 2: (2.0, "accepted"), 3: (3.0, "accepted")}
    assert [r["g"] for r in feeds.newest(table.read(), 1).collect()] == [3]


def test_zarr_round_trip(spark, tmp_path):
    ds = query.open_dataset(cells(spark), ["A"])
    ds.to_zarr(str(tmp_path / "out"), "t2m", [48, 3], [24, 2])
    back = {tuple(r["idx"]): r["value"] for r in zarr.read_cells(spark, str(tmp_path / "out")).collect()}
    assert len(back) == 144 and back[47, 2] == 472.0
    report = zarr.scan(spark, str(tmp_path / "out")).first()
    assert (report["present"], report["expected"], report["dims"]) == (4, 4, ["time", "x"])


def test_zarr_v2_packed(spark, tmp_path):
    var = tmp_path / "g" / "t"
    var.mkdir(parents=True)
    (var / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [5], "chunks": [3], "dtype": "<i2", "compressor": {"id": "zlib"}, "fill_value": -9, "order": "C", "filters": None}))
    (var / ".zattrs").write_text(json.dumps({"scale_factor": 0.5, "add_offset": 1.0, "_FillValue": -9}))
    import zlib

    (var / "0").write_bytes(zlib.compress(np.array([2, -9, 0], "<i2").tobytes()))
    (var / "1").write_bytes(zlib.compress(np.array([4, 6, 7], "<i2").tobytes()))
    rows = {r["idx"][0]: r["value"] for r in zarr.read_cells(spark, str(tmp_path / "g")).collect()}
    assert rows == {0: 2.0, 1: None, 2: 1.0, 3: 3.0, 4: 4.0}


def test_time_axis():
    assert zarr.time_axis([0, 1, 2], "hours since 2024-01-01") == (3600, 0, 473352)
    assert zarr.time_axis([0.5, 1.5], "days since 2024-01-01")[:2] == (86400, 43200)
    for bad in ([0, 1, 3], [0]):
        with pytest.raises(ValueError):
            zarr.time_axis(bad, "days since 2024-01-01")
    with pytest.raises(ValueError):
        zarr.time_axis([0, 1], "months since 2024-01-01")
