"""The labelled-array facade: datasets over replicas, lazily, as DataFrames.

``open_dataset`` gives a :class:`Dataset` of cells (var, g, x..., value).  Selections are
filters that Catalyst pushes to the scan; reductions are hash aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions import grid
from .operators import aqp, merge


@dataclass(frozen=True)
class Dataset:
    """Cells with a time quantum q (seconds), a phase, and coordinate tables by dimension."""

    cells: DataFrame
    q: int = 3600
    rphase: int = 0
    dims: tuple[str, ...] = ("x",)
    coords: tuple[tuple[str, DataFrame], ...] = ()

    def _with(self, cells: DataFrame) -> Dataset:
        return replace(self, cells=cells)

    def __getitem__(self, names: str | Sequence[str]) -> Dataset:
        names = [names] if isinstance(names, str) else list(names)
        return self._with(self.cells.where(F.col("var").isin(names)))

    @property
    def variables(self) -> list[str]:
        return sorted(r[0] for r in self.cells.select("var").distinct().collect())

    def sel(self, time: tuple[str | None, str | None] | str | None = None, **box) -> Dataset:
        """Labels: a date covers its day; coordinate bounds come in either order and may be open."""
        rows = self.cells
        if time is not None:
            t0, t1 = (time, time) if isinstance(time, str) else time
            if t0 is not None:
                rows = rows.where(F.col("g") >= grid.label_bounds(F.lit(t0), F.lit(t0), self.q, self.rphase)[0])
            if t1 is not None:
                rows = rows.where(F.col("g") < grid.label_bounds(F.lit(t1), F.lit(t1), self.q, self.rphase)[1])
        for dim, bounds in box.items():
            table = dict(self.coords)[dim]
            lo, hi = bounds if isinstance(bounds, (tuple, list)) else (bounds, bounds)
            if lo is not None and hi is not None and lo > hi:
                lo, hi = hi, lo
            inside = F.lit(True)
            if lo is not None:
                inside = inside & (F.col("value") >= lo)
            if hi is not None:
                inside = inside & (F.col("value") <= hi)
            ends = table.where(inside).agg(F.min("i"), F.max("i")).first()
            if ends[0] is None:
                raise ValueError(f"no {dim} between {lo} and {hi}")
            rows = rows.where((F.col(dim) >= ends[0]) & (F.col(dim) <= ends[1]))
        return self._with(rows)

    def isel(self, **box: tuple[int, int] | int) -> Dataset:
        """Half-open index boxes; a plain index selects one place."""
        rows = self.cells
        for dim, bounds in box.items():
            lo, hi = bounds if isinstance(bounds, (tuple, list)) else (bounds, bounds + 1)
            if lo < 0 or hi <= lo:
                raise ValueError(f"bounds of {dim} are out of order")
            rows = rows.where((F.col(dim) >= lo) & (F.col(dim) < hi))
        return self._with(rows)

    def step(self, seconds: int, offset: int = 0) -> Dataset:
        """Every sample of a coarser lattice; the step must be a multiple of the quantum."""
        if seconds % self.q:
            raise ValueError("the step is not a multiple of the time quantum")
        return self._with(self.cells.where(grid.on_lattice("g", F.lit(seconds // self.q), F.lit(offset))))

    def _reduce(self, over: Sequence[str] | str | None, f: Callable[[str], Column]) -> DataFrame:
        gone = {"time" if d == "g" else d for d in ([over] if isinstance(over, str) else over or ["time", *self.dims])}
        keep = ["var", *([] if "time" in gone else ["g"]), *[d for d in self.dims if d not in gone]]
        return self.cells.where(grid.valid("value")).groupBy(*keep).agg(f("value").alias("value"))

    def mean(self, over=None) -> DataFrame:
        return self._reduce(over, F.avg)

    def sum(self, over=None) -> DataFrame:
        return self._reduce(over, F.sum)

    def min(self, over=None) -> DataFrame:
        return self._reduce(over, F.min)

    def max(self, over=None) -> DataFrame:
        return self._reduce(over, F.max)

    def std(self, over=None) -> DataFrame:
        return self._reduce(over, F.stddev_pop)

    def count(self, over=None) -> DataFrame:
        return self._reduce(over, F.count)

    def dropna(self) -> Dataset:
        """Drop times at which a variable has no valid cell."""
        good = self.cells.where(grid.valid("value")).select("var", "g").distinct()
        return self._with(self.cells.join(good, ["var", "g"], "left_semi"))

    def resample(self, seconds: int, f: Callable[[str], Column] = F.avg) -> Dataset:
        every = seconds // self.q
        rows = self.cells.groupBy("var", (grid.floor_div(F.col("g"), every) * every).alias("g"), *self.dims).agg(f("value").alias("value"))
        return self._with(rows)

    def rolling(self, samples: int, f: Callable[[str], Column] = F.avg) -> Dataset:
        w = Window.partitionBy("var", *self.dims).orderBy("g").rangeBetween(1 - samples, 0)
        return self._with(self.cells.withColumn("value", f("value").over(w)))

    def groupby(self, unit: str, f: Callable[[str], Column] = F.avg) -> DataFrame:
        """By a calendar field of the time: hour, day, month, year and so on."""
        field = F.date_part(F.lit(unit), self.time).cast("int").alias(unit)
        return self.cells.groupBy("var", field, *self.dims).agg(f("value").alias("value"))

    @property
    def time(self) -> Column:
        return grid.quantum_time("g", self.q, self.rphase)

    def with_time(self) -> DataFrame:
        return self.cells.withColumn("time", self.time)

    def chunk_stats(self, samples: int) -> DataFrame:
        rows = self.cells.where(grid.valid("value"))
        return rows.groupBy("var", grid.floor_div(F.col("g"), samples).alias("c")).agg(F.sum("value").alias("s"), F.count("*").alias("n"))

    def progressive_mean(self, rel_err: float = 0.01, z: float = 1.96, min_chunks: int = 8, samples: int = 24) -> DataFrame:
        return aqp.progressive_mean(self.chunk_stats(samples), ["var"], ["c"], rel_err, z, min_chunks)

    def progressive_mean_vas(self, var: str, rel_err: float = 0.01, samples: int = 24, **kw) -> dict:
        means = self[var].chunk_stats(samples).select("c", (F.col("s") / F.col("n")).alias("mean"))
        return aqp.mean_vas(means, ["c"], rel_err, **kw)

    def to_parquet(self, path: str) -> None:
        self.cells.write.partitionBy("var").parquet(path)

    def to_zarr(self, root: str, var: str, shape: list[int], chunks: list[int], g0: int = 0) -> None:
        from .sources import zarr

        idx = F.array((F.col("g") - g0).cast("long"), *[F.col(d).cast("long") for d in self.dims])
        zarr.write_v3(self[var].cells.select(idx.alias("idx"), "value"), root, var, shape, chunks, ["time", *self.dims])


def open_dataset(replicas: DataFrame, priority: Sequence[str], q: int = 3600, rphase: int = 0, step: int | None = None, coords: dict[str, DataFrame] | None = None) -> Dataset:
    """The union of replicas as one data set; the first holder of priority that has a cell wins."""
    ds = Dataset(merge.gap_fill(replicas, priority).drop("holder"), q, rphase, coords=tuple((coords or {}).items()))
    return ds.step(step) if step else ds


def keys_for(chunks: DataFrame, var: str, g_lo: int, g_hi: int) -> DataFrame:
    """Keys of the chunks a request touches, without reading them; bounds reach the scan as filters."""
    hit = chunks.where((F.col("var") == var) & (F.col("g0") < g_hi) & (F.col("g1") > g_lo))
    return hit.select(F.concat(F.col("var"), F.lit("@"), F.col("layout"), F.lit("/"), F.concat_ws(".", "c", "t")).alias("key")).distinct()


def prefetch(ds: Dataset) -> int:
    """Read a selection into the cache and return its number of cells."""
    return ds.cells.persist().count()


def open_views(replicas: DataFrame, link: str, priority: Sequence[str], grid_column: str = "grid", **kw) -> dict[str, Dataset]:
    """One data set for each grid of a composite link such as ``a+b``, in its order."""
    names = dict.fromkeys(x.strip() for x in link.split("+") if x.strip())
    return {name: open_dataset(replicas.where(F.col(grid_column) == name).drop(grid_column), priority, **kw) for name in names}


def open_view(replicas: DataFrame, link: str, priority: Sequence[str], grid_column: str = "grid", **kw) -> Dataset:
    """The first grid of a link."""
    return next(iter(open_views(replicas, link, priority, grid_column, **kw).values()))


def mean_of(ds: Dataset, var: str, method: str = "vdc", rel_err: float = 0.01, samples: int = 24, **kw) -> dict:
    """An approximate mean by progressive (vdc) or variance-adaptive (vas) sampling: mean, ci95, chunks, of, exact."""
    if method == "vas":
        return ds.progressive_mean_vas(var, rel_err, samples, **kw)
    if method != "vdc":
        raise ValueError(f"no method {method!r}: vdc or vas")
    row = ds[var].progressive_mean(rel_err, samples=samples, **kw).first()
    if row is None:
        return {"mean": float("nan"), "ci95": float("inf"), "chunks": 0, "of": 0, "exact": True}
    return {k: row[k] for k in ("mean", "ci95", "chunks", "of", "exact")}


class VirtualStore:
    """Chunks of a data set in any layout, assembled on demand: the array store that readers of chunk keys see."""

    def __init__(self, ds: Dataset, ct: int, width: int, dim: str = "x"):
        self.ds, self.ct, self.width, self.dim = ds, ct, width, dim

    def chunks(self) -> DataFrame:
        """var, c, t, values in C order; null where no replica has the cell."""
        keys = {"c": grid.floor_div(F.col("g"), self.ct), "t": grid.floor_div(F.col(self.dim), self.width)}
        place = F.pmod("g", F.lit(self.ct)) * self.width + F.pmod(self.dim, F.lit(self.width))
        return merge.assemble(self.ds.cells.withColumns(keys), ["var", "c", "t"], place, self.ct * self.width, "value")

    def get(self, var: str, c: int, t: int) -> DataFrame:
        """One chunk; the bounds of its cells reach the scan."""
        inside = (F.col("g") >= c * self.ct) & (F.col("g") < (c + 1) * self.ct) & (F.col(self.dim) >= t * self.width) & (F.col(self.dim) < (t + 1) * self.width)
        near = self.ds[var]
        return VirtualStore(near._with(near.cells.where(inside)), self.ct, self.width, self.dim).chunks()


class Views:
    """Views by the snapshot (holder, etag) pairs they were built from, kept for ``ttl`` seconds."""

    def __init__(self, build: Callable, ttl: float = 30.0, clock: Callable[[], float] | None = None):
        import time

        self.build, self.ttl, self.clock, self.kept = build, ttl, clock or time.monotonic, {}

    def get(self, name: str, snapshot: dict[str, str]):
        """The view of a name: built anew if a holder's etag changed or the time is up."""
        now, state = self.clock(), frozenset(snapshot.items())
        held = self.kept.get(name)
        if held is None or held[0] != state or now - held[1] >= self.ttl:
            self.kept[name] = held = (state, now, self.build(name, snapshot))
        return held[2]
