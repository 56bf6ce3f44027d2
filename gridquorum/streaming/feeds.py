"""Growing sources, follow windows and versioned upserts as Structured Streaming.

Late and revised data are kept: a revision that breaks the known prefix becomes a
conflict row, it is not dropped by a watermark.  State tables are logs of changed keys, one
folder a batch, that ``foreachBatch`` writes, so a restart from the checkpoint repeats a batch
without harm and a batch costs its own keys, not the table's.  A query that is stopped goes
on from its checkpoint when it is started again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class VersionedTable:
    """A keyed table as a log: ``root/v=<n>`` has the rows that batch n changed, ``root/s=<n>`` all rows up to batch n.

    The newest row of a key counts.  After ``most`` batches the log is folded into a new snapshot and what it
    replaces is deleted.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str] | None = None, most: int = 16):
        self.spark, self.root, self.keys, self.most = spark, root.rstrip("/"), keys, most

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _whole(self, kind: str) -> list[int]:
        fs = self._fs()
        names = [x.getPath().getName() for x in fs.listStatus(self._path())] if fs.exists(self._path()) else []
        return sorted(int(n[2:]) for n in names if n.startswith(f"{kind}=") and fs.exists(self._path(f"{n}/_SUCCESS")))

    def versions(self) -> list[int]:
        """Batches in the log or in the snapshot it begins with."""
        return sorted({*self._whole("v"), *self._whole("s")[-1:]})

    def log(self, before: int | None = None) -> DataFrame | None:
        """All rows written before a batch, with their batch as _v."""
        fits = lambda v: before is None or v < before
        base = [v for v in self._whole("s") if fits(v)][-1:]
        parts = [(f"s={v}", v) for v in base] + [(f"v={v}", v) for v in self._whole("v") if fits(v) and v > (base[0] if base else -1)]
        out = None
        for name, v in parts:
            part = self.spark.read.parquet(f"{self.root}/{name}").withColumn("_v", F.lit(v))
            out = part if out is None else out.unionByName(part)
        return out

    def latest(self, log: DataFrame) -> DataFrame:
        """The newest row of each key of a log."""
        rest = [c for c in log.columns if c not in (*self.keys, "_v")]
        return log.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "_v").alias("_r")).select(*self.keys, "_r.*")

    def read(self, before: int | None = None) -> DataFrame | None:
        log = self.log(before)
        return None if log is None else self.latest(log)

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/v={version}")

    def fold(self, version: int) -> None:
        """Before a batch: put the log up to it into one snapshot if it is long."""
        old = [v for v in self._whole("v") if v < version]
        if len(old) >= self.most:
            self.read(version).write.mode("overwrite").parquet(f"{self.root}/s={old[-1]}")
            fs = self._fs()
            for name in [f"v={v}" for v in old] + [f"s={v}" for v in self._whole("s") if v < old[-1]]:
                fs.delete(self._path(name), True)


def upsert(known: DataFrame | None, batch: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """The keys that a batch adds or changes: keys, value, status, change (new or contested).

    A new key is added.  A later value within the tolerance confirms, any other makes the
    cell ``contested`` and keeps the value that was there.  Only known rows with keys of the batch are looked at.
    """
    fresh = batch.groupBy(*keys).agg(F.min("value").alias("_b"), F.max("value").alias("_c"))
    if known is None:
        both = fresh.select("*", F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("status"))
    else:
        both = fresh.join(known.select(*keys, "value", "status"), keys, "left")
    at = F.coalesce("value", "_b")
    clash = F.coalesce((F.abs(F.col("_b") - at) > tolerance) | (F.abs(F.col("_c") - at) > tolerance), F.lit(False))
    status = F.when(clash, "contested").otherwise("accepted")
    out = both.where(F.col("status").isNull() | (clash & (F.col("status") != "contested")))
    return out.select(*keys, at.alias("value"), status.alias("status"), F.when(F.col("status").isNull(), "new").otherwise("contested").alias("change"))


def keep_current(stream: DataFrame, table: VersionedTable, keys: list[str], checkpoint: str, changed: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Follow a growing source into the table; ``changed`` gets the keys of each batch with a new value."""
    table.keys = keys

    def batch(df: DataFrame, n: int) -> None:
        table.fold(n)
        log = table.log(before=n)
        known = None if log is None else table.latest(log.join(df.select(*keys).distinct(), keys, "left_semi"))
        delta = upsert(known, df, keys)
        table.write(delta.drop("change"), n)
        if changed:
            changed(delta.where("change = 'new'").select(*keys, "change"), n)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(cells: DataFrame, last: int, by: str = "var", at: str = "g") -> DataFrame:
    """The last quanta of each variable, ending at the newest sample anyone holds."""
    ends = cells.groupBy(by).agg(F.max(at).alias("_end"))
    return cells.join(F.broadcast(ends), by).where(F.col(at) > F.col("_end") - last).drop("_end")  # one row for each variable


def follow(stream: DataFrame, sink: str, last: int, checkpoint: str, table: VersionedTable, keys: list[str]) -> StreamingQuery:
    """Keep the newest window of each variable at ``sink`` up to date; the log is cut to the window before its keys are merged."""

    def changed(changes: DataFrame, n: int) -> None:
        table.latest(newest(table.log(), last)).write.mode("overwrite").parquet(f"{sink}/v={n}")

    return keep_current(stream, table, keys, checkpoint, changed)


def monotonic_heads(stream: DataFrame) -> DataFrame:
    """The highest sequence number of each node and grid so far."""
    return stream.groupBy("node", "grid").agg(F.max("seq").alias("seq"), F.max_by("root", "seq").alias("root"))


def windowed(stream: DataFrame, at: str, late: str, size: str, by: list[str], slide: str | None = None) -> DataFrame:
    """Event-time windows with a watermark, for users who want late rows dropped."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return stream.withWatermark(at, late).groupBy(w.alias("window"), *by).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, at: str, late: str, gap: str, by: list[str]) -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("session"), *by).agg(F.count("*").alias("n"))
