"""Plumbing shared by the operators: work folders, row keys, Arrow slabs and bucket blobs."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import io
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLAB_BYTES = 2 << 20
LAST_ID = (1 << 63) - 1


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local master (a test) gets a temporary folder and a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-work-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Work:
    """Intermediate tables below ``spark.checkpoint.dir``, which all executors share.

    A written table cuts the lineage, so a lost executor costs at most one step.  Spark
    deletes the shuffle files of a step when its table is written.  Tables go when they
    are dropped, and the folder goes when the program ends, as results read from it.
    """

    live: list[Work] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.tables: set[str] = set()
        Work.live.append(self)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    @contextlib.contextmanager
    def saving(self):
        """Settings for what is made and run inside: see ``_SAVING``."""
        before = {key: self.spark.conf.get(key, None) for key in _SAVING}
        try:
            for key, value in _SAVING.items():
                self.spark.conf.set(key, value)
            yield
        finally:
            for key, value in before.items():
                self.spark.conf.unset(key) if value is None else self.spark.conf.set(key, value)

    def save(self, df: DataFrame, table: str) -> DataFrame:
        with self.saving():
            df.write.option("compression", "zstd").parquet(self.path(table))
        self.tables.add(table)
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        """Delete tables that nothing reads any more."""
        for table in tables:
            self._delete(self.path(table))
        self.tables -= set(tables)

    def keep(self, *tables: str) -> None:
        """Delete all tables but these."""
        self.drop(*sorted(self.tables - set(tables)))

    def close(self) -> None:
        """Delete the folder: no result that reads from it is needed any more."""
        self._delete(self.root)
        Work.live.remove(self)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


@atexit.register
def _close_all() -> None:
    with contextlib.suppress(Py4JError, OSError):  # the JVM may be gone
        for work in list(Work.live):
            work.close()


#: Settings while a table is written: Spark deletes the shuffle files of a query that has ended, and Arrow batches are bounded in bytes.
_SAVING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) whose tasks give the memory they freed back to the system, as their worker lives on."""

    def returned(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # a function of the C library on Linux
        if trim:
            trim(0)

    return df.mapInArrow(returned, schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def named_rows(df: DataFrame, work: Work) -> DataFrame:
    """df with _llm_id, the id as a long (null: the largest), and _llm_tk, which together name a text.

    _llm_tk is 0 where all rows of an id have one text, else the text's 64-bit hash: texts of
    one id are mixed up only if all 64 bits agree, for n texts of an id at a chance of n * n / 2^65.
    The table of ids with several texts is joined by broadcast only if it is small.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    tk = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    several = df.groupBy(key.alias("_llm_id")).agg(F.min(tk).alias("a"), F.max(tk).alias("b")).where("a <> b").select("_llm_id", F.lit(True).alias("_llm_several"))
    several = work.save(several, "several")
    out = df.withColumn("_llm_id", key).join(several, "_llm_id", "left")
    return out.withColumn("_llm_tk", F.when(F.col("_llm_several"), tk).otherwise(F.lit(0).cast("long"))).drop("_llm_several")


def text_column(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an Arrow string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return offsets, data


def slabs(batch: pa.RecordBatch, text: str = "text", limit: int = SLAB_BYTES):
    """Cut a batch into runs of whole rows of about ``limit`` bytes: (first, last, offsets, bytes)."""
    offsets, data = text_column(batch.column(text))
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, n)
        yield first, last, offsets[first : last + 1] - offsets[first], data[offsets[first] : offsets[last]]
        first = last


def numbers(column, null: int = 0) -> np.ndarray:
    return pc.fill_null(column, null).to_numpy(zero_copy_only=False)


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays as one compressed Arrow stream."""
    batch = pa.record_batch({k: v if isinstance(v, pa.Array) else pa.array(v, pa.binary()) if v.dtype == object else pa.array(v) for k, v in arrays.items()})
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue()


def unpack(blob) -> dict[str, np.ndarray]:
    table = pa.ipc.open_stream(blob).read_all()
    return {k: table[k].to_numpy() for k in table.column_names}  # binary columns become arrays of objects


def bucket_rows(kind: int, buckets: np.ndarray, arrays: dict[str, np.ndarray]):
    """One (kind, bucket, blob) for each bucket that has entries."""
    order = np.argsort(buckets, kind="stable")
    found, starts = np.unique(buckets[order], return_index=True)
    ends = np.append(starts[1:], len(order))
    arrays = {k: v.take(pa.array(order)) if isinstance(v, pa.Array) else v[order] for k, v in arrays.items()}
    for b, s, e in zip(found.tolist(), starts.tolist(), ends.tolist()):
        yield kind, b, pack(**{k: v[s:e] for k, v in arrays.items()})


def by_bucket(batches):
    """Blobs of a partition that is sorted by (kind, bucket), joined bucket by bucket."""
    key, held = None, []
    for batch in batches:
        kinds, buckets, blobs = (batch.column(c) for c in ("kind", "bucket", "blob"))
        for k, b, blob in zip(kinds.to_pylist(), buckets.to_pylist(), blobs):
            if (k, b) != key:
                if held:
                    yield key[0], {c: np.concatenate([h[c] for h in held]) for c in held[0]}
                key, held = (k, b), []
            held.append(unpack(blob.as_buffer()))
    if held:
        yield key[0], {c: np.concatenate([h[c] for h in held]) for c in held[0]}


def exchange(df: DataFrame, n: int) -> DataFrame:
    """Bring the blobs of a bucket together: bucket b is partition b of n."""
    return df.repartitionById(n, F.col("bucket")).sortWithinPartitions("kind", "bucket")


BLOBS = "kind int, bucket int, blob binary"


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space."""
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)



_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, A-Z lowered: a sum of byte codes times powers of an odd number."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    first = np.cumsum(size) - size
    within = np.arange(int(size.sum())) - np.repeat(first, size)
    powers = np.cumprod(np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64))
    codes = _CODE[_LOWER[data[np.repeat(start, size) + within]]] * powers[within]
    return mix(np.add.reduceat(codes, first))


def word_slabs(batch, limit: int = 4 << 20):
    """Runs of whole rows of about ``limit`` bytes: first, last, text starts, bytes with a space after each text, word starts, ends, texts."""
    offsets, data = text_column(batch.column("text"))
    first, n = 0, len(offsets) - 1
    while first < n:
        last = min(n, max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1))
        piece = data[offsets[first] : offsets[last]]
        at = offsets[first : last + 1] - offsets[first]
        # a space between documents, so that no word crosses
        spaced = np.full(len(piece) + last - first, 0x20, np.uint8)
        spaced[np.arange(len(piece)) + np.repeat(np.arange(last - first), np.diff(at))] = piece
        at = at + np.arange(last - first + 1)
        start, end = word_spans(spaced)
        yield first, last, at, spaced, start, end, np.searchsorted(at, start, "right") - 1
        first = last


def run_starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """First index of each run of equal keys."""
    n = len(sorted_keys[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... of each range, concatenated."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths) + np.arange(total)
