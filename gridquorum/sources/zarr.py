"""Zarr v2 and v3 groups as chunk and cell rows, and cells as a Zarr v3 group.

Files are read by Spark's ``binaryFile`` source, so any file system it knows serves; one
row is one chunk file.  Metadata comes first and is small (one document for each array).
Codecs: bytes in either order, transpose, zlib, gzip, zstd, crc32c and shards of chunks with
these; others, blosc among them, raise.  Arrays are written through Arrow's file systems, so
a path may be local or a URI that Arrow knows.
"""

from __future__ import annotations

import gzip
import hashlib
import itertools
import json
import math
import uuid
import zlib

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: data types of the v3 format and the v2 codes they stand for
TYPES = {"bool": "|b1", "int8": "|i1", "int16": "<i2", "int32": "<i4", "int64": "<i8", "uint8": "|u1", "uint16": "<u2", "uint32": "<u4", "uint64": "<u8", "float32": "<f4", "float64": "<f8"}


def _fill(value, dtype: np.dtype):
    if isinstance(value, str):
        return np.array({"NaN": np.nan, "Infinity": np.inf, "-Infinity": -np.inf}[value], dtype)
    return np.array(0 if value is None else value, dtype)


def _pipeline(codecs: list[dict], dtype: str) -> dict:
    """Type, byte codecs, axis order and shard layout of a v3 codec list."""
    out = {"dtype": dtype, "codecs": [], "axes": None, "shard": None}
    for c in codecs:
        conf = c.get("configuration", {})
        if c["name"] == "bytes":
            out["dtype"] = out["dtype"].replace("<", ">") if conf.get("endian") == "big" else out["dtype"]
        elif c["name"] == "transpose":
            out["axes"] = conf["order"]
        elif c["name"] == "sharding_indexed":
            index = _pipeline(conf["index_codecs"], "<u8")
            out["shard"] = {"chunks": conf["chunk_shape"], "index": index, "first": conf.get("index_location", "end") == "start", "inner": _pipeline(conf["codecs"], dtype)}
        else:
            out["codecs"].append(c["name"])
    return out


def describe(doc: dict, attrs: dict | None = None) -> dict:
    """Shape, chunks, type, fill, codecs, separator, dimensions and attributes of an array document."""
    if doc.get("zarr_format") == 2:
        codec = doc["compressor"]["id"] if doc.get("compressor") else "raw"
        attrs = attrs or {}
        axes = list(range(len(doc["shape"])))[::-1] if doc.get("order") == "F" else None
        out = {"shape": doc["shape"], "chunks": doc["chunks"], "fill": doc.get("fill_value"), "prefix": "", "sep": doc.get("dimension_separator", "."), "dims": attrs.get("_ARRAY_DIMENSIONS"), "attrs": attrs}
        out |= {"dtype": doc["dtype"], "codecs": [codec], "axes": axes, "shard": None}
    else:
        grid_, key = doc["chunk_grid"]["configuration"], doc.get("chunk_key_encoding", {"name": "default"})
        default = key["name"] == "default"
        sep = key.get("configuration", {}).get("separator", "/" if default else ".")
        out = {"shape": doc["shape"], "chunks": grid_["chunk_shape"], "fill": doc.get("fill_value"), "prefix": "c" if default else "", "sep": sep, "dims": doc.get("dimension_names"), "attrs": doc.get("attributes", {})}
        out |= _pipeline(doc.get("codecs", []), TYPES[doc["data_type"]])
    if not out["dims"]:
        out["dims"] = None
    return out


def _unpack(raw: bytes, codecs: list[str]) -> bytes:
    for c in reversed(codecs):
        if c in ("raw", "crc32c"):
            raw = raw[:-4] if c == "crc32c" else raw
        elif c == "zlib":
            raw = zlib.decompress(raw)
        elif c == "gzip":
            raw = gzip.decompress(raw)
        elif c == "zstd":
            import zstandard

            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        else:
            raise ValueError(f"codec {c} is not supported")
    return raw


def decode(meta: dict, raw: bytes | None) -> np.ndarray:
    """One chunk or shard; a missing one is all fill."""
    dtype = np.dtype(meta["dtype"])
    if raw is None:
        return np.full(meta["chunks"], _fill(meta["fill"], dtype), dtype)
    if meta["shard"]:
        return _unshard(meta, raw)
    axes = meta["axes"] or list(range(len(meta["chunks"])))
    stored = np.frombuffer(_unpack(raw, meta["codecs"]), dtype).reshape([meta["chunks"][i] for i in axes])
    return stored.transpose(np.argsort(axes))


def _unshard(meta: dict, raw: bytes) -> np.ndarray:
    """A shard: chunks one after the other, and an index of their places, (offset, bytes) each."""
    shard = meta["shard"]
    counts = [n // c for n, c in zip(meta["chunks"], shard["chunks"])]
    size = 16 * math.prod(counts) + 4 * ("crc32c" in shard["index"]["codecs"])
    index = np.frombuffer(_unpack(raw[:size] if shard["first"] else raw[-size:], shard["index"]["codecs"]), "<u8").reshape(*counts, 2)
    inner = shard["inner"] | {"chunks": shard["chunks"], "fill": meta["fill"]}
    out = decode(meta, None).copy()
    for place in itertools.product(*map(range, counts)):
        at, n = (int(x) for x in index[place])
        if at != (1 << 64) - 1:  # fixed value of the format: no such chunk
            out[tuple(slice(p * c, (p + 1) * c) for p, c in zip(place, shard["chunks"]))] = decode(inner, raw[at : at + n])
    return out


def arrays(spark: SparkSession, path: str) -> dict[str, dict]:
    """Descriptions of the arrays of a flat group."""
    # file sources skip names with a leading dot, so metadata goes through the file system itself
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    docs = {}
    for status in store.listStatus(top):
        for name in (".zarray", ".zattrs", "zarr.json") if status.isDirectory() else ():
            doc = jvm.org.apache.hadoop.fs.Path(status.getPath(), name)
            if store.exists(doc):
                stream = store.open(doc)
                docs.setdefault(status.getPath().getName(), {})[name] = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                stream.close()
    out = {}
    for array, d in docs.items():
        doc = d.get("zarr.json") or d.get(".zarray")
        if doc and (doc.get("node_type") == "array" or ".zarray" in d):
            meta = describe(doc, d.get(".zattrs"))
            meta["dims"] = meta["dims"] or [f"{array}_dim{i}" for i in range(len(meta["shape"]))]
            out[array] = meta
    return out


def chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """var, coord, size, content of each chunk file that exists."""
    metas = arrays(spark, path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.where(~F.col("path").rlike(r"/(\.z[a-z]+|zarr\.json)$"))
    found = []
    for var, meta in sorted(metas.items()):
        pattern = f"/{var}/" + (meta["prefix"] + ("/" if meta["prefix"] and meta["sep"] == "/" else meta["sep"] if meta["prefix"] else "")).replace(".", r"\.") + r"(-?\d+(?:[./]\d+)*)$"
        key = F.regexp_extract("path", pattern, 1)
        found.append(F.when(key != "", F.struct(F.lit(var).alias("var"), F.transform(F.split(key, "[./]"), lambda x: x.cast("long")).alias("coord"))))
    if not found:
        return spark.createDataFrame([], "var string, coord array<long>, size long, content binary")
    return rows.withColumn("_k", F.coalesce(*found)).where("_k is not null").select("_k.var", "_k.coord", F.col("length").alias("size"), "content")


def read_cells(spark: SparkSession, path: str, variables: list[str] | None = None) -> DataFrame:
    """var, idx, value of the cells of the chunk files that exist; packed values come decoded, fill as null."""
    metas = {k: v for k, v in arrays(spark, path).items() if variables is None or k in variables}

    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples():
                meta = metas[r.var]
                values = decode(meta, r.content)
                start = [int(c) * s for c, s in zip(r.coord, meta["chunks"])]
                shape = [min(s, n - a) for s, n, a in zip(meta["chunks"], meta["shape"], start)]
                values = values[tuple(slice(0, n) for n in shape)]
                index = np.stack([g.ravel() for g in np.meshgrid(*[np.arange(a, a + n) for a, n in zip(start, shape)], indexing="ij")], axis=1) if shape else np.zeros((1, 0), int)
                flat = values.ravel().astype(float)
                fill = meta["attrs"].get("_FillValue")
                if fill is not None:
                    flat = np.where(values.ravel() == fill, np.nan, flat)
                flat = flat * meta["attrs"].get("scale_factor", 1.0) + meta["attrs"].get("add_offset", 0.0)
                yield pd.DataFrame({"var": r.var, "idx": list(index), "value": flat})

    return chunk_files(spark, path).where(F.col("var").isin(*metas)).select("var", "coord", "content").mapInPandas(run, "var string, idx array<long>, value double").withColumn("value", F.when(F.isnan("value"), None).otherwise(F.col("value")))


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Scan report: chunks present and expected, bytes, shape and layout of each array."""
    metas = arrays(spark, path)
    rows = [(k, [int(x) for x in m["shape"]], [int(x) for x in m["chunks"]], list(m["dims"]), m["dtype"], int(math.prod(-(-n // c) for n, c in zip(m["shape"], m["chunks"])))) for k, m in sorted(metas.items())]
    known = spark.createDataFrame(rows, "var string, shape array<long>, chunks array<long>, dims array<string>, dtype string, expected long")
    return known.join(chunk_files(spark, path).groupBy("var").agg(F.count("*").alias("present"), F.sum("size").alias("bytes")), "var", "left")


def chunk_ids(spark: SparkSession, path: str) -> DataFrame:
    """var, coord, size, cid, vcid of each chunk file: hashes of its bytes, and of type, shape and values, which are the same under any codec."""
    metas = arrays(spark, path)

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                values = np.ascontiguousarray(decode(metas[r.var], r.content))
                little = values.astype(values.dtype.newbyteorder("<"))
                name = hashlib.blake2b(f"{little.dtype.str}{values.shape}".encode(), digest_size=16)
                name.update(little.tobytes())
                out.append((r.var, list(r.coord), r.size_, hashlib.blake2b(r.content, digest_size=16).hexdigest(), name.hexdigest()))
            yield pd.DataFrame(out, columns=["var", "coord", "size", "cid", "vcid"])

    return chunk_files(spark, path).withColumnRenamed("size", "size_").mapInPandas(run, "var string, coord array<long>, size long, cid string, vcid string")


def _files(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def _put(store: fs.FileSystem, path: str, content: bytes) -> None:
    """Write under a name of its own, then rename, so that readers and repeated tasks never see half a file."""
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(part) as out:
        out.write(content)
    store.move(part, path)


def write_v3(cells: DataFrame, root: str, var: str, shape: list[int], chunks: list[int], dims: list[str], attrs: dict | None = None) -> DataFrame:
    """Cells (idx, value) as a v3 array of float64 at a path that the driver and executors share: chunk and cells of each file.

    Cells are grouped by chunk; each group writes one file.
    """
    store, base = _files(root)
    _put(store, f"{base}/zarr.json", json.dumps({"zarr_format": 3, "node_type": "group", "attributes": {}}).encode())
    doc = {"zarr_format": 3, "node_type": "array", "shape": shape, "data_type": "float64", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunks}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": "NaN", "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "zstd", "configuration": {"level": 1, "checksum": False}}], "dimension_names": dims, "attributes": attrs or {}}
    _put(store, f"{base}/{var}/zarr.json", json.dumps(doc).encode())

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        coord = [int(x) for x in pdf["_c"].iloc[0].split("/")]
        block = np.full(chunks, np.nan)
        at = np.stack(pdf["idx"].to_numpy()) - np.array(coord) * np.array(chunks)
        block[tuple(at.T)] = pdf["value"].to_numpy(float)
        here, base = _files(root)
        _put(here, f"{base}/{var}/c/{pdf['_c'].iloc[0]}", zstandard.ZstdCompressor(level=1).compress(block.astype("<f8").tobytes()))
        return pd.DataFrame({"chunk": [pdf["_c"].iloc[0]], "cells": [len(pdf)]})

    key = F.array_join(F.transform(F.arrays_zip(F.col("idx").alias("i"), F.array(*[F.lit(c) for c in chunks]).alias("n")), lambda p: F.floor(p["i"] / p["n"]).cast("string")), "/")
    written = cells.select("idx", "value", key.alias("_c")).groupBy("_c").applyInPandas(one, "chunk string, cells long")
    # one row for each file; they stand for the write itself
    return cells.sparkSession.createDataFrame(written.toPandas(), "chunk string, cells long")


def time_axis(values: list[float], units: str) -> tuple[int, int, int]:
    """(quantum, phase, first g) of a regular CF time axis; raises if it is irregular or too short."""
    scale = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
    word, _, since = units.partition(" since ")
    unit = word.strip().rstrip("s").lower()
    if unit not in scale or not since:
        raise ValueError(f"time units {units!r} are not supported")
    origin = np.datetime64(since.strip().replace(" ", "T").removesuffix("Z"), "s").astype(int)
    t = np.asarray(values, float) * scale[unit] + origin
    if len(t) < 2:
        raise ValueError("a time axis needs two samples")
    steps = np.diff(t)
    if np.abs(steps - steps[0]).max() > 1e-3 or steps[0] <= 0:
        raise ValueError("the time axis is irregular")
    step, first = int(round(steps[0])), int(round(t[0]))
    quantum = next(q for q in (86400, 3600, 60, 1) if step % q == 0)
    phase = first % quantum
    return quantum, phase, (first - phase) // quantum


def expected_keys(shape: list[int], chunks: list[int]) -> list[tuple[int, ...]]:
    return list(itertools.product(*[range(-(-n // c)) for n, c in zip(shape, chunks)]))
