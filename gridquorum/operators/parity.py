"""Erasure-coded repair over GF(256): one parity row for each stripe, any k pieces restore.

Stripe arithmetic is integer Columns; field sums run inside Arrow batches of rows that are sorted
by stripe, one stripe of k members at a time, so a task holds a batch and a stripe.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grid

# fixed value: the field polynomial x^8 + x^4 + x^3 + x^2 + 1
POLYNOMIAL = 0x11D


def _tables() -> tuple[np.ndarray, np.ndarray]:
    powers, logs, x = np.zeros(510, np.int64), np.zeros(256, np.int64), 1
    for i in range(255):
        powers[i] = powers[i + 255] = x
        logs[x] = i
        x <<= 1
        if x & 0x100:
            x ^= POLYNOMIAL
    return powers, logs


_POWERS, _LOGS = _tables()


def multiply(a, b):
    """Product in the field, elementwise."""
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    return np.where((a == 0) | (b == 0), 0, _POWERS[_LOGS[a] + _LOGS[b]]).astype(np.uint8)


def inverse(a: int) -> int:
    if not a:
        raise ZeroDivisionError("0 has no inverse")
    return int(_POWERS[255 - _LOGS[a]])


def coefficient(row: int, member: int) -> int:
    """Entry of a Cauchy matrix: rows from 128 up, members below 128, so all squares are regular."""
    if not (0 <= member < 128 and 0 <= row < 128):
        raise ValueError("a stripe has at most 128 members and 128 rows")
    return inverse((128 + row) ^ member)


def encode(members: list[bytes], row: int) -> bytes:
    size = max(map(len, members), default=0)
    out = np.zeros(size, np.uint8)
    for i, m in enumerate(members):
        out[: len(m)] ^= multiply(coefficient(row, i), np.frombuffer(m, np.uint8))
    return out.tobytes()


def restore(known: dict[int, bytes], parity: dict[int, bytes], k: int, sizes: list[int]) -> list[bytes]:
    """All k members from those known and as many parity rows as are missing (Gauss-Jordan)."""
    lost = [i for i in range(k) if i not in known]
    rows = sorted(parity)[: len(lost)]
    if len(rows) < len(lost):
        raise ValueError("too few pieces to restore the stripe")
    size = max(sizes, default=0)
    matrix = np.array([[coefficient(r, i) for i in lost] for r in rows], np.uint8).reshape(len(lost), len(lost))
    right = np.zeros((len(lost), size), np.uint8)
    for n, r in enumerate(rows):
        blob = np.frombuffer(parity[r], np.uint8)
        right[n, : len(blob)] = blob[:size]
        for i, m in known.items():
            right[n, : len(m)] ^= multiply(coefficient(r, i), np.frombuffer(m, np.uint8))
    for c in range(len(lost)):
        pivot = next(r for r in range(c, len(lost)) if matrix[r, c])
        matrix[[c, pivot]], right[[c, pivot]] = matrix[[pivot, c]], right[[pivot, c]]
        scale = inverse(int(matrix[c, c]))
        matrix[c], right[c] = multiply(scale, matrix[c]), multiply(scale, right[c])
        for r in range(len(lost)):
            if r != c and matrix[r, c]:
                by = int(matrix[r, c])
                matrix[r] ^= multiply(by, matrix[c])
                right[r] ^= multiply(by, right[c])
    found = dict(known) | {i: right[n].tobytes()[: sizes[i]] for n, i in enumerate(lost)}
    return [found[i] for i in range(k)]


def stripes(chunks: DataFrame, k: int, order: str, offset: int = 0) -> DataFrame:
    """stripe and member of each chunk number: members of a stripe stand D = ceil(N / k) apart, so
    a lost run of chunks spreads over many stripes."""
    n = F.broadcast(chunks.agg((F.max(order) + 1).alias("_n")))
    d = grid.ceil_div(F.col("_n"), k)
    at = F.col(order) + offset
    out = chunks.crossJoin(n).withColumn("stripe", F.pmod(at, d)).withColumn("member", F.pmod(grid.floor_div(at, d), F.lit(k)))
    return out.drop("_n")


def _stripe_frames(frames):
    """(stripe, its rows) of a partition that is sorted by stripe."""
    rest = None
    for pdf in frames:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        cuts = [0, *(np.flatnonzero(np.diff(pdf["stripe"].to_numpy())) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield int(pdf["stripe"].iat[a]), pdf.iloc[a:b]
        rest = pdf.iloc[cuts[-1] :]
    if rest is not None and len(rest):
        yield int(rest["stripe"].iat[0]), rest


def _batches(rows, columns: list[str], size: int = 4096):
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)


def encode_stripes(members: DataFrame, *rows: int) -> DataFrame:
    """Parity blobs (stripe, row, blob) of each stripe from (stripe, member, payload), all rows in one pass."""

    def run(frames):
        def blobs():
            for stripe, pdf in _stripe_frames(frames):
                held = dict(zip(pdf["member"].tolist(), pdf["payload"].tolist()))
                whole = [held.get(i, b"") for i in range(max(held) + 1)]
                for row in rows:
                    yield stripe, row, encode(whole, row)

        yield from _batches(blobs(), ["stripe", "row", "blob"])

    near = members.select("stripe", "member", "payload").repartition("stripe").sortWithinPartitions("stripe")
    return near.mapInPandas(run, "stripe long, row int, blob binary")


def restore_stripes(members: DataFrame, parity: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """Payloads of all members of each stripe.

    members: stripe, member, payload of what is left; parity: stripe, row, blob; sizes: stripe, member, size of all.
    """
    part = members.select("stripe", F.lit("m").alias("kind"), F.col("member").cast("int").alias("i"), F.col("payload").alias("blob"), F.lit(0).alias("size"))
    part = part.unionByName(parity.select("stripe", F.lit("p").alias("kind"), F.col("row").alias("i"), "blob", F.lit(0).alias("size")))
    part = part.unionByName(sizes.select("stripe", F.lit("s").alias("kind"), F.col("member").cast("int").alias("i"), F.lit(None).cast("binary").alias("blob"), F.col("size").cast("int").alias("size")))

    def run(frames):
        def payloads():
            for stripe, pdf in _stripe_frames(frames):
                held: dict[str, dict] = {"m": {}, "p": {}, "s": {}}
                for kind, i, blob, size in zip(pdf["kind"].tolist(), pdf["i"].tolist(), pdf["blob"].tolist(), pdf["size"].tolist()):
                    held[kind][int(i)] = int(size) if kind == "s" else blob
                known = held["m"] | {i: b"" for i in range(k) if i not in held["s"]}
                got = restore(known, held["p"], k, [held["s"].get(i, 0) for i in range(k)])
                for i in sorted(held["s"]):
                    yield stripe, i, got[i]

        yield from _batches(payloads(), ["stripe", "member", "payload"])

    return part.repartition("stripe").sortWithinPartitions("stripe").mapInPandas(run, "stripe long, member int, payload binary")


def xor_stripes(members: DataFrame, value: str) -> DataFrame:
    """Plain XOR parity of integer payloads: a hash aggregate with map-side combine."""
    return members.groupBy("stripe").agg(F.bit_xor(value).alias("parity"), F.count("*").alias("members"))
