"""Time, lattice, layout and chunk arithmetic as Column expressions.

Integer quanta g count from an epoch phase; a lattice (S, O) holds the g with
g = O mod S; a layout packs ``ct`` lattice samples into one chunk.  All divisions floor.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def floor_div(a, b) -> Column:
    """floor(a / b) of integers, exact for 64 bits."""
    a, b = col(a), col(b)
    return F.call_function("div", a - F.pmod(a, b), b).cast("long")


def ceil_div(a, b) -> Column:
    return -floor_div(-col(a), b)


def quantum(ts, q: int, rphase: int = 0) -> Column:
    """g of a timestamp: whole quanta of q seconds since the phase."""
    return floor_div(F.unix_seconds(col(ts).cast("timestamp")) - rphase, q)


def quantum_time(g, q: int, rphase: int = 0) -> Column:
    return F.timestamp_seconds(col(g) * q + rphase)


def best_quantum(step) -> Column:
    """Largest of day, hour, minute, second that divides a step of seconds."""
    step = col(step)
    return F.when(step % 86400 == 0, 86400).when(step % 3600 == 0, 3600).when(step % 60 == 0, 60).otherwise(1)


def on_lattice(g, stride, offset) -> Column:
    return F.pmod(col(g) - col(offset), col(stride)) == 0


def complete_for(stride, offset, view_stride, view_offset) -> Column:
    """A layout lattice holds every sample of a view lattice."""
    return (F.pmod(col(view_stride), col(stride)) == 0) & (F.pmod(col(view_offset) - col(offset), col(stride)) == 0)


def sample_index(g, stride, offset) -> Column:
    return floor_div(col(g) - col(offset), stride)


def chunk_index(g, ct, stride=1, offset=0, phase=0) -> Column:
    return floor_div(sample_index(g, stride, offset) - col(phase), ct)


def chunk_start(c, ct, stride=1, offset=0, phase=0) -> Column:
    return (col(c) * col(ct) + col(phase)) * col(stride) + col(offset)


def held_end(start, nvalid, stride=1) -> Column:
    """End of the held extent of a chunk with nvalid samples."""
    return col(start) + (col(nvalid) - 1) * col(stride) + 1


def samples_in(g_lo, g_hi, stride, offset) -> Column:
    """Number of lattice samples in [g_lo, g_hi)."""
    return ceil_div(col(g_hi) - col(offset), stride) - ceil_div(col(g_lo) - col(offset), stride)


def label_end(label) -> Column:
    """Exclusive end of a time label: a date covers its day, a timestamp is inclusive to the second."""
    label = col(label)
    at = F.unix_seconds(label.cast("timestamp"))
    return F.when(F.length(label) <= 10, at + 86400).otherwise(at + 1)


def label_bounds(t0, t1, q: int, rphase: int = 0) -> tuple[Column, Column]:
    """[g_lo, g_hi) of a label range."""
    return ceil_div(F.unix_seconds(col(t0).cast("timestamp")) - rphase, q), ceil_div(label_end(t1) - rphase, q)


def layout_id(chunks, phase, stride, offset) -> Column:
    """Such as ``24x8+0s6o0``; stride 1 and offset 0 are left out."""
    head = F.concat(F.concat_ws("x", col(chunks)), F.lit("+"), col(phase).cast("string"))
    return F.when((col(stride) == 1) & (col(offset) == 0), head).otherwise(F.concat(head, F.lit("s"), col(stride).cast("string"), F.lit("o"), col(offset).cast("string")))


def parse_key(key) -> Column:
    """var, layout and coordinates of a chunk key ``var@layout/i.j.k``; null where it is malformed."""
    key = col(key)
    ok = key.rlike(r"^[^@/]+@[^@/]+/-?\d+(\.-?\d+)*$")
    var, rest = F.split_part(key, F.lit("@"), F.lit(1)), F.split_part(key, F.lit("@"), F.lit(2))
    coord = F.transform(F.split(F.split_part(rest, F.lit("/"), F.lit(2)), r"\."), lambda x: x.cast("long"))
    return F.when(ok, F.struct(var.alias("var"), F.split_part(rest, F.lit("/"), F.lit(1)).alias("layout"), coord.alias("coord")))


def parse_link(link) -> Column:
    """The grids of a composite link joined by ``+``."""
    return F.filter(F.transform(F.split(col(link), r"\+"), lambda x: F.trim(x)), lambda x: x != "")


def duration_seconds(text) -> Column:
    """Seconds of ``7d``, ``12h``, ``30m``, ``45s`` or a bare number."""
    text = F.trim(col(text))
    n = F.regexp_extract(text, r"^(\d+)[dhms]?$", 1)
    unit = F.regexp_extract(text, r"([dhms])$", 1)
    scale = F.when(unit == "d", 86400).when(unit == "h", 3600).when(unit == "m", 60).otherwise(1)
    return F.when(n != "", n.try_cast("long") * scale)


def time_unit_seconds(units) -> Column:
    """Seconds per unit of a ``<unit>s since <date>`` attribute; null for anything else."""
    unit = F.regexp_extract(F.lower(col(units)), r"^(second|minute|hour|day)s? since ", 1)
    return F.when(unit == "second", 1).when(unit == "minute", 60).when(unit == "hour", 3600).when(unit == "day", 86400)


def valid(value, fill=None) -> Column:
    """Finite and not the fill value."""
    v = col(value)
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return ok if fill is None else ok & (v != F.lit(fill))


def t_quantile(z: float, df) -> Column:
    """Student quantile from the normal one by three Cornish-Fisher terms; df at least 1, normal beyond a million."""
    v = F.greatest(col(df).cast("double"), F.lit(1.0))
    a, b, c = (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    return F.when(v > 1e6, F.lit(float(z))).otherwise(F.lit(float(z)) + F.lit(a) / v + F.lit(b) / (v * v) + F.lit(c) / (v * v * v))


def bit_reversed(i, bits) -> Column:
    """i with its lowest bits in reverse order: the van der Corput order."""
    return F.conv(F.reverse(F.lpad(F.bin(col(i)), bits, "0")), 2, 10).cast("long")
