"""Formats of modes, sizes, durations and unit names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def format_mode(mode: Column) -> Column:
    return F.lpad(F.conv(mode.bitwiseAND(0o7777).cast("string"), 10, 8), 4, "0")



def _decimals(x: Column, pattern: str, unit: str) -> Column:
    """x with the decimals of a pattern, the even one of two that are as near, and no marks between thousands."""
    return F.concat(F.call_function("format_number", x, F.lit(pattern)), F.lit(unit))


def _tenths(x: Column, unit: str) -> Column:
    return _decimals(x, "0.0", unit)


def format_micros(us: Column) -> Column:
    """850µs, 12.3ms, 4.6s; a dash for null."""
    return F.when(us.isNull(), "—").when(us < 1000, F.concat(us.cast("string"), F.lit("µs"))).when(us < 1_000_000, _tenths(us / 1e3, "ms")).otherwise(_tenths(us / 1e6, "s"))


def format_nanos(ns: Column) -> Column:
    """850ns, 1.7µs, 33.5ms, 4.6s; a dash for null or 0, which stand for unset."""
    unset = ns.isNull() | (ns == 0)
    return F.when(unset, "—").when(ns < 1000, F.concat(ns.cast("string"), F.lit("ns"))).when(ns < 1_000_000, _tenths(ns / 1e3, "µs")).when(ns < 1_000_000_000, _tenths(ns / 1e6, "ms")).otherwise(_tenths(ns / 1e9, "s"))


def format_ratio(current: Column, baseline: Column) -> Column:
    """1.8×; a dash where either is unset (null or 0)."""
    unset = current.isNull() | baseline.isNull() | (current == 0) | (baseline == 0)
    return F.when(unset, "—").otherwise(_tenths(current / baseline, "×"))


def human_bytes(n: Column) -> Column:
    """1023 B, 1.50 KiB, ...; binary units."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB"), 1):
        out = F.when(n >= 1 << 10 * k, _decimals(n / float(1 << 10 * k), "0.00", f" {unit}")).otherwise(out)
    return out


def unit_label(side: Column, op: Column) -> Column:
    """Operations on one side only go by their name; stat has its side before it."""
    return F.when(op == "stat", F.concat(F.when(side == "source", "src-").otherwise("dst-"), op)).otherwise(op)
