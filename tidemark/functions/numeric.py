"""Rounding and division as SQL databases do them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_num(x: Column, digits: int) -> Column:
    """Half away from zero, in decimal."""
    return F.round(x.cast("decimal(38,12)"), digits)


def rint_int(x: Column) -> Column:
    """A cast to integer that rounds instead of cutting off."""
    return F.rint(x).cast("int")


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b, F.lit(0))


def pretty_bytes(n: Column) -> Column:
    """Bytes as text with the unit in which it has less than five digits."""
    out = F.concat(n.cast("string"), F.lit(" bytes"))
    for k, unit in enumerate(("kB", "MB", "GB", "TB", "PB"), 1):
        out = F.when(F.abs(n) >= 10240 * 1024 ** (k - 1), F.concat(F.round(n / 1024**k).cast("long").cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out
