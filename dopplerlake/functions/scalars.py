"""Scalar expressions that the operators share, all inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def half_even(c: Column) -> Column:
    """Rounds ties to the even neighbour, as a long."""
    return F.rint(c).cast("long")


def amplitude(snr_db: Column) -> Column:
    """10^(dB/20), or 1 where the SNR is missing."""
    return F.coalesce(F.pow(F.lit(10.0), snr_db / 20), F.lit(1.0))


def power(snr_db: Column) -> Column:
    """10^(dB/10)."""
    return F.pow(F.lit(10.0), snr_db / 10)


def range_of(x="x", y="y", z="z") -> Column:
    x, y, z = F.col(x), F.col(y), F.col(z)
    return F.sqrt(x * x + y * y + z * z)


def azimuth_of(x="x", y="y") -> Column:
    """Degrees from straight ahead, positive to the right."""
    return F.degrees(F.atan2(F.col(x), F.col(y)))


def elevation_of(x="x", y="y", z="z") -> Column:
    return F.degrees(F.atan2(F.col(z), F.hypot(F.col(x), F.col(y))))


def to_db(c: Column, floor: float = -120.0) -> Column:
    """20 log10, with values below 1e-12 and results below `floor` raised to them."""
    return F.greatest(20 * F.log10(F.greatest(c, F.lit(1e-12))), F.lit(floor))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded, negative zero made zero: the form in which results are compared."""
    return df.select(*((F.round(F.col(c), digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def fill_gaps(df: DataFrame, value: str, keys: list[str], order: str, edge: str = "clamp") -> Column:
    """Linear interpolation of nulls over `order`; beyond the ends the nearest value (clamp) or the end slope (linear)."""
    if edge not in ("clamp", "linear"):
        raise ValueError(f"edge must be clamp or linear, not {edge}")
    w = Window.partitionBy(*keys).orderBy(order)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col(order))
    v0, x0 = F.last(value, ignorenulls=True).over(before), F.last(at, ignorenulls=True).over(before)
    v1, x1 = F.first(value, ignorenulls=True).over(after), F.first(at, ignorenulls=True).over(after)
    inner = v0 + (v1 - v0) * (F.col(order) - x0) / (x1 - x0)
    return F.coalesce(F.col(value), F.when(v0.isNotNull() & v1.isNotNull(), inner), v0, v1)
