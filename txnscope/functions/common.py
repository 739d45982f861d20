"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(cond: Column) -> Column:
    """Boolean -> 0/1 int; NULL comparisons count as false (as NumPy does)."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def log1p(c: Column) -> Column:
    """ln(1+x); NULL (never NaN) at or below -1."""
    return F.when(c > F.lit(-1.0), F.log1p(c))


def safe_div(num: Column, den: Column, default=None) -> Column:
    """num/den in doubles; ``default`` (or NULL) when den is 0 or NULL."""
    out = F.try_divide(num.cast("double"), den.cast("double"))
    return out if default is None else F.coalesce(
        F.when(den.cast("double") != F.lit(0.0), out), F.lit(default))


def snap(c: Column, digits: int = 6) -> Column:
    """Put a double on a 10^-digits grid, identically in any IEEE engine.

    ``round`` differs between engines at decimal half-points (it may work on
    the shortest decimal text or on the binary value), and values such as
    sum/32 of cent amounts land exactly there. Cutting at 0.377 of a step
    instead keeps the cut away from every short decimal, so last-bit
    differences in sums never move a value to another grid point.
    The SQL twin is ``floor(x * 1e{digits} + 0.377) / 1e{digits}``.
    """
    scale = float(10 ** digits)
    return (F.floor(c.cast("double") * F.lit(scale) + F.lit(0.377)).cast("double")
            / F.lit(scale))


def snap_sql(expr: str, digits: int = 6) -> str:
    return (f"CAST(floor(CAST({expr} AS DOUBLE) * 1e{digits} + CAST(0.377 AS DOUBLE)) "
            f"AS DOUBLE) / 1e{digits}")
