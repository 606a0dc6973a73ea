"""Column functions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added before rounding, so that no average of money lies on a tie, where engines differ.
OFF_TIES = 1.2345e-6


def tidy(x: Column | str, digits: int = 4) -> Column:
    """x rounded for output."""
    return F.round((F.col(x) if isinstance(x, str) else x) + F.lit(OFF_TIES), digits)


def clip(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """x kept within bounds; null stays null."""
    out = x
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(x.isNotNull(), out)


def array_median(xs: Column) -> Column:
    """Median of an array without nulls, the mean of the middle two for an even size; null if empty."""

    def middle(s: Column) -> Column:
        n = F.size(s)
        mid = F.floor(n / 2).cast("int")
        return F.when(n % 2 == 1, F.get(s, mid)).otherwise((F.get(s, mid - 1) + F.get(s, mid)) / 2)

    return let(F.array_sort(xs), middle)


def array_mad(xs: Column, floor: float) -> Column:
    """1.4826 times the median absolute deviation, at least floor."""
    away = let(array_median(xs), lambda m: F.transform(xs, lambda x: F.abs(x - m)))
    return F.greatest(array_median(away) * 1.4826, F.lit(floor))


def hash_rank_key(seed: str, key: Column) -> Column:
    """A digest that orders keys the same way in every engine."""
    return F.sha2(F.concat(F.lit(seed + ":"), key.cast("string")), 256)


def let(x: Column, body) -> Column:
    """body(x) with x evaluated once, where the expression would otherwise repeat x's tree."""
    return F.get(F.transform(F.array(x), body), F.lit(0))
