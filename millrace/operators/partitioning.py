"""Global order and explicit partitioning.  Spark's own exchanges do the work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Printable characters of a sort-benchmark key, the first of them, and how many characters place a key.
SYMBOLS, FIRST, PLACES = 95, 32, 8


def ordering(by: str | list[str], descending: bool = False) -> list[Column]:
    """Nulls last, or first when descending."""
    names = [by] if isinstance(by, str) else by
    return [F.col(c).desc_nulls_first() if descending else F.col(c).asc_nulls_last() for c in names]


def order_by(df: DataFrame, by: str | list[str], descending: bool = False) -> DataFrame:
    """Global order: nulls last, or first when descending."""
    return df.orderBy(*ordering(by, descending))


def hash_partition(df: DataFrame, by: str, n: int) -> DataFrame:
    return df.repartition(n, by)


def range_partition(df: DataFrame, by: str, n: int, descending: bool = False) -> DataFrame:
    return df.repartitionByRange(n, *ordering(by, descending))


def range_bounds(df: DataFrame, by: str, n: int, error: float = 0.001) -> DataFrame:
    """The n - 1 inner bounds of n ranges with about equally many rows each."""
    at = [k / n for k in range(1, n)]
    bounds = F.percentile_approx(by, F.array(*map(F.lit, at)), round(1 / error))
    return df.agg(bounds.alias("b")).select(F.posexplode("b").alias("k", "bound"))


def key_partition(key: Column, n: int) -> Column:
    """The partition of a printable key, by its first eight characters as one number."""
    place = lambda i: (F.ascii(F.substring(key, i, 1)) - FIRST).cast("bigint") * SYMBOLS ** (PLACES - i)
    number = sum((place(i) for i in range(2, PLACES + 1)), place(1))
    return F.least(F.floor(number.cast("double") / (SYMBOLS**PLACES - 1) * n), F.lit(n - 1)).cast("int")


def remap_partition(partition: Column, old: int, new: int) -> Column:
    """The partition among ``new`` that one among ``old`` belongs to."""
    return F.call_function("div", partition * new, F.lit(old))
