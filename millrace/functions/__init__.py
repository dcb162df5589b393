"""Expression builders: aggregates, whole-partition transforms, flags, conditions and casts.

Builders return Columns or functions on DataFrames, so Catalyst sees through
all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]


def distinct_with_null(col: str | Column) -> Column:
    """Exact distinct count in which null is a value."""
    c = F.col(col) if isinstance(col, str) else col
    return F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("bigint")), F.lit(0))


def sum_or_zero(col: str | Column) -> Column:
    """Sum of what isn't null; zero, not null, if there is nothing."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.sum(c), F.lit(0))


class Agg:
    """Aggregates of ``groupby``."""

    @staticmethod
    def sum(col: str, alias: str) -> Column:
        return sum_or_zero(col).alias(alias)

    @staticmethod
    def n_unique(col: str, alias: str) -> Column:
        return distinct_with_null(col).alias(alias)

    @staticmethod
    def first(col: str, alias: str, order: str | list[str] | None = None) -> Column:
        """The first value, null or not; of the smallest ``order`` if that is given, else any row may be first."""
        if order is None:
            return F.first(col, ignorenulls=False).alias(alias)
        return F.min_by(F.struct(F.col(col).alias("v")), F.struct(*([order] if isinstance(order, str) else order))).v.alias(alias)


class Reduce:
    """Aggregates of a whole frame."""

    @staticmethod
    def sum(col: str, dest: str) -> Column:
        return Agg.sum(col, dest)

    @staticmethod
    def n_unique(col: str, dest: str) -> Column:
        return Agg.n_unique(col, dest)

    @staticmethod
    def udf(part: Callable[[pd.DataFrame], pd.DataFrame], schema: str, whole: Column, dest: str) -> Callable[[dict[str, Any], DataFrame], None]:
        """Opaque Python in two phases: ``part`` makes rows of ``schema`` of each batch, ``whole`` is the aggregate of those rows."""

        def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield from map(part, batches)

        def reducer(data: dict[str, Any], frame: DataFrame) -> None:
            data[dest] = frame.mapInPandas(parts, schema).agg(whole)

        return reducer


class Transform:
    """Values of a whole partition (``over``) added to each of its rows."""

    @staticmethod
    def max(col: str, over: str, alias: str) -> Step:
        return lambda df: df.withColumn(alias, F.max(col).over(Window.partitionBy(over)))

    @staticmethod
    def n_unique(col: str, over: str, alias: str) -> Step:
        """Distinct count, null included, by an aggregation and a null-safe join: no partition is held as a whole."""

        def step(df: DataFrame) -> DataFrame:
            counts = df.groupBy(F.col(over).alias("__over")).agg(distinct_with_null(col).alias(alias))
            return df.join(counts, F.col(over).eqNullSafe(F.col("__over"))).drop("__over")

        return step


class Ops:
    @staticmethod
    def flag(func: Callable[[Column], Column], col: str, alias: str, bool_type: bool = False) -> Step:
        """Add ``func(col)`` as a flag: a byte, or a boolean with ``bool_type``."""
        kind = "boolean" if bool_type else "tinyint"
        return lambda df: df.withColumn(alias, func(F.col(col)).cast(kind))


class Condition:
    @staticmethod
    def condition(cols: str | list[str], func: Callable[..., Column]) -> Step:
        """Keep the rows for which ``func`` of the columns is true."""
        names = [cols] if isinstance(cols, str) else cols
        return lambda df: df.where(func(*[F.col(c) for c in names]))


class Cast:
    @staticmethod
    def to_date(*args: str | int | Column) -> Column:
        """A date from a string column (bad input raises), or from year, month and day."""
        if len(args) == 1:
            return F.to_date(args[0])
        return F.make_date(*[a if isinstance(a, Column) else F.lit(a) for a in args])

    #: The name under which users of frame libraries look for it.
    to_datetime = to_date
