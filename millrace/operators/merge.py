"""Merges: inner join, semi-join and concatenation.

How a side is moved is left to Catalyst and adaptive execution, unless the
caller asks.  A side asked for by key is shuffled, as the other one is.  A side
asked to be replicated is broadcast only while the planner's estimate of it is
within ``BROADCAST_BYTES``; a larger one is joined by a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side asked to be replicated is broadcast up to this estimate of its size.
BROADCAST_BYTES = 256 << 20

Slots = dict[int, DataFrame]
MergeStep = Callable[[Slots], Slots]


class MergePattern(Enum):
    """How the other side of a merge is brought together with this one."""

    AUTO = "auto"  # as the planner sees fit
    PARTIAL = "partial"  # by key
    ALL = "all"  # whole, to every task


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a frame's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def moved(df: DataFrame, pattern: MergePattern, on: str, fanout: int | None = None) -> DataFrame:
    """The other side of a merge, marked with how it is to be moved; ``fanout`` is the width of its exchange."""
    if pattern is MergePattern.ALL and estimated_bytes(df) <= BROADCAST_BYTES:
        return F.broadcast(df)
    if fanout:
        df = df.repartition(fanout, on)
    return df if pattern is MergePattern.AUTO and not fanout else df.hint("merge")


def join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, suffix: str = "_right") -> DataFrame:
    """Inner join on one column each.  Null never matches.

    The right key goes; other right columns whose name the left side has get the suffix.
    """
    renamed = {c: f"{c}{suffix}" if c in left.columns else c for c in right.columns if c != right_on}
    key = "__right_key"
    side = right.select(F.col(right_on).alias(key), *[F.col(c).alias(n) for c, n in renamed.items()])
    return left.join(side, F.col(left_on) == F.col(key), "inner").drop(key)


def semi_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """The left rows whose key the right side has; no row is multiplied, null never matches."""
    return left.join(right.select(F.col(right_on).alias("__right_key")), F.col(left_on) == F.col("__right_key"), "left_semi")


def concatenate(*frames: DataFrame) -> DataFrame:
    """All rows of frames with the same columns."""
    out = frames[0]
    for f in frames[1:]:
        if set(f.columns) != set(out.columns):
            raise ValueError(f"columns differ: {out.columns} and {f.columns}")
        out = out.unionByName(f)
    return out


class Merge:
    """Steps on numbered frames; -1 is the frame itself."""

    @staticmethod
    def join(data_2: int, left_on: str, right_on: str, data_1: int = -1) -> MergeStep:
        return lambda slots: {**slots, data_1: join(slots[data_1], slots[data_2], left_on, right_on)}

    @staticmethod
    def isin(data_2: int, left_on: str, right_on: str, data_1: int = -1) -> MergeStep:
        return lambda slots: {**slots, data_1: semi_join(slots[data_1], slots[data_2], left_on, right_on)}

    @staticmethod
    def concatenate(data_indexes: list[int] | None = None, destination_index: int = -1) -> MergeStep:
        return lambda slots: {**slots, destination_index: concatenate(*[slots[k] for k in (data_indexes or list(slots))])}
