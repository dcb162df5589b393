"""Rows made by a function."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def generate(spark: SparkSession, make: Callable[..., pd.DataFrame], schema: T.StructType | str, fanout: int | None = None) -> DataFrame:
    """The frames that ``make`` returns when called once in each of ``fanout`` tasks.

    A function with a parameter gets the task's number, so that what it makes can differ and be repeated.
    """
    fanout = fanout or spark.sparkContext.defaultParallelism
    numbered = len(inspect.signature(make).parameters) > 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in batch["id"]:
                yield make(int(k)) if numbered else make()

    return spark.range(0, fanout, 1, fanout).mapInPandas(run, schema)
