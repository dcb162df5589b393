"""The fluent frame: an immutable handle on a few numbered DataFrames.

Slot -1 is the frame itself; others come from ``merge``.  Every method returns
a new Frame and extends a lazy plan; nothing runs before an action.  Aggregates,
sorts and joins are global.  ``fanout`` is the number of partitions that the
operator's own exchange makes, where it has one; rows are dealt anew after
operators that have none.  Other tuning options have no counterpart and are
refused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import merge as _merge
from ..operators.merge import MergePattern, MergeStep, Slots
from ..operators.partitioning import order_by, ordering, range_bounds, range_partition
from ..sources import generate, read_csv, read_parquet, read_records, read_tokens

Step = Callable[[DataFrame], DataFrame]
Reducer = Callable[[dict[str, Any], DataFrame], None]


@dataclass(frozen=True)
class MergeSource:
    """Another input of a merge."""

    dataframe: Frame | DataFrame
    on: str
    pattern: MergePattern = MergePattern.AUTO


def switch(data1: int, data2: int = -1) -> MergeStep:
    """Swap two slots."""
    return lambda slots: {**slots, data1: slots[data2], data2: slots[data1]}


def purge(data_ids: list[int]) -> MergeStep:
    """Forget slots."""
    return lambda slots: {k: v for k, v in slots.items() if k not in set(data_ids)}


class PhysicalPlan(str):
    """A plan's text.  ``stages`` has, by number, each stage's operators and the stages whose output it reads; 0 is the last."""

    stages: dict[int, dict[str, list[Any]]]

    @classmethod
    def of(cls, df: DataFrame) -> PhysicalPlan:
        root = df._jdf.queryExecution().executedPlan()
        plan = cls(root.toString())
        plan.stages = {}

        def walk(node: Any, stage: int) -> None:
            if node.nodeName().startswith("AdaptiveSparkPlan"):
                node = node.initialPlan()
            plan.stages.setdefault(stage, {"operators": [], "reads": []})["operators"].append(node.nodeName().strip())
            children = node.children()
            for k in range(children.size()):
                child, at = children.apply(k), stage
                if "Exchange" in child.nodeName():
                    at = len(plan.stages)
                    plan.stages[stage]["reads"].append(at)
                    plan.stages[at] = {"operators": [], "reads": []}
                walk(child, at)

        walk(root, 0)
        return plan


def _steps(given: Any) -> list[Any]:
    return list(given) if isinstance(given, (list, tuple)) else [given]


@dataclass(frozen=True)
class Frame:
    slots: Slots = field(default_factory=dict)
    spark: SparkSession | None = None

    # sources

    @classmethod
    def of(cls, df: DataFrame) -> Frame:
        return cls({-1: df}, df.sparkSession)

    @classmethod
    def void(cls, spark: SparkSession) -> Frame:
        """A frame without data, for ``map`` with a function that makes it."""
        return cls({}, spark)

    @classmethod
    def from_csv(cls, spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options: Any) -> Frame:
        return cls.of(read_csv(spark, path, schema, **options))

    @classmethod
    def from_text(cls, spark: SparkSession, path: str, eol_char: str = " ") -> Frame:
        return cls.of(read_tokens(spark, path, eol_char))

    @classmethod
    def from_teragen(cls, spark: SparkSession, path: str, binary: bool = False) -> Frame:
        return cls.of(read_records(spark, path, binary=binary))

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str) -> Frame:
        return cls.of(read_parquet(spark, path))

    # the frame itself

    @property
    def df(self) -> DataFrame:
        if -1 not in self.slots:
            raise ValueError("this frame has no data")
        return self.slots[-1]

    def _with(self, df: DataFrame, fanout: int | None = None, slot: int = -1) -> Frame:
        return Frame({**self.slots, slot: df.repartition(fanout) if fanout else df}, df.sparkSession)

    def slot(self, data_id: int) -> DataFrame:
        if data_id not in self.slots:
            raise ValueError(f"no data in slot {data_id}")
        return self.slots[data_id]

    def select(self, column_names: str | list[str], fanout: int | None = None, data_id: int = -1) -> Frame:
        return self._with(self.slot(data_id).select(*_steps(column_names)), fanout, data_id)

    def drop(self, column_names: str | list[str], data_id: int = -1, fanout: int | None = None) -> Frame:
        """Drop columns of a slot; unknown names are an error."""
        names, df = _steps(column_names), self.slots[data_id]
        if unknown := set(names) - set(df.columns):
            raise ValueError(f"unknown columns: {sorted(unknown)}")
        return self._with(df.drop(*names), fanout, data_id)

    def map(
        self, func: Callable[..., Any], schema: T.StructType | str | None = None, fanout: int | None = None, data_id: int = -1, aux_data: Any = None
    ) -> Frame:
        """Apply a function to the frame.

        Without a schema, ``func`` takes and returns a DataFrame.  With one, it is opaque Python: it takes and
        returns a pandas frame, once for each partition as a whole; on a frame without data it makes rows, once
        in each of ``fanout`` tasks.  ``aux_data`` is passed on as a second argument: a frame as it is, or, to
        opaque Python, as pandas, which is sent to all tasks and must be within the size of a broadcast.
        """
        if data_id not in self.slots:
            if schema is None:
                raise ValueError("a function that makes rows needs a schema")
            return self._with(generate(self.spark, func, schema, fanout), None, data_id)
        df = self.slots[data_id]
        aux = aux_data.df if isinstance(aux_data, Frame) else aux_data
        if schema is None:
            return self._with(df.transform(func) if aux is None else func(df, aux), fanout, data_id)
        if isinstance(aux, DataFrame):
            if _merge.estimated_bytes(aux) > _merge.BROADCAST_BYTES:  # or the planner knows nothing of it
                size = aux.agg(F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))).first()[0]
                if size > _merge.BROADCAST_BYTES:
                    raise ValueError(f"auxiliary data of about {size} bytes is too large for every task; join it instead")
            aux = aux.toPandas()
        shared = None if aux is None else df.sparkSession.sparkContext.broadcast(aux)

        def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = list(batches)
            if held:
                rows = pd.concat(held, ignore_index=True)
                yield func(rows) if shared is None else func(rows, shared.value)

        return self._with(df.mapInPandas(whole, schema), fanout, data_id)

    def filter(self, condition: Column | Step, fanout: int | None = None, data_id: int = -1) -> Frame:
        df = self.slot(data_id)
        return self._with(df.where(condition) if isinstance(condition, Column) else df.transform(condition), fanout, data_id)

    def unique(self, fanout: int | None = None) -> Frame:
        return self._with((self.df.repartition(fanout, *self.df.columns) if fanout else self.df).distinct())

    def groupby(
        self, by: str, aggs: Column | list[Column], transforms: Step | list[Step] = (), aggs2: Column | list[Column] = (), fanout: int | None = None
    ) -> Frame:
        """One row per key; ``transforms`` follow, then a second aggregation by the same key if one is given."""
        df = (self.df.repartition(fanout, by) if fanout else self.df).groupBy(by).agg(*_steps(aggs))
        for step in _steps(transforms):
            df = step(df)
        if second := _steps(aggs2):
            df = df.groupBy(by).agg(*second)
        return self._with(df)

    def gather(self) -> Frame:
        """Everything in one partition.  Global operators don't need it."""
        return self._with(self.df.repartition(1))

    def reduce(self, reduce_functions: Column | Reducer | list[Column | Reducer]) -> Frame:
        """One row of named scalars.

        A reducer is an aggregate, or a function of (data, frame) that sets names in the dict ``data``, to
        aggregates of the frame or to DataFrames of one value.
        """
        named, single = [], []
        for f in _steps(reduce_functions):
            if isinstance(f, Column):
                named.append(f)
                continue
            data: dict[str, Column | DataFrame] = {}
            f(data, self.df)
            for name, value in data.items():
                if isinstance(value, DataFrame):
                    single.append(value.toDF(name))
                else:
                    named.append(value.alias(name))
        rows = ([self.df.agg(*named)] if named else []) + single
        out = rows[0]
        for row in rows[1:]:
            out = out.join(F.broadcast(row))  # one row each
        return self._with(out)

    def sort(self, by: str | list[str], descending: bool = False, fanout: int | None = None) -> Frame:
        if not fanout:
            return self._with(order_by(self.df, by, descending))
        ranges = range_partition(self.df, by, fanout, descending)
        return self._with(ranges.sortWithinPartitions(*ordering(by, descending)))

    def sample(self, by: str, n: int = 500, descending: bool = False) -> Frame:
        """The bounds (k, bound) that part the values of a column into ``n`` ranges of about equally many rows."""
        bounds = range_bounds(self.df, by, n)
        return self._with(bounds.select((F.lit(n - 2) - F.col("k") if descending else F.col("k")).alias("k"), "bound"))

    # several inputs

    def merge(self, others: dict[int, MergeSource] | None = None, merge_ops: MergeStep | list[MergeStep] = (), fanout: int | None = None) -> Frame:
        slots = dict(self.slots)
        for k, source in (others or {}).items():
            df = source.dataframe.df if isinstance(source.dataframe, Frame) else source.dataframe
            if source.on not in df.columns:
                raise ValueError(f"unknown column: {source.on}")
            slots[k] = _merge.moved(df, source.pattern, source.on, fanout)
        for step in _steps(merge_ops):
            slots = step(slots)
        return Frame(slots, self.spark)

    def switch(self, data1: int, data2: int = -1) -> Frame:
        return Frame(switch(data1, data2)(self.slots), self.spark)

    def purge(self, data_ids: list[int]) -> Frame:
        return Frame(purge(data_ids)(self.slots), self.spark)

    #: The name used by scripts that spell it so.
    purgue = purge

    # actions

    def write(self, path: str, mode: str = "errorifexists", compression: str = "none") -> None:
        """Write Parquet; after ``sort`` the files' order is the rows' order."""
        self.df.write.mode(mode).option("compression", compression).parquet(path)

    def collect(self) -> pd.DataFrame:
        """One result, whatever the number of partitions."""
        return self.df.toPandas()

    def compute(self) -> None:
        """Run without output."""
        self.df.write.format("noop").mode("overwrite").save()

    def show_plan(self, mode: str = "formatted") -> None:
        self.df.explain(mode)

    def to_physical(self) -> PhysicalPlan:
        """The physical plan as text, with its graph of stages; nothing runs."""
        return PhysicalPlan.of(self.df)

    def head(self, n: int = 20) -> pd.DataFrame:
        """Spark pass-through."""
        return self.df.limit(n).toPandas()

    def alias(self, **columns: Column) -> Frame:
        """Spark pass-through: add columns."""
        return self._with(self.df.select("*", *[c.alias(k) for k, c in columns.items()]))

    def count(self) -> int:
        """Spark pass-through."""
        return self.df.agg(F.count(F.lit(1))).first()[0]
