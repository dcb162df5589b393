"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset and the master is local (tests) is a temporary folder made, one for each context.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    context = spark.sparkContext
    if not re.match(r"local(\[|$)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not getattr(context, "_millrace_shared", None):
        context._millrace_shared = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, context._millrace_shared, ignore_errors=True)
    return context._millrace_shared


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended already; the folder is temporary anyway
        pass


def scratch(spark: SparkSession, name: str = "table") -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


_watched: list[tuple[SparkSession, str, JavaObject]] = []


def _watch(df: DataFrame, path: str) -> None:
    """Remember a table with a weak reference to what every plan that reads it shares, its list of files."""
    spark = df.sparkSession
    files = df._jdf.queryExecution().analyzed().collectLeaves().head().relation().location()
    _watched.append((spark, path, spark.sparkContext._jvm.java.lang.ref.WeakReference(files)))


def sweep() -> None:
    """Delete the settled tables that no plan can read any more, as Spark does with its own checkpoints."""
    for entry in list(_watched):
        spark, path, files = entry
        if spark.sparkContext._jsc is None:
            _watched.remove(entry)
        elif files.refersTo(None):
            _watched.remove(entry)
            _delete(spark, path)


def settle(df: DataFrame, files: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; ``files`` bounds the number of files of tables known to be small.

    This cuts the lineage, so later passes neither repeat the work above nor lose it with an executor.
    The table goes when the driver has collected every plan that reads it, or when the driver ends.
    """
    sweep()
    path = scratch(df.sparkSession, "settled")
    (df.coalesce(files) if files else df).write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _watch(table, path)
    return table
