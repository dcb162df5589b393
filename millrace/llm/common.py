"""What the operators share: lookups of checked size, shipping of this package, word patterns."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import settle

__all__ = ["BLANKS", "BLANK_RUN", "WORD", "lookup", "python_ready", "settle", "table", "words_of"]

#: White space of the word contract: ``\x20`` and ``\x09``-``\x0D``.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: A run of it, for Java's regular expressions.
BLANK_RUN = r"[\x20\x09-\x0D]+"
#: A word, likewise.
WORD = r"[^\x20\x09-\x0D]+"

#: A lookup table of at most so many rows and bytes (as JSON) may be broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 10_000, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lookup(rows: DataFrame, small: DataFrame, on: Column | str | list[str], how: str = "left") -> DataFrame:
    """Join ``rows`` with a table that is usually small.

    It is measured first: up to ``BROADCAST_ROWS`` and ``BROADCAST_BYTES`` it is broadcast, beyond that Spark shuffles both sides.
    """
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("size")
    found = small.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)).alias("n"), size).first()
    fits = found["n"] <= BROADCAST_ROWS and found["size"] <= BROADCAST_BYTES
    return rows.join(F.broadcast(small) if fits else small.hint("merge"), on, how)


def python_ready(spark: SparkSession, rows: int = 1000) -> None:
    """Before Python runs on the executors: ship this package to them, and bound what one Arrow batch of texts holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    context = spark.sparkContext
    if getattr(context, "_millrace_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="millrace-")) / "millrace.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(archive))
    atexit.register(shutil.rmtree, archive.parent, ignore_errors=True)
    context._millrace_shipped = True


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))
