"""File sources.  Schemas are explicit wherever the format has none, so nothing is inferred in a second pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed layout of a sort-benchmark record: bytes of the record, of its key, and of its value.
RECORD, KEY, VALUE = 100, (0, 10), (12, 86)


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    *,
    has_header: bool = True,
    separator: str = ",",
    new_columns: list[str] | None = None,
    line_end: str | None = None,
    trailing_separator: bool = False,
    **options: str,
) -> DataFrame:
    """Delimited text.  Bad fields and rows are errors, unless the option ``mode`` says otherwise.

    With a schema, rows that end in a separator (one more, empty field) are told by ``trailing_separator``.
    Without one, all columns are strings, named by the header or ``new_columns``.
    """
    reader = spark.read.option("sep", separator).option("header", has_header).option("mode", "FAILFAST").options(**options)
    if line_end:
        reader = reader.option("lineSep", line_end)
    if schema is None:
        df = reader.csv(path)
    else:
        fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        end = [T.StructField("__end", T.StringType())] if trailing_separator else []
        df = reader.schema(T.StructType([*fields.fields, *end])).csv(path).select(*[f"`{f.name}`" for f in fields.fields])
    return df.toDF(*new_columns) if new_columns else df


def read_tokens(spark: SparkSession, path: str, separator: str = " ") -> DataFrame:
    """One row per non-empty token, in column ``0``; tokens may hold line ends unless that is the separator."""
    return spark.read.option("lineSep", separator).text(path).where(F.length("value") > 0).select(F.col("value").alias("0"))


def read_records(spark: SparkSession, path: str, *, binary: bool = False) -> DataFrame:
    """Fixed-width records: key in column ``0``, value in column ``1``.

    Printable records end in a line end and are read as lines.  ``binary`` records may hold any bytes; they
    are cut by length and read as Latin-1, which keeps the order of bytes.
    """
    if not binary:
        line = F.col("value")
        cut = [F.substring(line, at + 1, n).alias(str(k)) for k, (at, n) in enumerate((KEY, VALUE))]
        return spark.read.text(path).where(F.length(line) > 0).select(*cut)
    context, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    records = context.binaryRecords(path, RECORD, context.hadoopConfiguration())  # stays in the JVM
    whole = DataFrame(spark._jsparkSession.createDataset(records, jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark)
    return whole.select(*[F.decode(F.substring("value", at + 1, n), "ISO-8859-1").alias(str(k)) for k, (at, n) in enumerate((KEY, VALUE))])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, the format of the engine's own output."""
    return spark.read.parquet(path)
