"""A training corpus from raw documents, in five stages.

Each stage takes all that its predecessor kept, as (spark, docs, sf_dir), and
returns a DataFrame that is written as Parquet and read again for the next one.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, mixing, pii, quality, similar
from millrace.llm.common import python_ready, settle, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (SimHash index, five-word shingles, similarity 0.8) stays."""
    return similar.deduplicate(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is taken out of the texts; ``n_chars`` follows."""
    clean = pii.sanitise(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and a digest of the text that they decode to."""
    import public_tokenizers

    python_ready(spark)
    coded = docs.select("doc_id", "lang", "source", bpe.bpe(F.col("text"), public_tokenizers.path("byte_bpe_50k.json")).alias("c"))
    return coded.select("doc_id", "lang", "source", F.size("c.ids").cast("long").alias("n_tokens"), "c.ids", F.sha2("c.decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", good), ("near duplicates", distinct), ("personal data", private), ("mixing", mixed), ("tokens", tokens)]

#: Near duplicates, personal data and tokens are beyond SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline's last table."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settle(docs)
    return docs
