"""The thin queries of the contracts: each reads its table, applies its operator and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, licenses, mixing, pii, quality, sharding, simhash, topk, toxicity, urls
from .common import python_ready, table
from .oracle import ORACLE_SQL as ORACLE_SQL


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    python_ready(spark)
    coded = bpe.bpe(F.col("text"), public_tokenizers.path("byte_bpe_50k.json"), digests=True)
    return table(spark, sf_dir, "documents").select("doc_id", coded.alias("c")).select("doc_id", "c.*")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are learnt only from rows outside the held-out fifth."""
    fold = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(5)) == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~fold)
    model = toxicity.train(docs, labels)
    scored = docs.select("doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), toxicity.score(docs, model).alias("score"))
    return scored.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select("doc_id", *counts, "base_failed", "kept")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s.kind.isin(*pii.BASE))
    return found.select(
        "doc_id", *[count(k) for k in pii.BASE],
        F.sha2(pii.listed(base), 256).alias("base_sha256"),
        pii.listed(pii.all_spans(F.col("spans"), F.col("terms"))).alias("spans"),
        count("secret"), F.size("terms").cast("long").alias("n_term"), (F.size("spans") + F.size("terms")).cast("long").alias("n_spans"),
    )


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the likest licence found in it (null: none), its Dice coefficient, and all found."""
    python_ready(spark)
    found = table(spark, sf_dir, "documents").select("doc_id", licenses.licences(F.col("text")).alias("f"))
    return found.select(
        "doc_id",
        F.get("f", F.lit(0)).licence.alias("licence"),
        F.get("f", F.lit(0)).dice.alias("dice"),
        F.array_join(F.transform("f", lambda x: x.licence), ",").alias("licences"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op1_bpe": op1_bpe, "op2_toxicity": op2_toxicity, "op3_urls": op3_urls, "op4_sharding": op4_sharding, "op5_quality": op5_quality, "op6_mixing": op6_mixing, "op7_topk": op7_topk, "op8_pii": op8_pii, "op9_licenses": op9_licenses, "op10_simhash": op10_simhash}
