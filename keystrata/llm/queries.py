"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), shards=8).withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import components

    return components(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find

    return find(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import assess

    return assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import read_ranks, round_trip

    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    found = round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op8_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokencount import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license import licenses

    return licenses(table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import languages_of

    return languages_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_simhash, op3_pii, op4_quality, op5_bpe, op6_decontamination, op7_html, op8_tokencount, op9_license, op10_langid)}


def oracle_sql() -> dict[str, str]:
    from .decontam import ORACLE

    return {"op6_decontamination": ORACLE.format(docs="documents", items="benchmark")}
