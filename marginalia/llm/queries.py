"""The queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import embedding_dup, licenses, near_dup
from marginalia.llm.common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.token_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op2_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.training_order import write_shards

    return write_shards(table(spark, sf_dir, "documents"), stable=True)


def op5_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.flac import media

    return media(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op8_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.embedding_dup import embedding_near_duplicates

    return embedding_near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from marginalia.llm.licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_minhash_near_dup, op3_toxicity, op4_training_order, op5_flac_media, op6_quality, op7_best_fit_packing, op8_embedding_near_dup, op9_mixing, op10_license_scan)}
#: DuckDB SQL for the queries that SQL can express on whole tables.
ORACLES: dict[str, str] = {"op2_minhash_near_dup": near_dup.ORACLE, "op8_embedding_near_dup": embedding_dup.ORACLE, "op10_license_scan": licenses.ORACLE}
