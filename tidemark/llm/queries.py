"""The registered queries ``opN_<name>`` and their SQL, thin calls of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contamination, licenses, mixing, near_dup, oracle, pii, quality, secrets, substrings, token_files, topk
from .common import Scratch

#: Parameters of the token files.
TOKENIZER, END_ID = "word_bpe_49k.json", 2
#: Stands in for the secret that a deployment passes to ``pii.replace_pii``.
SURROGATE_KEY = "not-a-secret"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(table(spark, sf_dir, "documents")).taken()


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'token-files').root}/ids"
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path(), END_ID)
    return token_files.read_token_files(spark, path)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(table(spark, sf_dir, "documents"), SURROGATE_KEY)


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op10_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_strings(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_secrets, op3_licenses, op4_mixing, op5_token_files, op6_quality, op7_near_duplicates, op8_surrogates, op9_top_k, op10_repeated_strings)
}
#: The others draw, learn, tokenise or find spans of their own; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op1_decontamination": oracle.OP1, "op7_near_duplicates": oracle.OP7, "op9_top_k": oracle.OP9, "op10_repeated_strings": oracle.OP10}
