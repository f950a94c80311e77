"""The corpus pipeline: quality classifier, near-duplicate removal, benchmark
decontamination, mixing to target weights, token files.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns
a DataFrame that is written as Parquet and read again as the next stage's ``docs``. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import contamination, mixing, near_dup, quality, token_files
from tidemark.llm.common import Scratch
from tidemark.llm.queries import END_ID, table, tokenizer_path


def with_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row``, by which stages decide: the doc_id where one row alone has it,
    else (null and repeated ids) a hash of the whole row, above all usual ids. Rows that
    agree in all columns have one ``row``; ``shared`` tells rows with a hash."""
    shared = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select("doc_id")
    if shared.isEmpty():
        return docs.withColumn("row", F.col("doc_id").cast("long")).withColumn("shared", F.lit(False))
    own = (F.xxhash64(*[F.col(c) for c in sorted(docs.columns)]).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)).alias("row")
    flagged = docs.alias("d").join(shared.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")), "left_semi")
    plain = docs.alias("d").join(shared.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")), "left_anti")
    return plain.withColumn("row", F.col("doc_id").cast("long")).withColumn("shared", F.lit(False)).unionByName(flagged.select("*", own).withColumn("shared", F.lit(True)))


def by_row(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("row").alias("doc_id"), "text")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Every row is judged by its own
    text, also where ids are null or repeated (labels of such ids are not used)."""
    rows = with_rows(docs)
    scores = quality.quality_scores(by_row(rows), table(spark, sf_dir, "labels"))
    bad = scores.where("predicted = 0").select(F.col("doc_id").alias("row")).distinct()
    return rows.join(bad, "row", "left_anti").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id, or,
    if the group has only null and repeated ids, one row of it. Of rows that agree in all
    columns one stays."""
    rows = with_rows(docs)
    groups = near_dup.near_duplicates(by_row(rows))
    gone = groups.where(~F.col("kept")).select(F.col("doc_id").alias("row")).distinct()
    left = rows.join(gone, "row", "left_anti")
    return left.where("not shared").unionByName(left.where("shared").dropDuplicates(["row"])).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item. Every row is judged by its own text, also
    where ids are null or repeated."""
    rows = with_rows(docs)
    found = contamination.leaks(by_row(rows), table(spark, sf_dir, "benchmark"))
    return rows.join(found.select(F.col("doc_id").alias("row")).distinct(), "row", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to target weights: a row for every document and pass over its source in which
    words of it are drawn, with those words. Null and repeated ids are drawn like others."""
    return mixing.mixed_documents(docs)


def to_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix in a pseudorandom order of its documents, so that every file
    holds all sources, read back: a row for each row of the mix, null ids included."""
    path = f"{Scratch(spark, 'pipeline-tokens').root}/ids"
    token_files.write_token_files(docs, path, tokenizer_path(), END_ID, shuffled=True)
    return token_files.read_token_files(spark, path)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_files", to_token_files),
]
#: The stages train a model and hash; tests compare them with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
