"""A corpus made ready for training: five stages, each on what the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imgcurate.llm.decontamination import without_contaminated
from imgcurate.llm.line_dedup import dedup_lines
from imgcurate.llm.ngram_join import one_of_each_group
from imgcurate.llm.quality_classifier import fit_quality, with_score
from imgcurate.llm.sentencepiece_codec import public_model, round_trip
from imgcurate.session import written

LOWEST_QUALITY = 0.3


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    odds = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_score(docs, odds, out="_quality").where(F.col("_quality") >= LOWEST_QUALITY).drop("_quality")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines that occurred earlier. Those of which nothing is left go."""
    cut = dedup_lines(docs).where("n_deleted = 0 or trim(text) != ''")
    return cut.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(docs.columns)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones."""
    return one_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the tokens of each document and of the text decoded from them."""
    return round_trip(docs, public_model())


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_similar),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", tokenize),
]

#: SQL can express neither the classifier nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
