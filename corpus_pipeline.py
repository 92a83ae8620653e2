"""A cleaning pipeline over documents: five stages, each an operator of ``terrasift.llm``.

Each stage gets all rows that the one before kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.llm.common import documents, row_key, spare, stored
from terrasift.llm.decontaminate import find_leaks
from terrasift.llm.mixing import mix_sources
from terrasift.llm.near_duplicates import near_duplicates
from terrasift.llm.personal_data import redact
from terrasift.llm.quality import fit_quality, score_quality


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = fit_quality(docs, documents(spark, sf_dir, "labels"))
    score = spare("score", docs.columns)
    return score_quality(docs, model, score=score).where(F.col(score) >= 0.7).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id, null last.

    Of rows with equal id and text, the one with the least hash of all columns stays.
    """
    classes = near_duplicates(docs)
    own = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_key").alias("row_key"))
    first = stored(classes.groupBy("class_key").agg(F.min(own).alias("first")).select("first.row_key"))
    name = spare("row_key", docs.columns)
    kept = docs.withColumn(name, row_key("doc_id", "text")).join(first.withColumnRenamed("row_key", name), name, "left_semi")
    hashed = F.xxhash64(*[f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    one = kept.groupBy(name).agg(F.min_by(F.struct(*docs.columns), hashed).alias("one"))
    return one.select("one.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    leaks = spare("leaks", docs.columns)
    found = find_leaks(docs, documents(spark, sf_dir, "benchmark"), leaks=leaks)
    return found.where(F.size(leaks) == 0).select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    return redact(docs).withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mix_sources(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("personal data", redact_personal_data),
    ("mixing", mix),
]

#: No single statement: the stages train models and solve for classes.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
