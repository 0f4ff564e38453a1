"""The corpus pipeline: five stages, each over all that the stage before it kept.

Every stage is (spark, docs, sf_dir) -> DataFrame. A stage's rows are written as Parquet and read
back as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintmill.llm.common import shielded, staged, table
from stintmill.llm.decontam import decontaminate
from stintmill.llm.lines import dedup_lines
from stintmill.llm.mixing import mixed_texts
from stintmill.llm.neardup import dedup_documents
from stintmill.llm.toxicity import score, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the models learn from the labelled ones among docs. Without labels of
    both classes every document stays."""
    model = train(docs, table(spark, sf_dir, "labels"))
    hidden, back = shielded(docs, doc_id="doc_id", text="text")
    return back(score(hidden, model).where("score < 0.5"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each near-duplicate line stays where it stands first; documents left without a line go."""
    kept = dedup_lines(docs)
    return kept.where("text is null or trim(text) <> '' or n_chars = 0").withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return dedup_documents(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without items of the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each repetition of a document that it takes."""
    return mixed_texts(docs, carry=("lang",)).withColumn("n_chars", F.length("text").cast("long"))


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]
#: Trained models and similarity components cannot be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
