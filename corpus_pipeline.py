"""A corpus pipeline: stages, each of which applies one operator to all documents that its predecessor kept.

The stages take and return the columns of documents; the last returns token ids in place of the text. Rows with null
ids, null or empty texts and repeated rows pass by the rules that each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunklens.llm.decontaminate import contamination
from chunklens.llm.near_dedup import near_duplicates
from chunklens.llm.pieces import encoded, read_vocabulary
from chunklens.llm.pii import redact
from chunklens.llm.quality_classifier import classify
from chunklens.llm.queries import PIECES
from chunklens.llm.shared import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    return classify(docs).where("keep").select(*docs.columns)


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the ids of a table that is written already; rows with null ids stay."""
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: 5-word shingles, similarity of 0.8 or more. Of rows that are
    equal in all columns one is taken before; rows of one id with other texts stay or go together."""
    repeated = Scratch(spark, "repeated").keep(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "ids")
    if not repeated.isEmpty():
        docs = docs.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(docs.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates())
    copies = Scratch(spark, "copies").keep(near_duplicates(docs).where("not kept").select("doc_id"), "ids")
    return _without(docs, copies)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than 5 % of the words are in 13-word windows of the benchmark."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").select("doc_id")
    return _without(docs, Scratch(spark, "contaminated").keep(found, "ids"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document's pieces, and that they give the text again."""
    found = encoded(docs, read_vocabulary(PIECES))
    return found.select("doc_id", "lang", "source", "n_chars", F.size("ids").alias("n_pieces"), "ids", "exact")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("personal_data", personal_data), ("tokens", tokens)]

#: None: SQL can't express the classifier, the span classifier and the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if i > 0:
            scratch.drop(STAGES[i - 1][0])
    return docs
