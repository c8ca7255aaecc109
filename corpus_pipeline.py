"""The corpus pipeline: quality classifier, quality rules, near duplicates, mixing, SentencePiece encoding.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read
again as the next one's docs. All but the last return the columns they were given.

Defined cases, in all stages: null and empty texts have no words, so the quality rules reject them; a null id is a row of its own;
of equal rows one stays; an empty table gives an empty one; long texts are read whole; columns beyond those of documents pass
through, whatever their names, but for those that the last stage's result takes the name of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexgrid.llm import jaccard_join, mixing, quality_classifier, quality_rules, sentencepiece_codec
from lexgrid.llm.common import Workspace


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good."""
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.keep(docs, model)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id."""
    return jaccard_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in mixed order; sources weigh as the square root of what is left of them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the end id, and the spans of its text's bytes, in mixed order.

    Reading files back keeps no order. The schedule is a function of the rows, so it is computed again: the rows come sorted
    by its `mix_slot` and `mix_seq`, and have them as columns.
    """
    return sentencepiece_codec.encode(mixing.in_order(mixing.schedule(docs)), "piece_bpe_32k.model")


STAGES = [("quality classifier", classify), ("quality rules", rules), ("near duplicates", near_duplicates), ("mixing", mix), ("encoding", encode)]
#: The fitted classifier and the encoding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written to the shared folder, and removed when the next one's is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    space = Workspace(spark)
    for i, (_, stage) in enumerate(STAGES[:-1]):
        last, docs = docs, space.keep(stage(spark, docs, sf_dir))
        if i:
            space.drop(last)
    return STAGES[-1][1](spark, docs, sf_dir)
