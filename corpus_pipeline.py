"""From documents to packed sequences: five stages, each written as Parquet and read again.

Toxic documents go, then exact copies, then near copies; passages of 50 words that an
earlier document has are cut; what is left is packed. Rows without doc_id pass all
stages. An empty table gives no piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalweave.llm import exact, neardup, packing, substring, toxicity
from evalweave.llm.common import discard, stage
from evalweave.llm.queries import tokenizer_file


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_copies(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.drop_passages(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("toxicity", toxic), ("exact", copies), ("near", near_copies), ("substring", passages), ("packing", packed)]
# the learned model is beyond SQL; tests compare the other stages with brute force, and this one with the operator's scores
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that the stages keep."""
    out, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, step in STAGES[:-1]:
        out, path = stage(step(spark, out, sf_dir), f"pipeline-{name}")
        discard(spark, *before)  # what a stage has read goes once the stage is written
        before = [path]
    last = STAGES[-1][1](spark, out, sf_dir)
    discard(spark, *before)  # the pieces are written already
    return last
