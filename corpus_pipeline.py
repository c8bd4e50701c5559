"""From raw documents to packed sequences, in four stages.

Each stage is a function of (session, documents so far, folder of the tables). All but the last return the columns of
documents. Between stages the rows are a written table, so that a stage that reads its input twice does not make it twice.

1. Documents that the quality classifier rejects go; the classifier learns from labelled documents outside its held-out fold.
2. Of documents whose sets of five-word shingles are linked by a similarity of 0.8 or more, the one with the smallest id stays.
   Rows with a null id stay.
3. Personal data in the texts is replaced by its kind in brackets; n_chars follows the new text.
4. The texts are packed into sequences of 2048 tokens.

Cases: a null or empty text is scored like an empty one, has no duplicates and no personal data, and is packed as its end alone; a
redacted null text stays null, with null n_chars. Texts of any length are worked on whole. Rows of one id stay or go together,
unless their texts differ; of groups that tie, the smallest id stays. An empty table gives empty stages. Extra columns go
through all stages but the last, also those named like an operator's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinage.llm import jaccard, packing, pii, quality, tables

#: The network's answer and the exact packing are not expressible in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, quality.train(docs, labels))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = jaccard.similarity_components(docs, width=5, percent=80)
    return tables.only_ids(docs, "doc_id", groups.filter("doc_id <> component_id").select("doc_id"), "left_anti").select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact_pii(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [("quality", keep_good), ("near_duplicates", keep_one_of_each_group), ("pii", redact), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs, path = tables.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        tables.drop(spark, *before)  # only the last stage's table is still read
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
