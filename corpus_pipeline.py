"""A corpus pipeline of five training-data operators: what each stage keeps is the next stage's input.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallium.llm.common import Scratch, documents, fresh
from recallium.llm.exact_dedup import drop_exact_duplicates
from recallium.llm.jaccard_join import jaccard_components
from recallium.llm.packing import pack_documents
from recallium.llm.pii import mask
from recallium.llm.toxicity import fit, score_toxicity

TOXIC_FROM = 0.3


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches ``TOXIC_FROM`` go. The labelled fold that op 6 holds out is not learnt from here either."""
    fold = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), usable=fold != 2)
    score = fresh(docs.columns, "score")
    return score_toxicity(docs, model, score_col=score).filter(F.col(score) < TOXIC_FROM).drop(score)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (white space aside) the longest stays, then the one with the least id."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more: of each component the document with the least id stays."""
    gone = jaccard_components(docs, n=5, num=80, den=100).filter("doc_id <> component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` follows the text."""
    return mask(docs).withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the remaining documents' pieces in sequences of 4096 tokens."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("n-gram Jaccard join", near), ("PII", personal_data), ("best-fit packing", packing)]

#: SQL cannot express the trained stages; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir))
    return docs
