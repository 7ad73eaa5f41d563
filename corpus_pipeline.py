"""Quality rules, quality classifier, near duplicates, repeated passages, packing: documents to training sequences.

Each stage takes what the one before it kept, with the columns of `documents`; the last returns the pieces of sequences.
Null and empty texts have no words and fail the quality rules. Documents without an id are never dropped as near copies,
nor their passages removed. Rows that repeat an id stay or go together as near copies. Of copies and near copies the
smallest id stays; of equal passages the one in the smallest id. Very long texts are read whole by every stage; one is a
block of its own where texts are gathered in blocks. Extra columns, of any type and name, go along as they are up to the
last stage. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import dropped, table, written
from tessera.llm.jaccard_join import JaccardJoin
from tessera.llm.nb_svm import NaiveBayesSvm
from tessera.llm.packing import pack
from tessera.llm.prefix_trees import SubstringDedup
from tessera.llm.quality_rules import Cascade


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return Cascade().planned(docs).filter(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more; the model learns from the labelled ones among them."""
    return NaiveBayesSvm().fit(docs, table(spark, sf_dir, "labels")).filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of five-word Jaccard similarity 0.8 tie together, the one of smallest id."""
    dropped = JaccardJoin().links(docs).where("doc_id <> class_id").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of 13-word windows that start in a document of smaller id; n_chars follows."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    out = SubstringDedup().remove(docs, carry=rest)
    columns = {c: F.col(f"c{i}") for i, c in enumerate(rest)} | {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")}
    return out.select(*[columns[c].alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]
#: Tokenizers, trained models and link components are beyond SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        if k:
            dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
