"""Bounded samples of labelled documents for the classifiers.

`per_class` is the documented bound: of each label at most so many training documents are taken, those with the smallest
hash of their id, so a run repeats. Only their features or windows reach the driver. Labels of held-out ids are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import only, written


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, label of the documents of docs, text not null, that may be learned from; written, as it is read often.

    Ids that labels give both ways are dropped.
    """
    named = only(labels, doc_id=id_col, label=label).where("doc_id IS NOT NULL AND label IS NOT NULL").where(remainder(F.col("doc_id"), modulus) != held_out)
    clear = named.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").select("doc_id", "label")
    there = only(docs, doc_id=id_col, text=text_col).where("text IS NOT NULL").select("doc_id")
    return written(clear.join(there, "doc_id", "left_semi"), "labelled")


def training_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, per_class: dict[int, int], id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """doc_id, label, text of at most per_class[label] documents of each label, of those that labelled() gives.

    The chosen ids number sum(per_class) at most, which bounds the broadcast.
    """
    clear = labelled(docs, labels, label, modulus, held_out, id_col, text_col) if known is None else known
    there = {r["label"]: r["count"] for r in clear.where(F.col("label").isin(*per_class)).groupBy("label").count().collect()}
    chosen = None
    for value, n in per_class.items():
        # Four times as many as are asked for have a hash below this bound, so the sort that follows stays small.
        bound = -(2**63) + int(min(1.0, 4 * n / max(1, there.get(value, 0))) * (2**64 - 1))
        some = clear.where((F.col("label") == value) & (F.xxhash64("doc_id") <= F.lit(min(bound, 2**63 - 1)))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).select("doc_id", F.lit(value).alias("label"))
        chosen = some if chosen is None else chosen.unionByName(some)
    text = only(docs, doc_id=id_col, text=text_col).where("text IS NOT NULL")
    return text.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "label", "text")
