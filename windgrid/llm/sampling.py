"""Bounded training samples of labelled documents, by a hash of the id, for models fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash values are compared in this many steps, so that the bound for few of very many rows is no zero.
STEPS = 1 << 62


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def bounded(rows: DataFrame, key: str, most: int, count: int | None = None) -> DataFrame:
    """About `most` rows of more, chosen by a hash of `key`; all rows if there are no more than that."""
    count = rows.count() if count is None else count
    return rows if count <= most else rows.where(picked(F.col(key), most, count))


def picked(key: Column, most: int, count: int) -> Column:
    """True for about `most` of `count` rows, whatever their number, by a hash of `key`; for all if there are no more."""
    if count <= most:
        return F.lit(True)
    return F.shiftrightunsigned(F.xxhash64(F.lit("sample"), key), 2) < F.lit(STEPS * most // count).cast("long")


def labelled(docs: DataFrame, labels: DataFrame, label: str, keep: Column, most: int) -> DataFrame:
    """doc_id, text, label (0 or 1) of about `most` documents whose label is given and for which `keep` holds.

    The labels are sampled before the join, so the side that is sent to every executor has `most` rows,
    whatever the size of the corpus. Repeated and contradicting labels of a document count as the smallest.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    known = bounded(known.where(keep), "doc_id", most).groupBy("doc_id").agg(F.min("label").alias("label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(known), "doc_id")
