"""A corpus pipeline: toxic and poor documents go, one of each near-duplicate group stays, the rest is packed.

Every stage works on all documents that its predecessor kept. A stage's models learn from the labels of
the documents it is given, held-out ones apart.

Defined cases, of every stage but the last: a null or empty text is scored as one without words, is like no
other document and is kept as its scores say; a row without a doc_id is never trained on and is no copy, so
only the first two stages can reject it; of rows of equal doc_id all go or stay, until the near-duplicate
stage keeps one (the first by text, then by the row as JSON); documents without any label of a kind are all
kept by that stage; an empty table stays empty; all columns of the table, whatever their names, are kept as
they are. The last stage packs each row as a document of its own; a null text is the end token alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windgrid.llm import near_dedup, packing, quality, tokens, toxicity
from windgrid.llm.scratch import Scratch, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled model does not count as toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out(1, 3))
    return toxicity.accepted(docs, model)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking puts above its border."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out(2, 4))
    return quality.accepted(docs, model)


#: Percent of Jaccard similarity from which documents are near copies here.
NEAR_PERCENT = 80


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return near_dedup.representatives(docs, percent=NEAR_PERCENT)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    pieces = packing.pack(docs, tokens.byte_bpe_encoder(end=2))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("toxicity", without_toxic),
    ("quality", of_quality),
    ("near_dedup", without_near_copies),
    ("packing", packed),
]

#: Classifiers and tokenizers are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}_{name}")
        if k > 1:
            scratch.drop(f"{k - 1}_{STAGES[k - 1][0]}")
    return docs
