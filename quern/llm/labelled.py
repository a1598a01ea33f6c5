"""Training rows of a classifier: a bounded sample of the labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(id_col, mod: int = 5, remainder: int = 0):
    """True for the ids that nothing is learnt from: crc32 of the id as text."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % mod == remainder, F.lit(False))


def training_ids(labels: DataFrame, target: str, most: int) -> DataFrame:
    """(doc_id, y) of at most ``most`` rows: those whose hashed id is smallest, one a document.

    A document labelled twice counts as 1 if any of its labels is 1; null labels and ids are left out.
    """
    known = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    once = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(target).cast("int")).alias("y"))
    return once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def training_texts(docs: DataFrame, labels: DataFrame, target: str, most: int) -> DataFrame:
    """(doc_id, text, y) of the sample's documents; its ids are at most ``most`` rows, so they are broadcast.

    A document has as many rows as its id has in docs; who learns from them takes one an id.
    """
    ids = training_ids(labels, target, most)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
