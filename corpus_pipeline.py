"""The corpus pipeline: toxicity, quality, near duplicates, mixing, encoding.

Every stage takes (spark, docs, sf_dir); run() writes each stage's rows to the shared folder
and reads them again for the next.  All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import mixing, pieces, quality, shingles, toxicity
from quern.llm.store import stored

MODEL = public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more for toxicity go; null, empty and repeated rows are scored like any other, and stay if they score below."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(docs, toxicity.learn(docs, labels), COLUMNS)
    return scored.where("score < 0.5").select(*COLUMNS)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3 for quality go; null and empty texts are scored on statistics of zero, repeated rows each for itself."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.learn_from(docs, labels)
    return quality.with_statistics(docs, COLUMNS).where(quality.compiled(model) >= 0.3).select(*COLUMNS)


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates (five-word shingles, Jaccard 0.8 or more) the document of the least id stays, once; documents without an id stay.

    Of rows of equal ids the one of the least text stays, of equal texts that of the least other columns.
    """
    groups = shingles.near_groups(docs)
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    known = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi")
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    once = known.groupBy("doc_id").agg(F.min(F.struct("text", *rest)).alias("row")).select("doc_id", "row.*")
    return once.select(*COLUMNS).union(docs.where("doc_id IS NULL").select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample whose source, language and topic shares are raked to their targets; rows of equal ids are drawn alike, null and empty texts by the budget."""
    return mixing.mixed(docs, COLUMNS).where("selected").select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts of every document, digests of its ids and of the decoded text; a null or empty text has the begin and end ids."""
    return pieces.encode_decode(docs, MODEL, ["doc_id", "lang", "source"], digests=True)


STAGES = [("toxicity", toxic), ("quality", good), ("simhash", single), ("mixing", mixed), ("pieces", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
