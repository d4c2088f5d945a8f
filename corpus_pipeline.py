"""A corpus pipeline of five stages, each one of the operators in plyforge.llm.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it
kept. The first four return rows of documents with the columns of documents;
the last returns the packed pieces. A cluster writes each stage's result as
Parquet and rereads it; run() does the same in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plyforge.llm import compress_quality, decontaminate, langid, near_copies, packing
from plyforge.llm.common import materialize
from plyforge.llm.queries import remainder, table, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language (no letter, or no text) go.

    Rows of equal or null doc_id are judged by their own texts; without a
    labelled language to learn from, every document goes.
    """
    model = langid.fit(docs, known=remainder(5) != 0)
    return langid.identify(docs, model).filter("lang_pred <> 'und'").select(COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely bad than good go.

    Null and empty texts have the labels' share of good ones as their score;
    rows of equal or null doc_id are judged by their own texts. Without labels
    of both classes the share decides for all, and without any label all stay.
    """
    model = compress_quality.fit(docs, table(spark, sf_dir, "labels"), known=remainder(3) != 1)
    return compress_quality.score(docs, model).filter("predicted = 1").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more) stays: that of the smallest doc_id.

    Rows are told apart by all their columns, so unlike texts under one doc_id
    are judged on their own. Among rows of a group's smallest doc_id, a hash of
    the columns decides; equal rows stay once. Rows of null id are judged like
    others, but go before any of the group that has an id. Null and empty texts
    are one group. No documents give none.
    """
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(*COLUMNS).alias("h1"), F.hash(*COLUMNS, F.lit(1)).alias("h2"))
    docs = docs.select(COLUMNS).withColumn("row", row)
    kept = near_copies.near_copies(docs, key="row").filter("row = component_id").select("row.h1", "row.h2").distinct()
    rows = docs.select("row.h1", "row.h2", *COLUMNS).join(kept, ["h1", "h2"], "left_semi")
    return rows.groupBy("h1", "h2").agg(F.first(F.struct(*COLUMNS)).alias("row")).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows make a twentieth or more go.

    Null and empty texts stay, rows of equal or null doc_id are judged by their
    own texts, and an empty benchmark sends none away.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of 1024 tokens.

    Null and empty texts are one piece, the end; every row gives its own pieces,
    also where doc_id repeats or is null; no documents give none.
    """
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language),
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Trained models and tokenizers have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
