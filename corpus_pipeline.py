"""A corpus pipeline: each stage reads what the one before it wrote and keeps its decisions.

Language identification drops rejected documents; SimHash keeps one document of each group; secret
scans mask credentials; mixing takes documents as often as their source's target asks; SentencePiece
encoding gives the ids of what is left. Nulls, empty texts and empty tables have the results that
the operators define; an empty text is rejected by the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ombra.llm import langid, mixing, pieces, secrets, simhash
from ombra.llm.common import documents, written
from ombra.plans.shared import forget, large, passing


#: Words of a shingle and fingerprints of a document in the near-duplicate stage.
SHINGLE, PRINTS = 5, 2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, trained on these, doesn't reject."""
    return langid.accepted(docs, langid.fit(docs, ~langid.held_out()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that any of their fingerprints link: the one with the smallest id; of texts with that id, the one that hashes lowest. Rows with a null id stay."""
    found = simhash.near_duplicates(docs, size=SHINGLE, prints=PRINTS).where("id is not null")
    first = found.groupBy("group").agg(F.min(F.struct("id", "key")).alias("first")).select("first.id", "first.key").distinct()
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("own"), simhash.text_key().alias("own_key"), F.col("text").alias("text"))
    kept = rows.join(large(first), (F.col("own") == F.col("id")) & (F.col("own_key") == F.col("key")), "left_semi")
    # equal rows are one document
    kept = kept.withColumn("n", F.row_number().over(W.partitionBy("own", "own_key").orderBy("text"))).where("n = 1")
    return kept.unionByName(rows.where("own is null").withColumn("n", F.lit(1))).select("doc.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with credentials masked but for widely copied examples."""
    return secrets.redacted(docs, F.col("doc_id"), F.col("source"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of its schedule."""
    return mixing.mixed(docs, F.col("source"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids, and where their pieces begin and end in bytes of the text, for each document as taken."""
    return pieces.encoded(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", secret_scan),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding),
]

#: A trained classifier and piece merges can't be written in SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole table; what a stage wrote on its way goes once its result is stored."""
    docs, before = documents(spark, sf_dir), None
    for n, (name, stage) in enumerate(STAGES):
        if n == len(STAGES) - 1:
            docs = stage(spark, docs, sf_dir)
        else:
            with passing(spark) as kept:
                docs, path = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
                kept.add(path)
            if before:
                forget(spark, before)
            before = path
    return docs
