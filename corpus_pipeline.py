"""A corpus pipeline over `documents`: quality rules, language identification, near duplicates, packing.

Each stage is a function of (spark, docs, sf_dir) that works on all that the stage before it kept; `run` writes its
result as Parquet into the shared folder and reads it again as the next stage's docs. All but the last return the
columns of `documents`, as they were, whatever further columns there are. Every row is judged by itself: null and repeated
doc_ids are rows like others unless a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import langid, ngram_join, packing, quality
from textloom.llm.queries import PIECES, tokenizer_path
from textloom.llm.store import drop, kept, scratch, whole

#: A document is kept if its language was told with at least this posterior probability.
SURE = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that policy v1 keeps. A null or empty text has too few words and goes; texts are measured whole; an empty table
    stays empty. docs' columns are carried as one, so that none meets a measurement's name."""
    rows = docs.select(whole(docs).alias("row"), "text")
    return quality.apply_policy(quality.ledger(rows), "v1").where("kept").select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a learned language, told surely; `lang` stays as it was. Texts without a letter go. Where no row has a label
    nothing can be learned, and every row goes; an empty table stays empty."""
    model = langid.fit(docs, tokenizer_path(PIECES))
    told, lang, score = langid.judged(docs, model)
    return told.where(f"{lang} != 'und' and {score} >= {SURE}").select(*(f"`{c}`" for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of rows with similar shingle sets, the one with the least doc_id; repeated rows once. Rows without
    doc_id have no component and stay, as do rows without words, once each."""
    return ngram_join.one_of_each(docs, k=5, percent=80)


def length_buckets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in token-budget batches of optimal length buckets. Rows that repeat a doc_id, or have none, are packed like others; an
    empty table gives no rows; a text longer than the budget is a batch for itself."""
    return packing.pack(docs, carry=("text",))


STAGES = [("quality rules", quality_rules), ("language ID", language_id), ("n-gram Jaccard join", near_duplicates), ("packing", length_buckets)]
#: A trained language model and a dynamic program are no SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark):
            docs = kept(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
        if last is not None:
            drop(last)
        last = docs
    return docs
