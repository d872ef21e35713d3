"""Corpus pipeline: five stages from raw documents to a weighted mix.

Every stage takes all documents that its predecessor kept, as Parquet in the
shared folder, and returns the columns of ``documents`` with its decisions
applied; the last one adds what the mix takes of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, exact_dedup, langid, mixing, queries, simhash
from tidemark.llm.common import split_of, table, written
from tidemark.sources.shared import drop_table, scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified.

    Texts that are null, empty or without a letter go; long texts are read whole.
    Every row is judged by itself, so repeated rows and rows without an id share
    one fate, and nothing but the text counts. Without a labelled text to learn
    from, or with no rows at all, every document goes. Other columns stay.
    """
    learn = split_of(F.col("doc_id"), 5) != 0
    return langid.identify(docs, docs, learn).where(F.col("lang_pred") != langid.UNKNOWN).select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the smallest id, a null id last.

    A null text equals the empty one. Rows alike in id and text leave one of
    them. An empty table gives no rows. Other columns stay.
    """
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by SimHash: the smallest id.

    Texts without a word, null ones too, are linked to each other. Rows without an
    id stay, though others may be linked through them; rows that repeat a
    smallest id stay too. An empty table gives no rows. Other columns stay.
    """
    return simhash.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark.

    Every row is judged by its own text; null and empty texts have no words and
    stay, as do all rows if the benchmark is empty. Other columns stay.
    """
    return decontam.find_items(docs, table(spark, sf_dir, "benchmark")).where("NOT contaminated").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their words and those taken.

    Every row comes back once; rows that repeat an id in a source are taken
    alike. Texts without a word and empty tables give no rows, a null source is a
    source of its own, and repeated rows each come back.
    """
    return mixing.take(docs, quality=queries.quality_weights(spark, sf_dir))


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("decontamination", decontaminate),
    ("source_mixing", mix),
]

#: The learned first stage and the hashed fingerprints are beyond SQL; the
#: pipeline is tested against a brute-force version of every stage.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and reread.

    Once a stage is written, what its operators wrote and the stage before it are
    removed, so that at most two of the stages' tables exist at a time.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as tables:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
            done = tables.pop()
        if before:
            drop_table(spark, before)
        before = done
    return docs
