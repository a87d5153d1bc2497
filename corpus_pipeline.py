"""A corpus pipeline of five stages over ``documents``; each stage works on all that the one before kept.

All stages take empty tables (and give empty ones), repeated rows, null ids, texts and sources, texts of any length, and
further columns of any name, which all stages but the last carry along. What a stage does with them is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm import decontam, jaccard_join, langid, mixing, suffix_dedup
from lattiq.llm.common import id_crc, spent, table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts too) and those whose language is unclear, that is of a score
    below 0.5. Repeated rows are judged alike; a null language is filled in. Without labelled languages all texts with a
    letter stay."""
    return langid.keep_identified(docs, langid.train(docs.filter(id_crc() % 5 != 0)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document, by id, of each group of five-word shingle sets of Jaccard similarity 0.8 or more; one of equal
    rows. Different texts of one id, or of null ids, are different documents. Null, empty and word-less texts all stay."""
    return jaccard_join.keep_one(docs, width=5, percent=80)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every 200-byte string that still occurs elsewhere, in the same text too; ``n_chars`` follows. No row goes; a null
    text becomes an empty one, and repeated rows lose all that is in strings of that length."""
    return suffix_dedup.strip_repeats(docs, length=200).withColumn("n_chars", F.length("text").cast("long"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with 5 % or more of their words inside benchmark windows; null and empty texts stay, repeated rows go or
    stay together."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document, and when. Repeated rows are documents of their own, a null source is a
    source; texts without words take nothing. Columns are those of ``fair_queue``."""
    return mixing.fair_queue(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_copies", drop_near_copies),
    ("repeated_strings", cut_repeated_strings),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The stages use models, automata and link components, which SQL can't express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            spent(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
