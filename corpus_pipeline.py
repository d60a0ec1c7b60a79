"""A training-data pipeline: five stages over `documents`, each written and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of documents, without the rows and lines that the stage rejects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomwatch.llm import bpe, decontaminate, line_dedup, minhash, queries, toxicity
from loomwatch.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; the lexicon is learned from the labelled ones outside the held-out fold."""
    model = queries.toxicity_model(spark, docs.select("doc_id", "text"), sf_dir)
    return toxicity.drop_toxic(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines with an equal earlier line of any length go, and those of 20 characters or more with
    a nearly equal one; so do documents that lose all they had."""
    out = line_dedup.dedup_lines(docs, exact_chars=1)
    emptied = (F.col("lines_dropped") > 0) & (F.trim("text") == "")
    return out.where(~F.coalesce(emptied, F.lit(False))).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id."""
    return minhash.keep_one_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontaminate.drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, their number, and the digests of ids and decoded bytes."""
    vocabulary, pattern = queries.tokenizer()
    ids = bpe.encode_texts(docs.select("doc_id", "text"), vocabulary, pattern)
    return queries.bpe_digests(bpe.decode_ids(ids.drop("text"), vocabulary))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("minhash near-dedup", keep_one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level bpe", encode),
]

#: The learned lexicon and the merges of a vocabulary can't be put in SQL; tests hold the stages
#: against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
