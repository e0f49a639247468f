"""A training corpus from raw documents: five stages, each over all that the one before it kept.

Toxic documents go; of exact copies and of near copies one each stays; byte strings that repeat lose their later occurrences;
what is left is packed into sequences. Every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import exact_dedup, near_dedup, packing, suffix_dedup, toxicity
from faultline.llm.common import apply_settings, column, keyed, table
from faultline.session import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under one half."""
    apply_settings(spark)
    rows, key = keyed(docs)
    judged = toxicity.toxicity(rows, table(spark, sf_dir, "labels"), row_col=key)
    toxic = judged.filter("predicted = 1").select(F.col("row").alias(key))
    return rows.join(toxic, key, "left_anti").select(*[column(c) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that says the same but for white space."""
    apply_settings(spark)
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words at a similarity of 0.8 or more."""
    apply_settings(spark)
    return near_dedup.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without byte strings that an earlier document, or an earlier place, holds; none is dropped."""
    apply_settings(spark)
    return suffix_dedup.with_kept_text(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with their token ids."""
    import public_tokenizers

    apply_settings(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("packing", pack),
]

# Scores and token ids are not to be had in SQL; the tests hold every stage against a plain evaluation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
