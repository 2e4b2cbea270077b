"""A corpus pipeline of five stages; each is written as Parquet and reread as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import bayes_jaccard, lang_mixture, mix_schedule, piece_stream, secret_cost
from leafmill.llm.common import held_out, read_table, release, stored, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets lang to the language found; documents without any (null, or no letter in them) go."""
    model = lang_mixture.train(docs.where(~held_out("doc_id")))
    return lang_mixture.with_language(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least doc_id stays."""
    return bayes_jaccard.one_of_each(docs)


def counted(docs: DataFrame) -> DataFrame:
    """With n_chars set to the length of the text, where there is such a column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark and n_chars follows; all documents stay."""
    return counted(secret_cost.redacted(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in its order; repeats are rows of their own, n_chars follows a cut."""
    return counted(mix_schedule.resampled(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_ids of every row."""
    return piece_stream.encoded(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("sentencepiece", encode),
]

# Trained models, hashes and piece ids are beyond SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Once a stage is written, what it was made from is deleted."""
    docs, before = read_table(spark, sf_dir, "documents"), len(written)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, before, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
