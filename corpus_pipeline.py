"""A corpus pipeline in five stages: toxicity, language, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of ``documents``. A
stage's result is written and read again before the next one starts, so a lost executor never sets back more than one
stage. The same rows stay however many there are; models are fitted on bounded samples, all else is over all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karyospark.llm import common, decontamination, jaccard, language, packing, tokens, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; the model learns from every labelled fold."""
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.without_toxic(docs, model)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with the calibrated confidence; without any learned language all stay."""
    model = language.train(docs, F.lit(True))
    return language.accepted(docs, model) if model.languages else docs


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of the n-gram Jaccard join connect: the one with the least id.

    Links are of five words and a similarity of 0.8 or more; op7_jaccard has a contract of its own.
    """
    return jaccard.representatives(docs, words=5, least=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its edit budget."""
    return decontamination.without_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens."""
    return packing.pack(packing.document_examples(docs), tokens.vocabulary_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: Models, tokens and edit distances are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
