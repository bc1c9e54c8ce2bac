"""The corpus pipeline: language, near-duplicates, contamination, personal data, mixture.

Each stage takes all that the one before kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilframe.llm import dart, decontaminate, language, mixing, pii
from veilframe.llm._common import table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin, lang set to it; the others go."""
    found = language.identify(docs, language.fit(docs), lang_as="_lang", score_as="_score", rejected_as="_rejected")
    return found.where("not _rejected").select(*[found["_lang"].alias("lang") if c == "lang" else found[c] for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the smallest id."""
    return dart.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets, n_chars set anew."""
    return pii.redact(docs, pii.train())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mixture: documents as often as they are taken, numbered by copy_no."""
    return mixing.apply(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
]

#: The stages rest on trained models, hashes and components; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
