"""All registered queries outside of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import mask, rules
from . import analysis, detection, functions, relational, sources, streams  # noqa: F401 - register
from .base import ORACLE_SQL, QUERIES, table

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked documents and how much was masked, under all packs."""
    done = mask.mask_documents(table(spark, sf_dir, "documents"), rules.compose(rules.PACKS))
    return done.select("doc_id", "masked", "n_masked")
