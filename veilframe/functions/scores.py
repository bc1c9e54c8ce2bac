"""Weights, thresholds and sizes used in ranking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How much a shared entity says, by type; others count DEFAULT_WEIGHT.
WEIGHTS = {
    "NATIONAL_ID": 1.00, "PASSPORT_NUMBER": 1.00, "IBAN": 1.00, "TAX_ID": 1.00, "CREDIT_CARD_NUMBER": 1.00, "SOCIAL_SECURITY_NUMBER": 1.00, "DRIVERS_LICENSE": 1.00,
    "MEDICAL_RECORD_NUMBER": 0.95, "HEALTH_INSURANCE_ID": 0.95, "EMAIL_ADDRESS": 0.85, "PHONE_NUMBER": 0.80, "POSTAL_ADDRESS": 0.75, "DATE_OF_BIRTH": 0.40,
    "ORGANIZATION_NAME": 0.40, "PERSON_NAME": 0.30, "LOCATION": 0.10, "DATE_TIME": 0.05,
}
DEFAULT_WEIGHT = 0.30
STRONG, MEDIUM = 1.0, 0.4
LATENCY_BUCKETS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0)
TOP_K_MOST = 25
RRF_K = 60


def weight(entity_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, entity_type), F.lit(DEFAULT_WEIGHT))


def weight_sql(column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v:.2f}::DOUBLE" for k, v in WEIGHTS.items()) + f" ELSE {DEFAULT_WEIGHT}::DOUBLE END"


def strength(score: Column) -> Column:
    return F.when(score >= STRONG, "strong").when(score >= MEDIUM, "medium").otherwise("weak")


def strength_sql(column: str) -> str:
    return f"CASE WHEN {column} >= {STRONG} THEN 'strong' WHEN {column} >= {MEDIUM} THEN 'medium' ELSE 'weak' END"


def effective_k(k: Column, chunks: Column) -> Column:
    """More results for longer documents, up to TOP_K_MOST."""
    bonus = F.when(chunks <= 10, 0).otherwise(F.least(F.lit(10), F.floor(chunks / 3)))
    return F.when(chunks <= 0, k).otherwise(F.least(F.lit(TOP_K_MOST), F.greatest(k, k + bonus))).cast("int")


def document_k(k: Column, documents: Column, manual: bool = False) -> Column:
    """Results of each document where several are searched."""
    n = F.greatest(documents, F.lit(1))
    most = F.floor(F.lit(50) / n)
    return (F.greatest(F.lit(10), F.least(most, F.floor(k / n))) if manual else F.greatest(F.lit(5), F.least(most, k))).cast("int")


def widened(k: int) -> int:
    """Candidates of each list before fusion."""
    return min(3 * k, 50)
