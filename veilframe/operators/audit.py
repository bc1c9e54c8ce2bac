"""Filters, counts and reports over audit events and detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import plain_spans

#: Plain patterns that Java and other engines read alike, by entity type.
PLAIN = {
    "EMAIL_ADDRESS": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "IP_ADDRESS": r"[0-9]+(?:\.[0-9]+){3}",
    "CREDIT_CARD_NUMBER": r"[0-9]{16}",
    "PHONE_NUMBER": r"\+[0-9][0-9 ().-]+[0-9]",
}


def detections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, entity_type, start, end, value) of the plain patterns, in one pass."""
    return plain_spans(docs, PLAIN, id_col, text_col)


def filtered(events: DataFrame, event_type: str | None = None, user: int | None = None, since=None, until=None) -> DataFrame:
    """Events that pass every given test; both ends of the time range count."""
    for test in (
        F.col("event_type") == event_type if event_type is not None else None,
        F.col("user_id") == user if user is not None else None,
        F.col("ts") >= F.lit(since).cast("timestamp") if since is not None else None,
        F.col("ts") <= F.lit(until).cast("timestamp") if until is not None else None,
    ):
        if test is not None:
            events = events.where(test)
    return events


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of ordered rows; size is kept within 1 and 200."""
    size = min(max(size, 1), 200)
    return rows.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def visible(rows: DataFrame, user: int, admin: bool = False, owner: str = "user_id") -> DataFrame:
    """Rows of the user and of nobody; all of them for an administrator."""
    return rows if admin else rows.where((F.col(owner) == user) | F.col(owner).isNull())
