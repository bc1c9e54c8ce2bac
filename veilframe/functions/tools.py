"""Envelopes of the tool surface."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def answer(data: Column, error: Column | None = None) -> Column:
    """{ok, data} or {ok, error} as a struct named r."""
    error = F.lit(None).cast("string") if error is None else error
    return F.struct(error.isNull().alias("ok"), F.when(error.isNull(), data).alias("data"), error.alias("error")).alias("r")
