"""Streaming sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ledger
from ..operators.lineage import cut
from .queue import new_folder, run_available


def append_chained(batch: DataFrame, store: str, number: int) -> None:
    """Appends rows (ledger, seq, ...) of a batch to a chained ledger at ``store``. Beside the rows of each batch stands a table of heads,
    the last hash of every
    ledger after it: a batch reads the heads of the one before, never its rows. A batch given again starts from the same heads and replaces itself."""
    spark = batch.sparkSession
    before = spark.read.parquet(f"{store}/heads/batch={number - 1}") if number else None
    spark_rows = f"{store}/rows/batch={number}"
    ledger.append(ledger.bodies(batch), heads=before).write.mode("overwrite").parquet(spark_rows)
    ledger.heads_after(spark.read.parquet(spark_rows), before).write.mode("overwrite").parquet(f"{store}/heads/batch={number}")


def append_batches(rows: DataFrame, batches: int) -> DataFrame:
    """rows worked off as a stream in ``batches`` parts by order of seq; the resulting ledger."""
    spark = rows.sparkSession
    source, store, mark = (new_folder(spark, n) for n in ("source", "ledger", "checkpoint"))
    most = rows.agg(F.max("seq")).first()[0] or 0
    kept = cut(rows)
    for i in range(batches):
        lo, hi = i * (most + 1) // batches, (i + 1) * (most + 1) // batches
        kept.where((F.col("seq") >= lo) & (F.col("seq") < hi)).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        run_available(stream, lambda df, n: append_chained(df, store, n), mark)
    return spark.read.parquet(f"{store}/rows/*").select("ledger", "seq", "prev_hash", "hash")
