"""Shared DataFrame helpers of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: Column, m: int) -> Column:
    """crc32(column as text) mod m; null for null."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(m))


def draw(seed: int, *columns: Column) -> Column:
    """A uniform number in [0, 1) that depends on the values alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 40)) / float(1 << 40)


def bounded_sample(df: DataFrame, stratum: str, key: str, per_stratum: int, seed: int, max_strata: int = 256) -> DataFrame:
    """About ``per_stratum`` rows of each stratum, drawn by a hash of ``key``; a row is taken or
    left whatever the partitioning. Counts cover all rows; strata beyond the ``max_strata`` most
    frequent ones are left out of the sample. Adds ``_u``, the draw, smallest first."""
    counts = df.groupBy(stratum).count().orderBy(F.desc("count"), stratum).limit(max_strata).collect()
    rate = F.lit(0.0)
    for value, n in counts:
        rate = F.when(F.col(stratum) == F.lit(value), F.lit(min(1.0, 1.15 * per_stratum / n))).otherwise(rate)
    return df.withColumn("_u", draw(seed, F.col(key))).where(F.col("_u") < rate)


def one_text_each(docs: DataFrame, picked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The picked ids with one text each, that of least hash: what is learned from is bounded by the ids, however often the
    table repeats them. picked, a bounded sample: _id and more. Repeats are combined before they are dealt out."""
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "_id")
    more = [c for c in picked.columns if c != "_id"]
    return found.groupBy("_id", *more).agg(F.min_by("_text", F.struct(F.xxhash64("_text"), "_text")).alias("_text"))


#: Rows that cross to Python at once; long texts make large batches.
BATCH_ROWS = 1000


def bounded_batches(df: DataFrame) -> None:
    """Keeps Arrow batches of the session to BATCH_ROWS rows, where its setting is larger: several tasks share an executor."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
