"""Cutting lineage with tables in the shared folder, and joins with tables of checked size."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most so many rows may be broadcast; callers keep its rows narrow.
BROADCAST_ROWS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a session whose tasks all run in the
    driver's process gets a new one; on a cluster, where each executor would write to its own disk, this raises."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master or 'the cluster'} share")
    own = f"file://{tempfile.mkdtemp(prefix='veilframe-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: later steps neither recompute it nor
    lose it with an executor. The table goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def drop() -> None:
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # noqa: BLE001 - the session has ended; whoever owns the folder clears it
            pass

    atexit.register(drop)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, by: str, each: int = 10_000) -> DataFrame:
    """The rows dealt over tasks of about ``each``. A small file of many narrow rows is read by one task; where what follows is dear for each
    row, deal out the keys and make the rest of the row from them."""
    return rows.repartition(max(1, -(-rows.count() // each)), by)


def join_small(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", rows: int | None = None, salts: int = 64) -> DataFrame:
    """Null-safe join on columns of the same names with a table that ought to be small. Its rows are counted:
    up to BROADCAST_ROWS it is broadcast; beyond, left is salted and right repeated for each salt, so that
    no key gathers in one task."""
    n = right.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    right = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    same: Column = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    if n <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), same, how).drop(*[f"_r_{c}" for c in on])
    left = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)))
    right = right.withColumn("_r_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.join(right, same & (F.col("_salt") == F.col("_r_salt")), how).drop("_salt", "_r_salt", *[f"_r_{c}" for c in on])


def join_counted(left: DataFrame, right: DataFrame, on: str, n: str = "n", crowd: int = 1000) -> DataFrame:
    """Inner join with a table of one row for each key, whose column ``n`` says how many rows of left have that key.
    Keys of more than ``crowd`` rows, which are no more than left's rows / crowd, are joined apart by ``join_small``,
    so that no key gathers in one task. Both sides are read twice: tables that were cut cost nothing more."""
    many = right.where(F.col(n) > crowd)
    rows = many.limit(BROADCAST_ROWS + 1).count()
    if rows == 0:
        return left.join(right, on)
    told = join_small(left, many.withColumn("_many", F.lit(True)), [on], "left", rows)
    rest = told.where("_many is null").select(*left.columns).join(right.where(F.col(n) <= crowd), on)
    return told.where("_many").select(*rest.columns).unionByName(rest)


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each context: they need not have it installed."""
    import io
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if getattr(context, "_veilframe_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    folder = tempfile.mkdtemp(prefix="veilframe-package-")
    (path := Path(folder, "veilframe.zip")).write_bytes(content.getvalue())
    context.addPyFile(str(path))
    context._veilframe_shipped = True
