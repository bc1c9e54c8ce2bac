"""Hash-chained ledger: canonical records, append, verification, retention, exports."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64


def canonical(record: dict) -> str:
    """Sorted keys, no blanks, escaped to ASCII, without the hash itself."""
    return json.dumps({k: v for k, v in record.items() if k != "hash"}, sort_keys=True, separators=(",", ":"))


def chain_hash(previous: str, body: str) -> str:
    return hashlib.sha256((previous + body).encode()).hexdigest()


def bodies(records: DataFrame, seq_col: str = "seq") -> DataFrame:
    """(ledger, seq, body) from rows of any columns besides ledger and seq."""
    names = [c for c in records.columns if c not in ("ledger", seq_col)]
    both = ["ledger", seq_col, *names]
    types = {f.name: f.dataType.simpleString() for f in records.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.select(names).to_pylist() if names else [{}] * b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([canonical(r) for r in rows], pa.string())], names=["ledger", "seq", "body"])

    return records.select(*both).mapInArrow(run, f"ledger {types['ledger']}, seq {types[seq_col]}, body string")


def append(rows: DataFrame, last: str = GENESIS, heads: DataFrame | None = None) -> DataFrame:
    """(ledger, seq, body, prev_hash, hash): every ledger chained in order of seq, from its hash in ``heads`` (ledger, hash; one row each)
    or from ``last``. A chain is
    sequential by nature; ledgers are the unit of distribution, so a busy source should be split into several. Rows are dealt out by ledger and
    sorted, and a batch takes no more than the hash before it."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    begun = rows.select("ledger", "seq", "body")
    if heads is not None:
        known = heads.select(F.col("ledger").alias("_of"), F.col("hash").alias("head"))
        begun = begun.join(known, F.col("ledger").eqNullSafe(F.col("_of")), "left").drop("_of")
    else:
        begun = begun.withColumn("head", F.lit(None).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, previous, started = None, last, False
        for b in batches:
            out = []
            for key, head, body in zip(b["ledger"].to_pylist(), b["head"].to_pylist(), b["body"].to_pylist(), strict=True):
                if not started or key != now:
                    now, previous, started = key, head or last, True
                out.append((previous, chain_hash(previous, body)))
                previous = out[-1][1]
            before, after = (list(x) for x in zip(*out, strict=True)) if out else ([], [])
            yield pa.RecordBatch.from_arrays([b["ledger"], b["seq"], b["body"], pa.array(before, pa.string()), pa.array(after, pa.string())], ["ledger", "seq", "body", "prev_hash", "hash"])

    ordered = begun.repartition("ledger").sortWithinPartitions("ledger", "seq")
    return ordered.mapInArrow(run, f"ledger {kinds['ledger']}, seq {kinds['seq']}, body string, prev_hash string, hash string")


def heads_after(chained: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(ledger, seq, hash): the last of each ledger, from what was chained and from the heads before it."""
    every = chained.select("ledger", "seq", "hash")
    every = every.unionByName(before) if before is not None else every
    return every.groupBy("ledger").agg(F.max_by("hash", "seq").alias("hash"), F.max("seq").alias("seq")).select("ledger", "seq", "hash")


def verify(rows: DataFrame, start: Column | None = None) -> DataFrame:
    """(ledger, n, first_break, kind): the first row whose prev_hash is not the hash before it or whose hash does not fit its body; null if none."""
    w = Window.partitionBy("ledger").orderBy("seq")
    expected = F.coalesce(F.lag("hash").over(w), start if start is not None else F.lit(GENESIS))
    bad = F.when(F.col("prev_hash") != expected, "prev_hash mismatch").when(F.col("hash") != F.sha2(F.concat("prev_hash", "body"), 256), "hash mismatch")
    return rows.withColumn("bad", bad).groupBy("ledger").agg(F.count("*").alias("n"), F.min(F.when(F.col("bad").isNotNull(), F.col("seq"))).alias("first_break"), F.min_by("bad", F.when(F.col("bad").isNotNull(), F.col("seq"))).alias("kind"))


def retain(rows: DataFrame, most_rows: int | None = None, oldest: Column | None = None, time_col: str = "ts") -> DataFrame:
    """Rows young enough, and of each ledger the last ``most_rows``. The first kept prev_hash is what verification starts from."""
    if oldest is not None:
        rows = rows.where(F.col(time_col) >= oldest)
    if most_rows is not None:
        w = Window.partitionBy("ledger").orderBy(F.desc("seq"))
        rows = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most_rows).drop("_n")
    return rows


def ndjson(record: Column) -> Column:
    return F.to_json(record)


def csv_line(columns: list[Column]) -> Column:
    """All values quoted, quotes doubled; null is empty."""
    return F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns])


def collector_event(time: Column, host: str, source: str, event: Column) -> Column:
    """An event in the envelope of a log collector. Host and source may hold no control characters and 256 at most."""
    for name in (host, source):
        if len(name) > 256 or any(ord(c) < 32 or ord(c) == 127 for c in name):
            raise ValueError("host and source may hold no control characters and 256 characters at most")
    return F.to_json(F.named_struct(F.lit("time"), time, F.lit("host"), F.lit(host), F.lit("source"), F.lit(source), F.lit("event"), event))
