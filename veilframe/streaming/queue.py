"""Queues of JSON files on Structured Streaming: publishing, consuming with a checkpoint, dead letters, retries, correlation."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import shared_dir


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def publish(rows: DataFrame, path: str, files: int | None = None) -> str:
    """Each row as a line of JSON, times to the microsecond. Files appear whole: Spark's committer renames them into place."""
    lines = rows.select(F.to_json(F.struct(*rows.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("value"))
    (lines.repartition(files) if files else lines).write.mode("append").text(path)
    return path


def consume(spark: SparkSession, path: str, schema: str, most_files: int | None = None) -> DataFrame:
    """A stream of (message, raw): message is null where a line is not a whole message of the schema."""
    reader = spark.readStream.format("text")
    if most_files:
        reader = reader.option("maxFilesPerTrigger", most_files)
    raw = reader.load(path)
    parsed = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    message = F.struct(*[parsed[c].alias(c) for c in [p.strip().split(" ")[0] for p in schema.split(",")]])
    return raw.select(F.when(parsed.isNotNull() & parsed["_bad"].isNull(), message).alias("message"), F.col("value").alias("raw"))


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", idle: bool = True) -> int:
    """Works off what there is, batch by batch, from where the checkpoint stands; gives the number of batches. A batch whose
    sink fails is given again: sinks write by batch id, so doing it twice does no harm. idle: whether batches without
    data run as well; an operator with processing-time timers would ask for them without end."""
    done: list[int] = []
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name, "true")

    def batch(df: DataFrame, i: int) -> None:
        each(df, i)
        done.append(i)

    try:
        conf.set(name, str(idle).lower())
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
        query.awaitTermination()
    finally:
        conf.set(name, before)
    return len(done)


def drain(stream: DataFrame, mode: str = "append", idle: bool = True) -> DataFrame:
    """All output of a stream over what there is now, as a table in the shared folder; in complete mode the last."""
    spark = stream.sparkSession
    out, last = new_folder(spark, "drained"), []

    def each(df: DataFrame, i: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={i}")
        last.append(i)

    run_available(stream, each, new_folder(spark, "checkpoint"), mode, idle)
    if not last:
        return spark.createDataFrame([], stream.schema)
    read = spark.read.schema(stream.schema)
    return read.parquet(f"{out}/batch={max(last)}") if mode == "complete" else read.option("basePath", out).parquet(*[f"{out}/batch={i}" for i in sorted(set(last))]).select(*stream.columns)


def in_turns(spark: SparkSession, turns: list[Callable[[DataFrame | None], DataFrame]], schema: str, operator: Callable[[DataFrame], DataFrame], files: int | None = None) -> DataFrame:
    """All output of an operator over messages that come in turns, from one checkpoint: each turn is given what has come out so far (None at
    first), what it gives is published, and the stream runs until it has been worked off."""
    path, out, mark = new_folder(spark, "turns"), new_folder(spark, "out"), new_folder(spark, "checkpoint")
    kind: list = []

    def each(df: DataFrame, i: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={i}")

    def so_far() -> DataFrame | None:
        return spark.read.schema(kind[0]).parquet(f"{out}/*") if kind else None

    for turn in turns:
        publish(turn(so_far()), path, files)
        stream = operator(consume(spark, path, schema).where("message is not null").select("message.*"))
        run_available(stream, each, mark)
        kind[:] = [stream.schema]
    return so_far()


def settle(spark: SparkSession, path: str, schema: str, most_files: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(messages, dead letters, batches) of a queue worked off once; both are written by batch id."""
    good, dead = new_folder(spark, "good"), new_folder(spark, "dead")

    def each(df: DataFrame, i: int) -> None:
        df.where("message is not null").select("message.*").write.mode("overwrite").parquet(f"{good}/batch={i}")
        df.where("message is null").select("raw").write.mode("overwrite").parquet(f"{dead}/batch={i}")

    n = run_available(consume(spark, path, schema, most_files), each, new_folder(spark, "checkpoint"))
    return spark.read.schema(schema).parquet(f"{good}/*"), spark.read.schema("raw string").parquet(f"{dead}/*"), n


def with_retries(spark: SparkSession, path: str, schema: str, fails: Column, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(done, given_up) of messages (schema with ``attempt int``): a failing one goes to the tail of the queue with attempt + 1,
    and is given up after ``most``, so that it holds up no other."""
    done, lost = new_folder(spark, "done"), new_folder(spark, "lost")
    checkpoint = new_folder(spark, "checkpoint")

    def each(df: DataFrame, i: int) -> None:
        m = df.where("message is not null").select("message.*")
        m.where(~fails).write.mode("overwrite").parquet(f"{done}/batch={i}")
        again = m.where(fails).withColumn("attempt", F.col("attempt") + 1)
        again.where(F.col("attempt") >= most).write.mode("overwrite").parquet(f"{lost}/batch={i}")
        retry = again.where(F.col("attempt") < most)
        if not retry.isEmpty():
            publish(retry, path, 1)

    while run_available(consume(spark, path, schema), each, checkpoint):
        pass
    return spark.read.schema(schema).parquet(f"{done}/*"), spark.read.schema(schema).parquet(f"{lost}/*")


def correlate(requests: DataFrame, replies: DataFrame, deadline: str = "60 seconds", late: str = "2 minutes") -> DataFrame:
    """Streams (correlation_id, sent) and (correlation_id, replied, text): every request with its reply, or with none once the
    deadline and the watermark have passed."""
    a = requests.withWatermark("sent", late).select(F.col("correlation_id").alias("id"), "sent")
    b = replies.withWatermark("replied", late)
    return a.join(b, F.expr(f"id = correlation_id AND replied >= sent AND replied <= sent + INTERVAL {deadline}"), "leftOuter").select("id", "sent", "replied", "text")
