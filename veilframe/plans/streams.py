"""Streaming queries: queues, dead letters, retries, sessions, approvals, breakers, rates, windows. Streams run over what there is
and end, so that their results can be held against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.lineage import cut
from ..streaming import queue, sinks, state, timed
from .base import query, table

_SCHEMA = "event_id long, user_id long, event_type string, value double"


def events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value")


def _us(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


def stamped(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("src_16_file_queue", "SELECT event_id, user_id, event_type FROM events")
def src_16(spark, d):
    path = queue.publish(events(spark, d), queue.new_folder(spark, "queue"), 4)
    good, _, _ = queue.settle(spark, path, _SCHEMA)
    return good.select("event_id", "user_id", "event_type")


@query("src_17_consumer_group", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def src_17(spark, d):
    """A group of consumers on the file queue stands for a broker's: partitions are shared out by key, each once."""
    path = queue.publish(events(spark, d), queue.new_folder(spark, "queue"), 4)
    good, _, _ = queue.settle(spark, path, _SCHEMA)
    return good.groupBy("event_type").agg(F.count("*").alias("n"))


#: When the entries of the group below are put in; everything else happens some seconds later.
_T0 = 1_735_689_600

_GROUP = """WITH e AS (SELECT event_id AS entry, CAST(user_id % 8 AS VARCHAR) AS shard, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS r FROM events),
o AS (SELECT *, CASE WHEN r <= 5 THEN 'c0' WHEN r <= 12 THEN 'c1' ELSE 'c2' END AS owner FROM e),
x AS (SELECT *, owner = 'c2' OR (owner = 'c1' AND entry % 2 = 0) AS prompt FROM o),
y AS (SELECT *, row_number() OVER (PARTITION BY shard, prompt ORDER BY entry) AS nth FROM x)
"""


def _group(spark, d):
    """A topic of eight shards and a group of three consumers. The first dies with five entries of each shard; the second acknowledges
    only even ones; the third acknowledges all it gets. Nothing is idle after 30 seconds; after 60 a tick tells what is, and the
    third consumer claims it, three entries first."""
    e = cut(events(spark, d).select((F.col("user_id") % 8).cast("string").alias("shard"), F.col("event_id").alias("entry")))
    shards = e.select("shard").distinct()
    row = lambda df, kind, entry, consumer, at, seq: df.select("shard", F.lit(kind).alias("kind"), entry.cast("long").alias("entry"), consumer.alias("consumer"), F.timestamp_seconds(F.lit(_T0 + at)).alias("at"), seq.cast("long").alias("seq"))
    poll = lambda consumer, most, at, seq: row(shards, "poll", F.lit(most), F.lit(consumer), at, F.lit(seq))
    tick = lambda at: row(shards, "tick", F.lit(0), F.lit(None).cast("string"), at, F.lit(0))
    ack = lambda df, at: row(df, "ack", F.col("entry"), F.col("consumer"), at, F.col("entry"))
    live = (F.col("kind") == "delivered") & ((F.col("consumer") == "c2") | ((F.col("consumer") == "c1") & (F.col("entry") % 2 == 0)))
    turns = [
        lambda _: row(e, "add", F.col("entry"), F.lit(None).cast("string"), 0, F.col("entry")).unionByName(poll("c0", 5, 1, 1)).unionByName(poll("c1", 7, 1, 2)).unionByName(poll("c2", 1 << 40, 1, 3)),
        lambda out: ack(out.where(live), 10).unionByName(poll("c2", 1000, 30, 0)),
        lambda _: tick(61),
        lambda _: poll("c2", 3, 62, 0).unionByName(poll("c2", 1 << 40, 63, 1)),
        lambda out: ack(out.where("kind = 'reclaimed'"), 70),
    ]
    schema = "shard string, kind string, entry long, consumer string, at timestamp, seq long"
    return queue.in_turns(spark, turns, schema, timed.consumer_group)


@query("src_17_pending_entries", _GROUP + f"SELECT entry, shard, owner AS first_owner, CASE WHEN prompt THEN owner ELSE 'c2' END AS last_owner, CASE WHEN prompt THEN 1 ELSE 2 END AS deliveries, CASE WHEN NOT prompt THEN CASE WHEN nth <= 3 THEN {_T0 + 62}000000 ELSE {_T0 + 63}000000 END END AS reclaimed_us, CAST(1 AS BIGINT) AS acknowledged FROM y")
def src_17_pending(spark, d):
    """What became of every entry: who had it first and last, how often it was given out, when it was claimed."""
    at = lambda kind: F.col("kind") == kind
    return _group(spark, d).groupBy("entry", "shard").agg(
        F.max(F.when(at("delivered"), F.col("consumer"))).alias("first_owner"), F.max_by("consumer", F.when(at("delivered") | at("reclaimed"), F.col("us"))).alias("last_owner"),
        F.max("deliveries").alias("deliveries"), F.max(F.when(at("reclaimed"), F.col("us"))).alias("reclaimed_us"), F.count_if(at("acknowledged")).alias("acknowledged"),
    )


@query("str_02_idle_entries", _GROUP + f"SELECT entry, shard, owner AS consumer, {_T0 + 61}000000 AS us FROM y WHERE NOT prompt")
def str_02_idle(spark, d):
    """Entries of dead or forgetful consumers, told by timers before anybody polls."""
    return _group(spark, d).where("kind = 'idle'").select("entry", "shard", "consumer", "us")


@query("snk_12_publish", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def snk_12(spark, d):
    path = queue.publish(events(spark, d), queue.new_folder(spark, "queue"), 3)
    return spark.read.schema(_SCHEMA).json(path).agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query("str_01_at_least_once", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def str_01(spark, d):
    """Every message is published twice; the sink keeps one of each id."""
    path = queue.publish(events(spark, d), queue.new_folder(spark, "queue"), 2)
    queue.publish(events(spark, d), path, 2)
    stream = queue.consume(spark, path, _SCHEMA).where("message is not null").select("message.*").dropDuplicates(["event_id"])
    return queue.drain(stream).groupBy("user_id").agg(F.count("*").alias("n"))


@query("str_02_recovery", "SELECT event_id FROM events")
def str_02(spark, d):
    """A consumer that stops half way goes on from its checkpoint."""
    e = cut(events(spark, d))
    path, out, mark = (queue.new_folder(spark, n) for n in ("queue", "out", "checkpoint"))

    def each(df, i):
        df.where("message is not null").select("message.event_id").write.mode("overwrite").parquet(f"{out}/batch={i}")

    for half in (0, 1):
        queue.publish(e.where(F.col("event_id") % 2 == half), path, 2)
        queue.run_available(queue.consume(spark, path, _SCHEMA), each, mark)
    return spark.read.schema("event_id long").parquet(f"{out}/*")


@query("str_03_dead_letters", "SELECT 'good' AS kind, count(*) FILTER (event_id % 11 <> 0) AS n FROM events UNION ALL SELECT 'dead', count(*) FILTER (event_id % 11 = 0) FROM events")
def str_03(spark, d):
    path = queue.new_folder(spark, "queue")
    line = F.when(F.col("event_id") % 11 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("event_id", "user_id", "event_type", "value")))
    events(spark, d).select(line.alias("value")).write.text(path)
    good, dead, _ = queue.settle(spark, path, _SCHEMA)
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count(good, "good").unionByName(count(dead, "dead"))


@query("str_04_requeue", "SELECT 'done' AS kind, count(*) FILTER (event_id % 50 <> 0) AS n FROM events UNION ALL SELECT 'given_up', count(*) FILTER (event_id % 50 = 0) FROM events")
def str_04(spark, d):
    path = queue.publish(events(spark, d).withColumn("attempt", F.lit(0)), queue.new_folder(spark, "queue"), 2)
    done, lost = queue.with_retries(spark, path, _SCHEMA + ", attempt int", F.col("event_id") % 50 == 0)
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return count(done, "done").unionByName(count(lost, "given_up"))


@query("str_05_batch_size", "SELECT 4 AS batches, count(*) AS n FROM events")
def str_05(spark, d):
    path = queue.publish(events(spark, d), queue.new_folder(spark, "queue"), 4)
    good, _, n = queue.settle(spark, path, _SCHEMA, most_files=1)
    return good.agg(F.lit(n).alias("batches"), F.count("*").alias("n"))


@query("str_06_audit_consumer", "SELECT user_id AS ledger, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def str_06(spark, d):
    rows = events(spark, d).where("event_type = 'error'").select(F.col("user_id").alias("ledger"), F.col("event_id").alias("seq"), "event_type")
    return sinks.append_batches(rows, 2).groupBy("ledger").agg(F.count("*").alias("n"))


@query("str_07_gateway", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'provider_error' END AS error, CASE WHEN event_type <> 'error' THEN 'echo ' || event_type END AS text FROM events")
def str_07(spark, d):
    """Requests answered by a handler; each gives a response and an audit row, written by batch."""
    path = queue.publish(events(spark, d), queue.new_folder(spark, "queue"), 2)
    responses, audits = queue.new_folder(spark, "responses"), queue.new_folder(spark, "audits")

    def each(df, i):
        m = df.where("message is not null").select("message.*")
        bad = F.col("event_type") == "error"
        m.select("event_id", F.when(bad, "provider_error").alias("error"), F.when(~bad, F.concat(F.lit("echo "), "event_type")).alias("text")).write.mode("overwrite").parquet(f"{responses}/batch={i}")
        m.select("event_id", F.current_timestamp().alias("at"), bad.alias("failed")).write.mode("overwrite").parquet(f"{audits}/batch={i}")

    queue.run_available(queue.consume(spark, path, _SCHEMA), each, queue.new_folder(spark, "checkpoint"))
    r = spark.read.schema("event_id long, error string, text string").parquet(f"{responses}/*")
    a = spark.read.schema("event_id long, at timestamp, failed boolean").parquet(f"{audits}/*")
    return r.join(a, "event_id", "left_semi")


@query("str_08_sessions", "WITH o AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) <= 3600000000 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM o) SELECT user_id, CAST(session AS BIGINT) AS session, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last, count(*) AS n FROM s GROUP BY user_id, session")
def str_08(spark, d):
    s = state.sessions(stamped(spark, d), "user_id", "ts")
    return s.select("user_id", "session", _us("first").alias("first"), _us("last").alias("last"), "n")


@query("str_08_live_sessions", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def str_08_live(spark, d):
    """The stateful form on a stream; the last count of each session is its whole."""
    path = queue.publish(events(spark, d), queue.new_folder(spark, "queue"), 2)
    stream = queue.consume(spark, path, _SCHEMA, most_files=1).where("message is not null").select("message.*")
    out = queue.drain(state.live_sessions(stream, "user_id"), "update", idle=False)
    return out.groupBy("user_id").agg(F.max("n").alias("n"))


_APPROVED = "WITH q AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), a AS (SELECT user_id, ts AS t, value >= 50 AS ok FROM events WHERE event_type = 'purchase'), f AS (SELECT q.event_id, q.user_id, arg_min(a.ok, a.t) AS ok FROM q LEFT JOIN a ON a.user_id = q.user_id AND a.t >= q.ts AND a.t <= q.ts + INTERVAL 7200 SECOND GROUP BY 1, 2) SELECT event_id AS request_id, user_id AS owner, CASE WHEN ok THEN 'approved' ELSE 'rejected' END AS decision, CASE WHEN ok IS NULL THEN 'approval-timeout' WHEN ok THEN 'approved-by-owner' ELSE 'rejected-by-owner' END AS reason FROM f"


@query("str_09_approvals", _APPROVED)
def str_09(spark, d):
    e = stamped(spark, d)
    q = e.where("event_type = 'view'").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("owner"), F.col("ts").alias("asked"))
    # an owner's next purchase answers all of their open questions
    a = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("answered"), (F.col("value") >= 50).alias("approved"))
    asked = q.select("request_id", "owner").join(a, F.col("owner") == F.col("user_id")).select("request_id", "owner", "answered", "approved")
    return state.approvals(q, asked, 7200)


_DAYS = [f"ts >= TIMESTAMP '2024-01-01' + INTERVAL {8 * i} DAY AND ts < TIMESTAMP '2024-01-01' + INTERVAL {8 * i + 8} DAY" for i in range(1, 3)]
#: The month in four parts, whatever lies outside in the first or last.
_PARTS = ["ts < TIMESTAMP '2024-01-09'", *_DAYS, "ts >= TIMESTAMP '2024-01-25'"]


@query("str_09_live_approvals", _APPROVED)
def str_09_live(spark, d):
    """The same questions and answers as a stream in four parts; what nobody answers is rejected by timers alone."""
    e = cut(stamped(spark, d).where("event_type IN ('view', 'purchase')"))
    ask = F.col("event_type") == "view"
    rows = e.select("ts", F.when(ask, "ask").otherwise("answer").alias("kind"), F.when(ask, F.col("event_id")).alias("request_id"), F.col("user_id").alias("owner"), F.col("ts").alias("at"), (F.col("value") >= 50).alias("approved"))
    tick = rows.agg(F.lit("tick").alias("kind"), F.lit(None).cast("long").alias("request_id"), F.lit(0).cast("long").alias("owner"), (F.max("at") + F.expr("INTERVAL 1 DAY")).alias("at"), F.lit(False).alias("approved"))
    turns = [lambda _, p=p: rows.where(p).drop("ts") for p in _PARTS] + [lambda _: tick]
    schema = "kind string, request_id long, owner long, at timestamp, approved boolean"
    return queue.in_turns(spark, turns, schema, lambda s: timed.approval_gate(s, 7200))


def _breaker_sql(key: str, failures: int, window: int, cooldown: int) -> str:
    """Calls of each key in order, folded one after another; window and cooldown in seconds."""
    return f"""WITH RECURSIVE c AS (SELECT {key} AS k, event_id, epoch_us(ts) AS us, event_type = 'error' AS failed, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS i FROM events),
b(k, i, event_id, us, state, allowed, n, since, opened) AS (
  SELECT k, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), 'closed', true, 0, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM (SELECT DISTINCT k FROM c)
  UNION ALL
  SELECT k, i, event_id, us,
    CASE WHEN now = 'open' THEN 'open' WHEN NOT failed THEN 'closed' WHEN now = 'half_open' OR fails >= {failures} THEN 'open' ELSE 'closed' END, now <> 'open',
    CASE WHEN now = 'open' THEN n WHEN NOT failed THEN 0 WHEN now = 'half_open' THEN n ELSE fails END,
    CASE WHEN now = 'closed' AND failed AND fails = 1 THEN us ELSE since END,
    CASE WHEN failed AND (now = 'half_open' OR (now = 'closed' AND fails >= {failures})) THEN us ELSE opened END
  FROM (SELECT c.k, c.i, c.event_id, c.us, c.failed, b.n, b.since, b.opened, CASE WHEN b.state = 'open' AND c.us - b.opened >= {cooldown}000000 THEN 'half_open' ELSE b.state END AS now,
          CASE WHEN b.n = 0 OR c.us - b.since > {window}000000 THEN 1 ELSE b.n + 1 END AS fails
        FROM b JOIN c ON c.k = b.k AND c.i = b.i + 1))
"""


#: Two failures within a day open the breaker for twelve hours.
_RARE = {"failures": 2, "window": 24 * 3600, "cooldown": 12 * 3600}
_BREAKER = _breaker_sql("user_id", **_RARE)


def _live_breakers(spark, d):
    e = cut(stamped(spark, d))
    rows = e.select("ts", F.lit("call").alias("kind"), F.col("user_id").alias("user"), F.col("ts").alias("at"), F.col("event_id").alias("tie"), (F.col("event_type") == "error").alias("failed"))
    tick = rows.agg(F.lit("tick").alias("kind"), F.lit(0).cast("long").alias("user"), (F.max("at") + F.expr("INTERVAL 1 DAY")).alias("at"), F.lit(0).cast("long").alias("tie"), F.lit(False).alias("failed"))
    turns = [lambda _, p=p: rows.where(p).drop("ts") for p in _PARTS] + [lambda _: tick]
    schema = "kind string, user long, at timestamp, tie long, failed boolean"
    return queue.in_turns(spark, turns, schema, lambda s: timed.breakers(s, "user", **_RARE))


@query("str_10_live_breaker", _BREAKER + "SELECT k AS user_id, event_id, us, state, allowed FROM b WHERE i > 0")
def str_10_live(spark, d):
    """A breaker for each user, on a stream in four parts."""
    return _live_breakers(spark, d).where("kind = 'call'").select(F.col("key").cast("long").alias("user_id"), F.col("tie").alias("event_id"), "us", "state", "allowed")


@query("str_10_breaker_by_user", _BREAKER + "SELECT k AS user_id, event_id, state, allowed FROM b WHERE i > 0")
def str_10_user(spark, d):
    """The batch form on the same calls."""
    e = stamped(spark, d).withColumn("tie", F.col("event_id"))
    return state.breaker_states(e, "user_id", "ts", F.col("event_type") == "error", **_RARE).select("user_id", F.col("tie").alias("event_id"), "state", "allowed")


@query("jn_13_live_replies", "SELECT event_id AS id, CASE WHEN event_id % 3 <> 0 AND event_id % 100 <= 60 THEN event_id % 100 END AS seconds, CASE WHEN event_id % 3 <> 0 AND event_id % 100 <= 60 THEN 'answer ' || user_id END AS text FROM events WHERE event_type = 'click'")
def jn_13_live(spark, d):
    """Requests and replies on one stream, in four parts: a reply within 60 seconds, or none once the watermark has passed. A third are
    never answered, others too late."""
    e = cut(stamped(spark, d).where("event_type = 'click'"))
    ask = e.select("ts", F.lit("request").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("at"), F.lit(None).cast("string").alias("text"))
    answer = e.where("event_id % 3 <> 0").select("ts", F.lit("reply").alias("kind"), F.col("event_id").alias("id"), (F.col("ts") + F.make_dt_interval(secs=F.col("event_id") % 100)).alias("at"), F.concat(F.lit("answer "), F.col("user_id").cast("string")).alias("text"))
    last = e.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("at")).select(F.explode(F.array(F.lit("request"), F.lit("reply"))).alias("kind"), F.lit(-1).cast("long").alias("id"), "at", F.lit(None).cast("string").alias("text"))
    rows = ask.unionByName(answer)
    turns = [lambda _, p=p: rows.where(p).drop("ts") for p in _PARTS] + [lambda _: last]

    def joined(s):
        asked = s.where("kind = 'request'").select(F.col("id").alias("correlation_id"), F.col("at").alias("sent"))
        replied = s.where("kind = 'reply'").select(F.col("id").alias("correlation_id"), F.col("at").alias("replied"), "text")
        return queue.correlate(asked, replied)

    found = queue.in_turns(spark, turns, "kind string, id long, at timestamp, text string", joined).where("id >= 0")
    return found.select("id", F.floor((F.unix_micros("replied") - F.unix_micros("sent")) / 1_000_000).alias("seconds"), "text")


@query("str_10_breaker_states", _breaker_sql("'p' || user_id % 5", 3, 120, 60) + "SELECT k AS provider, us / 1e6 AS t, event_id AS tie, state, allowed FROM b WHERE i > 0")
def str_10(spark, d):
    e = stamped(spark, d).withColumn("provider", F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string"))).withColumn("tie", F.col("event_id"))
    return state.breaker_states(e, "provider", "ts", F.col("event_type") == "error")


@query("str_11_rate_limit", "SELECT user_id, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, count(*) AS n, greatest(count(*) - 2, 0) AS over FROM events GROUP BY 1, 2")
def str_11(spark, d):
    return state.rate_limited(stamped(spark, d), "user_id", "ts", 2, "1 hour").select("user_id", _us("start").alias("start"), "n", "over")


_CACHE = """WITH k AS (SELECT user_id, max(event_id) AS newest FROM events GROUP BY 1),
f AS (SELECT user_id, newest, CASE WHEN user_id % 4 = 0 AND user_id % 3 <> 0 THEN 0 WHEN user_id % 2 = 0 AND user_id % 5 <> 0 THEN 1 WHEN user_id % 7 <> 0 THEN 2 END AS tier FROM k)
"""


def _tiers(spark, d):
    """A session's maps (a third of them older than a day), a node's (a fifth of them), and the store, which lacks some."""
    k = cut(events(spark, d).groupBy("user_id").agg(F.max("event_id").alias("value")))
    hours = lambda old: F.timestamp_seconds(F.lit(1_700_000_000) - F.when(old, 25 * 3600).otherwise(23 * 3600))
    by = F.col("user_id")
    tiers = [k.where(by % 4 == 0).withColumn("stored", hours(by % 3 == 0)), k.where(by % 2 == 0).withColumn("stored", hours(by % 5 == 0)), k.where(by % 7 != 0).withColumn("stored", hours(F.lit(True)))]
    return state.cached(tiers, k, "user_id", F.timestamp_seconds(F.lit(1_700_000_000)))


@query("str_12_map_cache", _CACHE + "SELECT user_id, tier, CASE WHEN tier IS NOT NULL THEN newest END AS newest FROM f")
def str_12(spark, d):
    """Maps from the fastest tier that holds them and has not outlived its day."""
    return _tiers(spark, d)[0].select("user_id", "tier", F.col("value").alias("newest"))


@query("str_12_map_backfill", _CACHE + "SELECT user_id, CAST(unnest(range(tier)) AS INTEGER) AS tier, newest FROM f WHERE tier > 0")
def str_12_backfill(spark, d):
    """What is written back into the faster tiers."""
    return _tiers(spark, d)[1].select("user_id", "tier", F.col("value").alias("newest"))


@query("str_13_ingestion_cap", "SELECT CAST(ceil(4 / 2.0) AS INTEGER) AS batches, count(*) AS n FROM events")
def str_13(spark, d):
    path = queue.publish(events(spark, d), queue.new_folder(spark, "queue"), 4)
    good, _, n = queue.settle(spark, path, _SCHEMA, most_files=2)
    return good.agg(F.lit(n).alias("batches"), F.count("*").alias("n"))


@query("str_14_progress", "SELECT count(*) AS rows_seen FROM events")
def str_14(spark, d):
    """Rows as the query's own progress reports count them."""
    path = queue.publish(events(spark, d), queue.new_folder(spark, "queue"), 2)
    q = queue.consume(spark, path, _SCHEMA).writeStream.option("checkpointLocation", queue.new_folder(spark, "checkpoint")).trigger(availableNow=True).foreachBatch(lambda df, i: None if df.count() < 0 else None).start()
    q.awaitTermination()
    seen = max((p["numInputRows"] for p in q.recentProgress), default=0)
    return spark.createDataFrame([(int(seen),)], "rows_seen long")


@query("str_15_tumbling", "SELECT event_type, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def str_15(spark, d):
    w = stamped(spark, d).groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select("event_type", _us("w.start").alias("start"), "n", "total")


@query("str_15_sliding", "WITH x AS (SELECT epoch_us(time_bucket(INTERVAL 12 HOUR, ts)) AS b FROM events) SELECT start, count(*) AS n FROM (SELECT b AS start FROM x UNION ALL SELECT b - 43200000000 FROM x) GROUP BY 1")
def str_15_sliding(spark, d):
    w = stamped(spark, d).groupBy(F.window("ts", "1 day", "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return w.select(_us("w.start").alias("start"), "n")


@query("str_15_stream_windows", "SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def str_15_stream(spark, d):
    """Windows over a stream with a watermark; repeated messages within it are dropped."""
    path = queue.new_folder(spark, "events")
    e = stamped(spark, d).select("event_id", "ts")
    e.unionByName(e).write.parquet(path)
    stream = spark.readStream.schema("event_id long, ts timestamp").parquet(path).withWatermark("ts", "400 days").dropDuplicatesWithinWatermark(["event_id"])
    out = queue.drain(stream.select("event_id", "ts"))
    return out.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select(_us("w.start").alias("start"), "n")
