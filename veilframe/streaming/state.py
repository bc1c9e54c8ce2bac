"""Stateful operators: sessions with a sliding time to live, approvals with a deadline, circuit breakers, rate limits, event-time windows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds, failures.
SESSION_TTL, APPROVAL_SECONDS = 3600, 300
FAILURES, FAILURE_WINDOW, COOLDOWN = 3, 120, 60
MAP_TTL = 24 * 3600


def sessions(events: DataFrame, key: str, time: str, gap_seconds: int = SESSION_TTL) -> DataFrame:
    """(key, session, first, last, n): a session ends when nothing came for ``gap_seconds``."""
    w = Window.partitionBy(key).orderBy(time)
    new = F.coalesce(F.unix_micros(time) - F.unix_micros(F.lag(time).over(w)) > gap_seconds * 1_000_000, F.lit(True))
    numbered = events.select(key, time).withColumn("_new", new.cast("int")).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n"))


def live_sessions(stream: DataFrame, key: str, ttl_ms: int = SESSION_TTL * 1000) -> DataFrame:
    """A stream of (key, n, expired): messages by session so far, and sessions that idled away. State is dropped on expiry; every
    message, a read as well as a write, moves the expiry on."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = stream.schema[key].dataType.simpleString()

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n = state.get[0]
            state.remove()
            yield pd.DataFrame({key: [k[0]], "n": [n], "expired": [True]})
            return
        n = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
        state.update((n,))
        if ttl_ms > 0:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({key: [k[0]], "n": [n], "expired": [False]})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, expired boolean", "n long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def approvals(requests: DataFrame, answers: DataFrame, seconds: int = APPROVAL_SECONDS) -> DataFrame:
    """(request_id, owner, decision, reason): the owner's first answer within ``seconds`` of asking, else a rejection for want of time.
    requests: request_id, owner, asked; answers: request_id, owner, answered, approved."""
    a = answers.select(F.col("request_id").alias("rid"), F.col("owner").alias("by"), "answered", "approved")
    in_time = (F.col("rid") == F.col("request_id")) & (F.col("by") == F.col("owner")) & (F.col("answered") >= F.col("asked")) & (F.unix_micros("answered") <= F.unix_micros("asked") + seconds * 1_000_000)
    first = requests.join(a, in_time, "left").groupBy("request_id", "owner").agg(F.min_by("approved", "answered").alias("approved"))
    return first.select("request_id", "owner", F.when(F.coalesce("approved", F.lit(False)), "approved").otherwise("rejected").alias("decision"), F.when(F.col("approved").isNull(), "approval-timeout").when(F.col("approved"), "approved-by-owner").otherwise("rejected-by-owner").alias("reason"))


def cached(tiers: list[DataFrame], keys: DataFrame, key: str, now: Column, ttl_seconds: int = MAP_TTL) -> tuple[DataFrame, DataFrame]:
    """(found, backfill). found: for each of the keys its value from the first tier that holds it and, but for the last tier, put it
    there no longer than ``ttl_seconds`` ago, with the tier's number; null for a key that no tier holds. backfill: (key, tier, value),
    what the tiers before the one that answered lack. tiers: tables (key, value, stored), the fastest first; the last one keeps for good."""
    last = len(tiers) - 1
    held = [t.select(key, F.lit(i).alias("tier"), "value").where(F.lit(True) if i == last else F.unix_micros("stored") >= F.unix_micros(now) - ttl_seconds * 1_000_000) for i, t in enumerate(tiers)]
    best = reduce(DataFrame.unionByName, held).groupBy(key).agg(F.min("tier").alias("tier"), F.min_by("value", "tier").alias("value"))
    found = keys.select(key).distinct().join(best, key, "left")
    return found, found.where("tier > 0").select(key, F.explode(F.sequence(F.lit(0), F.col("tier") - 1)).alias("tier"), "value")


def breaker_states(calls: DataFrame, key: str, time: str, failed: Column, failures: int = FAILURES, window: int = FAILURE_WINDOW, cooldown: int = COOLDOWN) -> DataFrame:
    """(key, time, tie, state, allowed) for every call in order of time: closed until ``failures`` within ``window`` seconds, then open; after
    ``cooldown`` one probe is let through, and its outcome closes or reopens. Calls turned away change nothing. A key's calls are
    folded in order in one task, batch by batch: what is carried from one to the next is the state alone."""
    kind = calls.schema[key].dataType.simpleString()
    rows = calls.select(F.col(key).alias("k"), (F.unix_micros(time) / 1e6).alias("t"), F.monotonically_increasing_id().alias("tie") if "tie" not in calls.columns else F.col("tie").cast("long").alias("tie"), failed.alias("failed"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, count, first, opened = "closed", 0, 0.0, 0.0
        for pdf in batches:
            out = []
            for new, t, bad in zip(pdf["begins"], pdf["t"], pdf["failed"], strict=True):
                if new:
                    state, count, first, opened = "closed", 0, 0.0, 0.0
                if state == "open" and t - opened >= cooldown:
                    state = "half_open"
                allowed = state != "open"
                if allowed and not bad:
                    state, count = "closed", 0
                elif allowed and state == "half_open":
                    state, opened = "open", t
                elif allowed:
                    if count and t - first > window:
                        count = 0
                    first = t if count == 0 else first
                    count += 1
                    if count >= failures:
                        state, opened = "open", t
                out.append((state, allowed))
            yield pd.DataFrame({"k": pdf["k"], "t": pdf["t"], "tie": pdf["tie"], "state": [s for s, _ in out], "allowed": [x for _, x in out]})

    done = in_order(rows, "k", "t", "tie").mapInPandas(fold, f"k {kind}, t double, tie long, state string, allowed boolean")
    return done.select(F.col("k").alias(key), "t", "tie", "state", "allowed")


def in_order(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """rows dealt out by key and sorted, with ``begins`` where a key's first row stands: sorted runs spill, groups would not."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1
    # the window leaves rows in this very order, one key after another
    return rows.withColumn("begins", first)


def rate_limited(calls: DataFrame, key: str, time: str, most: int, per: str = "1 minute") -> DataFrame:
    """(key, start, n, over): calls of each key in tumbling windows, and how many are over the limit. Works on streams and tables."""
    n = calls.groupBy(key, F.window(time, per).alias("w")).agg(F.count("*").alias("n"))
    return n.select(key, F.col("w.start").alias("start"), "n", F.greatest(F.col("n") - most, F.lit(0)).alias("over"))
