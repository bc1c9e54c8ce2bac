"""Stateful stream operators with event-time timers: a consumer group, an approval gate, a circuit breaker.

Each is a ``StatefulProcessor`` whose state lives in Spark's state store and survives lost executors with the checkpoint. Rows
of a key are taken in order of their own times within a micro-batch; what ought to happen without a further row (an approval that is
not given, an entry that nobody acknowledges, a breaker that has cooled down) is told by timers once the watermark has passed. A stream
without traffic does not move its watermark: send a row of kind ``tick`` with the present time now and then.

Rows that come behind the watermark are dropped by Spark; ``late`` says how far rows may be out of order.
"""

from __future__ import annotations

import json
from collections import namedtuple
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .state import APPROVAL_SECONDS, COOLDOWN, FAILURE_WINDOW, FAILURES

#: Fixed value: milliseconds after which an entry that is not acknowledged may be claimed by another consumer.
IDLE_MS = 60_000
_TICK = "\x00tick"


def use_store(spark: SparkSession) -> None:
    """These operators need the state store on RocksDB, whose size memory does not bound."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _fields(schema: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in schema.split(",")]


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_fields(schema)).astype(object)


@lru_cache(maxsize=16)
def _row(columns: tuple[str, ...]) -> type:
    """Making a class of rows takes longer than working off a key of few rows."""
    return namedtuple("Row", columns)


def _in_order(rows: Iterator[pd.DataFrame], *more: str) -> list:
    """Rows of a key in this micro-batch, by time; nulls last."""
    every: list = []
    for part in rows:
        every += map(_row(tuple(part.columns)), *[part[c].tolist() for c in part.columns])
    if len(every) > 1:
        every.sort(key=lambda r: [(v is None or v != v, v) for v in (r.us, *(getattr(r, c) for c in more))])
    return every


#: Rows of a shard that are Python objects at once.
AT_ONCE = 10_000
_KINDS = ("add", "ack", "poll")


_ROW = np.dtype([("kind", "i1"), ("entry", "i8"), ("who", "i4"), ("us", "i8")])


def _blocks(rows: Iterator[pd.DataFrame], names: dict | None = None) -> Iterator[np.ndarray]:
    """(kind, entry, who, us) of a shard's rows in this micro-batch, by time and seq, in blocks of AT_ONCE. Held are numbers, 28 bytes a row
    and the order; names takes each consumer's name and number, before the first block is given."""
    names = {} if names is None else names
    parts = []
    for p in rows:
        p = p[p["kind"].isin(_KINDS)]
        kind = p["kind"].map({k: i for i, k in enumerate(_KINDS)}).to_numpy(np.int8)
        who = np.array([names.setdefault(c, len(names)) for c in p["consumer"].tolist()], np.int32)
        parts.append((kind, who, *(p[c].to_numpy(np.int64) for c in ("entry", "us", "seq"))))
    if not parts:
        return
    kind, who, entry, us, seq = (np.concatenate(c) for c in zip(*parts, strict=True))
    parts.clear()
    order = np.lexsort((seq, us))
    del seq
    for i in range(0, len(order), AT_ONCE):
        at = order[i : i + AT_ONCE]
        block = np.empty(len(at), _ROW)
        block["kind"], block["entry"], block["who"], block["us"] = kind[at], entry[at], who[at], us[at]
        yield block


# --- consumer group --------------------------------------------------------------------------------

_DELIVERY = "shard string, kind string, entry long, consumer string, us long, deliveries int"
_TELLS = ("delivered", "reclaimed", "acknowledged", "idle")
_TOLD = np.dtype([("kind", "i1"), ("entry", "i8"), ("us", "i8"), ("times", "i4"), ("who", "i4")])
_OUT = np.dtype([("entry", "i8"), ("us", "i8"), ("times", "i4"), ("who", "i4")])
_PAGE = np.dtype([("page", "i8"), ("oldest", "i8")])
#: Entries of a page have numbers alike but for so many bits; a piece of a backlog has at most as many entries; so many pending ones are in memory at once.
PAGE_BITS = 16
IN_MEMORY = 1_000_000


class _Pages:
    """What is out in a shard, by entry, in packed pages of neighbouring numbers: a call of the state store moves a page. The index knows the
    oldest delivery of each page."""

    def __init__(self, store, index):
        self.store, self.index = store, index
        self.oldest: dict[int, int] = dict(np.frombuffer(index.get()[0], _PAGE).tolist()) if index.exists() else {}
        self.pages: dict[int, np.ndarray] = {}
        self.changed: set[int] = set()
        self.stored, self.n, self.dirty = set(self.oldest), 0, False

    def page(self, page: int) -> np.ndarray:
        """Rows of a page, by entry."""
        if page not in self.pages:
            if self.n > IN_MEMORY:
                self._write()
            rows = np.frombuffer(self.store.getValue((page,))[0], _OUT) if page in self.oldest else np.empty(0, _OUT)
            self.pages[page], self.n = rows, self.n + len(rows)
        return self.pages[page]

    def _put(self, page: int, rows: np.ndarray) -> None:
        self.n += len(rows) - len(self.pages[page])
        self.pages[page], self.dirty = rows, True
        self.changed.add(page)
        if len(rows):
            self.oldest[page] = int(rows["us"].min())
        else:
            self.oldest.pop(page, None)

    def _write(self) -> None:
        for page in sorted(self.changed):
            if len(self.pages[page]):
                self.store.updateValue((page,), (self.pages[page].tobytes(),))
                self.stored.add(page)
            elif page in self.stored:
                self.store.removeKey((page,))
                self.stored.discard(page)
        self.changed.clear()
        self.pages.clear()
        self.n = 0

    def save(self) -> None:
        self._write()
        if self.dirty:
            self.index.update((np.array(sorted(self.oldest.items()), _PAGE).tobytes(),))

    def _places(self, entries: np.ndarray) -> Iterator[tuple[int, np.ndarray, slice, np.ndarray, np.ndarray]]:
        """For sorted entries without repeats, page by page: its number, its rows, which of the entries, where they belong, whether they are there."""
        pages = entries >> PAGE_BITS
        cuts = [0, *(np.flatnonzero(np.diff(pages)) + 1).tolist(), len(pages)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i < j:
                rows = self.page(page := int(pages[i]))
                at = np.searchsorted(rows["entry"], entries[i:j])
                there = at < len(rows)
                there[there] = rows["entry"][at[there]] == entries[i:j][there]
                yield page, rows, slice(i, j), at, there

    def give(self, told: np.ndarray) -> None:
        """Puts deliveries in, in place of earlier ones of the same entries."""
        entries, first = np.unique(told["entry"], return_index=True)
        new = told[first][list(_OUT.names)].astype(_OUT)
        for page, rows, part, at, there in self._places(entries):
            rows = rows.copy()
            rows[at[there]] = new[part][there]
            self._put(page, np.insert(rows, at[~there], new[part][~there]))

    def end(self, entries: np.ndarray) -> np.ndarray:
        """Takes entries off; gives where among them those stand, by their first place, that were out."""
        entries, first = np.unique(entries, return_index=True)
        out = []
        for page, rows, part, at, there in self._places(entries):
            if there.any():
                self._put(page, np.delete(rows, at[there]))
                out.append(first[part][there])
        return np.sort(np.concatenate(out)) if out else np.empty(0, np.int64)

    def idle(self, limit: int) -> Iterator[np.ndarray]:
        """What was delivered at ``limit`` or before, page by page."""
        for page in sorted(p for p, us in self.oldest.items() if us <= limit):
            rows = self.page(page)
            yield rows[rows["us"] <= limit]

    def first(self, after: int | None = None) -> int | None:
        """The time of the oldest delivery, or of the oldest later than that."""
        times = (us if after is None or us > after else min(self.page(p)["us"][self.page(p)["us"] > after].tolist(), default=None) for p, us in sorted(self.oldest.items()))
        return min((us for us in times if us is not None), default=None)


class _Backlog:
    """Entries that wait, in order: packed pieces in the store, of which one is read at a time, and behind them what has come in this micro-batch."""

    def __init__(self, store, ends):
        self.store, self.ends = store, ends
        self.first, self.taken, self.next = self.before = tuple(ends.get()) if ends.exists() else (0, 0, 0)
        self.piece: np.ndarray | None = None
        self.tail: list[np.ndarray] = []
        self.n = 0

    def add(self, entries: np.ndarray) -> None:
        self.tail.append(entries)
        self.n += len(entries)
        if self.n >= 1 << PAGE_BITS:
            self._store()

    def _store(self) -> None:
        rest, self.tail, self.n = np.concatenate(self.tail), [], 0
        for i in range(0, len(rest), 1 << PAGE_BITS):
            self.store.updateValue((self.next,), (rest[i : i + (1 << PAGE_BITS)].tobytes(),))
            self.next += 1

    def take(self, most: int) -> Iterator[np.ndarray]:
        while most > 0 and self.first < self.next:
            if self.piece is None:
                self.piece = np.frombuffer(self.store.getValue((self.first,))[0], np.int64)
            new = self.piece[self.taken : self.taken + most]
            most, self.taken = most - len(new), self.taken + len(new)
            if self.taken == len(self.piece):
                self.store.removeKey((self.first,))
                self.first, self.taken, self.piece = self.first + 1, 0, None
            yield new
        if most > 0 and self.n:
            every = np.concatenate(self.tail) if len(self.tail) > 1 else self.tail[0]
            self.tail, self.n = [every[most:]], max(0, len(every) - most)
            yield every[:most]

    def save(self) -> None:
        if self.n:
            self._store()
        if (self.first, self.taken, self.next) != self.before:
            self.ends.update((self.first, self.taken, self.next))


class _Told:
    """What is to be told of a shard, as numbers until it is given in frames of at most AT_ONCE rows."""

    def __init__(self, shard: str):
        self.shard, self.parts, self.n = shard, [], 0

    def add(self, kind: str, entries, us, times, who) -> np.ndarray:
        told = np.empty(len(entries), _TOLD)
        told["kind"], told["entry"], told["us"], told["times"], told["who"] = _TELLS.index(kind), entries, us, times, who
        self.parts.append(told)
        self.n += len(told)
        return told

    def frames(self, names: dict, least: int = 1) -> Iterator[pd.DataFrame]:
        if self.n < least:
            return
        every, self.parts, self.n = np.concatenate(self.parts), [], 0
        kinds, consumers = np.array(_TELLS, object), np.array([*names, None], object)
        for i in range(0, len(every), AT_ONCE):
            t = every[i : i + AT_ONCE]
            yield pd.DataFrame({"shard": np.full(len(t), self.shard, object), "kind": kinds[t["kind"]], "entry": t["entry"], "consumer": consumers[t["who"]], "us": t["us"], "deliveries": t["times"]})


class ConsumerGroup(StatefulProcessor):
    """One shard of a topic for one group: entries wait in ``backlog``; a poll first claims entries that another delivery has left
    without acknowledgement for ``idle_ms``, oldest delivery first, then takes new ones; ``pending`` holds what is out, by entry,
    with its owner. An acknowledgement, whoever sends it, takes the entry off the list. Calling the store for each entry takes longer than
    all else, so both are kept in packed pieces."""

    def __init__(self, idle_ms: int):
        self.idle_us = idle_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.backlog = handle.getMapState("backlog", "piece long", "entries binary")
        self.ends = handle.getValueState("ends", "first long, taken long, next long")
        self.pending = handle.getMapState("pending", "page long", "held binary")
        self.index = handle.getValueState("index", "pages binary")
        self.names = handle.getValueState("names", "names string")
        self.soonest = handle.getValueState("soonest", "us long")

    def _known(self) -> dict:
        """Consumers and their numbers."""
        return {name: i for i, name in enumerate(json.loads(self.names.get()[0]))} if self.names.exists() else {}

    def _claim(self, told: _Told, pages: _Pages, who: int, us: int, most: int) -> int:
        """Claims up to ``most`` idle entries; gives when the next one will be idle."""
        held = np.concatenate([np.empty(0, _OUT), *pages.idle(us - self.idle_us)])
        held = held[np.lexsort((held["entry"], held["us"]))[:most]]
        pages.give(told.add("reclaimed", held["entry"], us, held["times"] + 1, who))
        first = pages.first()
        return 0 if first is None else first + self.idle_us

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        if key[0] == _TICK:
            return
        before = soonest = self.soonest.get()[0] if self.soonest.exists() else 0
        pages, backlog, told, names = _Pages(self.pending, self.index), _Backlog(self.backlog, self.ends), _Told(key[0]), self._known()
        known = len(names)
        for block in _blocks(rows, names):
            for run in np.split(block, np.flatnonzero(np.diff(block["kind"])) + 1):
                kind = _KINDS[run["kind"][0]]
                if kind == "add":
                    backlog.add(run["entry"])
                elif kind == "ack":
                    ended = run[pages.end(run["entry"])]
                    told.add("acknowledged", ended["entry"], ended["us"], 0, ended["who"])
                else:
                    for _, most, who, us in run.tolist():
                        if soonest and soonest <= us:
                            soonest = self._claim(told, pages, who, us, most)
                        for new in backlog.take(most):
                            pages.give(told.add("delivered", new, us, 1, who))
                            soonest = soonest or (us + self.idle_us if len(new) else 0)
                            yield from told.frames(names, AT_ONCE)
                yield from told.frames(names, AT_ONCE)
        yield from told.frames(names)
        pages.save()
        backlog.save()
        if len(names) != known:
            self.names.update((json.dumps(list(names)),))
        self._watch(before, soonest)

    def _watch(self, before: int, soonest: int) -> None:
        if soonest == before:
            return
        if before:
            self.handle.deleteTimer(before // 1000)
        if soonest:
            self.soonest.update((soonest,))
            self.handle.registerTimer(soonest // 1000)
        else:
            self.soonest.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Entries that have become idle are told once, so that somebody polls; they stay pending."""
        limit = expiredTimerInfo.getExpiryTimeInMs() * 1000 + 999 - self.idle_us
        pages, told, names = _Pages(self.pending, self.index), _Told(key[0]), self._known()
        # idle ones stay claimable at once; the timer goes to the next that will be
        if (first := pages.first()) is not None:
            self.soonest.update((first + self.idle_us,))
        else:
            self.soonest.clear()
        if (later := pages.first(limit)) is not None:
            self.handle.registerTimer((later + self.idle_us) // 1000)
        for held in pages.idle(limit):
            told.add("idle", held["entry"], held["us"] + self.idle_us, held["times"], held["who"])
            yield from told.frames(names, AT_ONCE)
        yield from told.frames(names)

    def close(self) -> None:
        pass


def _timed(stream: DataFrame, time: str, key: Column, names: list[str], late: str) -> DataFrame:
    """Rows of the columns that a processor takes: key, time as event time and as microseconds, the named ones."""
    keyed = stream.select(F.when(F.col("kind") == "tick", F.lit(_TICK)).otherwise(key.cast("string")).alias("key"), F.col(time).alias("event_time"), F.unix_micros(time).alias("us"), *names)
    return keyed.withWatermark("event_time", late).groupBy("key")


def consumer_group(operations: DataFrame, shard: str = "shard", idle_ms: int = IDLE_MS, late: str = "0 seconds") -> DataFrame:
    """A stream of (shard, kind, entry, consumer, us, deliveries) from a stream of (shard, kind, entry, consumer, at, seq): kind ``add``
    puts an entry in, ``poll``
    asks for up to ``entry`` new and as many idle ones, ``ack`` ends one. seq orders rows of one time. What comes out is ``delivered``,
    ``reclaimed``, ``acknowledged``
    or, without any row coming in, ``idle``. Shards are the unit of distribution."""
    use_store(operations.sparkSession)
    keyed = _timed(operations, "at", F.col(shard), ["kind", "entry", "consumer", "seq"], late)
    return keyed.transformWithStateInPandas(ConsumerGroup(idle_ms), _DELIVERY, "append", "EventTime")


# --- approvals -------------------------------------------------------------------------------------

_DECISION = "request_id long, owner long, decision string, reason string"


#: Owners share so many groups of state: calling the store for each owner and request takes longer than deciding them.
BUCKETS = 512
_ASKED = np.dtype([("owner", "i8"), ("known", "?"), ("request", "i8"), ("us", "i8")])


class ApprovalGate(StatefulProcessor):
    """The open requests of the owners of a bucket, as one packed value. An answer decides the request that it names, or all open ones of its owner, if
    it comes in time; what is open at its deadline is rejected by a timer, of which a bucket has one, for its earliest deadline. Requests
    without an owner are never answered."""

    def __init__(self, seconds: int):
        self.us = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "asked binary")

    def _held(self) -> np.ndarray:
        return np.frombuffer(self.open.get()[0], _ASKED) if self.open.exists() else np.empty(0, _ASKED)

    def _hold(self, held: np.ndarray, timer: int) -> None:
        """Keeps what is open; timer: the one that stands, 0 for none."""
        if len(held):
            self.open.update((held.tobytes(),))
        else:
            self.open.clear()
        now = self._deadline(held)
        if now != timer:
            if timer:
                self.handle.deleteTimer(timer)
            if now:
                self.handle.registerTimer(now)

    def _deadline(self, held: np.ndarray) -> int:
        """The first millisecond at which the earliest of them is overdue."""
        return (int(held["us"].min()) + self.us) // 1000 + 1 if len(held) else 0

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if key[0] == _TICK:
            return
        kinds = {"us": np.int64, "kind_order": np.int8, "owner": np.int64, "known": bool, "request_id": np.int64, "named": bool, "approved": bool}
        parts = [[p[c].to_numpy(t) for c, t in kinds.items()] for p in rows]
        every = [np.concatenate(c) for c in zip(*parts, strict=True)]
        parts.clear()
        order, held = np.lexsort((every[1], every[0])), self._held()
        timer, mine = self._deadline(held), np.isin(held["owner"], every[2])
        asked: dict = {}
        for owner, known, request, us in held[mine].tolist():
            asked.setdefault(owner if known else None, {})[request] = us
        out = []
        for i in range(0, len(order), AT_ONCE):
            for us, answer, owner, known, request, named, approved in zip(*(c[order[i : i + AT_ONCE]].tolist() for c in every), strict=True):
                waiting = asked.setdefault(owner if known else None, {})
                if not answer:
                    waiting[request] = us
                elif known:
                    for r in [request] if named else list(waiting):
                        if r in waiting and waiting[r] <= us <= waiting[r] + self.us:
                            del waiting[r]
                            out.append((r, owner, "approved" if approved else "rejected", "approved-by-owner" if approved else "rejected-by-owner"))
            if out:
                yield _frame(out, _DECISION)
                out = []
        left = [(owner or 0, owner is not None, request, us) for owner, waiting in asked.items() for request, us in waiting.items()]
        self._hold(np.concatenate([held[~mine], np.array(left, _ASKED)]), timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Rejects all that the watermark has passed: no answer in time can come any more."""
        now, held = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()), self._held()
        over = (held["us"] + self.us) // 1000 + 1 <= now
        self._hold(held[~over], 0)
        late = held[over]
        for i in range(0, len(late), AT_ONCE):
            yield _frame([(r, owner if known else None, "rejected", "approval-timeout") for owner, known, r, _ in late[i : i + AT_ONCE].tolist()], _DECISION)

    def close(self) -> None:
        pass


def approval_gate(stream: DataFrame, seconds: int = APPROVAL_SECONDS, late: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """A stream of (request_id, owner, decision, reason) from a stream of (kind, request_id, owner, at, approved): kind ``ask`` opens a
    request, ``answer`` decides it;
    an answer without request_id decides all that its owner has open. Owners are dealt over buckets, the unit of distribution, whose
    number stays what it was when a checkpoint was begun. The batch form is ``state.approvals``."""
    use_store(stream.sparkSession)
    order = F.when(F.col("kind") == "ask", 0).otherwise(1).alias("kind_order")
    number = lambda c, there: (F.coalesce(c, F.lit(0)).cast("long").alias(c), F.col(c).isNotNull().alias(there))
    columns = ["kind", order, *number("owner", "known"), *number("request_id", "named"), F.coalesce("approved", F.lit(False)).alias("approved")]
    keyed = _timed(stream, "at", F.pmod(F.hash("owner"), F.lit(buckets)), columns, late)
    return keyed.transformWithStateInPandas(ApprovalGate(seconds), _DECISION, "append", "EventTime")


# --- circuit breaker -------------------------------------------------------------------------------

_CALL = "key string, us long, tie long, state string, allowed boolean, kind string"


class Breaker(StatefulProcessor):
    """The breaker of one provider: state, failures since the first of the window, and when it opened."""

    def __init__(self, failures: int, window: int, cooldown: int):
        self.failures, self.window, self.cooldown = failures, window * 1_000_000, cooldown * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "state string, count int, first long, opened long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if key[0] == _TICK:
            return
        state, count, first, opened = self.now.get() if self.now.exists() else ("closed", 0, 0, 0)
        was, out = opened if state == "open" else 0, []
        for r in _in_order(rows, "tie"):
            if state == "open" and r.us - opened >= self.cooldown:
                state = "half_open"
            allowed = state != "open"
            if allowed and not r.failed:
                state, count = "closed", 0
            elif allowed and state == "half_open":
                state, opened = "open", int(r.us)
            elif allowed:
                if not count or r.us - first > self.window:
                    count, first = 0, int(r.us)
                count += 1
                if count >= self.failures:
                    state, opened = "open", int(r.us)
            out.append((key[0], int(r.us), int(r.tie), state, allowed, "call"))
        self.now.update((state, count, first, opened))
        is_open = opened if state == "open" else 0
        if is_open != was:
            if was:
                self.handle.deleteTimer((was + self.cooldown) // 1000)
            if is_open:
                self.handle.registerTimer((is_open + self.cooldown) // 1000)
        yield _frame(out, _CALL)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Tells that a probe will be let through; the state changes with the probe."""
        state, _, _, opened = self.now.get()
        if state == "open":
            yield _frame([(key[0], opened + self.cooldown, 0, "half_open", True, "cooled")], _CALL)

    def close(self) -> None:
        pass


def breakers(calls: DataFrame, key: str, failures: int = FAILURES, window: int = FAILURE_WINDOW, cooldown: int = COOLDOWN, late: str = "0 seconds") -> DataFrame:
    """A stream of (key, us, tie, state, allowed, kind) from a stream of (kind, key, at, tie, failed): each call with the state it leaves
    behind, as in
    ``state.breaker_states``, and a row of kind ``cooled`` when an open breaker would let a probe through, though no call has come.
    Providers are the unit of distribution."""
    use_store(calls.sparkSession)
    keyed = _timed(calls, "at", F.col(key), ["tie", "failed"], late)
    return keyed.transformWithStateInPandas(Breaker(failures, window, cooldown), _CALL, "append", "EventTime")
