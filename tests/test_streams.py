"""Stream operators with timers against plain simulations."""

import random
from datetime import datetime, timedelta, timezone

from veilframe.streaming import queue, timed

T0 = datetime(2024, 5, 1, tzinfo=timezone.utc)
US = int(T0.timestamp()) * 1_000_000


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def run(spark, turns, schema, operator):
    frames = [spark.createDataFrame(t, schema) for t in turns]
    return queue.in_turns(spark, [lambda _, f=f: f for f in frames], schema, operator, 3)


def plain_group(rows, idle=60):
    """Rows (shard, kind, entry, consumer, second, seq), one after another."""
    out, backlog, pending = [], {}, {}
    for shard, kind, entry, consumer, s, _ in sorted(rows, key=lambda r: (r[4], r[5])):
        waiting, held = backlog.setdefault(shard, []), pending.setdefault(shard, {})
        if kind == "add":
            waiting.append(entry)
        elif kind == "ack" and held.pop(entry, None):
            out.append((shard, "acknowledged", entry, consumer, s, 0))
        elif kind == "poll":
            idle_ones = sorted((t, e) for e, (_, t, _) in held.items() if t + idle <= s)[:entry]
            for _, e in idle_ones:
                held[e] = (consumer, s, held[e][2] + 1)
                out.append((shard, "reclaimed", e, consumer, s, held[e][2]))
            for e in waiting[:entry]:
                held[e] = (consumer, s, 1)
                out.append((shard, "delivered", e, consumer, s, 1))
            del waiting[:entry]
    return out


def test_consumer_group_against_plain(spark):
    rng = random.Random(3)
    rows, entry = [], 0
    for n in range(500):
        shard, s = rng.choice("ab"), n // 2 + rng.randrange(3)
        kind = rng.choices(["add", "poll", "ack"], [5, 2, 3])[0]
        entry += kind == "add"
        what = entry if kind == "add" else rng.randrange(1, 5) if kind == "poll" else rng.randrange(max(1, entry - 30), entry + 1)
        rows.append((shard, kind, what, rng.choice(["x", "y"]), s, n))
    rows.sort(key=lambda r: (r[4], r[5]))
    schema = "shard string, kind string, entry long, consumer string, at timestamp, seq long"
    cuts = [0, 120, 130, 300, 500]
    turns = [[(a, b, c, d, at(s), q) for a, b, c, d, s, q in rows[i:j]] for i, j in zip(cuts, cuts[1:], strict=False)]
    got = run(spark, turns, schema, lambda s: timed.consumer_group(s, late="10 seconds")).collect()
    want = plain_group(rows)
    assert sorted((r["shard"], r["kind"], r["entry"], r["consumer"], (r["us"] - US) // 1_000_000, r["deliveries"]) for r in got if r["kind"] != "idle") == sorted(want)
    assert {r[1] for r in want} == {"delivered", "reclaimed", "acknowledged"}


def test_breakers_tell_when_they_have_cooled(spark):
    schema = "kind string, provider string, at timestamp, tie long, failed boolean"
    calls = [("call", p, at(s), s, bad) for p, s, bad in (("a", 0, True), ("a", 10, True), ("a", 20, True), ("a", 30, True), ("b", 0, True), ("b", 5, False), ("b", 20, True))]
    turns = [calls, [("tick", None, at(200), 0, False)], [("call", "a", at(300), 9, False)]]
    got = {(r["key"], (r["us"] - US) // 1_000_000, r["state"], r["allowed"], r["kind"]) for r in run(spark, turns, schema, lambda s: timed.breakers(s, "provider")).collect()}
    assert got == {
        ("a", 0, "closed", True, "call"), ("a", 10, "closed", True, "call"), ("a", 20, "open", True, "call"), ("a", 30, "open", False, "call"), ("a", 80, "half_open", True, "cooled"), ("a", 300, "closed", True, "call"),
        ("b", 0, "closed", True, "call"), ("b", 5, "closed", True, "call"), ("b", 20, "closed", True, "call"),
    }


def test_answers_to_named_requests_and_too_late(spark):
    schema = "kind string, request_id long, owner long, at timestamp, approved boolean"
    turns = [
        [("ask", 1, 7, at(0), None), ("ask", 2, 7, at(0), None), ("ask", 3, 8, at(0), None), ("ask", 4, 9, at(0), None), ("answer", 1, 7, at(10), True), ("answer", 3, 7, at(20), True), ("answer", 4, 9, at(301), True)],
        [("answer", 2, 7, at(300), False)],
        [("tick", None, None, at(1000), None)],
    ]
    got = run(spark, turns, schema, lambda s: timed.approval_gate(s, late="10 seconds")).collect()
    assert sorted((r["request_id"], r["owner"], r["reason"]) for r in got) == [(1, 7, "approved-by-owner"), (2, 7, "rejected-by-owner"), (3, 8, "approval-timeout"), (4, 9, "approval-timeout")]


class _State:
    """A value, list or map state in memory."""

    def __init__(self):
        self.v, self.rows, self.map = None, [], {}

    exists = lambda self: self.v is not None or bool(self.rows) or bool(self.map)
    get = lambda self: iter(self.rows) if self.v is None else self.v
    appendList = lambda self, rows: self.rows.extend(rows)  # noqa: E731, N815
    updateValue = lambda self, k, v: self.map.__setitem__(k, v)  # noqa: E731, N815
    getValue = lambda self, k: self.map[k]  # noqa: E731, N815
    iterator = lambda self: iter(self.map.items())

    def update(self, v):
        self.v = v

    def clear(self):
        self.v, self.rows = None, []


def test_large_shards_are_worked_off_in_blocks():
    """Deliveries of a shard were one frame, and its rows of a micro-batch one list of Python objects."""
    import pandas as pd

    class Handle:
        getListState = getValueState = getMapState = lambda self, *a: _State()  # noqa: N815, E731
        registerTimer = deleteTimer = lambda self, *a: None  # noqa: N815, E731

    n = 25_000
    rows = pd.DataFrame({"kind": ["poll"] + ["add"] * n, "entry": [n + 5, *range(n, 0, -1)], "consumer": ["a"] + [None] * n, "us": [9] + [1] * n, "seq": [0, *range(n, 0, -1)]})
    assert [len(b) for b in timed._blocks(iter([rows[:70], rows[70:]]))] == [10_000, 10_000, 5_001]
    group = timed.ConsumerGroup(60_000)
    group.init(Handle())
    out = list(group.handleInputRows(("s",), iter([rows[:70], rows[70:]]), None))
    assert max(map(len, out)) <= 10_000
    assert [e for f in out for e in f["entry"]] == list(range(1, n + 1)) and {c for f in out for c in f["consumer"]} == {"a"}
    assert timed._in_order(iter([rows[:2], rows[2:4]]), "seq")[-1].kind == "poll"


class _Counted:
    """A handle that keeps timers and counts what is asked of the store."""

    def __init__(self):
        self.calls, self.timers, outer = 0, set(), self

        class Value(_State):
            def update(self, v):
                outer.calls += 1
                self.v = v

        self.getValueState = self.getMapState = self.getListState = lambda *a: Value()

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)


class _At:
    def __init__(self, ms):
        self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: ms


def test_owners_of_a_bucket_share_state_and_timer():
    """Each owner was a group of its own, and each request three calls of the store."""
    import pandas as pd

    rng, handle = random.Random(4), _Counted()
    gate = timed.ApprovalGate(60)
    gate.init(handle)
    got, want, open_, clock = [], [], {}, 0
    for turn in range(6):
        rows = []
        for n in range(3000):
            clock += rng.randrange(60_000)
            owner = rng.choice([None, *range(400)])
            ask = rng.random() < 0.5
            rows.append((clock, 0 if ask else 1, owner or 0, owner is not None, rng.randrange(2**60, 2**60 + 50) if ask or rng.random() < 0.3 else 0, None, rng.random() < 0.5))
            rows[-1] = (*rows[-1][:5], ask or rows[-1][4] > 0, rows[-1][6])
            us, answer, _, _, request, named, approved = rows[-1]
            held = open_.setdefault(owner, {})
            if not answer:
                held[request] = us
            elif owner is not None:
                for r in [request] if named else list(held):
                    if r in held and held[r] <= us <= held[r] + 60_000_000:
                        del held[r]
                        want.append((r, owner, "approved-by-owner" if approved else "rejected-by-owner"))
        rng.shuffle(rows)
        frame = pd.DataFrame(rows, columns=["us", "kind_order", "owner", "known", "request_id", "named", "approved"])
        before = handle.calls
        got += [f for f in gate.handleInputRows(("b",), iter([frame[:1000], frame[1000:]]), None)]
        assert handle.calls <= before + 2 and len(handle.timers) <= 1
        now = clock // 1000 - (30_000 if turn < 5 else -100_000)
        for at in [t for t in handle.timers if t <= now]:
            handle.timers.remove(at)
            got += [f for f in gate.handleExpiredTimer(("b",), _At(now), _At(at))]
        for owner, held in open_.items():
            for r in [r for r, us in held.items() if (us + 60_000_000) // 1000 + 1 <= now]:
                del held[r]
                want.append((r, owner, "approval-timeout"))
    rows = [(int(r), None if pd.isna(o) else int(o), why) for f in got for r, o, why in zip(f["request_id"], f["owner"], f["reason"], strict=True)]
    order = lambda x: sorted(x, key=str)
    assert order(rows) == order(want) and {w for *_, w in want} == {"approved-by-owner", "rejected-by-owner", "approval-timeout"}
    assert not handle.timers and not any(open_.values())


def _stores():
    """A handle whose map states are counted, and its states by name."""
    kept: dict = {}

    class Map(_State):
        calls = 0

        def updateValue(self, k, v):  # noqa: N802
            Map.calls += 1
            self.map[k] = v

        def removeKey(self, k):  # noqa: N802
            Map.calls += 1
            del self.map[k]

        def getValue(self, k):  # noqa: N802
            Map.calls += 1
            return self.map[k]

    class Handle:
        getValueState = getMapState = getListState = lambda self, name, *a: kept.setdefault(name, Map())  # noqa: E731, N815
        registerTimer = deleteTimer = lambda self, *a: None  # noqa: E731, N815

    return Handle(), Map, kept


def _frame_of(rows):
    import pandas as pd

    return pd.DataFrame([(kind, entry, consumer, US + s * 1_000_000, seq) for _, kind, entry, consumer, s, seq in rows], columns=["kind", "entry", "consumer", "us", "seq"])


def test_pending_entries_in_pages(monkeypatch):
    """Pages and pieces of a few entries, written out whenever more than a few are in memory, against the plain group."""
    monkeypatch.setattr(timed, "PAGE_BITS", 3)
    monkeypatch.setattr(timed, "IN_MEMORY", 20)
    monkeypatch.setattr(timed, "AT_ONCE", 7)
    rng = random.Random(11)
    rows, entry = [], 0
    for n in range(4000):
        kind = rng.choices(["add", "poll", "ack"], [5, 2, 4])[0]
        entry += rng.randrange(1, 4) if kind == "add" else 0
        what = entry - rng.randrange(3) if kind == "add" else rng.choice([1, 2, 4, 40]) if kind == "poll" else rng.randrange(-2, entry + 1)
        rows.append(("s", kind, what, rng.choice("xyz"), n // 3, n))
    handle, _, kept = _stores()
    got, i = [], 0
    while i < len(rows):
        j = i + rng.choice([1, 50, 700])
        group = timed.ConsumerGroup(60_000)
        group.init(handle)
        part = rows[i:j]
        rng.shuffle(part)
        frames = list(group.handleInputRows(("s",), iter([_frame_of(part)]), None))
        assert all(len(f) <= 7 for f in frames)
        got += [t for f in frames for t in f.itertuples(index=False)]
        i = j
    want = plain_group(rows)
    assert sorted((t.shard, t.kind, t.entry, t.consumer, (t.us - US) // 1_000_000, t.deliveries) for t in got) == sorted(want)
    assert {r[1] for r in want} == {"delivered", "reclaimed", "acknowledged"} and len(kept["pending"].map) > 5


def test_pending_entries_cost_few_calls_of_the_store():
    """Each delivery and each acknowledgement called the store; 36 million entries in eight shards did not end in time."""
    handle, store, kept = _stores()
    group = timed.ConsumerGroup(60_000)
    group.init(handle)
    n = 150_000
    first = [("s", "add", 8 * i, None, 0, i) for i in range(n)] + [("s", "poll", n - 50, "a", 1, 0), ("s", "poll", 20, "b", 1, 1)]
    out = list(group.handleInputRows(("s",), iter([_frame_of(first)]), None))
    assert sum(map(len, out)) == n - 30 and store.calls < 60
    acks = [("s", "ack", 8 * i, "a", 2, i) for i in range(n - 60)]
    assert sum(map(len, group.handleInputRows(("s",), iter([_frame_of(acks)]), None))) == n - 60
    assert store.calls < 120 and len(kept["pending"].map) == 1

    told = [t for f in group.handleExpiredTimer(("s",), None, _At(US // 1000 + 61_000)) for t in f.itertuples(index=False)]
    assert [(t.kind, t.entry, t.consumer, t.us) for t in told] == [("idle", 8 * i, "a" if i < n - 50 else "b", US + 61_000_000) for i in range(n - 60, n - 30)]
    assert [e for f in group.handleInputRows(("s",), iter([_frame_of([("s", "poll", 100, "c", 3, 0)])]), None) for e in f["entry"]] == [8 * i for i in range(n - 30, n)]
    assert not kept["backlog"].map


def test_idle_entries_of_many_pages(monkeypatch):
    """The timer's call went through the store entry by entry, and asked it once more for each idle one."""
    monkeypatch.setattr(timed, "PAGE_BITS", 10)
    monkeypatch.setattr(timed, "IN_MEMORY", 5_000)
    handle, store, _ = _stores()
    n = 30_000
    rows = [("s", "add", i, None, 0, i) for i in range(n)] + [("s", "poll", n // 2, "a", 1, 0), ("s", "poll", n // 2, "b", 30, 0)]
    timers: set = set()
    handle.registerTimer, handle.deleteTimer = timers.add, timers.remove
    group = timed.ConsumerGroup(60_000)
    group.init(handle)
    list(group.handleInputRows(("s",), iter([_frame_of(rows)]), None))
    assert timers == {US // 1000 + 61_000}
    before = store.calls
    frames = list(group.handleExpiredTimer(("s",), None, _At(US // 1000 + 61_000)))
    assert store.calls - before < 3 * n / 1024 + 10 and max(map(len, frames)) <= timed.AT_ONCE
    assert sorted(e for f in frames for e in f["entry"]) == list(range(n // 2)) and {(k, c, us) for f in frames for k, c, us in zip(f["kind"], f["consumer"], f["us"], strict=True)} == {("idle", "a", US + 61_000_000)}
    assert US // 1000 + 90_000 in timers
