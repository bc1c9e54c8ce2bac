"""Repairs of conversations against a plain search, a plain reading of the contract, and SQL."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tests.harness import connect, same
from veilframe.llm import queries, repair

WHITE = " \t\n\x0b\x0c\r"


def plain_best(kinds):
    """Cost and audit, audits compared as text: what follows from each state is worked out from the end."""
    after = {0: (0, ""), 1: (4, "II"), 2: (2, "I"), 3: (0, "")}
    inserted = {0: 2, 1: 2, 2: 3, 3: 2}
    for initial, gone, cut_off in reversed(kinds):
        new = {}
        for state in range(4):
            ways = []
            for k in range(4):
                now = state
                for _ in range(k):
                    now = inserted[now]
                ways.append((2 * k + 3 + after[now][0], "I" * k + "D" + after[now][1]))
                if not gone:
                    to = 3 if now == 2 else 2
                    ways.append((2 * k + 2 + cut_off + after[to][0], "I" * k + "R" + after[to][1]))
                    to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((initial, now))
                    if to is not None:
                        ways.append((2 * k + cut_off + after[to][0], "I" * k + "K" + after[to][1]))
            new[state] = min(ways)
        after = new
    return after[0]


def searched(kinds):
    """Every audit with at most two inserts in a place, judged by the pattern of its initials."""
    found = []
    for ops in itertools.product("KRD", repeat=len(kinds)):
        for runs in itertools.product(range(3), repeat=len(kinds) + 1):
            audit, options, cost = "", [""], 0
            for k, op, kind in zip(runs, [*ops, ""], [*kinds, None], strict=True):
                audit += "I" * k + op
                cost += 2 * k
                for _ in range(k):
                    options = [o + x for o in options for x in "ua"]
                if op == "D":
                    cost += 3
                elif op:
                    cost += 2 * (op == "R") + kind[2] + (1000 if kind[1] else 0)
                    options = [o + x for o in options for x in ("ua" if op == "R" else kind[0] or "?")]
            if cost < 1000 and any(re.fullmatch("(s?(ua)+)?", o) for o in options):
                found.append((cost, audit))
    return min(found)


ALL = [(i, False, t) for i in ("s", "u", "a", "") for t in (False, True)] + [("u", True, False)]


def test_against_search():
    for n in (0, 1, 2):
        for kinds in itertools.product(ALL, repeat=n):
            assert repair.solve(list(kinds)) == searched(kinds) == plain_best(kinds)
    rng = random.Random(4)
    for _ in range(60):
        kinds = [rng.choice(ALL) for _ in range(3)]
        assert repair.solve(kinds) == searched(kinds)


def test_against_plain_texts():
    rng = random.Random(5)
    for _ in range(1500):
        kinds = [rng.choice(ALL) for _ in range(rng.randrange(30))]
        assert repair.solve(kinds) == plain_best(kinds)


def test_chained_tables():
    """A conversation split anywhere is repaired as a whole one."""
    rng = random.Random(6)
    for _ in range(400):
        kinds = [rng.choice(ALL) for _ in range(rng.randrange(1, 25))]
        cuts = sorted({0, len(kinds), *(rng.randrange(len(kinds) + 1) for _ in range(3))})
        parts = [kinds[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        rows = []
        for p in parts:
            tables = [repair.run(p, entry)[:2] for entry in range(4)]
            rows.append({"costs": [-1 if b is None else c + b[0] for layer, c in tables for b in layer], "ranks": [-1 if b is None else b[1] for layer, _ in tables for b in layer]})
        audit = ""
        for p, (entry, to, tail) in zip(parts, repair._chain(rows), strict=True):
            audit += "".join(repair.trace(repair.run(p, entry)[2], to)) + "I" * tail
        assert audit == plain_best(kinds)[1]


def plain(rows):
    """The contract, row by row."""
    out, kept = {}, {}
    for c, t, r, x in rows:
        out.setdefault(c, [])
        told = lambda v: " " if v is None else str(v)
        f = zlib.crc32(f"{told(c)}:{told(t)}".encode()) % 20
        r, x = told(r), told(x)
        if f:
            x = "" if f == 1 else re.sub("[.!?]", "", x) if f == 2 else x
            out[c] += [(t, "user" if f == 4 else r, x)] * (2 if f == 3 else 1)
    for c, turns in out.items():
        turns.sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))
        kinds, seen, n = [], set(), dict.fromkeys("bdt-", 0)
        for _, r, x in turns:
            rest = x.rstrip(WHITE)
            fault = "b" if not rest else "d" if (r, x) in seen else "t" if rest[-1] not in ".!?" else "-"
            seen.add((r, x))
            n[fault] += 1
            kinds.append((r[:1] if r[:1] in "sua" else "", fault in "bd", fault == "t"))
        cost, audit = plain_best(kinds)
        said, i = [], 0
        for op in audit:
            role = "assistant" if said and said[-1][0] == "u" else "user"
            if op == "I":
                said.append(role + ":")
            else:
                if op != "D":
                    said.append((turns[i][1] if op == "K" else role) + ":" + turns[i][2])
                i += 1
        known = [t for t, _, _ in turns if t is not None]
        initials = [r[:1] for _, r, _ in turns]
        kept[c] = (
            max(known) - min(known) + 1 - len(set(known)) if known else 0, n["b"], n["d"], n["t"], sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
            cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest(),
        )
    return kept


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def agree(spark, rows, folder):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"part": F.lit("x"), "k": F.lit(0)})
    df.repartition(6).write.parquet(f"{folder}/conversations.parquet")
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op12_repair(spark, str(folder)).collect()}
    assert got == plain(rows)


def test_op12_sql(spark, sf):
    same(spark, connect(sf), sf, queries.op12_repair, queries.OP12_SQL)


@pytest.mark.parametrize(("turns", "chars"), [(4096, 4_000_000), (7, 4_000_000), (4096, 60)])
def test_op12_against_plain(spark, tmp_path, monkeypatch, turns, chars):
    """One conversation with a third of all rows, nulls everywhere, odd roles, ties; pieces of a few turns as well."""
    monkeypatch.setattr(repair, "PIECE_TURNS", turns)
    monkeypatch.setattr(repair, "PIECE_CHARS", chars)
    rng = random.Random(turns + chars)
    said = ["Yes.", "No", "Why?", "", " \n", "Well.\x85", "ok! \t", "é.", None]
    roles = ["user", "assistant", "system", "tool", "", None, "sage"]
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"turn {t}" + rng.choice([".", "", "?"])) for t in range(900)]
    rows += [(c, t, rng.choice(roles[:2] if c % 3 else roles), rng.choice([*said, f"turn {t}."])) for c in range(20, 220) for t in range(rng.randrange(1, 9))]
    rows += [(None, t, "user", "null id.") for t in range(5)] + [(9, None, "user", "no turn."), (9, None, "user", "no turn."), (9, None, "system", "First."), (9, 2, "user", "tie."), (9, 2, "user", "tie."), (9, 2, "assistant", "tie.")]
    rows += [(8, rng.randrange(40), rng.choice(roles), rng.choice(said)) for _ in range(300)]
    agree(spark, rows, tmp_path)


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi?"), (1, 2, "user", "Hi?"), (1, 3, "assistant", "Yes."), (2, 0, "system", "Be kind.")]
    links = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = [(r["conv"], r["edit"], r["role"], r["text"]) for r in repair.repaired(links).orderBy("conv", "part", "piece", "place").collect()]
    assert got == [(1, "I", "user", ""), (1, "K", "assistant", "Hello."), (1, "K", "user", "Hi?"), (1, "K", "assistant", "Yes.")]


def test_op12_empty(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op12_repair(spark, str(tmp_path)).collect() == []
