"""Repair of the structure of conversations: the cheapest edits that give an optional system turn and then pairs of user and assistant.

Turns of a conversation are read in order. Each is kept (K), given the role user or assistant (R) or deleted (D); empty turns of
either role may be inserted (I) anywhere. Of the cheapest audits (edits in order) the one least by ASCII is taken.

The dynamic program has four states: nothing yet, after system, after user, after assistant. One step is a macro edit: a run of inserts and the
edit of one turn. Written out (``D``, ``IK``, ``IID``...) these codes are free of prefixes, so audits of as many turns are too,
and their order never changes by what follows. A layer therefore keeps no audits: for each state the cost, the *rank* of its audit among the
layer's four, and a pointer to the state and the code it came by. Ranks of the next layer follow from (rank before, code). Audits are read
back along the pointers. Layers less their least cost are few, so each step is looked up once it has been worked out.

The same holds for a stretch of turns, as a table from entry to exit states of (cost, rank), and such tables chain. So a conversation
of any length is split: turns are dealt out by ranges of (conversation, turn) and packed into pieces of at most ``PIECE_TURNS`` turns
or ``PIECE_CHARS`` code points; a conversation that lies within one piece is solved there, and of the others only the tables
travel to be chained, which tells each piece where it is entered and left. The hash of a repaired conversation takes its text in one
order by its nature; it is fed piece by piece and holds none of it.

Order: by turn, nulls first; ties by role, text and hash. A turn is blank without a sign other than white space, a duplicate if its role and text
stand earlier in the conversation (by 128 bits of hash), else truncated if its last such sign is none of ``.!?``. Null roles and texts count as one
space. A null conversation id is a conversation of its own. Conversations asked for that have no turns give empty results.
"""

from __future__ import annotations

import functools
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut, join_counted, join_small

#: Costs of the edits, and what an undeleted truncated turn adds.
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
PIECE_TURNS, PIECE_CHARS = 4096, 4_000_000
SPACE = " \t\n\x0b\x0c\r"

_START, _S, _U, _A = range(4)
_INSERTED = {_START: _U, _S: _U, _U: _A, _A: _U}
_MOST_INSERTS = 2  # three in a row would repeat a state
_CODES = sorted("I" * k + op for k in range(_MOST_INSERTS + 1) for op in "DKR")
_LEGAL = ("su", "ua", "au")


def _after(state: int, op: str, initial: str) -> int | None:
    """The state after an edit, None where it is not allowed."""
    if op == "D":
        return state
    if op == "R":
        return _A if state == _U else _U
    if initial == "s":
        return _S if state == _START else None
    if initial == "u":
        return _U if state != _U else None
    return _A if initial == "a" and state == _U else None


@functools.cache
def _moves(kind: tuple[str, bool, bool]) -> list[tuple[int, int, int, int]]:
    """(from, to, cost, code) of all macro edits of a turn of (initial, to be deleted, truncated)."""
    initial, gone, cut_off = kind
    out = []
    for state in range(4):
        for code, text in enumerate(_CODES):
            now = state
            for _ in text[:-1]:
                now = _INSERTED[now]
            op = text[-1]
            to = _after(now, op, initial)
            if to is None or (gone and op != "D"):
                continue
            cost = INSERT * (len(text) - 1) + (DELETE if op == "D" else (REROLE if op == "R" else 0) + TRUNCATED * cut_off)
            out.append((state, to, cost, code))
    return out


#: A layer: for each state (cost above the layer's least, rank), or None where no audit leads.
Layer = tuple[tuple[int, int] | None, ...]


@functools.cache
def _step(layer: Layer, kind: tuple[str, bool, bool]) -> tuple[Layer, int, tuple]:
    """(layer, what its least cost adds, for each state the (state, code) it comes from)."""
    best: list = [None] * 4
    for at, to, cost, code in _moves(kind):
        if layer[at] is not None:
            found = (layer[at][0] + cost, layer[at][1], code, at)
            if best[to] is None or found < best[to]:
                best[to] = found
    least = min(b[0] for b in best if b)
    order = sorted((b[1], b[2]) for b in best if b)
    ranked = tuple(b and (b[0] - least, order.index((b[1], b[2]))) for b in best)
    return ranked, least, tuple(b and (b[3], b[2]) for b in best)


def entered(state: int) -> Layer:
    return tuple((0, 0) if s == state else None for s in range(4))


def run(kinds: list, entry: int) -> tuple[Layer, int, list[tuple]]:
    """(last layer, least cost, pointers of each layer) from an entry state."""
    layer, total, pointers = entered(entry), 0, []
    for kind in kinds:
        layer, more, back = _step(layer, kind)
        total += more
        pointers.append(back)
    return layer, total, pointers


def end(layer: Layer) -> tuple[int, int, int]:
    """(cost, state, inserts) of the cheapest, then least, way to end: after an assistant, or with nothing at all."""
    ways = []
    for state, best in enumerate(layer):
        now = state
        for k in range(_MOST_INSERTS + 1):
            if best is not None and now in (_START, _A):
                ways.append((best[0] + INSERT * k, best[1], k, state))
            now = _INSERTED[now]
    cost, _, k, state = min(ways)
    return cost, state, k


def trace(pointers: list[tuple], state: int) -> list[str]:
    """The codes that lead to a state, read back along the pointers."""
    codes = []
    for back in reversed(pointers):
        state, code = back[state]
        codes.append(_CODES[code])
    return codes[::-1]


def solve(kinds: list) -> tuple[int, str]:
    """(cost, audit) of a conversation."""
    layer, total, pointers = run(kinds, _START)
    cost, state, k = end(layer)
    return total + cost, "".join(trace(pointers, state)) + "I" * k


def rewrite(codes: list[str], tail: int, entry: int, roles: list[str], texts: list[str]) -> list[tuple[str, str, str]]:
    """(edit, role, text) of the turns that stay or come in."""
    out, state = [], entry
    name = {_U: "user", _A: "assistant"}
    for code, role, text in zip([*codes, "I" * tail], [*roles, ""], [*texts, ""], strict=True):
        for op in code:
            if op == "I":
                state = _INSERTED[state]
                out.append((op, name[state], ""))
            elif op != "D":
                state = _after(state, op, role[:1])
                out.append((op, name[state] if op == "R" else role, text))
    return out


# --- pieces ----------------------------------------------------------------------------------------

_TABLE = "open boolean, first_initial string, last_initial string, first_turn long, last_turn long, turns long, distinct long, illegal long, blank long, duplicate long, truncated long, costs array<int>, ranks array<int>"
_PIECE = f"part int, piece int, {_TABLE}, entry int, exit int, tail int, kinds array<string>, roles array<string>, texts array<string>"


def _names(schema: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in schema.split(",")]


class Piece:
    """Consecutive turns of one conversation, in the making."""

    def __init__(self, conv, part: int, number: int):
        self.conv, self.part, self.number = conv, part, number
        self.kinds, self.roles, self.texts, self.turns, self.faults = [], [], [], [], []
        self.chars = 0

    def add(self, turn, role: str, text: str, duplicate: bool) -> None:
        rest = text.rstrip(SPACE)
        fault = "b" if not rest else "d" if duplicate else "t" if rest[-1] not in ".!?" else "-"
        self.kinds.append((role[:1] if role[:1] in ("s", "u", "a") else "", fault in "bd", fault == "t"))
        self.faults.append(fault)
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)

    def row(self, open_: bool) -> dict:
        known = [t for t in self.turns if t is not None]
        initials = [r[:1] for r in self.roles]
        out = {
            "conv": self.conv, "part": self.part, "piece": self.number, "open": open_,
            "first_initial": initials[0] if initials else None, "last_initial": initials[-1] if initials else None,
            "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None, "turns": len(self.roles), "distinct": len(set(known)),
            "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False)),
            "blank": self.faults.count("b"), "duplicate": self.faults.count("d"), "truncated": self.faults.count("t"),
            "costs": None, "ranks": None, "entry": None, "exit": None, "tail": None,
            "kinds": [i + "D" * gone + "T" * cut_off for i, gone, cut_off in self.kinds], "roles": self.roles, "texts": self.texts,
        }
        if open_:
            tables = [run(self.kinds, entry)[:2] for entry in range(4)]
            out["costs"] = [-1 if b is None else total + b[0] for layer, total in tables for b in layer]
            out["ranks"] = [-1 if b is None else b[1] for layer, _ in tables for b in layer]
        else:
            _, state, k = end(run(self.kinds, _START)[0])
            out |= {"entry": _START, "exit": state, "tail": k}
        return out


def _kind(text: str) -> tuple[str, bool, bool]:
    return text.rstrip("DT"), "D" in text, "T" in text


def _packed(kind: pa.DataType, rows: list[dict], names: list[str], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind if n == "conv" else kinds[n]) for n in names], names)


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}


def _kinds(schema: str) -> dict:
    return {c.strip().split(" ")[0]: _ARROW[c.strip().split(" ")[1]] for c in schema.split(",")}


def pieces(turns: DataFrame, conversations: DataFrame | None, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns in order, packed. A conversation that is neither the first nor the last of its range and small enough is whole in
    its piece, which is then closed: it knows how it ends. Open pieces carry their tables instead."""
    kind = turns.schema[conv].dataType.simpleString()
    said = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    hashed = F.struct(*[F.xxhash64(F.lit(i), "conv", "role", "text").alias(f"h{i}") for i in (1, 2)])
    said = said.withColumns({"head": F.substring("text", 1, 32), "k": hashed})
    # where a role and text come again: the first turn that has them, and marks for all later ones
    seen = said.groupBy("k", "conv", "turn", "role", "head").agg(F.lit(True).alias("again"))
    first = seen.groupBy("k").agg(F.count("*").alias("n"), F.min(F.struct(F.col("turn").isNotNull().alias("told"), "turn")).alias("first")).where("n > 1")
    seen, first = cut(seen), cut(first)
    late = join_counted(seen, first, "k").where(F.struct(F.col("turn").isNotNull().alias("told"), "turn") > F.col("first"))
    nothing = F.lit(None).cast("string")
    marks = late.select("conv", F.lit(1).alias("body"), "turn", "role", "head", "k", F.lit(0).alias("real"), nothing.alias("text"))
    real = said.select("conv", F.lit(1).alias("body"), "turn", "role", "head", "k", F.lit(1).alias("real"), "text")
    ids = (conversations.select(F.col(conv).alias("conv")) if conversations is not None else said.select("conv")).distinct()
    none = ids.select("conv", F.lit(0).alias("body"), F.lit(None).cast("long").alias("turn"), nothing.alias("role"), nothing.alias("head"), F.lit(None).cast(real.schema["k"].dataType).alias("k"), F.lit(0).alias("real"), nothing.alias("text"))
    order = ["conv", "body", "turn", "role", "head", "k"]
    dealt = real.unionByName(marks).unionByName(none).repartitionByRange(*order).sortWithinPartitions(*order, "real")
    dealt = dealt.select("conv", "body", "turn", "role", "text", F.col("k.h1").alias("k1"), F.col("k.h2").alias("k2"), "real", F.spark_partition_id().alias("part"))
    names = ["conv", *_names(_PIECE)]
    arrow = _kinds(_PIECE)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, split, marked, last = None, 0, True, None, None
        done, size, schema = [], 0, None
        for b in batches:
            schema = b.schema.field("conv").type
            for c, body, t, r, x, k1, k2, real, part in zip(*[b.column(i).to_pylist() for i in range(b.num_columns)], strict=True):
                if now is None or c != now.conv:
                    if now is not None:
                        # the first of the range, or one that was split, is open
                        done.append(now.row(split))
                        size += now.chars
                        split = False
                    now, marked, last = Piece(c, part, number), None, None
                    number += 1
                if not body:
                    continue
                if not real:
                    marked = (t, k1, k2)
                    continue
                if len(now.roles) >= PIECE_TURNS or now.chars >= PIECE_CHARS:
                    split = True
                    done.append(now.row(True))
                    size += now.chars
                    now = Piece(c, part, number)
                    number += 1
                # rows alike in all stand side by side, and in one range
                now.add(t, r, x, marked == (t, k1, k2) or last == (t, k1, k2))
                last = (t, k1, k2)
                if size > PIECE_CHARS or len(done) >= 1000:
                    yield _packed(schema, done, names, arrow)
                    done, size = [], 0
        if now is not None:
            done.append(now.row(True))
            yield _packed(schema, done, names, arrow)

    return cut(dealt.mapInArrow(pack, f"conv {kind}, {_PIECE}"))


def _chain(rows: list[dict]) -> list[tuple[int, int, int]]:
    """(entry, exit, tail) of the pieces of one conversation from their tables."""
    layer, back = entered(_START), []
    for r in rows:
        best: list = [None] * 4
        for at in range(4):
            for to in range(4):
                cost = r["costs"][4 * at + to]
                if layer[at] is not None and cost >= 0:
                    found = (layer[at][0] + cost, layer[at][1], r["ranks"][4 * at + to], at)
                    if best[to] is None or found < best[to]:
                        best[to] = found
        order = sorted(b[1:3] for b in best if b)
        layer = tuple(b and (b[0], order.index(b[1:3])) for b in best)
        back.append([b and b[3] for b in best])
    _, state, k = end(layer)
    out = []
    for i in reversed(range(len(rows))):
        out.append((back[i][state], state, k if i == len(rows) - 1 else 0))
        state = back[i][state]
    return out[::-1]


def linked(packed: DataFrame) -> DataFrame:
    """Pieces with where they are entered and left: open ones learn it from their conversation's chain of tables."""
    kind = packed.schema["conv"].dataType.simpleString()

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []

        def told() -> pa.RecordBatch:
            ways = _chain(rows)
            columns = [[r["part"] for r in rows], [r["piece"] for r in rows], *map(list, zip(*ways, strict=True))]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in columns], ["part", "piece", "entry", "exit", "tail"])

        for b in batches:
            for r in b.to_pylist():
                if rows and rows[-1]["conv"] != r["conv"]:
                    yield told()
                    rows = []
                rows.append(r)
        if rows:
            yield told()

    tables = packed.where("open").select("conv", "part", "piece", "costs", "ranks").repartition("conv").sortWithinPartitions("conv", "part", "piece")
    ways = cut(tables.mapInArrow(chain, "part int, piece int, entry int, exit int, tail int"))
    joined = join_small(packed.where("open").drop("entry", "exit", "tail"), ways, ["part", "piece"])
    return packed.where("not open").unionByName(joined.select(*packed.columns))


def _rewritten(r: dict) -> tuple[list[str], list[tuple[str, str, str]]]:
    codes = trace(run([_kind(k) for k in r["kinds"]], r["entry"])[2], r["exit"])
    return codes, rewrite(codes, r["tail"], r["entry"], r["roles"], r["texts"])


def repaired(links: DataFrame) -> DataFrame:
    """(conv, part, piece, place, edit, role, text) of every turn of the repaired conversations, in order of part, piece and place."""
    kind = links.schema["conv"].dataType.simpleString()

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                if new := _rewritten(r)[1]:
                    n = len(new)
                    edit, role, text = zip(*new, strict=True)
                    columns = [pa.array([r["conv"]] * n, b.schema.field("conv").type), pa.array([r["part"]] * n, pa.int32()), pa.array([r["piece"]] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(edit), pa.array(role), pa.array(text)]
                    yield pa.RecordBatch.from_arrays(columns, ["conv", "part", "piece", "place", "edit", "role", "text"])

    return links.mapInArrow(turns, f"conv {kind}, part int, piece int, place int, edit string, role string, text string")


_SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Sum:
    """One conversation, piece by piece."""

    def __init__(self, conv):
        self.conv, self.audit, self.sha, self.said = conv, io.StringIO(), hashlib.sha256(), False
        self.n = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
        self.distinct, self.first, self.turn, self.initial = 0, None, None, None

    def add(self, r: dict) -> None:
        codes, new = _rewritten(r)
        audit = "".join(codes) + "I" * r["tail"]
        self.audit.write(audit)
        for name in ("blank", "duplicate", "truncated", "illegal"):
            self.n[name] += r[name]
        kept = sum(k.endswith("T") and c[-1] != "D" for k, c in zip(r["kinds"], codes, strict=True))
        self.n["cost"] += DELETE * audit.count("D") + REROLE * audit.count("R") + INSERT * audit.count("I") + TRUNCATED * kept
        if r["turns"]:
            self.n["illegal"] += self.initial is not None and self.initial + r["first_initial"] not in _LEGAL
            self.initial = r["last_initial"]
        if r["first_turn"] is not None:
            self.distinct += r["distinct"] - (self.turn == r["first_turn"])
            self.first = r["first_turn"] if self.first is None else self.first
            self.turn = r["last_turn"]
        for _, role, text in new:
            self.sha.update((("\n" if self.said else "") + role + ":" + text).encode())
            self.said = True

    def row(self) -> dict:
        gaps = 0 if self.first is None else self.turn - self.first + 1 - self.distinct
        return {"conv": self.conv, "gaps": gaps, **self.n, "audit": self.audit.getvalue(), "repaired_sha256": self.sha.hexdigest()}


def summary(links: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation."""
    kind = links.schema["conv"].dataType.simpleString()
    names, arrow = ["conv", *_names(_SUMMARY)], _kinds(_SUMMARY)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, schema = None, [], None
        for b in batches:
            schema = b.schema.field("conv").type
            for r in b.to_pylist():
                if now is None or now.conv != r["conv"]:
                    if now is not None:
                        done.append(now.row())
                    now = _Sum(r["conv"])
                now.add(r)
            if done:
                yield _packed(schema, done, names, arrow)
                done = []
        if now is not None:
            yield _packed(schema, [*done, now.row()], names, arrow)

    schema = f"conv {kind}, {_SUMMARY}"
    in_order = links.where("open").repartition("conv").sortWithinPartitions("conv", "part", "piece")
    return links.where("not open").mapInArrow(add, schema).unionByName(in_order.mapInArrow(add, schema))


def repair(turns: DataFrame, conversations: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Linked pieces of all conversations, for ``summary`` and ``repaired``. conversations: a table whose ids are wanted even where no turn is left."""
    return linked(pieces(turns, conversations, conv, turn, role, text))


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns with faults put in by a hash of ``conv:turn``: dropped, emptied, without their ends, repeated, or said by the user."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h: Column = F.pmod(F.crc32(F.concat(told(conv), F.lit(":"), told(turn)).cast("binary")), F.lit(20))
    said = F.when(h == 1, "").when(h == 2, F.regexp_replace(told(text), "[.!?]", "")).otherwise(told(text))
    by = F.when(h == 4, "user").otherwise(told(role))
    times = F.explode(F.when(h == 3, F.array(F.lit(0), F.lit(1))).when(h != 0, F.array(F.lit(0))))
    return rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), by.alias("role"), said.alias("text"), times.alias("_copy")).drop("_copy")
