"""Substring deduplication by relative Lempel-Ziv parsing.

Every document is a reference block for those that follow it (by id, then position). Blocks are
indexed by their runs of ``window`` words, keyed so that only runs that can repeat are indexed at all. A document is
parsed greedily (``factors``): at a word where a run was seen before, a factor opens that points to the run's earliest
place, and it grows for as long as the next runs point to the places that follow. Where it can grow no
more, the next run is looked up anew, so runs that straddle the border of two factors are found as well.
Factors are at least ``window`` words long, and their words are the duplicate spans. So a word is in a
span exactly if some run that covers it begins earlier as well.

What is indexed is chosen by anchors: of the short runs within each window, the one with the least hash, which two equal
windows share. Every slice of texts sends each of its anchors once, to be joined with those of all other slices; only anchors
found again there, or within their own slice, come back to their documents, and only windows above such anchors are
indexed, by hashes of 96 bits. Nothing about the corpus is held by the driver or shipped to all tasks. Runs repeated within a slice are
settled on the spot, so however often a passage occurs, each slice sends it once; a document that repeats an earlier one
as a whole is settled as one run, and sends no windows.

Words are runs of anything but ASCII blanks, unchanged. Nulls and empty texts have no words. Ids order
documents, null last. Rows that share an id are told apart, and ordered, by the hash of their text; rows
that share both are one document, and each of them gets its result. An empty table gives no rows. Columns other
than id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded_batches
from ._words import U64, Words, as_strings, mix, ngrams, slices, split, whole

SEED_WORDS = 9


def _least(a: np.ndarray, width: int) -> np.ndarray:
    """Minima of all stretches of ``width``."""
    if a.size < width:
        return a[:0]
    have = 1
    while have * 2 <= width:
        a, have = np.minimum(a[:-have], a[have:]), have * 2
    return np.minimum(a[: a.size - (width - have)], a[width - have :])


def _seeds(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all short runs, and for each window whether it lies in one document, and its seed."""
    short = min(SEED_WORDS, window)
    grams = ngrams(words.hash, short, seed=1)
    return grams, whole(words, window), _least(grams, window - short + 1)


def anchors(texts: DataFrame, keys: list[str], window: int) -> DataFrame:
    """(keys, starts): for each document the windows whose anchors occur again, one window for each anchor at least.
    texts: keys, text. An anchor that occurs again within its slice is known at once and asks nothing; the others
    are sent with their document, one row for each slice."""
    fields = [texts.schema[k] for k in keys]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = as_strings(batch.column(n_keys))
            for lo, hi in slices(column):
                words = split(column.slice(lo, hi - lo))
                grams, ok, seed = _seeds(words, window)
                at = np.flatnonzero(ok)
                new = np.ones(at.size, bool)
                new[1:] = (seed[at[1:]] != seed[at[:-1]]) | (words.doc[at[1:]] != words.doc[at[:-1]])
                at = at[new]
                at = at[np.lexsort((words.doc[at], seed[at]))]
                new = np.ones(at.size, bool)
                new[1:] = (seed[at[1:]] != seed[at[:-1]]) | (words.doc[at[1:]] != words.doc[at[:-1]])
                at = at[new]
                value, times = np.unique(grams, return_counts=True)
                again = times[np.searchsorted(value, seed[at])] > 1 if at.size else np.zeros(0, bool)
                first = np.ones(at.size, bool)
                first[1:] = seed[at[1:]] != seed[at[:-1]]
                # one row of each anchor asks, or tells the others; what is known already goes back as one list a document
                ask, told = at[first], at[again]
                told = told[np.argsort(words.doc[told], kind="stable")]
                who, count = np.unique(words.doc[told], return_counts=True)
                spread = mix(who.astype(U64) ^ (seed[told[0]] if told.size else U64(0)), 92)
                of = pa.array(lo + np.concatenate([words.doc[ask], who]))
                start = lambda x: (x - words.first[words.doc[x]]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(start(told)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([seed[ask], spread]).astype(np.int64)), *[batch.column(i).take(of) for i in range(n_keys)],
                        pa.array(np.concatenate([start(ask), np.full(who.size, -1, np.int32)])), pa.concat_arrays([pa.nulls(ask.size, lists.type), lists]),
                    ],
                    names=["anchor", *keys, "start", "told"],
                )

    asked = texts.select(*keys, "text").mapInArrow(run, f"anchor long, {ddl}, start int, told array<int>")
    asked = asked.withColumn("n", F.count("*").over(Window.partitionBy("anchor")))
    return asked.where("told is not null or n > 1").select(*keys, F.coalesce("told", F.array("start")).alias("starts"))


def first_texts(texts: DataFrame) -> DataFrame:
    """The smallest id of each text, as hints: (id, starts = [-1]). texts: id, text."""
    firsts = texts.groupBy(F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")).agg(F.min("id").alias("id"))
    return firsts.select("id", F.array(F.lit(-1)).alias("starts"))


def _ranks(keys: list) -> np.ndarray:
    """Places of keys in order, nulls last; equal keys share a place."""
    order = sorted(set(keys), key=lambda k: tuple((x is None, 0 if x is None else x) for x in k))
    place = {k: i for i, k in enumerate(order)}
    return np.array([place[k] for k in keys], np.int64)


def windows(hinted: DataFrame, keys: list[str], window: int, copies: bool) -> DataFrame:
    """Windows that may repeat, one row for each and slice (known null), and runs of windows that repeat an earlier one
    of their slice, which need no more checking (known: how many windows, and where they repeat).
    hinted: keys, text, starts (null for none). If copies, a row whose starts lack -1 repeats a whole text; all of it is
    one run, whose reference is null: the first row with that text."""
    fields = [hinted.schema[k] for k in keys]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known_type = [pa.field("len", pa.int32()), pa.field("ref", batch.column(0).type), pa.field("ref_start", pa.int32())]
            column = as_strings(batch.column(n_keys))
            all_keys = list(zip(*[batch.column(i).to_pylist() for i in range(n_keys)], strict=True))
            hints = batch.column(n_keys + 1)
            hint = hints.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            hint_of = np.repeat(np.arange(batch.num_rows), np.nan_to_num(np.asarray(hints.value_lengths().to_numpy(zero_copy_only=False), float)).astype(int))
            for lo, hi in slices(column, 1 << 21):
                words = split(column.slice(lo, hi - lo))
                _, ok, seed = _seeds(words, window)
                mine = slice(*np.searchsorted(hint_of, [lo, hi]))
                start, of = hint[mine], hint_of[mine] - lo
                copy = np.full(hi - lo, copies)
                copy[of[start < 0]] = False
                ok &= ~copy[words.doc[: ok.size]]
                whole_runs = np.flatnonzero(copy & (np.diff(words.first) >= window))
                again = np.unique(seed[(words.first[of] + start)[start >= 0]])
                at = np.flatnonzero(ok & (again[np.minimum(np.searchsorted(again, seed), again.size - 1)] == seed)) if again.size else np.zeros(0, np.int64)
                h1, h2 = ngrams(words.hash, window, seed=21)[at], ngrams(words.hash, window, seed=22)[at]
                doc = words.doc[at]
                start = at - words.first[doc]
                rank = _ranks(all_keys[lo:hi])[doc]
                order = np.lexsort((start, rank, h2, h1))
                doc, start, h1, h2, rank = doc[order], start[order], h1[order], h2[order], rank[order]
                new = np.ones(order.size, bool)
                new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                head = np.maximum.accumulate(np.where(new, np.arange(order.size), 0))
                # the same place of the same document, from rows that repeat each other, is no repetition
                known = ~new & ~((rank == rank[head]) & (start == start[head]))
                o = np.flatnonzero(known)[np.lexsort((start[known], doc[known]))]
                d, s, rd, rs = doc[o], start[o], doc[head[o]], start[head[o]]
                opens = np.ones(o.size, bool)
                opens[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1) | (rd[1:] != rd[:-1]) | (rs[1:] != rs[:-1] + 1)
                first = np.flatnonzero(opens)
                f = np.flatnonzero(new)
                who = np.concatenate([doc[f], d[first], whole_runs])
                take = lambda i, which: batch.column(i).take(pa.array(lo + which))
                # settled rows go anywhere
                spread = mix(np.concatenate([h1[o[first]] ^ o[first].astype(U64), whole_runs.astype(U64) ^ U64(at.size)]), 91)
                lengths = np.concatenate([np.diff(np.append(first, o.size)), np.diff(words.first)[whole_runs] - window + 1]).astype(np.int32)
                refs = pa.concat_arrays([take(0, rd[first]), pa.nulls(whole_runs.size, batch.column(0).type)])
                runs = [pa.array(lengths), refs, pa.array(np.concatenate([rs[first], np.zeros(whole_runs.size, np.int64)]).astype(np.int32))]
                starts = np.concatenate([start[f], s[first], np.zeros(whole_runs.size, np.int64)]).astype(U64)
                none = pa.nulls(f.size, pa.struct(known_type))
                known = pa.concat_arrays([none, pa.StructArray.from_arrays(runs, fields=known_type)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([h1[f], spread]).astype(np.int64)), pa.array((np.concatenate([h2[f], mix(spread, 1)]) << U64(32) | starts).astype(np.int64)), *[take(i, who) for i in range(n_keys)], known],
                    names=["h1", "h2_start", *keys, "known"],
                )

    return hinted.select(*keys, "text", "starts").mapInArrow(run, f"h1 long, h2_start long, {ddl}, known struct<len:int,ref:{fields[0].dataType.simpleString()},ref_start:int>")


@dataclass
class Factors:
    """The greedy parses of several documents: words [start, end) of document ``row`` stand, from word ref_start on, in ``ref`` as well."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ref: pa.Array
    ref_start: np.ndarray


def factors(row: np.ndarray, start: np.ndarray, length: np.ndarray, ref: pa.Array, ref_start: np.ndarray, window: int) -> Factors:
    """Parses documents greedily. In go runs of ``length`` windows with the places of their references, in any order: a factor
    takes the next run if it follows on in the document and in the reference; else the next run opens a factor of its own."""
    o = np.lexsort((start, row))
    row, start, length, ref_start = row[o], start[o], length[o], ref_start[o]
    code = ref.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)[o]
    opens = np.ones(o.size, bool)
    after = start[:-1] + length[:-1]
    opens[1:] = (row[1:] != row[:-1]) | (start[1:] != after) | (code[1:] != code[:-1]) | (ref_start[1:] != ref_start[:-1] + length[:-1])
    f = np.flatnonzero(opens)
    last = np.append(f, o.size)[1:] - 1 if f.size else f
    return Factors(row[f], start[f], start[last] + length[last] - 1 + window, ref.take(pa.array(o[f])), ref_start[f])


def parse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """docs' rows as (id, text, f, g): f the windows found again, g the runs of such; null for none."""
    bounded_batches(docs)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keys = ["id"]
    if not texts.groupBy("id").count().where("count > 1 or id is null").isEmpty():
        keys = ["id", "k2"]
        texts = texts.withColumn("k2", F.xxhash64("text"))
    copies = len(keys) == 1
    hints = anchors(texts, keys, window)
    if copies:
        hints = hints.unionByName(first_texts(texts))
    hints = hints.groupBy(*keys).agg(F.flatten(F.collect_list("starts")).alias("starts"))
    texts = texts.repartition(*keys)  # once, for both joins
    hinted = _joined(texts, hints, keys).select(*keys, "text", "starts")
    # the second half of the hash shares a word with the place, which keeps the rows that are dealt out short
    found = windows(hinted, keys, window, copies).repartition("h1")
    found = found.withColumn("h2", F.shiftright("h2_start", 32)).withColumn("start", F.col("h2_start").bitwiseAND(0xFFFFFFFF).cast("int"))
    order = Window.partitionBy("h1", "h2").orderBy(*[F.col(k).asc_nulls_last() for k in keys], "start")
    # earliest: the smallest (id, start) of the window; rows that repeat each other share its place
    earliest = F.first(F.struct(*keys, "start")).over(order)
    found = found.withColumn("_e", earliest)
    same = F.col("start") == F.col("_e.start")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_e.{k}"))
    dup = found.where(F.col("known").isNotNull() | ~same)
    # place: the start and, below it, where the reference starts; single windows and runs in lists of their own, as most are single
    place = F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.coalesce("known.ref_start", "_e.start").cast("long"))
    run = F.col("known").isNotNull()
    dup = dup.select(*keys, F.when(~run, F.struct(F.col("_e.id").alias("ref"), place.alias("place"))).alias("f"), F.when(run, F.struct(F.col("known.ref").alias("ref"), place.alias("place"), F.col("known.len").alias("len"))).alias("g"))
    lists = dup.groupBy(*keys).agg(F.collect_list("f").alias("f"), F.collect_list("g").alias("g"))
    return _joined(texts, lists, keys).select("id", "text", "f", "g")


def _joined(texts: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """texts with the columns of more, which has one row for each of the keys at most."""
    more = more.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in more.columns if c not in keys])
    on = F.col("id") == F.col("_id")  # keeps the partitions of the texts
    if len(keys) > 1:
        on = F.col("id").eqNullSafe(F.col("_id")) & (F.col("k2") == F.col("_k2"))
    return texts.join(more, on, "left")


def _factors_of(batch: pa.RecordBatch, at: int, window: int) -> Factors:
    """The parses of a batch whose columns ``at`` and ``at + 1`` are f and g."""
    parts = []
    for column in (batch.column(at), batch.column(at + 1)):
        flat = column.flatten()
        place = flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64)
        length = flat.field(2).to_numpy(zero_copy_only=False).astype(np.int64) if flat.type.num_fields > 2 else np.ones(place.size, np.int64)
        counts = np.nan_to_num(np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), float)).astype(int)
        parts.append((np.repeat(np.arange(batch.num_rows), counts), place >> 32, length, flat.field(0), place & 0xFFFFFFFF))
    row, start, length, ref, ref_start = (pa.concat_arrays(list(x)) if isinstance(x[0], pa.Array) else np.concatenate(x) for x in zip(*parts, strict=True))
    return factors(row, start, length, ref, ref_start, window)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """One row for each factor: id, first word, end word, the document and word where its text was first seen (null for
    a document that repeats an earlier one as a whole)."""
    parsed = parse(docs, id_col, text_col, window).where("f is not null").select("id", "f", "g")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = _factors_of(batch, 1, window)
            columns = [batch.column(0).take(pa.array(f.row)), pa.array(f.start), pa.array(f.end), f.ref, pa.array(f.ref_start)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "first_word", "end_word", "ref", "ref_first_word"])

    return parsed.mapInArrow(run, f"id {kind}, first_word long, end_word long, ref {kind}, ref_first_word long").withColumnRenamed("id", id_col)


def strip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """One row for each row: id, text without the words of its factors (words joined by one blank), n_words, n_removed."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, removed = [], [], []
            f = _factors_of(batch, 2, window)
            first = np.searchsorted(f.row, np.arange(batch.num_rows + 1))
            for i, text in enumerate(as_strings(batch.column(1)).to_pylist()):
                words = text.encode().split()
                total.append(len(words))
                own = slice(first[i], first[i + 1])
                if own.start == own.stop:
                    removed.append(0)
                    kept.append(b" ".join(words).decode())
                    continue
                depth = np.zeros(len(words) + 1, np.int64)
                np.add.at(depth, f.start[own], 1)
                np.add.at(depth, f.end[own], -1)
                gone = np.cumsum(depth[:-1]) > 0
                removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=["id", "kept", "n_words", "n_removed"])

    return parse(docs, id_col, text_col, window).mapInArrow(run, f"id {kind}, kept string, n_words long, n_removed long").withColumnRenamed("id", id_col)
