"""Benchmark decontamination: rare n-gram seeds, then local alignment.

Seeds are runs of ``n`` words of the test items, of ``n_short`` words for items of fewer than ``short`` words, of which an edit
leaves fewer runs whole. One pass over the texts tells their runs that may be
seeds by bit tables sized by the number of seeds, and keeps the passages around them as word hashes. Items are classed by
length, and a class has a table of its own: passages reach as far as its items may, so a long item does not widen those of the
others. Everything else works
on tables of passages and items: runs are joined with the seeds they equal, and in how many passages a seed occurs is counted over
all texts. A seed is rare if few passages have it, measured against the item's own middling seed,
so that a test item that has leaked into very many documents keeps its seeds while turns of phrase that occur
everywhere are left out; an item keeps its ``least`` rarest seeds in any case, and the rarest of each stretch of ``n`` words, so
that no part of it goes without. A passage in which rare seeds of an item lie close together is aligned with it by
words (Smith and Waterman, linear gaps); the score is the alignment's share of the item's best possible one.

The texts are read once and never shuffled, whatever the number of items; neither items nor seeds pass through the driver. What is
shipped to the tasks are the bit tables: ``SEED_BITS`` bits for each seed, to the next power of two, ``MOST_BITS`` for a class of
lengths at most (64 MB, reached at 8 million seeds; beyond that more runs pass). A run passes by chance if ``PROBES`` bits happen to be set, about 2 in 100,000;
that costs a passage, and changes nothing.

Words are runs of anything but ASCII blanks, lower-cased, without punctuation at their ends; items of
fewer words than a seed have one seed, the whole item. Nulls, empty texts and items without a word never
match. Rows of documents that share an id, or have none, count as one document, rows of items likewise: the best
alignment of any two of them counts. Ids may have any type that can be ordered. Any empty table gives no rows.
Columns other than ids and texts are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut, join_small
from ._common import bounded_batches
from ._words import U64, Words, as_strings, mix, ngrams, slices, split

#: Signs that are no part of a word at its ends.
_SIGNS = np.zeros(256, bool)
_SIGNS[list(b""".,;:!?"'()[]{}<>*&$%#|-""")] = True
SEED_BITS = 64
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 29
PROBES = 4
#: Reach in words of the passages of the shortest class of items; each further class reaches four times as far.
LEAST_REACH = 64


def read(texts: pa.Array) -> Words:
    """The words by which texts are compared."""
    return split(pc.utf8_lower(texts), trim=_SIGNS)


def _grams(hashes: np.ndarray, m: int) -> np.ndarray:
    """Runs of m words; runs of different lengths never look alike."""
    return ngrams(hashes, m, seed=m)


def smith_waterman(item: np.ndarray, passage: np.ndarray, match: float = 2.0, differ: float = -1.0, gap: float = -1.0) -> tuple[float, int, int]:
    """Best local score, and the stretch of the passage that it covers. One row for each word of the
    item; gaps along the passage are a running maximum, so a row is a few vector operations."""
    m = passage.size
    ramp = np.arange(m + 1) * gap
    score, start = np.zeros(m + 1), np.arange(m + 1)
    best = (0.0, 0, 0)
    for w in item:
        step = np.where(passage == w, match, differ)
        diagonal, above = score[:-1] + step, score[1:] + gap
        row, begun = np.zeros(m + 1), np.arange(m + 1)
        take = diagonal >= above
        cell = np.where(take, diagonal, above)
        from_ = np.where(take, start[:-1], start[1:])
        fresh = cell <= 0
        row[1:], begun[1:] = np.where(fresh, 0, cell), np.where(fresh, np.arange(1, m + 1), from_)
        # a gap in the passage: the best cell to the left, less the gap's cost
        lifted = row - ramp
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(m + 1), 0))
        better = top + ramp > row
        row, begun = np.where(better, top + ramp, row), np.where(better, begun[source], begun)
        score, start = row, begun
        k = int(score.argmax())
        if score[k] > best[0]:
            best = (float(score[k]), int(start[k]), k)
    return best


def _items(benchmark: DataFrame, id_col: str, text_col: str, n: int, n_short: int, short: int) -> DataFrame:
    """(item_id, words, seeds, m): word hashes, runs of m words in order; a row for each item with a word."""
    kind = benchmark.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, words_of, seeds, lengths = [], [], [], []
            column = as_strings(batch.column(1))
            for lo, hi in slices(column):
                words = read(column.slice(lo, hi - lo))
                for i in range(hi - lo):
                    h = words.hash[words.first[i] : words.first[i + 1]]
                    if h.size:
                        m = min(n if h.size >= short else n_short, h.size)
                        rows.append(lo + i)
                        words_of.append(h.view(np.int64))
                        seeds.append(_grams(h, m).view(np.int64))
                        lengths.append(m)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(words_of, longs), pa.array(seeds, longs), pa.array(lengths, pa.int32())], names=["item_id", "words", "seeds", "m"])

    return benchmark.select(id_col, text_col).mapInArrow(run, f"item_id {kind}, words array<long>, seeds array<long>, m int")


def _place(seeds: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """Where in a table of ``bits`` places, a power of two, a seed sets its bit number ``probe``."""
    with np.errstate(over="ignore"):
        return ((mix(seeds, 31) + U64(probe) * (mix(seeds, 32) | U64(1))) & U64(bits - 1)).astype(np.int64)


@dataclass
class Filter:
    """Which runs may be seeds of the items of one class: of how many words, and how far the passages reach."""

    table: np.ndarray
    lengths: list[int]
    reach: int

    def passed(self, runs: np.ndarray) -> np.ndarray:
        """Places of the runs all of whose bits are set; the first bit settles most."""
        found, bits = np.arange(runs.size), self.table.size * 8
        for probe in range(PROBES):
            place = _place(runs[found], probe, bits)
            found = found[(self.table[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)]
        return found


def _bit_table(seeds: DataFrame, n: int) -> np.ndarray:
    """The bits of n seeds; at most MOST_BITS / 64 words of the table reach the driver."""
    bits = min(max(LEAST_BITS, 1 << (SEED_BITS * n - 1).bit_length()), MOST_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().astype(np.int64).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([_place(own, k, bits) for k in range(PROBES)]))], names=["bit"])

    places = seeds.select("seed").mapInArrow(run, "bit long")
    words = places.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint8)


def _filters(seeds: DataFrame) -> list[Filter]:
    """One for each class of items. seeds: item, seed, m, reach."""
    classes = seeds.groupBy("reach").agg(F.count("*").alias("n"), F.collect_set("m").alias("m")).orderBy("reach").collect()
    return [Filter(_bit_table(seeds.where(F.col("reach") == c.reach), c.n), sorted(c.m), c.reach) for c in classes]


def passages(docs: DataFrame, filters: list[Filter]) -> DataFrame:
    """(doc_id, first, words, at, seed, reach): for each filter, stretches of documents around runs that may be seeds, with ``reach`` words
    on both sides; at: where the runs begin, counted from the document's first word, as first is. docs: id, text."""
    kind = docs.schema[docs.columns[0]].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = as_strings(batch.column(1))
            for lo, hi in slices(column):
                words = read(column.slice(lo, hi - lo))
                runs = {m: _grams(words.hash, m) for m in {m for f in filters for m in f.lengths}}
                for one in filters:
                    yield _cut_out(batch.column(0), lo, words, runs, one)

    return docs.mapInArrow(run, f"doc_id {kind}, first long, words array<long>, at array<int>, seed array<long>, reach int")


def _cut_out(ids: pa.Array, lo: int, words: Words, runs: dict[int, np.ndarray], one: Filter) -> pa.RecordBatch:
    """The passages that one filter finds in the words of a slice of texts, whose ids begin at ``lo``."""
    at, seed = [], []
    for m in one.lengths:
        hit = one.passed(runs[m])
        hit = hit[words.doc[hit] == words.doc[hit + m - 1]]
        at.append(hit)
        seed.append(runs[m][hit])
    at, seed = np.concatenate(at), np.concatenate(seed)
    order = np.argsort(at, kind="stable")
    at, seed = at[order], seed[order]
    doc = words.doc[at]
    opens = np.ones(at.size, bool)
    opens[1:] = (doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > 2 * one.reach)
    f = np.flatnonzero(opens)
    until = np.append(f, at.size)[1:] if f.size else f
    a = np.maximum(words.first[doc[f]], at[f] - one.reach)
    b = np.minimum(words.first[doc[f] + 1], at[until - 1] + one.reach + 1)
    span = np.concatenate([[0], np.cumsum(b - a)]).astype(np.int32)
    inside = np.repeat(a - span[:-1], b - a) + np.arange(span[-1])
    cuts = pa.array(np.append(f, at.size).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(lo + doc[f])), pa.array((a - words.first[doc[f]]).astype(np.int64)), pa.ListArray.from_arrays(pa.array(span), pa.array(words.hash[inside].view(np.int64))),
            pa.ListArray.from_arrays(cuts, pa.array((at - words.first[doc]).astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(seed.view(np.int64))),
            pa.array(np.full(f.size, one.reach, np.int32)),
        ],
        names=["doc_id", "first", "words", "at", "seed", "reach"],
    )


def _rare(seeds: DataFrame, frequency: DataFrame, n: int, least: int, factor: float, floor: int) -> DataFrame:
    """The rare ones of seeds (item, seed, pos, reach). frequency: (seed, reach, n), in how many passages."""
    told = seeds.join(frequency, ["seed", "reach"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    middling = told.groupBy("item").agg(F.percentile("n", 0.5).alias("middling"))
    rank = lambda *by: F.row_number().over(Window.partitionBy("item", *by).orderBy("n", "seed"))
    # seeds of one item are no more than its words
    ranked = told.withColumns({"rank": rank(), "part": F.floor(F.col("pos") / n)}).withColumn("in_part", rank("part")).join(middling, "item")
    rare = (F.col("n") <= F.greatest(F.lit(float(floor)), factor * F.col("middling"))) | (F.col("rank") <= least) | (F.col("in_part") == 1)
    return ranked.where(rare & (F.col("n") > 0)).select("item", "seed", "reach")


def _align(found: DataFrame, n: int, min_score: float) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word, seeds), the best of each row that scores enough. found: doc_id,
    item_id, first, words, at (of the item's seeds), item (the words of it)."""
    ids = ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in ("doc_id", "item_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = lambda column: [np.asarray(x, np.int64) for x in column.to_pylist()]
        for batch in batches:
            out = []
            rows = zip(batch.column(2).to_pylist(), longs(batch.column(3)), longs(batch.column(4)), longs(batch.column(5)), strict=True)
            for i, (first, words, at, item) in enumerate(rows):
                at, best = np.sort(at), (0.0,)
                for part in np.split(at, np.flatnonzero(np.diff(at) > item.size + n) + 1):
                    a, b = max(0, int(part[0]) - first - item.size), int(part[-1]) - first + item.size + n
                    score, s, e = smith_waterman(item, words[a:b])
                    if score > best[0]:
                        best = (score, first + a + s, first + a + e, part.size)
                if best[0] and best[0] / (2.0 * item.size) >= min_score:
                    out.append((i, best[0] / (2.0 * item.size), *best[1:]))
            c = list(zip(*out, strict=True)) or [[]] * 5
            of = pa.array(list(c[0]), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(list(c[1]), pa.float64()), *[pa.array(list(x), pa.int64()) for x in c[2:]]], names=["doc_id", "item_id", "score", "first_word", "end_word", "seeds"])

    return found.mapInArrow(run, f"{ids}, score double, first_word long, end_word long, seeds long")


def find(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    n: int = 5, n_short: int = 3, short: int = 25, least: int = 8, factor: float = 8.0, floor: int = 20, min_score: float = 0.5,
) -> DataFrame:
    """One row for each document and item of which it holds a copy, edited or not: ids, score (0 to 1), the
    best passage by word positions, and its seeds. A seed is rare if it is in at most
    max(floor, factor x the item's median) passages."""
    bounded_batches(docs)
    items = cut(_items(benchmark, item_id_col, item_text_col, n, n_short, short).withColumn("item", F.xxhash64("item_id", "words")).dropDuplicates(["item"]))
    kinds = {"doc_id": docs.schema[id_col].dataType, "item_id": benchmark.schema[item_id_col].dataType}
    if items.isEmpty():
        ddl = ", ".join(f"{c} {t.simpleString()}" for c, t in kinds.items())
        return docs.sparkSession.createDataFrame([], f"{ddl}, score double, first_word long, end_word long, seeds long")
    times = F.greatest(F.ceil(F.log((F.size("words") + n) / LEAST_REACH) / F.log(F.lit(4.0))), F.lit(0))
    reach = (LEAST_REACH * F.pow(F.lit(4.0), times)).cast("int")
    seeds = items.select("item", "m", reach.alias("reach"), F.posexplode("seeds").alias("pos", "seed"))
    seeds = cut(seeds.groupBy("item", "seed", "m", "reach").agg(F.min("pos").alias("pos")))
    held = cut(passages(docs.select(id_col, text_col), _filters(seeds)).withColumn("passage", F.xxhash64("doc_id", "first", "words", "reach")))
    each = held.select("passage", "reach", F.explode(F.arrays_zip("at", "seed")).alias("hit")).select("passage", "reach", "hit.*")
    wanted = seeds.select("seed", "reach").distinct()
    # minima and counts are combined before they are dealt out, so that a seed which is everywhere is no burden
    frequency = cut(held.select("reach", F.explode(F.array_distinct("seed")).alias("seed")).groupBy("seed", "reach").agg(F.count("*").alias("n")).join(wanted, ["seed", "reach"]))
    rare = cut(_rare(seeds, frequency, n, least, factor, floor))
    pairs = join_small(each, rare, ["seed", "reach"]).groupBy("passage", "item").agg(F.collect_set("at").alias("near"))
    found = held.select("passage", "doc_id", "first", "words").dropDuplicates(["passage"]).join(pairs, "passage")
    found = join_small(found, items.select("item", "item_id", F.col("words").alias("of")), ["item"])
    best = _align(found.select("doc_id", "item_id", "first", "words", "near", "of"), n, min_score)
    order = F.struct("score", -F.col("first_word"), "end_word", "seeds")
    best = best.groupBy("doc_id", "item_id").agg(F.max(order).alias("b"))
    return best.select("doc_id", "item_id", "b.score", (-F.col("b.col2")).alias("first_word"), "b.end_word", "b.seeds")


def remove(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the documents that hold a copy of a test item. Rows with a null id are judged too, each by its text."""
    key = F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    bad = find(docs.select(key.alias("key"), F.col(text_col).alias("text")), benchmark, "key", "text", **options).select(F.col("doc_id").alias("key")).distinct()
    return docs.select(F.struct("*").alias("r"), key.alias("key")).join(bad, "key", "left_anti").select("r.*")
