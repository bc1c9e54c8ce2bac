"""Near-duplicates by DartMinHash and banded joining.

A document is a weighted set of runs of five words. Every unit of an element's weight is a region on
which hashed darts land at random ranks, the same ones whichever document holds it. A document takes
the darts below a rank bound at which it can expect a few for each of its coordinates, and keeps the
earliest dart of each coordinate: two documents agree in a coordinate with probability equal to their
weighted Jaccard similarity. Rows of a signature are hashed in bands.

Documents that share a band are candidates. Within a band nothing is paired with everything: each
member meets one leader; each band chooses its own, so a member meets as many as there are bands. Candidates
are checked exactly (Jaccard similarity of the sets of runs). With ``rounds`` above 1, bands that still hold members
of different classes get other leaders, until there is no untried pair left or a round joins nothing. Bands
that are mixed after that are settled exactly: all their members enter a prefix join over their rarest
runs (``_rarest``), which leaves out no pair that is similar enough. So the number of rounds decides how much
work is left to that join, never which documents are joined.
Classes are the connected components of the checked links.

Equal texts are one node from the start, so copies cost no pairs. Null counts as empty; all empty texts are
one class. Texts of fewer than five words have one run, all their words. Class ids are the smallest id in
the class (null if none has an id). Any number of rows may share an id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..operators.lineage import cut, join_counted
from ._common import bounded_batches
from ._words import U64, as_strings, mix, ngrams, slices, split, unit, whole

BANDS, ROWS = 28, 4
SHINGLE = 5


def shingles(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the distinct runs of n words, by row."""
    words = split(texts)
    rows, found = [], []
    grams, ok = ngrams(words.hash, n), whole(words, n)
    rows.append(words.doc[: ok.size][ok])
    found.append(grams[ok])
    sizes = np.diff(words.first)
    for short in range(1, n):  # texts with fewer words
        of = np.flatnonzero(sizes == short)
        if of.size:
            at = words.first[of]
            h = words.hash[at]
            for k in range(1, short):
                h = mix(h ^ words.hash[at + k], 50 + k)
            rows.append(of)
            found.append(mix(h, 40 + short))
    row, h = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(row.size, bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    start = np.flatnonzero(new)
    return row[start], h[start], np.diff(np.append(start, row.size))


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int, seed: int = 9) -> np.ndarray:
    """n x k hashes of the earliest dart of each coordinate; rows without an element are 0."""
    out, filled = np.zeros((n, k), U64), np.zeros((n, k), bool)
    total = np.bincount(row, weights=weight, minlength=n)
    bound = k * (np.log(k) + 1.5) / np.maximum(total, 1e-12)
    units = np.ceil(weight).astype(np.int64)
    cell_row, cell_of = np.repeat(row, units), np.repeat(np.arange(row.size), units)
    nth = np.arange(cell_of.size) - np.repeat(np.cumsum(units) - units, units)
    cell = mix(element[cell_of] ^ mix(nth.astype(U64), seed), seed + 1)
    room = np.minimum(weight[cell_of] - nth, 1.0)  # how much of its last unit an element fills
    todo = np.flatnonzero(total > 0)
    while todo.size:
        wanted = np.zeros(n, bool)
        wanted[todo] = True
        live = np.flatnonzero(wanted[cell_row]) if todo.size < n else np.arange(cell_row.size)
        rank, key, darts = np.zeros(live.size), cell[live], []
        step = 0
        while live.size:  # the next dart on each region, until it lies beyond the bound
            key = mix(key, seed + 2 + step % 7)
            rank = rank - np.log(unit(key))
            below = rank < bound[cell_row[live]]
            live, rank, key = live[below], rank[below], key[below]
            hit = unit(mix(key, seed + 20)) < room[live] if live.size and (room[live] < 1).any() else slice(None)
            darts.append((cell_row[live][hit], rank[hit], key[hit]))
            step += 1
        r, d, key = (np.concatenate(x) for x in zip(*darts, strict=True))
        slot = r * k + (mix(key, seed + 30) % U64(k)).astype(np.int64)
        order = np.lexsort((d, slot))
        slot, key = slot[order], key[order]
        first = np.ones(slot.size, bool)
        first[1:] = slot[1:] != slot[:-1]
        out.reshape(-1)[slot[first]] = mix(key[first], seed + 31)
        filled.reshape(-1)[slot[first]] = True
        todo = todo[~filled[todo].all(1)]
        bound[todo] *= 2
    return out


def bands(signature: np.ndarray, n_bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    out = np.zeros((signature.shape[0], n_bands), U64)
    for j in range(rows):
        out = mix(out ^ signature[:, j::rows][:, :n_bands], 60 + j)
    return mix(out ^ np.arange(n_bands, dtype=U64), 70)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of sorted distinct hashes; two empty sets are equal."""
    if not a.size and not b.size:
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True).size
    return both / (a.size + b.size - both)


def _node(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _signed(texts: DataFrame, counts: bool) -> DataFrame:
    """(node, bands) of texts (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = as_strings(batch.column(1))
            for lo, hi in slices(column):
                row, h, times = shingles(column.slice(lo, hi - lo))
                sig = signatures(row, h, times.astype(float) if counts else np.ones(h.size), hi - lo, BANDS * ROWS)
                flat = pa.array(bands(sig).astype(np.int64).reshape(-1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * BANDS, pa.int32()), flat)], names=["node", "bands"])

    return texts.mapInArrow(run, "node binary, bands array<long>")


def _checked(pairs: DataFrame, texts: DataFrame, similarity: float, deal: int = 200) -> DataFrame:
    """Pairs (a, b) that are similar enough, a being the smaller node; pairs: (node, leader); texts: (node, text), one
    row for each node. A leader's text is repeated for every ``deal`` pairs, so that no more of them meet in a task."""
    counted = cut(pairs.groupBy("leader").agg(F.count("*").alias("n")))
    deals = F.ceil(F.col("n") / deal).cast("int")
    dealt = join_counted(pairs, counted, "leader").select("node", "leader", F.pmod(F.xxhash64("node"), deals).cast("int").alias("salt"))
    led = counted.join(texts.select(F.col("node").alias("leader"), F.col("text").alias("t")), "leader")
    led = led.select("leader", "t", F.explode(F.sequence(F.lit(0), deals - 1)).alias("salt"))
    left = dealt.join(texts.select("node", F.col("text").alias("s")), "node")
    both = left.join(led, ["leader", "salt"]).select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"), "s", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for lo in range(0, batch.num_rows, 256):
                sets = []
                for c in (2, 3):
                    part = as_strings(batch.column(c).slice(lo, 256))
                    row, h, _ = shingles(part)
                    at = np.searchsorted(row, np.arange(len(part) + 1))
                    sets.append([h[at[i] : at[i + 1]] for i in range(len(part))])
                keep[lo : lo + len(sets[0])] = [jaccard(x, y) >= similarity for x, y in zip(*sets, strict=True)]
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return both.mapInArrow(run, "a binary, b binary")


def _least(share: float, size: Column) -> Column:
    return F.ceil(F.lit(share) * size - 1e-9).cast("int")


def _rarest(mixed: DataFrame, texts: DataFrame, similarity: float, deal: int = 500) -> DataFrame:
    """Pairs (a, b) of nodes of different classes that may be similar enough, none of those left out; mixed: (node, c).

    Runs are ordered by the number of nodes that have them, then by hash. Of two sets x and y, no larger than x, that are
    similar enough, the first common run lies within the first |x| - ceil(t |x|) + 1 of x and |y| - ceil(2 t / (1 + t) |y|) + 1
    of y, and from it on both hold as many as they must share. A family with a template meets in its own words so, not in
    the template. Of a run's holders only those outside its largest class meet the others, dealt out by salts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = as_strings(batch.column(2))
            for lo, hi in slices(column):
                row, h, _ = shingles(column.slice(lo, hi - lo))
                at = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                runs = pa.ListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in (0, 1)), runs], names=["node", "c", "runs"])

    held = cut(texts.join(mixed, "node").select("node", "c", "text").mapInArrow(run, "node binary, c binary, runs array<long>"))
    each = held.select("node", "c", F.size("runs").alias("size"), F.explode("runs").alias("run"))
    # runs of one node are no use but count as the first ones
    common = cut(each.groupBy("run").agg(F.count("*").alias("n")).where("n > 1"))
    listed = join_counted(each, common, "run").groupBy("node").agg(F.first("c").alias("c"), F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("n", "run"))).alias("runs"))
    own = F.col("size") - F.size("runs")
    reach = F.col("size") - _least(similarity, F.col("size")) + 1 - own
    first = listed.where(reach > 0).select("node", "c", "size", own.alias("own"), F.posexplode(F.slice("runs", 1, reach)).alias("at", "r"))
    first = cut(first.select("node", "c", "size", (F.col("own") + F.col("at")).alias("at"), F.col("r.run").alias("run")))
    by_class = first.groupBy("run", "c").agg(F.count("*").alias("k"))
    spread = by_class.groupBy("run").agg(F.max_by("c", F.struct("k", "c")).alias("most"), F.sum("k").alias("n"), F.count("*").alias("classes"))
    dealt = join_counted(first, cut(spread.where("classes > 1")), "run").withColumn("deals", F.ceil(F.col("n") / deal).cast("int"))
    one = dealt.where("c <> most").select("run", F.pmod(F.xxhash64("node"), "deals").cast("int").alias("salt"), *[F.col(x).alias(f"{x}1") for x in ("node", "c", "size", "at")])
    two = dealt.select("run", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("salt"), *[F.col(x).alias(f"{x}2") for x in ("node", "c", "size", "at")])
    short, at = F.least("size1", "size2"), F.when(F.col("size1") == F.col("size2"), F.greatest("at1", "at2")).when(F.col("size1") < F.col("size2"), F.col("at1")).otherwise(F.col("at2"))
    near = at <= short - _least(2 * similarity / (1 + similarity), short)
    rest = F.least(F.col("size1") - F.col("at1"), F.col("size2") - F.col("at2"))
    fits = rest >= _least(similarity / (1 + similarity), F.col("size1") + F.col("size2"))
    return one.join(two, ["run", "salt"]).where((F.col("c1") != F.col("c2")) & near & fits).select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, counts: bool = False, rounds: int = 2) -> DataFrame:
    """(node, class_id, rep_id, rows) for every distinct text; node is what ``_node`` gives for a text, rep_id the
    smallest id with that very text, rows their number. counts: repeated runs weigh by their number in the signatures."""
    bounded_batches(docs)
    smaller = F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")
    texts = docs.select(F.col(id_col).alias("id"), _node(F.col(text_col)).alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    nodes = cut(texts.groupBy("node").agg(F.min("id").alias("rep_id"), F.count("*").alias("n")))
    signed = _signed(texts.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("node", "text"), counts)
    banded = signed.groupBy("node").agg(F.first("bands").alias("bands")).select("node", F.explode("bands").alias("band"))
    banded = cut(banded)
    # bands with one member are no use; leaders are chosen by hash, anew for each band
    shared = cut(banded.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("leader")).where("n > 1"))
    members = cut(join_counted(banded, shared, "band").select("band", "node", "leader", "n"))
    pairs = cut(members.where("node <> leader").select("node", "leader").distinct())
    tried = pairs.select(*smaller)
    # a text is fetched from the row that stands for it, so that thousands of copies do not meet
    involved = members.select("node").distinct().join(nodes.drop("n"), "node").select("node", F.xxhash64("rep_id").alias("of"))
    standing = texts.select("node", F.xxhash64("id").alias("of"), "text").join(involved, ["node", "of"])
    kept = cut(standing.groupBy("node", "of").agg(F.min("text").alias("text")).select("node", "text"))
    links = cut(_checked(pairs, kept, similarity))
    for turn in range(1, rounds):
        found = connected_components(links).select("node", F.col("component").alias("c"))
        told = cut(members.where("n > 2").join(found, "node", "left").select("band", "node", F.coalesce("c", "node").alias("c")))
        pick = told.groupBy("band").agg(
            F.min_by(F.struct("node", "c"), F.xxhash64(F.lit(turn), "band", "node")).alias("l"), F.count("*").alias("n"), F.min("c").alias("x"), F.max("c").alias("y")
        ).where("x <> y")
        pick = cut(pick.select("band", "n", F.col("l.node").alias("leader"), F.col("l.c").alias("lc")))
        more = join_counted(told, pick, "band").where("c <> lc").select("node", "leader", *smaller).distinct()
        more = cut(more.join(tried, ["a", "b"], "left_anti"))
        if more.isEmpty():
            break
        new = cut(_checked(more.select("node", "leader"), kept, similarity))
        if new.isEmpty():
            break
        tried, links = tried.unionByName(more.select("a", "b")), links.unionByName(new)
    found = connected_components(links)
    told = cut(members.where("n > 2").join(found.select("node", F.col("component").alias("c")), "node", "left").select("band", "node", F.coalesce("c", "node").alias("c")))
    torn = told.groupBy("band").agg(F.count("*").alias("n"), F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("band", "n")
    mixed = cut(join_counted(told, cut(torn), "band").select("node", "c").distinct())
    if not mixed.isEmpty():
        last = cut(_rarest(mixed, kept, similarity).join(tried, ["a", "b"], "left_anti"))
        new = cut(_checked(last.select(F.col("a").alias("node"), F.col("b").alias("leader")), kept, similarity))
        if not new.isEmpty():
            links = links.unionByName(new)
            found = connected_components(links)
    joined = cut(nodes.join(found, "node", "left").select("node", "rep_id", F.col("n").alias("rows"), F.coalesce("component", "node").alias("c")))
    smallest = cut(joined.groupBy("c").agg(F.min("rep_id").alias("class_id"), F.count("*").alias("n")))
    return join_counted(joined, smallest, "c").select("node", "rep_id", "class_id", "rows")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each row of docs: its id and class id."""
    found = cut(classes(docs, id_col, text_col, **options))
    rows = docs.select(F.col(id_col).alias("id"), _node(F.col(text_col)).alias("node"))
    return join_counted(rows, found.select("node", "class_id", F.col("rows").alias("n")), "node").select(F.col("id").alias(id_col), "class_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each class: that of the smallest id. Where rows of one class share that id (or none has
    one), the row with the smallest text stays; of rows alike in all columns, one."""
    found = cut(classes(docs, id_col, text_col, **options))
    best = found.groupBy("class_id").agg(F.min(F.when(F.col("rep_id").eqNullSafe(F.col("class_id")), F.col("node"))).alias("node"))
    best = best.select("node", F.xxhash64("class_id").alias("of"), "class_id")
    # the row is fetched by its id as well as its text: copies do not meet in one task
    keyed = docs.select(F.struct("*").alias("r"), F.col(id_col).alias("id"), _node(F.col(text_col)).alias("node"), F.xxhash64(F.col(id_col)).alias("of"))
    keyed = keyed.join(best, ["node", "of"]).where(F.col("id").eqNullSafe(F.col("class_id")))
    # rows left for one node: usually one, else rows that repeat an id with the same text
    return keyed.groupBy("node", "of").agg(F.min("r").alias("r")).select("r.*")
