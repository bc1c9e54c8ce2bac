"""Merkle manifest of a dataset: leaves of ordered trees, their roots, and a proof for every leaf.

Leaves of a tree (of one value of ``tree``) stand in order of ``at``. While a level has more than one node, every
``fanout`` consecutive ones, the last run as many as are left, become the hash of their digests put one after another.

Leaves are dealt out by ranges of (tree, at) and numbered; each stretch of consecutive leaves that a task meets is worked
off with a stack, as a mountain range: a node is put on it, and while the topmost ones fill a run their parent takes
their place, carrying like a counter to the base ``fanout``. The last run of a level is short, and needs no padding, since
the number of leaves is known. What is left at the end of a stretch are its peaks: nodes whose runs reach beyond it.
Peaks are merged by the same stack, in zones of ``fanout ** STEP`` leaves first, then in zones of as many zones, until only
roots remain; so no task ever holds more than a zone. Proofs go down the same zones.

Rows that tie in (tree, at) are ordered by digest. A null tree is a tree of its own and the first one. Whatever else the rows
carry is handed through in ``row``, whatever its columns are called. No leaves give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut, join_small

#: A zone has at most this many leaves; its levels are the power of the fan-out.
ZONE_LEAVES = 4096


def hash_of(*values: Column) -> Column:
    """H of values: '-' for null, else UTF-8 bytes, ':', value."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def _join(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def _step(fanout: int) -> int:
    """Levels of a zone."""
    step = 1
    while fanout ** (step + 1) <= ZONE_LEAVES:
        step += 1
    return step


class Range:
    """The mountain range of one stretch of a tree of ``n`` leaves: nodes come in order of their leaves, ``made`` gets every
    new parent (level, index, digest), ``stack`` holds the peaks."""

    def __init__(self, n: int, fanout: int):
        self.fanout, self.stack, self.made = fanout, [], []
        self.counts = [n]
        while self.counts[-1] > 1:
            self.counts.append(-(-self.counts[-1] // fanout))

    def put(self, level: int, index: int, digest: str) -> None:
        stack, k = self.stack, self.fanout
        stack.append((level, index, digest))
        while level < len(self.counts) - 1 and (index % k == k - 1 or index == self.counts[level] - 1):
            run = index % k + 1
            # siblings of an earlier stretch are not on the stack: the run is completed when stretches merge
            if len(stack) < run or stack[-run][:2] != (level, index - run + 1):
                return
            digest = _join([d for _, _, d in stack[-run:]])
            del stack[-run:]
            level, index = level + 1, index // k
            stack.append((level, index, digest))
            self.made.append((level, index, digest))


_NODE = "n long, level int, idx long, digest string, peak boolean"


def numbered(leaves: DataFrame, tree: Column, at: Column, digest: Column) -> DataFrame:
    """(tree, pos, n, digest, row): leaves in order, numbered within their tree of n leaves. Each range of the order
    counts its leaves by tree; only these counts are summed up across ranges."""
    rows = leaves.select(tree.alias("tree"), at.alias("at"), digest.alias("digest"), F.struct("*").alias("row"))
    order = ["tree", "at", "digest"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = cut(dealt.select("tree", "digest", "row", F.spark_partition_id().alias("part"), within.alias("place")))
    counts = dealt.groupBy("tree", "part").agg(F.count("*").alias("many"), F.min("place").alias("first"))
    whole = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("tree", "part", "first", F.sum("many").over(whole).alias("n"), F.coalesce(F.sum("many").over(before), F.lit(0)).alias("start"))
    told = join_small(dealt, cut(starts), ["tree", "part"])
    return told.select("tree", (F.col("start") + F.col("place") - F.col("first")).alias("pos"), "n", "digest", "row")


def _stretches(fanout: int, every: int):
    """Over leaves as they come: every run of consecutive ones of a tree is one stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, kind = None, (None, -2), None

        def told(peaks: bool, tree):
            out = [(level, i, d, False) for level, i, d in now.made if level % every == 0]
            now.made.clear()
            if peaks:
                out += [(level, i, d, True) for level, i, d in now.stack]
            return _batch(kind, [tree] * len(out), [now.counts[0]] * len(out), out)

        for b in batches:
            kind = b.schema.field("tree").type
            for tree, pos, n, digest in zip(b["tree"].to_pylist(), b["pos"].to_pylist(), b["n"].to_pylist(), b["digest"].to_pylist(), strict=True):
                if now is None or last != (tree, pos - 1):
                    if now is not None:
                        yield told(True, last[0])
                    now = Range(n, fanout)
                now.put(0, pos, digest)
                last = (tree, pos)
            if now is not None:
                yield told(False, last[0])
        if now is not None:
            yield told(True, last[0])

    return run


def _batch(kind: pa.DataType, trees: list, ns: list[int], nodes: list[tuple]) -> pa.RecordBatch:
    level, idx, digest, peak = zip(*nodes, strict=True) if nodes else ((), (), (), ())
    columns = [pa.array(trees, kind), pa.array(ns, pa.int64()), pa.array(level, pa.int32()), pa.array(idx, pa.int64()), pa.array(digest, pa.string()), pa.array(peak, pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, ["tree", "n", "level", "idx", "digest", "peak"])


def _merged(fanout: int, every: int):
    """Over the peaks of a zone: one stretch."""

    def run(t: pa.Table) -> pa.Table:
        n = t["n"][0].as_py()
        nodes = sorted(zip(t["level"].to_pylist(), t["idx"].to_pylist(), t["digest"].to_pylist(), strict=True), key=lambda x: x[1] * fanout ** x[0])
        now = Range(n, fanout)
        for level, i, d in nodes:
            now.put(level, i, d)
        out = [(level, i, d, False) for level, i, d in now.made if level % every == 0] + [(level, i, d, True) for level, i, d in now.stack]
        return pa.Table.from_batches([_batch(t.schema.field("tree").type, [t["tree"][0].as_py()] * len(out), [n] * len(out), out)])

    return run


def nodes(indexed: DataFrame, fanout: int = 2, every: int = 1) -> tuple[DataFrame, DataFrame, int]:
    """(nodes, roots, rounds) of numbered leaves. nodes: (tree, n, level, idx, digest), all that stand above the leaves on levels
    that ``every`` divides; roots: (tree, n, level, idx, digest), one for each tree (of one leaf: the leaf)."""
    step = _step(fanout)
    kind = indexed.schema["tree"].dataType.simpleString()
    most = indexed.agg(F.max("n")).first()[0] or 0
    levels = len(Range(most, fanout).counts) - 1 if most else 0
    rounds = -(-levels // step)
    found = cut(indexed.select("tree", "pos", "n", "digest").mapInArrow(_stretches(fanout, every), f"tree {kind}, {_NODE}"))
    made, peaks = found.where("not peak"), found.where("peak")
    for r in range(1, rounds + 1):
        low = F.col("level") < step * r
        zone = F.floor(F.col("idx") / F.pow(F.lit(float(fanout)), (F.lit(step * r) - F.col("level")).cast("double")))
        merged = cut(peaks.where(low).withColumn("zone", zone).groupBy("tree", "zone").applyInArrow(_merged(fanout, every), f"tree {kind}, {_NODE}"))
        made = made.unionByName(merged.where("not peak"))
        peaks = peaks.where(~low).unionByName(merged.where("peak"))
    return made.drop("peak"), peaks.drop("peak"), rounds


def _paths(fanout: int, step: int, level: int):
    """Over the nodes of one level of a zone: what stands left and right of each one's way up, level by level, then that of
    the zone itself."""

    def ways(t: pa.Table, above: tuple[list[str], list[str]]) -> tuple[list[list[str]], list[list[str]]]:
        counts = Range(t["n"][0].as_py(), fanout).counts
        tops = [t["digest"].to_pylist()]
        # within the zone and below the root
        while len(tops) <= step and level + len(tops) < len(counts):
            d = tops[-1]
            tops.append([_join(d[i : i + fanout]) for i in range(0, len(d), fanout)])
        left, right = [above[0]], [above[1]]
        for d in reversed(tops[:-1]):
            left = [["".join(d[i - i % fanout : i]), *left[i // fanout]] for i in range(len(d))]
            right = [["".join(d[i + 1 : i - i % fanout + fanout]), *right[i // fanout]] for i in range(len(d))]
        return left, right

    def with_ways(t: pa.Table, above: tuple[list[str], list[str]]) -> pa.Table:
        t = t.sort_by("idx")
        left, right = ways(t, above)
        kind = pa.list_(pa.string())
        return t.drop_columns(["zone", "n"]).append_column("left", pa.array(left, kind)).append_column("right", pa.array(right, kind))

    def top(t: pa.Table) -> pa.Table:
        return with_ways(t, ([], []))

    def below(t: pa.Table, zone: pa.Table) -> pa.Table:
        # a tree whose root lies within the zone has nothing above it
        return with_ways(t, (zone["left"][0].as_py(), zone["right"][0].as_py()) if len(zone) else ([], []))

    return top, below


def prove(leaves: DataFrame, tree: Column, at: Column, digest: Column, fanout: int = 2) -> DataFrame:
    """(tree, digest, row, left, right, root) for each leaf: ``root`` of its tree and its proof, for each level from the leaf to
    the root the digests of its run before it (``left``) and after it (``right``), put one after another."""
    step = _step(fanout)
    indexed = numbered(leaves, tree, at, digest)
    made, roots, rounds = nodes(indexed, fanout, step)
    size = float(fanout**step)
    above = None
    for r in reversed(range(max(1, rounds))):
        level = step * r
        here = made.where(F.col("level") == level).drop("level") if r else indexed.withColumnRenamed("pos", "idx")
        here = here.withColumn("zone", F.floor(F.col("idx") / size))
        more = ", row " + here.schema["row"].dataType.simpleString() if not r else ""
        schema = f"tree {here.schema['tree'].dataType.simpleString()}, idx long, digest string{more}, left array<string>, right array<string>"
        top, below = _paths(fanout, step, level)
        here = here.select("tree", "n", "idx", "digest", *([] if r else ["row"]), "zone").groupBy("tree", "zone")
        if above is None:
            above = here.applyInArrow(top, schema)
        else:
            above = here.cogroup(above.select("tree", F.col("idx").alias("zone"), "left", "right").groupBy("tree", "zone")).applyInArrow(below, schema)
        if r:
            above = cut(above)
    own = cut(roots.select("tree", F.col("digest").alias("root")))
    return join_small(above.drop("idx"), own, ["tree"])


def fold(leaf: Column, left: Column, right: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(F.arrays_zip(left.alias("l"), right.alias("r")), leaf, lambda a, x: F.sha2(F.concat(x["l"], a, x["r"]), 256))


def manifest(docs: DataFrame, tree: Column, at: Column, digest: Column, given: Column) -> DataFrame:
    """(row, leaf, given, subroot, root, left, right): every row's leaf under the root of its tree, and that under the root over
    all trees in their order; the proof leads from the leaf to the root of all. ``given`` is the leaf that is put to the test."""
    rows = docs.select(tree.alias("tree"), at.alias("at"), digest.alias("leaf"), given.alias("given"), F.struct("*").alias("row"))
    proven = cut(prove(rows, F.col("tree"), F.col("at"), F.col("leaf")))
    subroots = proven.select("tree", "root").distinct()
    over = prove(subroots, F.lit(0), F.col("tree"), F.col("root")).select(F.col("row.tree").alias("tree"), F.col("left").alias("l2"), F.col("right").alias("r2"), F.col("root").alias("all"))
    both = join_small(proven, cut(over), ["tree"])
    own = F.col("row")
    return both.select(
        own["row"].alias("row"), own["leaf"].alias("leaf"), own["given"].alias("given"), F.col("root").alias("subroot"), F.col("all").alias("root"),
        F.concat("left", "l2").alias("left"), F.concat("right", "r2").alias("right"),
    )


def verify(found: DataFrame) -> DataFrame:
    """Adds to a manifest ``proof_sha256``, ``folded_root`` (from the leaf given) and ``verified``."""
    siblings = F.array_join(F.zip_with("left", "right", lambda a, b: F.concat(a, b)), "")
    done = found.withColumns({"proof_sha256": F.sha2(siblings, 256), "folded_root": fold(F.col("given"), F.col("left"), F.col("right"))})
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))
