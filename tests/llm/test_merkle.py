"""Manifests against a plain tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tests.harness import connect, same
from veilframe.llm import merkle, queries


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_levels(leaves, fanout=2):
    levels = [leaves]
    while len(levels[-1]) > 1:
        d = levels[-1]
        levels.append([h("".join(d[i : i + fanout])) for i in range(0, len(d), fanout)])
    return levels


def plain_proof(levels, i, fanout=2):
    left, right = [], []
    for d in levels[:-1]:
        b = i - i % fanout
        left.append("".join(d[b:i]))
        right.append("".join(d[i + 1 : b + fanout]))
        i //= fanout
    return left, right


def plain_leaf(*values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


@pytest.mark.parametrize("fanout", [2, 3])
def test_proofs_against_plain(spark, monkeypatch, fanout):
    """Zones of a few leaves, so that several rounds of merging and of proofs run; trees of 1 to some hundred leaves."""
    monkeypatch.setattr(merkle, "ZONE_LEAVES", fanout**2)
    sizes = {None: 5, "a": 1, "b": 2, "c": fanout**4, "d": fanout**4 + 1, "é": 301}
    data = [(k, i, h(f"{k}{i}")) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(data, "k string, i long, root string").repartition(7)
    got = merkle.prove(df, F.col("k"), F.col("i"), F.col("root"), fanout).collect()
    assert len(got) == len(data)
    for k, n in sizes.items():
        levels = plain_levels([h(f"{k}{i}") for i in range(n)], fanout)
        for r in (x for x in got if x["tree"] == k):
            assert r["root"] == levels[-1][0]
            assert (r["left"], r["right"]) == plain_proof(levels, r["row"]["i"], fanout)


def test_all_nodes(spark, monkeypatch):
    monkeypatch.setattr(merkle, "ZONE_LEAVES", 4)
    df = spark.createDataFrame([(i, h(str(i))) for i in range(77)], "i long, d string").repartition(5)
    made, roots, _ = merkle.nodes(merkle.numbered(df, F.lit("t"), F.col("i"), F.col("d")))
    levels = plain_levels([h(str(i)) for i in range(77)])
    want = {(k, i): d for k, level in enumerate(levels) if k for i, d in enumerate(level)}
    got = made.collect()
    assert {(r["level"], r["idx"]): r["digest"] for r in got} == want and len(got) == len(want)
    assert roots.first()["digest"] == levels[-1][0]


def test_range_merges_unaligned_stretches():
    leaves = [h(str(i)) for i in range(29)]
    levels = plain_levels(leaves)
    peaks = []
    for a, b in ((0, 3), (3, 4), (4, 15), (15, 29)):
        r = merkle.Range(29, 2)
        for i in range(a, b):
            r.put(0, i, leaves[i])
        peaks += r.stack
    whole = merkle.Range(29, 2)
    for p in peaks:
        whole.put(*p)
    assert whole.stack == [(len(levels) - 1, 0, levels[-1][0])]


def test_op13_sql(spark, sf):
    same(spark, connect(sf), sf, queries.op13_merkle, queries.OP13_SQL)


def test_op13_odd(spark, tmp_path):
    """Nulls in every column, repeated ids and rows, empty texts, one language with a single row."""
    data = [(1, None, "en", "a", None), (2, "", "en", "a", 0), (None, "é", "en", None, 1), (3, "x", None, "b", 1), (3, "x", None, "b", 1), (4, "y" * 100_000, "zz", "b", 100_000), (7, "t", "en", "s", 1), (49, "u", "en", "s", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumn("tree", F.lit(1)).withColumn("row", F.lit(2)).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_merkle(spark, str(tmp_path)).collect()
    trees = {}
    for i, text, lang, source, n in data:
        bad = i is not None and zlib.crc32(str(i).encode()) % 7 == 0
        trees.setdefault(lang, []).append((i is not None, i or 0, plain_leaf(i, source, lang, n, text), plain_leaf(i, source, lang, n + 1 if bad and n is not None else n, text), i))
    order = sorted(trees, key=lambda x: (x is not None, x or ""))
    levels = {k: plain_levels([x[2] for x in sorted(trees[k])]) for k in order}
    over = plain_levels([levels[k][-1][0] for k in order])
    want = []
    for k in order:
        for place, x in enumerate(sorted(trees[k])):
            (l1, r1), (l2, r2) = plain_proof(levels[k], place), plain_proof(over, order.index(k))
            acc = x[3]
            for a, b in zip(l1 + l2, r1 + r2, strict=True):
                acc = h(a + acc + b)
            want.append((x[4], x[2], levels[k][-1][0], over[-1][0], h("".join(a + b for a, b in zip(l1 + l2, r1 + r2, strict=True))), acc, acc == over[-1][0]))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_op13_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op13_merkle(spark, str(tmp_path)).collect() == []
