"""Clusters and relations of documents against plain versions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from veilframe.functions.scores import DEFAULT_WEIGHT, WEIGHTS
from veilframe.operators import index


def plain_clusters(rows, least=0.4):
    of = {}
    for d, t, v in rows:
        of.setdefault(d, set()).add((t, v))
    parent = {d: d for d in of}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    linked = set()
    for a, b in itertools.combinations(sorted(of), 2):
        if round(sum(WEIGHTS.get(t, DEFAULT_WEIGHT) for t, _ in of[a] & of[b]), 6) >= least:
            linked |= {a, b}
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: root(d) for d in linked}


@pytest.mark.parametrize(("seed", "few"), [(1, 64), (2, 2), (3, 3)])
def test_clusters_against_pairs(spark, monkeypatch, seed, few):
    """Values from rare to held by every document, light ones in all combinations; sets of values grow to several."""
    monkeypatch.setattr(index, "FEW_HOLDERS", few)
    rng = random.Random(seed)
    types = ["LOCATION", "DATE_TIME", "PERSON_NAME", "OTHER", "DATE_OF_BIRTH", "IBAN"]
    rows = []
    for d in range(150):
        for _ in range(rng.randrange(1, 8)):
            t = rng.choices(types, [6, 6, 2, 1, 0.2, 0.1])[0]
            rows.append((d, t, str(int(rng.paretovariate(0.5)) % 200)))
        rows += [(d, "LOCATION", "common")] * (seed != 1) + [(d, "DATE_TIME", "common")] * (d % 3 > 0)
        if d % 10 == 0:  # copies in all light values
            rows += [(1000 + d, t, v) for x, t, v in rows if x == d]
    df = spark.createDataFrame(rows, "doc_id long, entity_type string, value_hash string")
    got = {r["doc_id"]: r["cluster"] for r in index.cluster_documents(df).collect()}
    assert got == plain_clusters(rows)


def test_a_value_held_by_all_links_in_a_star(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("IBAN").alias("entity_type"), F.lit("x").alias("value_hash"))
    got = index.cluster_documents(df)
    assert got.count() == 3000 and got.select("cluster").distinct().count() == 1


def test_relations_by_differences(spark):
    """Documents replaced, emptied and new; a value held by more documents than one salt takes."""
    rng = random.Random(8)
    types = ["IBAN", "PERSON_NAME", "LOCATION", "EMAIL_ADDRESS"]
    made = lambda ids: [(d, rng.choice(types), str(rng.randrange(12)), 1) for d in ids for _ in range(rng.randrange(4))]
    schema = "doc_id long, entity_type string, value_hash string, occurrences long"
    old = made(range(60)) + [(d, "IBAN", "all", 1) for d in range(60)]
    new = made([3, 5, 70, 71])
    ix, fresh = spark.createDataFrame(old, schema).distinct(), spark.createDataFrame(new, schema).distinct()
    ids = spark.createDataFrame([(i,) for i in (3, 5, 9, 70, 71)], "doc_id long")
    got, after = index.maintain(index.pairs(ix), ix, fresh, ids=ids)
    want = index.pairs(spark.createDataFrame([r for r in old if r[0] not in (3, 5, 9)] + new, schema).distinct())
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r[0] for r in after.select("doc_id").collect()} == {r[0] for r in old if r[0] not in (3, 5, 9)} | {r[0] for r in new}
