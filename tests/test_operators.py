import hashlib
import random

import pytest
from pyspark.sql import functions as F

from veilframe.functions import scores
from veilframe.operators import chunk, index, ledger, lineage, retrieve
from veilframe.operators.graph import connected_components
from veilframe.operators.lineage import join_small, shared_dir
from veilframe.sources import files
from veilframe.streaming import queue, state


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_join_small_both_ways(spark, monkeypatch):
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "id int, k string")
    right = spark.createDataFrame([("a", 10), (None, 20)], "k string, v int")
    for most in (10, 0):
        monkeypatch.setattr("veilframe.operators.lineage.BROADCAST_ROWS", most)
        assert sorted((r.id, r.v) for r in join_small(left, right, ["k"]).collect()) == [(1, 10), (2, 20)]


def test_nearest_is_exact_with_ties(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "TILE_QUERIES", 3)
    rng = random.Random(1)
    rows = [(i, [rng.choice((-1.0, 0.0, 1.0)) for _ in range(3)]) for i in range(200)] + [(900, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = retrieve.nearest(df, df.where("vec_id % 20 = 0"), 7).collect()

    def unit(v):
        n = sum(x * x for x in v) ** 0.5
        return [x / n if n else x for x in v]

    for q, v in rows[::20][:10]:
        if v is None:
            continue
        want = sorted(((-round(sum(a * b for a, b in zip(unit(v), unit(w), strict=True)), 6) + 0.0, i) for i, w in rows if w is not None))[:7]
        assert [r.id for r in sorted((r for r in got if r.q == q), key=lambda r: r["rank"])] == [i for _, i in want]


@pytest.mark.parametrize(("k", "n", "want"), [(5, 0, 5), (5, 10, 5), (5, 11, 8), (5, 15, 10), (5, 30, 15), (5, 100, 15), (20, 50, 25), (10, 40, 20)])
def test_effective_k(spark, k, n, want):
    assert spark.range(1).select(scores.effective_k(F.lit(k), F.lit(n)).alias("x")).first().x == want


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "q int, id int, rank int")
    b = spark.createDataFrame([(1, 20, 1), (1, 10, 2)], "q int, id int, rank int")
    got = retrieve.fuse([(a, 0.5), (b, 0.5)]).collect()
    assert len({r.score for r in got}) == 1
    one = retrieve.relevant(spark.createDataFrame([(1, 5, 0.0)], "q int, id int, score double")).collect()
    assert [r.id for r in one] == [5]


def test_index_weights_and_pairs(spark):
    e = spark.createDataFrame([(1, "IBAN", "DE1"), (1, "LOCATION", "Muratpaşa / ANTALYA"), (1, "PERSON_NAME", "Ann Lee"), (2, "IBAN", "de1"), (3, "LOCATION", "antalya,")], "doc_id int, entity_type string, value string")
    ix = index.build(e, b"k")
    assert ix.where("doc_id = 1 and entity_type = 'LOCATION'").count() == 3
    assert ix.where("doc_id = 1 and entity_type = 'PERSON_NAME'").count() == 1
    assert {(r.doc_a, r.doc_b, r.score) for r in index.pairs(ix).collect()} == {(1, 2, 1.0), (1, 3, 0.1)}
    assert {(r.doc_id, r.cluster) for r in index.clusters(index.pairs(ix)).collect()} == {(1, 1), (2, 1)}


def test_ledger_breaks(spark):
    rows = ledger.append(ledger.bodies(spark.createDataFrame([("a", i, "x", i) for i in range(5)], "ledger string, seq int, kind string, n int"))).cache()
    assert ledger.verify(rows).first().first_break is None
    assert ledger.verify(rows.withColumn("body", F.when(F.col("seq") == 2, "{}").otherwise(F.col("body")))).first().kind == "hash mismatch"
    cut = ledger.verify(rows.where("seq <> 2")).first()
    assert cut.kind == "prev_hash mismatch" and cut.first_break == 3
    assert sorted(r.seq for r in ledger.retain(rows, most_rows=2).collect()) == [3, 4]
    with pytest.raises(ValueError):
        ledger.collector_event(F.lit(1), "bad\nhost", "s", F.lit("e"))


def test_chunking(spark):
    text = "\n".join(["1. First part", "body " * 30, "", "2. SECOND PART", "more " * 300, "\n", "last words here"])
    rows = chunk.structured(spark.createDataFrame([(1, text), (2, "short"), (3, ""), (4, None)], "doc_id int, text string")).orderBy("doc_id", "index").collect()
    assert [r.title for r in rows if r.doc_id == 1][:2] == ["1. First part", "2. SECOND PART"]
    assert [r.text for r in rows if r.doc_id == 2] == ["short"]
    sizes = spark.createDataFrame([(n, "x" * n) for n in (0, 1, 800, 801, 1400, 1401)], "n int, t string").select("n", F.size(chunk.sliding(F.col("t"))).alias("k")).collect()
    assert {r.n: r.k for r in sizes} == {0: 0, 1: 1, 800: 1, 801: 2, 1400: 2, 1401: 3}


def test_formats_round_trip():
    assert files.read_docx(files.write_docx("a & b\n\nc")) == "a & b\n\nc"
    assert files.read_pdf(files.write_pdf(["one (1)\ntwo\\", "page two"])) == "one (1)\ntwo\\\n\npage two"
    assert files.read_xlsx(files.write_xlsx({"s": [["h"], ["1", None, "2"]]})) == "# Sheet: s — columns: COLUMN_1\nCOLUMN_1\n1\t2"
    assert files.read_ods(files.write_ods({"s": [["h"], ["1", "", "2"]]})) == "# Sheet: s — columns: COLUMN_1\nCOLUMN_1\n1\t2"


def test_broken_files_do_not_stop_others(spark):
    f = spark.createDataFrame([(1, bytearray(b"PK nonsense"), "docx"), (2, bytearray(files.write_docx("fine")), "docx"), (3, None, "pdf")], "path int, content binary, format string")
    got = {r.path: r for r in files.ingest(f).collect()}
    assert got[2].text == "fine" and got[1].warning and got[3].warning


def test_breaker(spark):
    calls = [(0, True), (10, True), (20, True), (30, False), (81, False), (82, True)]
    df = spark.createDataFrame([("p", 1_000_000 + t, bad, i) for i, (t, bad) in enumerate(calls)], "p string, s long, bad boolean, tie long").withColumn("ts", F.timestamp_seconds("s"))
    got = state.breaker_states(df, "p", "ts", F.col("bad")).orderBy("tie").collect()
    assert [r.state for r in got] == ["closed", "closed", "open", "open", "closed", "closed"]
    assert [r.allowed for r in got] == [True, True, True, False, True, True]


def test_correlated_streams(spark):
    base = "2024-01-01 00:00:%02d"
    a, b = queue.new_folder(spark, "a"), queue.new_folder(spark, "b")
    spark.createDataFrame([("x", base % 0), ("y", base % 1)], "correlation_id string, sent string").selectExpr("correlation_id", "cast(sent as timestamp) sent").write.parquet(a)
    spark.createDataFrame([("x", base % 5, "hi")], "correlation_id string, replied string, text string").selectExpr("correlation_id", "cast(replied as timestamp) replied", "text").write.parquet(b)
    s = spark.readStream.schema("correlation_id string, sent timestamp").parquet(a)
    t = spark.readStream.schema("correlation_id string, replied timestamp, text string").parquet(b)
    assert {r.id for r in queue.drain(queue.correlate(s, t)).collect()} == {"x"}


@pytest.mark.parametrize("rows", [1, 3, 10_000])
def test_folds_do_not_depend_on_batches(spark, rows):
    """Breakers and chained ledgers, key by key, in batches of any size."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        calls = [("a", t, t in (1, 2, 3, 70)) for t in (1, 2, 3, 4, 62, 63, 70, 71)] + [("b", t, True) for t in (1, 200, 400, 401, 402, 403)]
        df = spark.createDataFrame([(k, t, n, bad) for n, (k, t, bad) in enumerate(calls)], "k string, s long, tie long, bad boolean").withColumn("ts", F.timestamp_seconds("s"))
        got = {(r.k, int(r.t)): (r.state, r.allowed) for r in state.breaker_states(df, "k", "ts", F.col("bad")).collect()}
        assert [got["a", t] for t in (1, 2, 3, 4, 62, 63, 70, 71)] == [("closed", True), ("closed", True), ("open", True), ("open", False), ("open", False), ("closed", True), ("closed", True), ("closed", True)]
        assert [got["b", t] for t in (1, 200, 400, 401, 402, 403)] == [("closed", True)] * 4 + [("open", True), ("open", False)]
        chained = ledger.append(spark.createDataFrame([(k, i, f"{{{k}{i}}}") for k in "xy" for i in range(7)], "ledger string, seq long, body string")).collect()
        for k in "xy":
            previous = ledger.GENESIS
            for r in sorted((r for r in chained if r.ledger == k), key=lambda r: r.seq):
                assert (r.prev_hash, r.hash) == (previous, hashlib.sha256((previous + r.body).encode()).hexdigest())
                previous = r.hash
    finally:
        spark.conf.set(name, before)


def test_cached_tiers(spark):
    tier = lambda *rows: spark.createDataFrame(list(rows), "k string, value string, s long").withColumn("stored", F.timestamp_seconds("s"))
    now = 100_000
    tiers = [tier(("a", "a0", now - 10), ("b", "b0", now - 90_000)), tier(("b", "b1", now), ("c", "c1", now - 86_400)), tier(("a", "a2", 0), ("d", "d2", 0))]
    found, back = state.cached(tiers, spark.createDataFrame([(k,) for k in "abcdea"], "k string"), "k", F.timestamp_seconds(F.lit(now)))
    assert {r.k: (r.tier, r.value) for r in found.collect()} == {"a": (0, "a0"), "b": (1, "b1"), "c": (1, "c1"), "d": (2, "d2"), "e": (None, None)}
    assert sorted((r.k, r.tier, r.value) for r in back.collect()) == [("b", 0, "b1"), ("c", 0, "c1"), ("d", 0, "d2"), ("d", 1, "d2")]


def test_joins_with_crowded_keys(spark):
    left = spark.createDataFrame([(k, i) for k, n in (("a", 40), ("b", 3), ("c", 1)) for i in range(n)] + [("z", 0)], "k string, i int")
    right = spark.createDataFrame([("a", 40, "A"), ("b", 3, "B"), ("c", 1, "C"), ("q", 0, "Q")], "k string, n int, v string")
    got = sorted((r.k, r.i, r.v) for r in lineage.join_counted(left, right, "k", crowd=10).collect())
    assert got == sorted((k, i, v) for k, n, v in (("a", 40, "A"), ("b", 3, "B"), ("c", 1, "C")) for i in range(n))


@pytest.mark.parametrize("master", ["local-cluster[3,2,3000]", "spark://host:7077", "yarn", ""])
def test_cluster_wants_a_shared_folder(master):
    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: master if name == "spark.master" else default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session)


def test_customers_are_dealt_over_tasks(spark, tmp_path):
    """A small file of many customers was scanned by one task, and requests were masked once for each tool."""
    from veilframe.operators.lineage import spread
    from veilframe.plans import registry

    spark.range(25_000).selectExpr("id as c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    few = spread(spark.range(0, 25_000, 1, 1), "id")
    assert few.rdd.getNumPartitions() == 3 and few.distinct().count() == 25_000 and spread(spark.range(0), "id").count() == 0
    for name in ("det_06_birth_date_made", "msk_11_tools"):
        assert registry.QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() == 3
    tools = registry.QUERIES["msk_11_tools"](spark, str(tmp_path))
    assert tools._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {(r.tool, r["count"]) for r in tools.where("ok").groupBy("tool").count().collect()} == {(t, 25_000) for t in ("mask_text", "unmask_response", "list_regulations")}
