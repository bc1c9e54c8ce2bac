"""Retrieval, entity index, graph, ledger, exports and evaluation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import audit, evaluate, index, ledger, mask, retrieve, rules
from ..operators.graph import connected_components
from ..operators.lineage import cut, spread
from ..streaming.queue import new_folder
from .base import query, table
from .functions import _hmac_sql
from .relational import DET, det, docs, events

# --- retrieval -------------------------------------------------------------------------------------

#: Every chunk here is a document; queries are the benchmark items.
BM25 = """WITH base AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '\\S+') AS words FROM documents),
st AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM base),
tf AS (SELECT id, len(words) AS len, w, count(*) AS tf FROM (SELECT id, words, unnest(words) AS w FROM base) GROUP BY id, words, w),
idf0 AS (SELECT w, ln((st.n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, st GROUP BY w, st.n),
idf AS (SELECT w, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM idf0) ELSE idf END AS idf FROM idf0),
q AS (SELECT item_id AS q, w, count(*) AS qn FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '\\S+')) AS w FROM benchmark) GROUP BY ALL),
sc AS (SELECT q, id, round(sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / st.mean))), 4) AS score FROM q JOIN idf USING (w) JOIN tf USING (w), st GROUP BY q, id),
bm AS (SELECT q, id, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS INTEGER) AS rank FROM sc QUALIFY rank <= 15)"""


def bm25(spark, d):
    return retrieve.bm25(docs(spark, d), table(spark, d, "benchmark"), 15, digits=4)


@query("fn_30_bm25_topk", BM25 + " SELECT q AS item_id, id AS doc_id, score, rank FROM bm")
def fn_30(spark, d):
    return bm25(spark, d)


@query("top_02_bm25_best", BM25 + " SELECT q AS item_id, id AS doc_id, score FROM bm WHERE rank <= 5")
def top_02(spark, d):
    return bm25(spark, d).where("rank <= 5").select("item_id", "doc_id", "score")


@query("fn_30_stored_index", BM25 + " SELECT q AS item_id, id AS doc_id, score, rank FROM bm")
def fn_30_stored(spark, d):
    """One stored index, searched for two halves of the queries."""
    found = retrieve.build_words(docs(spark, d), folder=new_folder(spark, "words"))
    items = table(spark, d, "benchmark")
    half = F.pmod(F.xxhash64("item_id"), F.lit(2))
    first, second = (retrieve.search_words(found, items.where(half == i), 15, digits=4) for i in (0, 1))
    return first.unionByName(second)


_CORPUS = r"""WITH st AS (SELECT count(*) AS n FROM documents),
x AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '\S+')) AS w FROM documents)
SELECT w, count(*) AS df, round(ln((any_value(st.n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM x, st GROUP BY w"""


@query("agg_10_corpus_statistics", _CORPUS)
def agg_10(spark, d):
    from ..functions.text import split_words

    t = docs(spark, d)
    n = t.count()
    df = t.select(F.explode(F.array_distinct(split_words(F.col("text")))).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    return df.select("w", "df", F.round(F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


_UNIT = "WITH u AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS e FROM embeddings)"
DENSE = _UNIT + ", dn AS (SELECT a.vec_id AS q, b.vec_id AS id, round(list_inner_product(a.e, b.e), 5) AS score, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(a.e, b.e), 5) DESC, b.vec_id) AS INTEGER) AS rank FROM u a, u b WHERE a.vec_id % 20 = 0 QUALIFY rank <= 15)"


def dense(spark, d):
    e = table(spark, d, "embeddings")
    return retrieve.nearest(e, e.where("vec_id % 20 = 0"), 15, digits=5)


@query("top_01_dense_topk", DENSE + " SELECT q, id, score, rank FROM dn")
def top_01(spark, d):
    return dense(spark, d)


@query("top_03_widened_candidates", DENSE + " SELECT q, count(*) AS n FROM dn GROUP BY q")
def top_03(spark, d):
    e = table(spark, d, "embeddings")
    return retrieve.nearest(e, e.where("vec_id % 20 = 0"), scores.widened(5), digits=5).groupBy("q").agg(F.count("*").alias("n"))


@query("flt_09_absolute_threshold", DENSE + " SELECT q, id, score FROM dn WHERE score >= 0.35")
def flt_09(spark, d):
    return dense(spark, d).where("score >= 0.35").select("q", "id", "score")


#: The other list of the fusion: nearest by the first eight coordinates.
_HEAD = "list_transform(CAST(embedding[1:8] AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(embedding[1:8] AS DOUBLE[]), CAST(embedding[1:8] AS DOUBLE[]))))"
_SPARSE = f", u8 AS (SELECT vec_id, {_HEAD} AS e FROM embeddings), sp AS (SELECT a.vec_id AS q, b.vec_id AS id, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(a.e, b.e), 5) DESC, b.vec_id) AS INTEGER) AS rank FROM u8 a, u8 b WHERE a.vec_id % 20 = 0 QUALIFY rank <= 15)"
_FUSED = DENSE + _SPARSE + ", fu AS (SELECT coalesce(dn.q, sp.q) AS q, coalesce(dn.id, sp.id) AS id, round(coalesce(0.5 / (60 + dn.rank), 0) + coalesce(0.5 / (60 + sp.rank), 0), 9) AS score FROM dn FULL JOIN sp ON dn.q = sp.q AND dn.id = sp.id)"


def sparse(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 8).alias("embedding"))
    return retrieve.nearest(e, e.where("vec_id % 20 = 0"), 15, digits=5)


def fused(spark, d):
    return retrieve.fuse([(dense(spark, d), 0.5), (sparse(spark, d), 0.5)])


@query("win_01_list_ranks", DENSE + _SPARSE + " SELECT q, id, rank FROM sp")
def win_01(spark, d):
    return sparse(spark, d).select("q", "id", "rank")


@query("win_02_rrf_hybrid", _FUSED + " SELECT q, id, score FROM fu")
def win_02(spark, d):
    return fused(spark, d)


@query("jn_12_full_outer_merge", _FUSED + " SELECT q, count(*) AS n FROM fu GROUP BY q")
def jn_12(spark, d):
    a, b = dense(spark, d).select("q", "id", F.col("rank").alias("ra")), sparse(spark, d).select("q", "id", F.col("rank").alias("rb"))
    return a.join(b, ["q", "id"], "full").groupBy("q").agg(F.count("*").alias("n"))


@query("flt_08_relative_threshold", _FUSED + " SELECT q, id, score, round(score / max(score) OVER (PARTITION BY q), 6) AS norm FROM fu QUALIFY norm >= 0.6 OR row_number() OVER (PARTITION BY q ORDER BY score DESC, id) = 1")
def flt_08(spark, d):
    return retrieve.relevant(fused(spark, d), 0.6)


@query("top_06_cross_document_merge", DENSE + " SELECT q, id, score FROM dn ORDER BY score DESC, q, id LIMIT 50")
def top_06(spark, d):
    return dense(spark, d).select("q", "id", "score").orderBy(F.desc("score"), "q", "id").limit(50)


# --- entity index and graph ------------------------------------------------------------------------

_KEY = b"index key"
_IDX = DET + f", ix AS (SELECT doc_id, entity_type, {_hmac_sql('v', _KEY)} AS value_hash, count(*) AS occurrences FROM (SELECT doc_id, entity_type, trim(regexp_replace(regexp_replace(lower(trim(value)), '[\\.,;:!?/\\\\\\-\\(\\)\\[\\]\\{{\\}}\"''`]+', ' ', 'g'), '\\s+', ' ', 'g')) AS v FROM det) GROUP BY ALL)"


def built(spark, d):
    return index.build(det(spark, d), _KEY)


@query("idx_keyed_hashes", _IDX + " SELECT doc_id, entity_type, value_hash, occurrences FROM ix")
def idx(spark, d):
    return built(spark, d)


_PAIRS = _IDX + f", pr AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, round(sum({scores.weight_sql('a.entity_type')}), 6) AS score, count(*) AS shared_entity_count FROM ix a JOIN ix b ON a.entity_type = b.entity_type AND a.value_hash = b.value_hash AND a.doc_id < b.doc_id GROUP BY 1, 2)"


@query("jn_08_document_pairs", _PAIRS + " SELECT doc_a, doc_b, score, shared_entity_count FROM pr")
def jn_08(spark, d):
    return index.pairs(built(spark, d))


@query("jn_08_pair_types", _IDX + " SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, a.entity_type, count(*) AS n FROM ix a JOIN ix b ON a.entity_type = b.entity_type AND a.value_hash = b.value_hash AND a.doc_id < b.doc_id GROUP BY ALL")
def jn_08_types(spark, d):
    return index.shared_types(built(spark, d))


@query("grf_04_full_rebuild", _PAIRS + " SELECT count(*) AS n_pairs, round(sum(score), 4) AS total FROM pr")
def grf_04(spark, d):
    return index.pairs(cut(built(spark, d))).agg(F.count("*").alias("n_pairs"), F.round(F.sum("score"), 4).alias("total"))


_ASKED = ", aq AS (SELECT DISTINCT entity_type, value_hash FROM ix WHERE doc_id % 20 = 0), hit AS (SELECT DISTINCT ix.doc_id, ix.entity_type, ix.value_hash FROM ix JOIN aq USING (entity_type, value_hash)), sd AS (SELECT doc_id, round(sum(" + scores.weight_sql("entity_type") + "), 6) AS score FROM hit GROUP BY 1)"


def asked_scores(spark, d):
    ix = cut(built(spark, d))
    asked = ix.where("doc_id % 20 = 0").select(F.concat_ws(":", "entity_type", "value_hash").alias("signature"), "entity_type", "value_hash").distinct()
    return ix, index.score_documents(ix, asked)


@query("jn_07_index_lookup", _IDX + _ASKED + " SELECT doc_id, score FROM sd")
def jn_07(spark, d):
    return asked_scores(spark, d)[1]


@query("jn_07_routing", _IDX + _ASKED + " SELECT doc_id, score FROM sd WHERE score >= CASE WHEN (SELECT max(score) FROM sd) >= 1.0 THEN 1.0 ELSE 0.4 END")
def jn_07_route(spark, d):
    return index.route(cut(asked_scores(spark, d)[1]))


#: Components by a recursive walk; a document without an edge is its own.
_COMPONENTS = ", e AS (SELECT doc_a AS a, doc_b AS b FROM pr WHERE score >= 0.4 UNION SELECT doc_b, doc_a FROM pr WHERE score >= 0.4), walk AS (SELECT a AS doc_id, a AS c FROM e UNION SELECT e.b, walk.c FROM walk JOIN e ON e.a = walk.doc_id), cl AS (SELECT doc_id, min(c) AS cluster FROM walk GROUP BY 1)"


def _recursive(sql: str) -> str:
    return "WITH RECURSIVE" + sql[len("WITH") :]


@query("grf_02_document_clusters", _recursive(_PAIRS + _COMPONENTS + " SELECT doc_id, cluster FROM cl"))
def grf_02(spark, d):
    return index.cluster_documents(built(spark, d))


#: Every document holds a common place and one of a few names; values of little weight reach the threshold in sum only.
_LIGHT_SQL = """WITH RECURSIVE ix AS (
  SELECT doc_id, 'LOCATION' AS t, 'l' || doc_id % 3 AS v FROM documents UNION ALL SELECT doc_id, 'PERSON_NAME', 'p' || doc_id % 7 FROM documents
  UNION ALL SELECT doc_id, 'LOCATION', 'all' FROM documents UNION ALL SELECT doc_id, 'DATE_TIME', 'd' || doc_id % 50 FROM documents WHERE doc_id % 2 = 0),
pr AS (SELECT a.doc_id AS a, b.doc_id AS b FROM ix a JOIN ix b ON a.t = b.t AND a.v = b.v AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING round(sum(CASE a.t WHEN 'PERSON_NAME' THEN 0.3 WHEN 'LOCATION' THEN 0.1 ELSE 0.05 END), 6) >= 0.4),
e AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr),
m AS (SELECT a, least(a, min(b)) AS c FROM e GROUP BY a), m2 AS (SELECT m.a, min(n.c) AS c FROM m JOIN e ON e.a = m.a JOIN m n ON n.a = e.b GROUP BY m.a)
"""


@query("grf_02_light_values", _LIGHT_SQL + ", w AS (SELECT a AS doc_id, a AS c FROM m2 WHERE a = c UNION SELECT e.b, w.c FROM w JOIN e ON e.a = w.doc_id) SELECT doc_id, min(c) AS cluster FROM w GROUP BY 1")
def grf_02_light(spark, d):
    """Clusters where no single value weighs enough and some are held by every document."""
    i = docs(spark, d).select("doc_id")
    row = lambda df, t, v: df.select("doc_id", F.lit(t).alias("entity_type"), v.alias("value_hash"))
    of = lambda p, m: F.concat(F.lit(p), (F.col("doc_id") % m).cast("string"))
    ix = row(i, "LOCATION", of("l", 3)).unionByName(row(i, "PERSON_NAME", of("p", 7))).unionByName(row(i, "LOCATION", F.lit("all"))).unionByName(row(i.where("doc_id % 2 = 0"), "DATE_TIME", of("d", 50)))
    return index.cluster_documents(ix)


@query("grf_01_components", _recursive(_PAIRS + ", e AS (SELECT doc_a AS a, doc_b AS b FROM pr UNION SELECT doc_b, doc_a FROM pr), walk AS (SELECT a AS node, a AS c FROM e UNION SELECT e.b, walk.c FROM walk JOIN e ON e.a = walk.node) SELECT node, min(c) AS component FROM walk GROUP BY 1"))
def grf_01(spark, d):
    return connected_components(index.pairs(built(spark, d)), "doc_a", "doc_b")


@query("top_10_clusters_by_score", _recursive(_PAIRS + _COMPONENTS + " SELECT cl.cluster, count(DISTINCT cl.doc_id) AS n, max(pr.score) AS best FROM cl JOIN pr ON pr.doc_a = cl.doc_id GROUP BY 1"))
def top_10(spark, d):
    edges = cut(index.pairs(built(spark, d)))
    j = index.clusters(edges).join(edges, F.col("doc_id") == F.col("doc_a"))
    return j.groupBy("cluster").agg(F.count_distinct("doc_id").alias("n"), F.max("score").alias("best")).orderBy(F.desc("best"), "cluster")


@query("jn_11_visible_edges", _PAIRS + f" SELECT doc_a, doc_b, score, {scores.strength_sql('score')} AS strength FROM pr WHERE doc_a % 2 = 0 AND doc_b % 2 = 0")
def jn_11(spark, d):
    e = index.graph_edges(index.pairs(built(spark, d)), docs(spark, d).where("doc_id % 2 = 0"))
    return e.select("doc_a", "doc_b", "score", "strength")


@query("grf_03_graph_nodes", _PAIRS + ", c AS (SELECT doc_id, count(*) AS n FROM ix GROUP BY 1), g AS (SELECT doc_id, count(*) AS degree FROM (SELECT doc_a AS doc_id FROM pr UNION ALL SELECT doc_b FROM pr) GROUP BY 1) SELECT doc_id, coalesce(c.n, 0) AS entities, coalesce(g.degree, 0) AS degree FROM documents LEFT JOIN c USING (doc_id) LEFT JOIN g USING (doc_id)")
def grf_03(spark, d):
    ix = cut(built(spark, d))
    n = ix.groupBy("doc_id").agg(F.count("*").alias("n"))
    p = index.pairs(ix)
    g = p.select(F.explode(F.array("doc_a", "doc_b")).alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("degree"))
    return docs(spark, d).select("doc_id").join(n, "doc_id", "left").join(g, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("entities"), F.coalesce("degree", F.lit(0)).alias("degree"))


@query("grf_05_disambiguation", _recursive(_PAIRS + _ASKED + _COMPONENTS + ", f AS (SELECT sd.doc_id, coalesce(cl.cluster, sd.doc_id) AS c FROM sd LEFT JOIN cl USING (doc_id) WHERE score >= 0.4) SELECT count(DISTINCT c) AS n_clusters, count(DISTINCT c) > 1 AS requires, CASE count(DISTINCT c) WHEN 0 THEN 'no_match' WHEN 1 THEN 'single_cluster' ELSE 'multiple_clusters' END AS reason FROM f"))
def grf_05(spark, d):
    ix, scored = asked_scores(spark, d)
    return index.disambiguate(scored, index.pairs(ix))


@query("snk_01_replace_document", _IDX + " SELECT doc_id, entity_type, value_hash, occurrences FROM ix WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, entity_type, value_hash, occurrences + 1 FROM ix WHERE doc_id % 3 = 0")
def snk_01(spark, d):
    ix = cut(built(spark, d))
    return index.replace_document(ix, ix.where("doc_id % 3 = 0").withColumn("occurrences", F.col("occurrences") + 1))


@query("snk_02_replace_relations", _PAIRS + " SELECT doc_a, doc_b, CASE WHEN doc_a = (SELECT min(doc_a) FROM pr) OR doc_b = (SELECT min(doc_a) FROM pr) THEN 9.0::DOUBLE ELSE score END AS score FROM pr")
def snk_02(spark, d):
    p = cut(index.pairs(built(spark, d)).select("doc_a", "doc_b", "score"))
    first = p.agg(F.min("doc_a")).first()[0]
    touched = (F.col("doc_a") == F.lit(first)) | (F.col("doc_b") == F.lit(first))
    fresh = p.where(touched).withColumn("score", F.lit(9.0))
    return p.where(~touched).unionByName(fresh)


#: Every fifth document gets the contents of the one after it.
_MOVED = ", ix2 AS (SELECT * FROM ix WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id - 1, entity_type, value_hash, occurrences FROM ix WHERE doc_id % 5 = 1)"


@query("snk_02_signed_deltas", _IDX + _MOVED + f" SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, round(sum({scores.weight_sql('a.entity_type')}), 6) AS score, count(*) AS shared_entity_count FROM ix2 a JOIN ix2 b ON a.entity_type = b.entity_type AND a.value_hash = b.value_hash AND a.doc_id < b.doc_id GROUP BY 1, 2")
def snk_02_deltas(spark, d):
    """Relations kept up by differences, where the SQL rebuilds them."""
    ix = cut(built(spark, d))
    fresh = ix.where("doc_id % 5 = 1").withColumn("doc_id", F.col("doc_id") - 1)
    return index.maintain(cut(index.pairs(ix)), ix, fresh, ids=docs(spark, d).where("doc_id % 5 = 0"))[0]


# --- ledger and exports ----------------------------------------------------------------------------


def chained(spark, d):
    """events as ledgers of users, chained; one hash in every thousand rows is spoilt."""
    e = events(spark, d).select(F.col("user_id").alias("ledger"), F.col("event_id").alias("seq"), "event_type", F.col("value").cast("string").alias("value"))
    return ledger.append(ledger.bodies(e))


#: Chains by a recursive walk along each ledger.
_CHAIN = """WITH RECURSIVE b AS (SELECT user_id AS ledger, event_id AS seq, '{"event_type":"' || event_type || '"}' AS body, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
c AS (SELECT ledger, seq, i, body, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || body) AS hash FROM b WHERE i = 1
UNION ALL SELECT b.ledger, b.seq, b.i, b.body, c.hash, sha256(c.hash || b.body) FROM c JOIN b ON b.ledger = c.ledger AND b.i = c.i + 1)"""


def simple_chain(spark, d):
    e = events(spark, d).select(F.col("user_id").alias("ledger"), F.col("event_id").alias("seq"), "event_type")
    return ledger.append(ledger.bodies(e))


@query("led_01_append_chain", _CHAIN + " SELECT ledger, seq, prev_hash, hash FROM c")
def led_01(spark, d):
    return simple_chain(spark, d).select("ledger", "seq", "prev_hash", "hash")


@query("led_02_verify_chain", _CHAIN + ", s AS (SELECT ledger, seq, i, CASE WHEN seq % 997 = 0 THEN 'x' ELSE body END AS body, prev_hash, hash FROM c) SELECT ledger, count(*) AS n, min(seq) FILTER (hash <> sha256(prev_hash || body)) AS first_break, CASE WHEN min(seq) FILTER (hash <> sha256(prev_hash || body)) IS NOT NULL THEN 'hash mismatch' END AS kind FROM s GROUP BY ledger")
def led_02(spark, d):
    spoilt = simple_chain(spark, d).withColumn("body", F.when(F.col("seq") % 997 == 0, "x").otherwise(F.col("body")))
    return ledger.verify(spoilt)


@query("win_08_chain_links", _CHAIN + ", s AS (SELECT * FROM c WHERE seq % 503 <> 0) SELECT ledger, count(*) FILTER (prev_hash <> p) AS broken FROM (SELECT ledger, prev_hash, coalesce(lag(hash) OVER (PARTITION BY ledger ORDER BY seq), repeat('0', 64)) AS p FROM s) GROUP BY ledger")
def win_08(spark, d):
    s = simple_chain(spark, d).where("seq % 503 <> 0")
    p = F.coalesce(F.lag("hash").over(Window.partitionBy("ledger").orderBy("seq")), F.lit(ledger.GENESIS))
    return s.withColumn("p", p).groupBy("ledger").agg(F.count_if(F.col("prev_hash") != F.col("p")).alias("broken"))


@query("fn_18_record_hash", "SELECT event_id AS seq, sha256('{\"event_type\":\"' || event_type || '\",\"props\":\"' || replace(props, '\"', '\\\"') || '\"}') AS hash FROM events")
def fn_18(spark, d):
    return ledger.bodies(events(spark, d).select(F.col("user_id").alias("ledger"), F.col("event_id").alias("seq"), "event_type", "props")).select("seq", F.sha2("body", 256).alias("hash"))


@query("win_09_keep_last", "SELECT user_id AS ledger, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 10")
def win_09(spark, d):
    return ledger.retain(events(spark, d).select(F.col("user_id").alias("ledger"), F.col("event_id").alias("seq")), most_rows=10)


@query("led_03_retention", "WITH m AS (SELECT max(ts) - INTERVAL 5 DAY AS t FROM events) SELECT user_id AS ledger, event_id AS seq FROM events, m WHERE ts >= t QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 20")
def led_03(spark, d):
    e = events(spark, d)
    latest = e.agg((F.max("ts") - F.expr("INTERVAL 5 DAY")).alias("t")).first()[0]
    rows = e.select(F.col("user_id").alias("ledger"), F.col("event_id").alias("seq"), "ts")
    return ledger.retain(rows, most_rows=20, oldest=F.lit(latest)).select("ledger", "seq")


@query("snk_06_csv_export", "SELECT event_id, '\"' || event_id || '\",\"' || event_type || '\",\"' || replace(props, '\"', '\"\"') || '\",\"' || printf('%.6f', value) || '\"' AS line FROM events")
def snk_06(spark, d):
    return events(spark, d).select("event_id", ledger.csv_line([F.col("event_id"), F.col("event_type"), F.col("props"), F.format_string("%.6f", "value")]).alias("line"))


@query("snk_07_ndjson_export", "SELECT event_id, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}' AS line FROM events")
def snk_07(spark, d):
    return events(spark, d).select("event_id", ledger.ndjson(F.struct("event_id", "event_type", "user_id")).alias("line"))


@query("snk_08_collector_export", "SELECT event_id, '{\"time\":' || (epoch_us(ts) // 1000000) || ',\"host\":\"node\",\"source\":\"audit\",\"event\":{\"event_type\":\"' || event_type || '\"}}' AS line FROM events")
def snk_08(spark, d):
    return events(spark, d).select("event_id", ledger.collector_event(F.unix_seconds(F.col("ts").cast("timestamp")), "node", "audit", F.struct("event_type")).alias("line"))


@query("snk_11_session_export", "SELECT conv_id, count(*) AS n, md5(string_agg(turn || ':' || role || ':' || text, chr(10) ORDER BY turn, role, text)) AS h FROM conversations GROUP BY conv_id")
def snk_11(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    lines = F.transform("m", lambda x: F.concat_ws(":", x["turn"].cast("string"), x["role"], x["text"]))
    return c.select("conv_id", "n", F.md5(F.array_join(lines, "\n").cast("binary")).alias("h"))


@query("snk_13_audit_events", DET + ", o AS (SELECT doc_id, count(*) AS entity_count, array_to_string(list(value ORDER BY entity_type, \"start\")[1:5], '|') AS samples FROM det GROUP BY 1) SELECT 'pii_detected' AS event_type, doc_id, entity_count, substring(samples, 1, 200) AS samples FROM o")
def snk_13(spark, d):
    o = det(spark, d).groupBy("doc_id").agg(F.count("*").alias("entity_count"), F.array_sort(F.collect_list(F.struct("entity_type", "start", "value"))).alias("l"))
    samples = F.substring(F.array_join(F.transform(F.slice("l", 1, 5), lambda x: x["value"]), "|"), 1, 200)
    return o.select(F.lit("pii_detected").alias("event_type"), "doc_id", "entity_count", samples.alias("samples"))


@query("snk_14_error_log", f"SELECT event_id, substring(props, 1, 2000) AS message, substring({_hmac_sql('CAST(user_id AS VARCHAR)', _KEY)}, 1, 16) AS ip_hash FROM events WHERE event_type = 'error'")
def snk_14(spark, d):
    from ..functions.text import hmac_sha256

    e = audit.filtered(events(spark, d), event_type="error")
    return e.select("event_id", F.substring("props", 1, 2000).alias("message"), F.substring(hmac_sha256(F.col("user_id").cast("string"), _KEY), 1, 16).alias("ip_hash"))


# --- evaluation ------------------------------------------------------------------------------------


@query("agg_13_precision_recall", DET + ", t AS (SELECT doc_id, max(1) AS found FROM det GROUP BY 1), j AS (SELECT l.quality, l.toxic = 1 AS gold, t.found IS NOT NULL AS found FROM labels l LEFT JOIN t USING (doc_id)), c AS (SELECT quality AS entity_type, count(*) FILTER (gold AND found) AS tp, count(*) FILTER (gold AND NOT found) AS fn, count(*) FILTER (found AND NOT gold) AS fp FROM j GROUP BY 1), r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS r FROM c) SELECT entity_type, tp, fn, fp, round(p, 6) AS \"precision\", round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM r")
def agg_13(spark, d):
    t = det(spark, d).select("doc_id").distinct().withColumn("found", F.lit(True))
    j = table(spark, d, "labels").join(t, "doc_id", "left").select("quality", (F.col("toxic") == 1).alias("gold"), F.coalesce("found", F.lit(False)).alias("found"))
    c = j.groupBy(F.col("quality").alias("entity_type")).agg(F.count_if(F.col("gold") & F.col("found")).alias("tp"), F.count_if(F.col("gold") & ~F.col("found")).alias("fn"), F.count_if(F.col("found") & ~F.col("gold")).alias("fp"))
    return evaluate.rates(c)


def _masked_corpus(spark, d, policy=None, values=None):
    values = cut(evaluate.planted(docs(spark, d)) if values is None else values)
    return values, cut(mask.mask_documents(evaluate.documents(values, docs(spark, d)), policy or rules.compose(rules.PACKS)))


_TYPE_NAMES = "t(i, entity_type) AS (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(evaluate.TYPES)) + ")"


@query("eval_01_planted_recall", f"WITH {_TYPE_NAMES} SELECT entity_type, count(*) AS tp, CAST(0 AS BIGINT) AS fn, 1.0::DOUBLE AS recall FROM documents JOIN t ON t.i = doc_id % 20 GROUP BY 1")
def eval_01(spark, d):
    """Of values of twenty types, one planted in each document, all are gone from the masked text."""
    return evaluate.rates(evaluate.hits(*_masked_corpus(spark, d))).select("entity_type", "tp", "fn", "recall")


@query("eval_01_strict_spans")
def eval_01_strict(spark, d):
    """By exact value and type; only what stands behind a document's own text counts."""
    values, masked = _masked_corpus(spark, d)
    spans = masked.select("doc_id", F.explode("entities").alias("e"), "text", F.instr("text", evaluate.MARK).alias("at")).where(F.col("e.start") >= F.col("at"))
    spans = spans.select("doc_id", "e.entity_type", F.substring("text", F.col("e.start") + 1, F.col("e.end") - F.col("e.start")).alias("value"))
    return evaluate.rates(evaluate.strict_hits(values, spans))


@query("eval_02_clean_false_positives", "SELECT doc_id, 0 AS spans FROM documents")
def eval_02(spark, d):
    """Masked spans of clean lines with numbers, colons and signs in them, one for each document, with a number of its own."""
    lines = F.array(*[F.lit(c) for c in evaluate.CLEAN])
    number = (F.col("doc_id") % 20 + 3).cast("string")
    clean = docs(spark, d).select("doc_id", F.replace(F.element_at(lines, (F.col("doc_id") % len(evaluate.CLEAN) + 1).cast("int")), F.lit("#"), number).alias("text"))
    return mask.mask_documents(clean, rules.compose(rules.PACKS)).select("doc_id", F.col("n_masked").alias("spans"))


@query("eval_03_adversarial", f"WITH {_TYPE_NAMES} SELECT entity_type, count(*) AS tp, CAST(0 AS BIGINT) AS fn, 1.0::DOUBLE AS recall FROM documents JOIN t ON t.i = doc_id % 20 WHERE entity_type IN ('CREDIT_CARD_NUMBER', 'IBAN') GROUP BY 1")
def eval_03(spark, d):
    """Spaced and dashed forms of card numbers and spaced ones of account numbers."""
    values = evaluate.planted(docs(spark, d)).where(F.col("entity_type").isin("CREDIT_CARD_NUMBER", "IBAN"))
    turn = F.floor(F.col("doc_id") / 20) % 3
    form = F.when(turn == 0, F.regexp_replace("original", "(....)(?=.)", "$1 ")).when((turn == 1) & (F.col("entity_type") == "CREDIT_CARD_NUMBER"), F.regexp_replace("original", "(....)(?=.)", "$1-")).otherwise(F.col("original"))
    return evaluate.rates(evaluate.hits(*_masked_corpus(spark, d, values=values.withColumn("original", form)))).select("entity_type", "tp", "fn", "recall")


@query("eval_04_layer_ablation")
def eval_04(spark, d):
    """Recall with packs only and with the baseline rules as well. Each text is dealt out, scanned once for both, and counted where it was
    masked; no text is stored."""
    policies = {"packs": rules.compose(rules.PACKS, baseline=False), "packs_and_baseline": rules.compose(rules.PACKS)}
    texts = spread(docs(spark, d).select("doc_id", "text"), "doc_id", 1000)
    masked = mask.mask_layers(evaluate.planted_documents(texts), policies)
    return evaluate.rates(evaluate.layer_hits(masked, list(policies)))
