"""Filters, joins, aggregations, set operations, ranks and pages over the driver's tables. events stand for
audit events, conversations for chat sessions, documents with their detections for the document store."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores
from ..functions import text as T
from ..operators import audit, chunk
from .base import query, table

_SPLIT = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{k}' AS entity_type, regexp_extract_all(text, '{p}') AS v, string_split_regex(text, '{p}') AS g FROM documents" for k, p in audit.PLAIN.items())
#: det(doc_id, lang, source, entity_type, start, end, value): what audit.detections finds.
DET = f"""WITH s AS ({_SPLIT}),
det AS (SELECT doc_id, lang, source, entity_type, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS "start",
  CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(v[1:i], lambda x: length(x))) AS INTEGER) AS "end", v[i] AS value
  FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM s))"""


def docs(spark, d):
    return table(spark, d, "documents")


def det(spark, d):
    return audit.detections(docs(spark, d))


def events(spark, d):
    return table(spark, d, "events")


_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"


def with_k(e):
    return e.withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("long"))


# --- detections and their counts ------------------------------------------------------------------


@query("det_plain_spans", DET + ' SELECT doc_id, entity_type, "start", "end", value FROM det')
def det_plain_spans(spark, d):
    return det(spark, d)


@query("agg_01_entity_type_counts", DET + " SELECT doc_id, entity_type, count(*) AS n FROM det GROUP BY ALL")
def agg_01(spark, d):
    return det(spark, d).groupBy("doc_id", "entity_type").agg(F.count("*").alias("n"))


@query("agg_01_entity_counts_by_lang", DET + " SELECT lang, entity_type, count(*) AS n FROM det GROUP BY ALL")
def agg_01_lang(spark, d):
    t = docs(spark, d).select("doc_id", "lang", "text")
    # the language goes along with the row: no join back
    return audit.detections(t.withColumn("doc_id", F.struct("doc_id", "lang"))).groupBy(F.col("doc_id.lang").alias("lang"), "entity_type").agg(F.count("*").alias("n"))


@query("agg_02_placeholder_summary", DET + ", p AS (SELECT '[' || entity_type || '_' || row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY \"start\") || ']' AS p FROM det) SELECT regexp_extract(p, '^\\[([A-Z_]+)_[0-9]+\\]$', 1) AS entity_type, count(*) AS n FROM p GROUP BY ALL")
def agg_02(spark, d):
    n = F.row_number().over(Window.partitionBy("doc_id", "entity_type").orderBy("start"))
    p = det(spark, d).select(F.concat(F.lit("["), "entity_type", F.lit("_"), n.cast("string"), F.lit("]")).alias("p"))
    return p.groupBy(T.placeholder_parts(F.col("p"))["entity_type"].alias("entity_type")).agg(F.count("*").alias("n"))


@query("agg_03_entity_index", DET + ", h AS (SELECT doc_id, entity_type, sha256(lower(trim(value))) AS value_hash FROM det) SELECT doc_id, entity_type, value_hash, count(*) AS occurrences FROM h GROUP BY ALL")
def agg_03(spark, d):
    return det(spark, d).select("doc_id", "entity_type", F.sha2(F.lower(F.trim("value")), 256).alias("value_hash")).groupBy("doc_id", "entity_type", "value_hash").agg(F.count("*").alias("occurrences"))


@query("agg_04_metrics_totals", f"SELECT count(DISTINCT user_id) AS n_docs, CAST(sum({_K}) AS BIGINT) AS n_entities, round(CAST(sum({_K}) AS DOUBLE) / count(DISTINCT user_id), 2) AS per_doc FROM events WHERE event_type = 'view'")
def agg_04(spark, d):
    e = with_k(events(spark, d).where("event_type = 'view'"))
    return e.agg(F.count_distinct("user_id").alias("n_docs"), F.sum("k").alias("n_entities"), F.round(F.sum("k").cast("double") / F.count_distinct("user_id"), 2).alias("per_doc"))


@query("agg_04_coverage", DET + ", c AS (SELECT entity_type, count(*) AS n FROM det GROUP BY 1) SELECT entity_type, n, round(CAST(n AS DOUBLE) / sum(n) OVER (), 4) AS coverage FROM c")
def agg_04_coverage(spark, d):
    c = det(spark, d).groupBy("entity_type").agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n")).first()[0] or 1
    return c.select("entity_type", "n", F.round(F.col("n").cast("double") / F.lit(total), 4).alias("coverage"))


@query("agg_05_compliance_report", f"SELECT user_id, count(*) AS n_events, count(*) FILTER (event_type = 'purchase') AS n_purchase, count(*) FILTER (event_type = 'error') AS n_error, CAST(sum({_K}) AS BIGINT) AS entities, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds FROM events GROUP BY user_id")
def agg_05(spark, d):
    e = with_k(events(spark, d))
    return e.groupBy("user_id").agg(
        F.count("*").alias("n_events"), F.count_if(F.col("event_type") == "purchase").alias("n_purchase"), F.count_if(F.col("event_type") == "error").alias("n_error"),
        F.sum("k").alias("entities"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"),
    )


@query("agg_06_distinct_entities", DET + " SELECT doc_id, count(DISTINCT (entity_type || ':' || value)) AS n FROM det GROUP BY doc_id")
def agg_06(spark, d):
    return det(spark, d).groupBy("doc_id").agg(F.count_distinct(F.concat_ws(":", "entity_type", "value")).alias("n"))


@query("agg_07_filtered_count", "SELECT count(*) AS n FROM events WHERE event_type = 'error' AND value > 10")
def agg_07(spark, d):
    return events(spark, d).where("event_type = 'error' and value > 10").agg(F.count("*").alias("n"))


_CHUNKS = "c AS (SELECT doc_id, unnest(range(0, CASE WHEN length(text) > 800 THEN CAST(ceil((length(text) - 800) / 600.0) AS BIGINT) ELSE 0 END + 1)) AS i, text FROM documents WHERE length(text) > 0)"


@query("win_10_sliding_chunks", f"WITH {_CHUNKS} SELECT doc_id, CAST(i AS INTEGER) AS i, CAST(i * 600 AS INTEGER) AS start, md5(substring(text, CAST(i * 600 + 1 AS BIGINT), 800)) AS h FROM c")
def win_10(spark, d):
    return docs(spark, d).select("doc_id", F.explode(chunk.sliding(F.col("text"))).alias("c")).select("doc_id", F.col("c.index").alias("i"), F.col("c.start").alias("start"), F.md5(F.col("c.text").cast("binary")).alias("h"))


@query("agg_08_chunks_per_document", f"WITH {_CHUNKS} SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id")
def agg_08(spark, d):
    return docs(spark, d).where("length(text) > 0").select("doc_id", F.size(chunk.sliding(F.col("text"))).cast("long").alias("n"))


@query("agg_09_max_normalised", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / max(CAST(embedding[1] AS DOUBLE)) OVER (PARTITION BY label), 6) AS s FROM embeddings")
def agg_09(spark, d):
    x = F.element_at("embedding", 1).cast("double")
    return table(spark, d, "embeddings").select("vec_id", F.round(x / F.max(x).over(Window.partitionBy("label")), 6).alias("s"))


@query("agg_11_mean_confidence", "SELECT event_type, round(avg(value), 6) AS mean, count(value) AS n FROM events GROUP BY event_type")
def agg_11(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("value").alias("n"))


@query("agg_12_widest_line", "SELECT doc_id, CAST(max(len(string_split(l, ' '))) AS INTEGER) AS width FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id")
def agg_12(spark, d):
    widths = F.transform(F.split("text", "\n", -1), lambda x: F.size(F.split(x, " ", -1)))
    return docs(spark, d).select("doc_id", F.array_max(widths).alias("width"))


@query("agg_14_latency_histogram", "SELECT event_type, count(*) AS n, " + ", ".join(f"count(*) FILTER (value <= {b}) AS le_{i}" for i, b in enumerate(scores.LATENCY_BUCKETS)) + " FROM events GROUP BY event_type")
def agg_14(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), *[F.count_if(F.col("value") <= b).alias(f"le_{i}") for i, b in enumerate(scores.LATENCY_BUCKETS)])


@query("agg_14_path_counts", "SELECT regexp_replace(regexp_extract(url, '://[^/]*([^?#]*)', 1), '/[0-9]+(/|$)', '/{id}\\1', 'g') AS path, count(*) AS n FROM pages GROUP BY 1")
def agg_14_paths(spark, d):
    path = T.path_template(F.regexp_extract("url", "://[^/]*([^?#]*)", 1))
    return table(spark, d, "pages").groupBy(path.alias("path")).agg(F.count("*").alias("n"))


@query("agg_15_first_appearance", DET + ", p AS (SELECT doc_id, entity_type, min(\"start\") AS f FROM det GROUP BY ALL) SELECT doc_id, string_agg(entity_type, ',' ORDER BY f, entity_type) AS kinds FROM p GROUP BY doc_id")
def agg_15(spark, d):
    p = det(spark, d).groupBy("doc_id", "entity_type").agg(F.min("start").alias("f"))
    return p.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "entity_type"))), lambda x: x["entity_type"]), ",").alias("kinds"))


@query("agg_16_weighted_sum", DET + f" SELECT doc_id, round(sum({scores.weight_sql('entity_type')}), 6) AS score FROM (SELECT DISTINCT doc_id, entity_type, value FROM det) GROUP BY doc_id")
def agg_16(spark, d):
    distinct = det(spark, d).select("doc_id", "entity_type", "value").distinct()
    return distinct.groupBy("doc_id").agg(F.round(F.sum(scores.weight(F.col("entity_type"))), 6).alias("score"))


# --- filters ---------------------------------------------------------------------------------------


@query("flt_02_stop_words", "SELECT doc_id, CAST(len(list_filter(string_split(lower(text), ' '), lambda w: NOT list_contains(['the','a','an','of','in','at'], w))) AS INTEGER) AS n FROM documents")
def flt_02(spark, d):
    return docs(spark, d).select("doc_id", F.size(F.filter(F.split(F.lower("text"), " ", -1), lambda w: ~w.isin(*T.STOP_WORDS))).alias("n"))


@query("flt_03_allowed_types", DET + " SELECT doc_id, entity_type, value FROM det WHERE entity_type IN ('EMAIL_ADDRESS', 'IP_ADDRESS')")
def flt_03(spark, d):
    return det(spark, d).where(F.col("entity_type").isin("EMAIL_ADDRESS", "IP_ADDRESS")).select("doc_id", "entity_type", "value")


@query("flt_04_audit_filter", "SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'click' AND ts >= (SELECT min(ts) FROM events) + INTERVAL 1 DAY AND ts <= (SELECT min(ts) FROM events) + INTERVAL 9 DAY")
def flt_04(spark, d):
    e = events(spark, d)
    first = e.agg(F.min("ts")).first()[0]
    import datetime

    days = lambda n: first + datetime.timedelta(days=n) if first else None
    return audit.filtered(e, event_type="click", since=days(1), until=days(9)).select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


@query("flt_05_owner_scope", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7 OR o_custkey IS NULL")
def flt_05(spark, d):
    return audit.visible(table(spark, d, "orders").select("o_orderkey", "o_custkey"), 7, owner="o_custkey")


@query("flt_06_error_filter", "SELECT event_id, user_id FROM events WHERE event_type = 'error' AND value >= 50")
def flt_06(spark, d):
    return audit.filtered(events(spark, d), event_type="error").where("value >= 50").select("event_id", "user_id")


@query("flt_07_detections_of_type", DET + " SELECT doc_id, \"start\", value FROM det WHERE entity_type = 'PHONE_NUMBER'")
def flt_07(spark, d):
    return det(spark, d).where("entity_type = 'PHONE_NUMBER'").select("doc_id", "start", "value")


@query("flt_10_ready_documents", "SELECT doc_id, n_chars FROM documents WHERE lang IS NOT NULL AND n_chars > 0")
def flt_10(spark, d):
    return docs(spark, d).where("lang is not null and n_chars > 0").select("doc_id", "n_chars")


@query("flt_11_key_validity", "SELECT c_custkey FROM customer WHERE substring(sha256(c_name), 1, 1) = 'a' AND sha256(c_name) < sha256(c_name || 'x') AND c_acctbal > 0")
def flt_11(spark, d):
    h = F.sha2("c_name", 256)
    return table(spark, d, "customer").where((F.substring(h, 1, 1) == "a") & (h < F.sha2(F.concat("c_name", F.lit("x")), 256)) & (F.col("c_acctbal") > 0)).select("c_custkey")


@query("flt_12_document_list", "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND source = 'src3' ORDER BY n_chars DESC, doc_id")
def flt_12(spark, d):
    return docs(spark, d).where("lang = 'en' and source = 'src3'").select("doc_id", "source", "n_chars").dropDuplicates(["doc_id"]).orderBy(F.desc("n_chars"), "doc_id")


@query("flt_13_count_excluding", "SELECT count(*) AS n FROM customer WHERE c_acctbal > 0 AND c_custkey <> 1")
def flt_13(spark, d):
    return table(spark, d, "customer").where("c_acctbal > 0 and c_custkey <> 1").agg(F.count("*").alias("n"))


# --- joins -----------------------------------------------------------------------------------------


@query("jn_04_exists_semi_join", DET + " SELECT l.doc_id FROM labels l WHERE EXISTS (SELECT 1 FROM det WHERE det.doc_id = l.doc_id AND det.entity_type = 'IP_ADDRESS')")
def jn_04(spark, d):
    return table(spark, d, "labels").join(det(spark, d).where("entity_type = 'IP_ADDRESS'"), "doc_id", "left_semi").select("doc_id")


@query("jn_05_chunks_of_owner", "SELECT c_nationkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey")
def jn_05(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("jn_06_session_messages", "WITH m AS (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1) SELECT s.conv_id, coalesce(m.n, 0) AS n FROM (SELECT DISTINCT conv_id FROM conversations) s LEFT JOIN m USING (conv_id)")
def jn_06(spark, d):
    c = table(spark, d, "conversations")
    messages = c.where("role = 'user'").groupBy("conv_id").agg(F.count("*").alias("n"))
    return c.select("conv_id").distinct().join(messages, "conv_id", "left").select("conv_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("jn_09_hydrate_in_rank_order", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 25) SELECT r.rank, d.doc_id, d.source FROM r JOIN documents d USING (doc_id) ORDER BY rank")
def jn_09(spark, d):
    t = docs(spark, d)
    top = t.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(25)
    ranked = top.select("doc_id", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).alias("rank"))
    return F.broadcast(ranked).join(t.select("doc_id", "source"), "doc_id").select(F.col("rank").cast("long").alias("rank"), "doc_id", "source").orderBy("rank")


@query("jn_10_node_counts", DET + ", c AS (SELECT doc_id, count(DISTINCT value) AS n FROM det GROUP BY 1) SELECT d.doc_id, coalesce(c.n, 0) AS n FROM documents d LEFT JOIN c USING (doc_id)")
def jn_10(spark, d):
    c = det(spark, d).groupBy("doc_id").agg(F.count_distinct("value").alias("n"))
    return docs(spark, d).select("doc_id").join(c, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("jn_14_back_reference", DET + ", e AS (SELECT user_id, max(event_id) AS audit_id FROM events GROUP BY 1) SELECT det.doc_id, det.\"start\", e.audit_id FROM det LEFT JOIN e ON e.user_id = det.doc_id")
def jn_14(spark, d):
    e = events(spark, d).groupBy(F.col("user_id").alias("doc_id")).agg(F.max("event_id").alias("audit_id"))
    return det(spark, d).join(e, "doc_id", "left").select("doc_id", "start", "audit_id")


@query("jn_15_schema_columns", "SELECT n.n_name, string_agg(coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_name END, 'COLUMN_' || c_custkey), ',' ORDER BY c_custkey) AS cols FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY 1")
def jn_15(spark, d):
    label = F.coalesce(F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")), F.concat(F.lit("COLUMN_"), F.col("c_custkey").cast("string")))
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", label.alias("x")))), lambda s: s["x"]), ",").alias("cols"))


@query("jn_13_correlated_replies", "WITH q AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), r AS (SELECT user_id, ts AS rts FROM events WHERE event_type = 'purchase') SELECT q.event_id, CAST(count(r.rts) AS BIGINT) AS replies, count(r.rts) = 0 AS timed_out FROM q LEFT JOIN r ON r.user_id = q.user_id AND r.rts >= q.ts AND r.rts <= q.ts + INTERVAL 1 HOUR GROUP BY q.event_id")
def jn_13(spark, d):
    e = events(spark, d)
    q = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    r = e.where("event_type = 'purchase'").select(F.col("user_id").alias("ru"), F.col("ts").alias("rts"))
    j = q.join(r, (F.col("ru") == F.col("user_id")) & (F.col("rts") >= F.col("ts")) & (F.col("rts") <= F.col("ts") + F.expr("INTERVAL 1 HOUR")), "left")
    return j.groupBy("event_id").agg(F.count("rts").alias("replies"), (F.count("rts") == 0).alias("timed_out"))


# --- set operations --------------------------------------------------------------------------------

_A = "SELECT DISTINCT doc_id FROM det WHERE entity_type = 'EMAIL_ADDRESS'"
_B = "SELECT DISTINCT doc_id FROM det WHERE entity_type = 'PHONE_NUMBER'"


def _ab(spark, d):
    x = det(spark, d)
    return x.where("entity_type = 'EMAIL_ADDRESS'").select("doc_id"), x.where("entity_type = 'PHONE_NUMBER'").select("doc_id")


@query("set_01_union_of_layers", DET + " SELECT doc_id, entity_type FROM det WHERE entity_type = 'EMAIL_ADDRESS' UNION ALL SELECT doc_id, entity_type FROM det WHERE entity_type <> 'IP_ADDRESS'")
def set_01(spark, d):
    x = det(spark, d).select("doc_id", "entity_type")
    return x.where("entity_type = 'EMAIL_ADDRESS'").unionByName(x.where("entity_type <> 'IP_ADDRESS'"))


@query("set_02_first_pass_wins", DET + ", u AS (SELECT doc_id, \"start\", \"end\", entity_type, 1 AS pass, 0.9 AS score FROM det WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, \"start\", \"end\", entity_type, 2, 0.5 FROM det) SELECT doc_id, \"start\", \"end\", entity_type, CAST(score AS DOUBLE) AS score FROM u QUALIFY row_number() OVER (PARTITION BY doc_id, \"start\", \"end\", entity_type ORDER BY pass) = 1")
def set_02(spark, d):
    x = det(spark, d).select("doc_id", "start", "end", "entity_type")
    both = x.where("doc_id % 2 = 0").withColumns({"pass": F.lit(1), "score": F.lit(0.9)}).unionByName(x.withColumns({"pass": F.lit(2), "score": F.lit(0.5)}))
    return both.groupBy("doc_id", "start", "end", "entity_type").agg(F.min_by("score", "pass").alias("score"))


@query("set_03_union_distinct", DET + f" {_A} UNION {_B}")
def set_03(spark, d):
    a, b = _ab(spark, d)
    return a.union(b).distinct()


@query("set_04_intersection", DET + f" {_A} INTERSECT {_B}")
def set_04(spark, d):
    a, b = _ab(spark, d)
    return a.intersect(b)


@query("set_05_difference", DET + f" {_A} EXCEPT {_B}")
def set_05(spark, d):
    a, b = _ab(spark, d)
    return a.subtract(b)


@query("set_06_symmetric_difference", DET + f", a AS ({_A}), b AS ({_B}) (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)")
def set_06(spark, d):
    a, b = _ab(spark, d)
    return a.subtract(b).union(b.subtract(a))


@query("set_07_union_of_candidates", "(SELECT vec_id FROM embeddings ORDER BY embedding[1] DESC, vec_id LIMIT 50) UNION (SELECT vec_id FROM embeddings ORDER BY embedding[2] DESC, vec_id LIMIT 50)")
def set_07(spark, d):
    e = table(spark, d, "embeddings")
    top = lambda i: e.orderBy(F.element_at("embedding", i).desc(), "vec_id").limit(50).select("vec_id")
    return top(1).union(top(2)).distinct()


@query("set_08_strength_subsets", DET + f", w AS (SELECT doc_id, round(sum({scores.weight_sql('entity_type')}), 6) AS s FROM det GROUP BY 1) SELECT {scores.strength_sql('s')} AS strength, count(*) AS n FROM w GROUP BY 1")
def set_08(spark, d):
    w = det(spark, d).groupBy("doc_id").agg(F.round(F.sum(scores.weight(F.col("entity_type"))), 6).alias("s"))
    return w.groupBy(scores.strength(F.col("s")).alias("strength")).agg(F.count("*").alias("n"))


# --- ranks, windows, pages -------------------------------------------------------------------------


@query("win_06_placeholder_numbers", DET + ", f AS (SELECT doc_id, entity_type, value, min(\"start\") AS p FROM det GROUP BY ALL) SELECT doc_id, value, '[' || entity_type || '_' || dense_rank() OVER (PARTITION BY doc_id, entity_type ORDER BY p) || ']' AS placeholder FROM f")
def win_06(spark, d):
    f = det(spark, d).groupBy("doc_id", "entity_type", "value").agg(F.min("start").alias("p"))
    n = F.dense_rank().over(Window.partitionBy("doc_id", "entity_type").orderBy("p"))
    return f.select("doc_id", "value", F.concat(F.lit("["), "entity_type", F.lit("_"), n.cast("string"), F.lit("]")).alias("placeholder"))


_UNIFIED = ", f AS (SELECT entity_type, value, min(doc_id * 10000000 + \"start\") AS p FROM det GROUP BY ALL), u AS (SELECT entity_type, value, dense_rank() OVER (PARTITION BY entity_type ORDER BY p) AS n FROM f)"


def unified(spark, d):
    """(entity_type, value, n): numbers across documents by first appearance. Numbering a type is a running count:
    values are counted by ranges of their first places, so no range holds a whole type."""
    f = det(spark, d).groupBy("entity_type", "value").agg(F.min(F.col("doc_id") * 10000000 + F.col("start")).alias("p"))
    f = f.withColumn("block", F.floor(F.col("p") / (10000000 * 4096)))
    sizes = f.groupBy("entity_type", "block").agg(F.count("*").alias("c"))
    before = sizes.select("entity_type", "block", (F.sum("c").over(Window.partitionBy("entity_type").orderBy("block")) - F.col("c")).alias("b"))
    within = F.row_number().over(Window.partitionBy("entity_type", "block").orderBy("p"))
    return f.withColumn("w", within).join(before, ["entity_type", "block"]).select("entity_type", "value", (F.col("b") + F.col("w")).alias("n"))


@query("win_07_unified_numbers", DET + _UNIFIED + " SELECT entity_type, value, n FROM u")
def win_07(spark, d):
    return unified(spark, d)


@query("msk_08_unified_space", DET + _UNIFIED + " SELECT DISTINCT det.doc_id, det.value, '[' || det.entity_type || '_' || u.n || ']' AS placeholder FROM det JOIN u ON u.entity_type = det.entity_type AND u.value = det.value")
def msk_08(spark, d):
    u = unified(spark, d)
    x = det(spark, d).select("doc_id", "entity_type", "value").distinct().join(u, ["entity_type", "value"])
    return x.select("doc_id", "value", F.concat(F.lit("["), "entity_type", F.lit("_"), F.col("n").cast("string"), F.lit("]")).alias("placeholder"))


@query("win_12_header_on_change", "SELECT doc_id, source, coalesce(lag(source) OVER (PARTITION BY doc_id // 64 ORDER BY doc_id) <> source, true) AS header FROM documents")
def win_12(spark, d):
    w = Window.partitionBy(F.floor(F.col("doc_id") / 64)).orderBy("doc_id")
    return docs(spark, d).select("doc_id", "source", F.coalesce(F.lag("source").over(w) != F.col("source"), F.lit(True)).alias("header"))


@query("win_04_name_islands", DET + ", o AS (SELECT doc_id, \"start\", \"end\", CASE WHEN \"start\" <= lag(\"end\") OVER (PARTITION BY doc_id ORDER BY \"start\", \"end\") + 200 THEN 0 ELSE 1 END AS new FROM det), i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY \"start\", \"end\" ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT doc_id, min(\"start\") AS a, max(\"end\") AS b, count(*) AS n FROM i GROUP BY doc_id, g")
def win_04(spark, d):
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    o = det(spark, d).withColumn("new", F.when(F.col("start") <= F.lag("end").over(w) + 200, 0).otherwise(1))
    i = o.withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return i.groupBy("doc_id", "g").agg(F.min("start").alias("a"), F.max("end").alias("b"), F.count("*").alias("n")).drop("g")


@query("top_07_page", "SELECT event_id, user_id FROM events WHERE event_type = 'view' ORDER BY ts DESC, event_id LIMIT 50 OFFSET 100")
def top_07(spark, d):
    return audit.page(audit.filtered(events(spark, d), event_type="view"), [F.desc("ts"), F.col("event_id")], 3, 50).select("event_id", "user_id")


@query("top_08_first_chunks", f"WITH {_CHUNKS} SELECT doc_id, CAST(i AS INTEGER) AS i FROM c WHERE i < 3")
def top_08(spark, d):
    return docs(spark, d).select("doc_id", F.explode(F.slice(chunk.sliding(F.col("text")), 1, 3)).alias("c")).select("doc_id", F.col("c.index").alias("i"))


@query("top_09_newest_first", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def top_09(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey", "o_custkey")


@query("top_04_effective_k", "WITH t AS (SELECT doc_id, CAST(doc_id % 30 AS INTEGER) AS k, CAST(length(text) // 200 AS INTEGER) AS n FROM documents) SELECT doc_id, CAST(CASE WHEN n <= 0 THEN k ELSE least(25, greatest(k, k + CASE WHEN n <= 10 THEN 0 ELSE least(10, n // 3) END)) END AS INTEGER) AS effective FROM t")
def top_04(spark, d):
    """How many results are wanted of each document, by the number of its pieces of 200 signs."""
    n = F.floor(F.length("text") / 200).cast("int")
    return docs(spark, d).select("doc_id", scores.effective_k((F.col("doc_id") % 30).cast("int"), n).alias("effective"))


@query("top_05_document_k", "WITH t AS (SELECT event_id, CAST(event_id % 60 AS INTEGER) AS k, CAST(user_id % 14 AS INTEGER) AS n FROM events) SELECT event_id, CAST(greatest(5, least(50 // greatest(n, 1), k)) AS INTEGER) AS auto, CAST(greatest(10, least(50 // greatest(n, 1), k // greatest(n, 1))) AS INTEGER) AS manual FROM t")
def top_05(spark, d):
    """Results of each of several documents, for questions of all sizes."""
    k, n = (F.col("event_id") % 60).cast("int"), (F.col("user_id") % 14).cast("int")
    return events(spark, d).select("event_id", scores.document_k(k, n).alias("auto"), scores.document_k(k, n, manual=True).alias("manual"))