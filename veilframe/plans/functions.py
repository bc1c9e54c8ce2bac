"""Scalar functions: identity checks, text functions, hashes, slicing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as T
from .base import query, table

_O = "o_orderkey * 7919"
#: Numbers made from order keys: about one in a hundred passes a test of two check digits.
_ID11 = f"'1' || lpad(CAST(({_O}) % 100000000 AS VARCHAR), 8, '0') || lpad(CAST((o_orderkey * 37) % 100 AS VARCHAR), 2, '0')"
_D = "list_transform(string_split(v, ''), lambda c: CAST(c AS INTEGER))"


def _pad(x, n):
    return F.lpad(x.cast("string"), n, "0")


def orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey")


def id11(spark, d):
    k = F.col("o_orderkey")
    return orders(spark, d).withColumn("v", F.concat(F.lit("1"), _pad(k * 7919 % 100000000, 8), _pad(k * 37 % 100, 2)))


@query("fn_08_tckn", f"WITH x AS (SELECT o_orderkey, {_ID11} AS v FROM orders), y AS (SELECT *, {_D} AS d FROM x) SELECT o_orderkey, v, (((d[1]+d[3]+d[5]+d[7]+d[9])*7 - (d[2]+d[4]+d[6]+d[8])) % 10 + 10) % 10 = d[10] AND list_sum(d[1:10]) % 10 = d[11] AS ok FROM y")
def fn_08(spark, d):
    return id11(spark, d).select("o_orderkey", "v", ids.tckn(F.col("v")).alias("ok"))


def _cpf_digit(n):
    total = " + ".join(f"d[{i + 1}] * {n + 1 - i}" for i in range(n))
    return f"(CASE WHEN ({total}) * 10 % 11 = 10 THEN 0 ELSE ({total}) * 10 % 11 END)"


@query("fn_09_cpf", f"WITH x AS (SELECT o_orderkey, {_ID11} AS v FROM orders), y AS (SELECT *, {_D} AS d FROM x) SELECT o_orderkey, v, len(list_distinct(d)) > 1 AND {_cpf_digit(9)} = d[10] AND {_cpf_digit(10)} = d[11] AS ok FROM y")
def fn_09(spark, d):
    return id11(spark, d).select("o_orderkey", "v", ids.cpf(F.col("v")).alias("ok"))


@query("fn_10_ssn", f"WITH x AS (SELECT o_orderkey, lpad(CAST({_O} % 1000 AS VARCHAR), 3, '0') || '-' || lpad(CAST(o_orderkey % 10 AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_orderkey % 7 AS VARCHAR), 4, '0') AS v FROM orders) SELECT o_orderkey, v, substring(v, 1, 3) NOT IN ('000', '666') AND substring(v, 1, 1) <> '9' AND substring(v, 5, 2) <> '00' AND substring(v, 8, 4) <> '0000' AS ok FROM x")
def fn_10(spark, d):
    k = F.col("o_orderkey")
    v = F.concat(_pad(k * 7919 % 1000, 3), F.lit("-"), _pad(k % 10, 2), F.lit("-"), _pad(k % 7, 4))
    return orders(spark, d).select("o_orderkey", v.alias("v")).withColumn("ok", ids.ssn(F.col("v")))


@query("fn_11_iban", f"WITH x AS (SELECT o_orderkey, 'DE' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || lpad(CAST({_O} AS VARCHAR), 18, '0') AS v FROM orders) SELECT o_orderkey, v, CAST(CAST(substring(v, 5) || '1314' || substring(v, 3, 2) AS HUGEINT) % 97 AS INTEGER) AS rest, CAST(substring(v, 5) || '1314' || substring(v, 3, 2) AS HUGEINT) % 97 = 1 AS ok FROM x")
def fn_11(spark, d):
    k = F.col("o_orderkey")
    x = orders(spark, d).select("o_orderkey", F.concat(F.lit("DE"), _pad(k % 100, 2), _pad(k * 7919, 18)).alias("v"))
    return x.select("o_orderkey", "v", ids.iban_remainder(F.col("v")).alias("rest"), ids.iban(F.col("v")).alias("ok"))


_VERHOEFF_P = str(ids._PLACE).replace(" ", "")
_VERHOEFF_D = str([[ids._dihedral(a, b) for b in range(10)] for a in range(10)]).replace(" ", "")


@query(
    "fn_12_verhoeff",
    f"""WITH x AS (SELECT o_orderkey, '2' || lpad(CAST({_O} % 10000000000 AS VARCHAR), 10, '0') || CAST(o_orderkey % 10 AS VARCHAR) AS v FROM orders),
    p AS (SELECT o_orderkey, v, list_transform(list_reverse({_D}), lambda c, i: {_VERHOEFF_P}[(i - 1) % 8 + 1][c + 1]) AS d FROM x)
    SELECT o_orderkey, v, list_reduce(list_prepend(0, d), lambda a, b: {_VERHOEFF_D}[a + 1][b + 1]) = 0 AS ok FROM p""",
)
def fn_12(spark, d):
    k = F.col("o_orderkey")
    x = orders(spark, d).select("o_orderkey", F.concat(F.lit("2"), _pad(k * 7919 % 10000000000, 10), (k % 10).cast("string")).alias("v"))
    return x.select("o_orderkey", "v", ids.aadhaar(F.col("v")).alias("ok"))


@query("fn_13_detailed_validation", f"WITH x AS (SELECT o_orderkey, substring({_ID11}, 1, 3) || '.' || substring({_ID11}, 4) AS w FROM orders), y AS (SELECT *, replace(w, '.', '') AS v FROM x), z AS (SELECT *, {_D} AS d FROM y) SELECT o_orderkey, v AS normal, (((d[1]+d[3]+d[5]+d[7]+d[9])*7 - (d[2]+d[4]+d[6]+d[8])) % 10 + 10) % 10 = d[10] AND list_sum(d[1:10]) % 10 = d[11] AS valid FROM z")
def fn_13(spark, d):
    x = id11(spark, d).select("o_orderkey", F.concat(F.substring("v", 1, 3), F.lit("."), F.substring("v", 4, 20)).alias("w"))
    return x.select("o_orderkey", ids.detailed("tckn", F.col("w")).alias("r")).select("o_orderkey", "r.normal", "r.valid")


@query("fn_14_luhn_digit", f"WITH x AS (SELECT o_orderkey, '4' || lpad(CAST({_O} AS VARCHAR), 14, '0') AS v FROM orders), y AS (SELECT *, list_transform(list_reverse({_D}), lambda c, i: CASE WHEN i % 2 = 0 THEN c WHEN c > 4 THEN 2 * c - 9 ELSE 2 * c END) AS d FROM x) SELECT o_orderkey, v, CAST((10 - list_sum(d) % 10) % 10 AS INTEGER) AS digit FROM y")
def fn_14(spark, d):
    x = orders(spark, d).select("o_orderkey", F.concat(F.lit("4"), _pad(F.col("o_orderkey") * 7919, 14)).alias("v"))
    return x.select("o_orderkey", "v", ids.luhn_digit(F.col("v")).alias("digit"))


@query("fn_07_id_normal", "SELECT c_custkey, replace(replace(replace(c_name || '. -1', '-', ''), ' ', ''), '.', '') AS v FROM customer")
def fn_07(spark, d):
    return table(spark, d, "customer").select("c_custkey", ids.normal(F.concat("c_name", F.lit(". -1"))).alias("v"))


# --- text ------------------------------------------------------------------------------------------
_L = "CASE WHEN doc_id % 5 = 0 THEN 'tr' ELSE lang END"


def docs(spark, d):
    return table(spark, d, "documents").withColumn("l", F.when(F.col("doc_id") % 5 == 0, "tr").otherwise(F.col("lang")))


def _md5(c):
    return F.md5(c.cast("binary"))


@query("fn_01_nfc", "SELECT doc_id, md5(nfc_normalize(replace(text, 'é', 'e' || chr(769)))) AS h FROM documents")
def fn_01(spark, d):
    return docs(spark, d).select("doc_id", _md5(T.nfc(F.replace("text", F.lit("é"), F.lit("é")))).alias("h"))


@query("fn_02_strip_controls", "SELECT doc_id, md5(regexp_replace(text || chr(8203) || chr(7) || chr(9) || 'x', '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\x{200B}]', '', 'g')) AS h FROM documents")
def fn_02(spark, d):
    return docs(spark, d).select("doc_id", _md5(T.strip_controls(F.concat("text", F.lit("​\x07\tx")))).alias("h"))


@query("fn_03_locale_lower", f"SELECT doc_id, md5(lower(CASE WHEN {_L} IN ('tr', 'az') THEN translate(text, 'İI', 'ii') ELSE text END)) AS h FROM documents")
def fn_03(spark, d):
    return docs(spark, d).select("doc_id", _md5(T.locale_lower(F.col("text"), F.col("l"))).alias("h"))


@query("fn_04_comparison_key", f"SELECT doc_id, md5(trim(regexp_replace(lower(CASE WHEN {_L} IN ('tr', 'az') THEN translate(text, 'İI', 'ii') ELSE text END), '\\s+', ' ', 'g'))) AS h FROM documents")
def fn_04(spark, d):
    return docs(spark, d).select("doc_id", _md5(T.comparison_key(F.col("text"), F.col("l"))).alias("h"))


_NAME = "string_split(text, ' ')[1] || CASE doc_id % 4 WHEN 0 THEN '''s' WHEN 1 THEN 's''' WHEN 2 THEN '''in' ELSE '' END"


@query("fn_05_possessive", f"WITH x AS (SELECT doc_id, {_L} AS l, {_NAME} AS v FROM documents) SELECT doc_id, CASE WHEN length(v) < 3 THEN v WHEN l = 'tr' AND ends_with(v, '''in') THEN substring(v, 1, length(v) - 3) WHEN ends_with(v, '''s') OR ends_with(v, 's''') THEN substring(v, 1, length(v) - 2) ELSE v END AS v FROM x")
def fn_05(spark, d):
    k = F.col("doc_id") % 4
    v = F.concat(F.element_at(F.split("text", " ", -1), 1), F.when(k == 0, "'s").when(k == 1, "s'").when(k == 2, "'in").otherwise(""))
    return docs(spark, d).select("doc_id", T.strip_possessive(v, F.col("l")).alias("v"))


@query("fn_06_starts_upper", "SELECT doc_id, regexp_matches(text, '^\\p{L}') AND substring(text, 1, 1) = upper(substring(text, 1, 1)) AS v FROM documents")
def fn_06(spark, d):
    return docs(spark, d).select("doc_id", T.starts_upper(F.col("text")).alias("v"))


@query("fn_15_placeholder_parse", "WITH x AS (SELECT doc_id, '[' || upper(lang) || CASE WHEN doc_id % 2 = 0 THEN '_NAME_' ELSE ' ' END || doc_id || ']' AS p FROM documents) SELECT doc_id, nullif(regexp_extract(p, '^\\[([A-Z][A-Z_]*)_([0-9]+)\\]$', 1), '') AS entity_type, CAST(nullif(regexp_extract(p, '^\\[([A-Z][A-Z_]*)_([0-9]+)\\]$', 2), '') AS INTEGER) AS number FROM x")
def fn_15(spark, d):
    p = F.concat(F.lit("["), F.upper("lang"), F.when(F.col("doc_id") % 2 == 0, "_NAME_").otherwise(" "), F.col("doc_id").cast("string"), F.lit("]"))
    return docs(spark, d).select("doc_id", T.placeholder_parts(p).alias("r")).select("doc_id", "r.*")


_PUNCT = r"[\.,;:!?/\\\-\(\)\[\]\{\}\"'`]+".replace("'", "''")


@query("fn_16_index_value", f"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(trim(text)), '{_PUNCT}', ' ', 'g'), '\\s+', ' ', 'g'))) AS v FROM documents")
def fn_16(spark, d):
    return docs(spark, d).select("doc_id", _md5(T.index_value(F.col("text"))).alias("v"))


_STOP = "[" + ", ".join(f"'{w}'" for w in T.INDEX_STOP_WORDS) + "]"


@query("fn_17_index_tokens", f"WITH x AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '{T.INDEX_WORD}')) AS t FROM documents) SELECT DISTINCT doc_id, t FROM x WHERE NOT list_contains({_STOP}, t)")
def fn_17(spark, d):
    return docs(spark, d).select("doc_id", F.explode(T.index_tokens(F.col("text"))).alias("t"))


@query("fn_19_record_defaults", "SELECT event_id, coalesce(CAST(nullif(regexp_extract(props, '\"k\": *([0-9]+)', 1), '') AS BIGINT), 0) AS k, 'unknown' AS source FROM events")
def fn_19(spark, d):
    r = F.from_json("props", "k long, source string")
    return table(spark, d, "events").select("event_id", F.coalesce(r["k"], F.lit(0)).alias("k"), F.coalesce(r["source"], F.lit("unknown")).alias("source"))


def _hmac_sql(value: str, key: bytes) -> str:
    inner, outer = (bytes(b ^ x for b in key.ljust(64, b"\0")).hex() for x in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({value}))))"


@query("fn_20_hmac", f"SELECT c_custkey, {_hmac_sql('c_name', b'index key')} AS h FROM customer")
def fn_20(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.hmac_sha256(F.col("c_name"), b"index key").alias("h"))


@query("fn_21_encrypt_round_trip", "SELECT c_custkey, c_name AS back, CAST(NULL AS VARCHAR) AS wrong FROM customer")
def fn_21(spark, d):
    key, aad = F.lit(b"0123456789abcdef0123456789abcdef"), F.col("c_custkey").cast("string")
    sealed = T.encrypt(F.col("c_name"), key, aad)
    return table(spark, d, "customer").select("c_custkey", sealed.alias("s")).select("c_custkey", T.decrypt(F.col("s"), key, aad).alias("back"), T.decrypt(F.col("s"), key, F.concat(aad, F.lit("x"))).alias("wrong"))


@query("fn_22_strength", "SELECT event_id, CASE WHEN value / 100 >= 1.0 THEN 'strong' WHEN value / 100 >= 0.4 THEN 'medium' ELSE 'weak' END AS s FROM events")
def fn_22(spark, d):
    from ..functions.scores import strength

    return table(spark, d, "events").select("event_id", strength(F.col("value") / 100).alias("s"))


@query("fn_23_weights", """WITH t(i, t, w) AS (VALUES (0, 'NATIONAL_ID', 1.0), (1, 'PASSPORT_NUMBER', 1.0), (2, 'IBAN', 1.0), (3, 'TAX_ID', 1.0), (4, 'CREDIT_CARD_NUMBER', 1.0), (5, 'SOCIAL_SECURITY_NUMBER', 1.0),
(6, 'DRIVERS_LICENSE', 1.0), (7, 'MEDICAL_RECORD_NUMBER', 0.95), (8, 'HEALTH_INSURANCE_ID', 0.95), (9, 'EMAIL_ADDRESS', 0.85), (10, 'PHONE_NUMBER', 0.8), (11, 'POSTAL_ADDRESS', 0.75), (12, 'DATE_OF_BIRTH', 0.4),
(13, 'ORGANIZATION_NAME', 0.4), (14, 'PERSON_NAME', 0.3), (15, 'LOCATION', 0.1), (16, 'DATE_TIME', 0.05), (17, 'URL', 0.3), (18, NULL, 0.3))
SELECT user_id, round(sum(CAST(w AS DOUBLE)), 6) AS weight FROM events JOIN t ON t.i = event_id % 19 GROUP BY 1""")
def fn_23(spark, d):
    """Weights of the types that each user's events stand for, types without a weight of their own and null among them."""
    from ..functions.scores import WEIGHTS, weight

    kinds = F.array(*[F.lit(t) for t in (*WEIGHTS, "URL")])
    e = table(spark, d, "events").withColumn("t", F.try_element_at(kinds, (F.col("event_id") % 19 + 1).cast("int")))
    return e.groupBy("user_id").agg(F.round(F.sum(weight(F.col("t"))), 6).alias("weight"))


_LINES = "SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, unnest(string_split(text, chr(10))) AS line FROM documents"


@query("fn_24_headings", f"WITH x AS ({_LINES}), y AS (SELECT *, length(regexp_replace(line, '\\P{{Lu}}', '', 'g')) AS u, length(regexp_replace(line, '\\P{{L}}', '', 'g')) AS a FROM x) SELECT doc_id, CAST(i - 1 AS INTEGER) AS i, length(line) BETWEEN 5 AND 150 AND (ends_with(line, ':') OR (a > 0 AND u > 0.7 * a)) AS heading FROM y")
def fn_24(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).select("doc_id", "i", T.is_heading(F.col("line")).alias("heading"))


@query("fn_29_bm25_tokens", "WITH x AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '\\S+')) AS w FROM benchmark) SELECT item_id, w, count(*) AS n FROM x GROUP BY ALL")
def fn_29(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.explode(T.split_words(F.col("text"))).alias("w")).groupBy("item_id", "w").agg(F.count("*").alias("n"))


@query("fn_33_normalisation_rules", "SELECT doc_id, md5(regexp_replace(regexp_replace(text, '([A-Za-z])!!', '\\1', 'g'), '(%%%|###)', ' ', 'g')) AS h FROM documents")
def fn_33(spark, d):
    rules = [(2, 1, "(%%%|###)", " "), (1, 7, "([A-Za-z])!!", "\\1"), (1, 9, "([unclosed", "x")]
    return docs(spark, d).select("doc_id", _md5(T.normalise_by_rules(F.col("text"), rules)).alias("h"))


@query("fn_35_path_template", "SELECT page_id, regexp_replace(regexp_extract(url, '://[^/]*([^?#]*)', 1), '/[0-9]+(/|$)', '/{id}\\1', 'g') AS path FROM pages")
def fn_35(spark, d):
    return table(spark, d, "pages").select("page_id", T.path_template(F.regexp_extract("url", "://[^/]*([^?#]*)", 1)).alias("path"))


@query("fn_36_text_slices", "WITH x AS (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 256.0) AS BIGINT))) AS i FROM documents) SELECT doc_id, CAST(i AS INTEGER) AS i, md5(substring(text, i * 256 + 1, 256)) AS h FROM x")
def fn_36(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(T.slices(F.col("text"))).alias("i", "s")).select("doc_id", "i", _md5(F.col("s")).alias("h"))


@query("fn_37_section_predicates", f"WITH x AS ({_LINES}) SELECT doc_id, CAST(i - 1 AS INTEGER) AS i, regexp_matches(line, '^\\s*\\([a-zA-Z0-9]+\\)') AS marker, length(line) < 80 AND NOT regexp_matches(line, '[.!?]$') AS short FROM x")
def fn_37(spark, d):
    lines = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    return lines.select("doc_id", "i", F.col("line").rlike(r"^\s*\([a-zA-Z0-9]+\)").alias("marker"), ((F.length("line") < 80) & ~F.col("line").rlike(r"[.!?]\z")).alias("short"))


@query("fn_38_currency_fix", "SELECT doc_id, md5(regexp_replace(text, '([0-9])[ ]*(€|£)', '\\1 \\2', 'g')) AS h FROM documents")
def fn_38(spark, d):
    return docs(spark, d).select("doc_id", _md5(F.regexp_replace("text", "([0-9])[ ]*(€|£)", "$1 $2")).alias("h"))


@query("fn_34_json_salvage", "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events")
def fn_34(spark, d):
    # the answer is wrapped in prose: the outermost array is cut out and parsed, null if it is none
    answer = F.concat(F.lit("Sure, here it is:\n```json\n["), F.col("props"), F.lit("]\n```"))
    found = F.try_parse_json(F.regexp_extract(answer, r"(?s)(\[.*\])", 1))
    return table(spark, d, "events").select("event_id", F.try_variant_get(found, "$[0].k", "long").alias("k"))


@query("fn_28_inner_product", "SELECT a.vec_id, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS s FROM embeddings a, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) b")
def fn_28(spark, d):
    from ..operators.retrieve import inner_product

    e = table(spark, d, "embeddings")
    first = e.orderBy("vec_id").select("embedding").first()
    q = F.array(*[F.lit(float(x)) for x in first[0]])
    return e.select("vec_id", F.round(inner_product(F.col("embedding"), q), 5).alias("s"))


@query("fn_27_l2_normalise", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS x FROM embeddings")
def fn_27(spark, d):
    from ..operators.retrieve import l2_normalise

    return table(spark, d, "embeddings").select("vec_id", F.round(F.element_at(l2_normalise(F.col("embedding")), 1), 6).alias("x"))
