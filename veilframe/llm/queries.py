"""The registered queries of these operators: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dart, decontaminate, imatch, language, merkle, mixing, pii, quality, repair, substring, tokens, toxicity, urls
from ._common import crc_mod, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a copy of a benchmark item, edited or not, with the item, score and place."""
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text; base spans by rule, more by the semi-Markov model."""
    return pii.detect(table(spark, sf_dir, "documents"), pii.train())


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document so that sources weigh 1, 2, 3, ..., none above 3 times its size."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), ["doc_id"])
    return mixed.select(F.col("key.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitting rule and the verdict for every page."""
    judged = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), urls.rules_table(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = r"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r(h, q, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (
  SELECT page_id, arg_max(h || q, length(h || q)) AS rule, arg_max(v, length(h || q)) AS v
  FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.q)
  GROUP BY page_id)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.v, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text; rows without an id are never learned from and count as held out."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(True)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text without the words of 20-word windows that begin earlier as well."""
    kept = substring.strip(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, s, array_to_string(list_slice(w, s, s + 19), ' ') AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS n FROM g) WHERE n > 1),
k AS (SELECT doc_id, list_distinct(flatten(list(range(s, s + 20)))) AS gone FROM r GROUP BY doc_id),
c AS (SELECT d.doc_id, d.w, coalesce(k.gone, []) AS gone FROM d LEFT JOIN k USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN len(gone) = 0 THEN w ELSE list_where(w, list_transform(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i))) END, ' ')) AS kept_sha256
FROM c
"""


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text; rejected marks narrow margins, whose best guess is returned all the same."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs)
    found = language.identify(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(True)).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score", "rejected")


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and of its edit, and how near the edit and the next document are."""
    return imatch.compare(table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-duplicates of every document, named by its smallest id."""
    return dart.find(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every whole text; rows without an id are never learned from and count as held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(True)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_tokens(spark: SparkSession, sf_dir: str, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """Every whole text as ids in token files, and what is read back from them. vocabulary: a file of the public tokenizers."""
    import public_tokenizers

    folder = tokens.write(table(spark, sf_dir, "documents"), tokens.new_folder(spark), public_tokenizers.path(vocabulary))
    return tokens.read(spark, folder)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the damage did to every conversation, and its cheapest repair."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair.summary(repair.repair(repair.damaged(rows), rows))
    return found.withColumnRenamed("conv", "conv_id")


def _crc32_sql(ascii_text: str) -> str:
    """Unsigned crc32 of a text of ASCII signs, bit by bit."""
    signs = f"list_transform(range(1, strlen({ascii_text}) + 1), lambda i: CAST(ascii(substr({ascii_text}, i, 1)) AS BIGINT))"
    bits = "lambda c, y: list_reduce([xor(c, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1)))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {signs}), {bits}), CAST(4294967295 AS BIGINT))"


#: A row for each way on, states 0 to 3 as in ``repair``: from, to, edits, edit of the turn, initial it is for, cost. Audits are
#: compared as text here, from the last turn backwards, so that what follows is known in full.
OP12_SQL = rf"""
WITH RECURSIVE
h AS (SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
d AS (
  SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, {_crc32_sql("key")} % 20 AS f FROM h), range(2) AS copy(c)
  WHERE f <> 0 AND (c = 0 OR f = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
x AS (
  SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
         WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 't' ELSE '-' END AS fault
  FROM o),
ins(s, k, t) AS (VALUES (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (2, 2, 2), (3, 0, 3), (3, 1, 2), (3, 2, 3)),
op(op, initial, t, u, cost) AS (
  VALUES ('K', 's', 0, 1, 0), ('K', 'u', 0, 2, 0), ('K', 'u', 1, 2, 0), ('K', 'u', 3, 2, 0), ('K', 'a', 2, 3, 0),
         ('R', '*', 0, 2, 2), ('R', '*', 1, 2, 2), ('R', '*', 2, 3, 2), ('R', '*', 3, 2, 2),
         ('D', '*', 0, 0, 3), ('D', '*', 1, 1, 3), ('D', '*', 2, 2, 3), ('D', '*', 3, 3, 3)),
way AS (SELECT ins.s, op.u, repeat('I', ins.k) || op.op AS code, op.op, op.initial, 2 * ins.k + op.cost AS cost FROM ins JOIN op ON op.t = ins.t),
n AS (SELECT conv_id, count(*) AS n FROM x GROUP BY conv_id),
best(conv_id, i, s, b) AS (
  SELECT conv_id, n, s, min({{'cost': CAST(2 * k AS BIGINT), 'audit': repeat('I', k)}}) FROM n, ins WHERE t IN (0, 3) GROUP BY conv_id, n, s
  UNION ALL
  SELECT x.conv_id, x.i - 1, way.s, min({{'cost': CAST(best.b.cost + way.cost + CASE WHEN x.fault = 't' AND way.op <> 'D' THEN 1 ELSE 0 END AS BIGINT), 'audit': way.code || best.b.audit}})
  FROM best JOIN x ON x.conv_id IS NOT DISTINCT FROM best.conv_id AND x.i = best.i
  JOIN way ON way.u = best.s AND (way.op = 'D' OR (x.fault NOT IN ('b', 'd') AND way.initial IN ('*', x.initial)))
  GROUP BY x.conv_id, x.i, way.s),
a AS (SELECT conv_id, b.cost AS cost, b.audit AS audit FROM best WHERE i = 0 AND s = 0),
e AS (SELECT conv_id, p, substr(audit, p, 1) AS op, strlen(replace(substr(audit, 1, p), 'I', '')) AS i FROM (SELECT conv_id, audit, unnest(range(1, strlen(audit) + 1)) AS p FROM a)),
k AS (
  SELECT e.conv_id, e.p, e.op, x.role, x.text, row_number() OVER (PARTITION BY e.conv_id ORDER BY e.p) - 1 AS j, first(e.op = 'K' AND x.initial = 's') OVER (PARTITION BY e.conv_id ORDER BY e.p) AS s
  FROM e LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM e.conv_id AND x.i = e.i AND e.op <> 'I' WHERE e.op <> 'D'),
t AS (
  SELECT conv_id, sha256(string_agg(CASE op WHEN 'K' THEN role WHEN 'R' THEN CASE WHEN (j - CAST(s AS INTEGER)) % 2 = 0 THEN 'user' ELSE 'assistant' END ELSE CASE WHEN (j - CAST(s AS INTEGER)) % 2 = 0 THEN 'user' ELSE 'assistant' END END
    || ':' || CASE op WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS sha FROM k GROUP BY conv_id),
c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM x GROUP BY conv_id)
SELECT q.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
       coalesce(a.cost, 0) AS cost, coalesce(a.audit, '') AS audit, coalesce(t.sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM q.conv_id
LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM q.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM q.conv_id
"""


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A leaf for every document, under the root of its language and the root of all, and whether its proof holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    leaf = lambda n: merkle.hash_of(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))  # noqa: E731
    given = F.when(crc_mod(F.col("doc_id"), 7) == 0, leaf(F.col("n_chars") + 1)).otherwise(leaf(F.col("n_chars")))
    hashed = docs.select("doc_id", "lang", leaf(F.col("n_chars")).alias("leaf"), given.alias("given"))
    done = merkle.verify(merkle.manifest(hashed, F.col("lang"), F.col("doc_id"), F.col("leaf"), F.col("given")))
    return done.select("row.doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


OP13_SQL = rf"""
WITH RECURSIVE
v AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS pos FROM (
  SELECT doc_id, lang, CAST(doc_id AS VARCHAR) AS id, n_chars,
    (CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR) END) || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
    coalesce(strlen(text) || ':' || text, '-') AS b,
    sha256(a || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') || b) AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {_crc32_sql("id")} % 7 = 0
      THEN sha256(a || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || CAST(n_chars + 1 AS VARCHAR), '-') || b) ELSE leaf END AS given
  FROM documents)),
t(lang, level, h) AS (
  SELECT lang, 0, list(leaf ORDER BY pos) FROM v GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(0, CAST(ceil(len(h) / 2.0) AS BIGINT)), lambda i: sha256(array_to_string(list_slice(h, 2 * i + 1, 2 * i + 2), ''))) FROM t WHERE len(h) > 1),
s AS (SELECT lang, h[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM t WHERE len(h) = 1),
u(level, h) AS (
  SELECT 0, list(subroot ORDER BY pos) FROM s
  UNION ALL
  SELECT level + 1, list_transform(range(0, CAST(ceil(len(h) / 2.0) AS BIGINT)), lambda i: sha256(array_to_string(list_slice(h, 2 * i + 1, 2 * i + 2), ''))) FROM u WHERE len(h) > 1),
c AS (
  SELECT lang, level, h, 0 AS part FROM t WHERE len(h) > 1
  UNION ALL SELECT s.lang, u.level, u.h, 1 FROM s, u WHERE len(u.h) > 1),
steps AS (
  SELECT v.doc_id, v.leaf, row_number() OVER (PARTITION BY v.lang, v.pos ORDER BY c.part, c.level) AS k, v.lang, v.pos,
    (CASE c.part WHEN 0 THEN v.pos ELSE s.pos END >> c.level) & 1 AS side, coalesce(c.h[xor(CASE c.part WHEN 0 THEN v.pos ELSE s.pos END >> c.level, 1) + 1], '') AS sibling
  FROM v JOIN s ON v.lang IS NOT DISTINCT FROM s.lang JOIN c ON c.lang IS NOT DISTINCT FROM v.lang),
f(lang, pos, k, acc) AS (
  SELECT lang, pos, CAST(0 AS BIGINT), given FROM v
  UNION ALL
  SELECT f.lang, f.pos, f.k + 1, sha256(CASE side WHEN 1 THEN sibling || acc ELSE acc || sibling END)
  FROM f JOIN steps ON steps.lang IS NOT DISTINCT FROM f.lang AND steps.pos = f.pos AND steps.k = f.k + 1),
g AS (SELECT lang, pos, arg_max(acc, k) AS folded FROM f GROUP BY lang, pos),
p AS (SELECT lang, pos, string_agg(sibling, '' ORDER BY k) AS proof FROM steps GROUP BY lang, pos)
SELECT v.doc_id, v.leaf, s.subroot, r.root, sha256(coalesce(p.proof, '')) AS proof_sha256, g.folded AS folded_root, g.folded = r.root AS verified
FROM v JOIN s ON v.lang IS NOT DISTINCT FROM s.lang CROSS JOIN (SELECT h[1] AS root FROM u WHERE len(h) = 1) r
JOIN g ON g.lang IS NOT DISTINCT FROM v.lang AND g.pos = v.pos LEFT JOIN p ON p.lang IS NOT DISTINCT FROM v.lang AND p.pos = v.pos
"""


QUERIES = {
    f.__name__: f
    for f in (op1_decontaminate, op2_pii, op3_mixing, op4_quality, op5_url_rules, op6_substring, op7_language, op8_imatch, op9_near_duplicates, op10_toxicity, op11_tokens, op12_repair, op13_merkle)
}
#: The others draw on hashes, models or connected components and are tested against plain versions instead.
ORACLE_SQL = {"op5_url_rules": OP5_SQL, "op6_substring": OP6_SQL, "op12_repair": OP12_SQL, "op13_merkle": OP13_SQL}
