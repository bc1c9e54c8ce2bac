"""Sources, sinks and extension points as queries over files made from the tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrow import pieces
from ..operators.lineage import cut, shared_dir
from ..sources import files
from .base import query, table
from .relational import DET, det, docs


def _made(df, write, key, schema_key):
    """(key, content) of files written by ``write`` from (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([write(t or "") for t in b.column(1).to_pylist()], pa.binary())], names=[key, "content"])

    return df.mapInArrow(run, f"{key} {schema_key}, content binary")


_MD5 = "SELECT doc_id, md5(text) AS h FROM documents"


def _read_back(spark, d, write, fmt):
    made = _made(docs(spark, d).select("doc_id", "text"), write, "doc_id", "long").withColumn("format", files.format_of(files.mime_of(F.col("content"))))
    return files.ingest(made.where(F.col("format") == fmt), keep="doc_id")


@query("src_01_mime_sniffing", "SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'audio/wav' WHEN 4 THEN 'audio/ogg' WHEN 5 THEN 'audio/flac' WHEN 6 THEN 'audio/mpeg' WHEN 7 THEN 'audio/mp4' WHEN 8 THEN 'text/plain' ELSE 'audio/mpeg' END AS mime FROM documents")
def src_01(spark, d):
    """Contents that begin with the signs of ten kinds, followed by the document's text."""
    heads = (b"%PDF-1.4", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"RIFF0000WAVEfmt ", b"OggS", b"fLaC", b"ID3\x03", b"0000ftypM4A 0000", b"hello ", b"\xff\xfb\x90")
    head = F.element_at(F.array(*[F.lit(bytearray(h)) for h in heads]), (F.col("doc_id") % 10 + 1).cast("int"))
    made = docs(spark, d).select("doc_id", F.concat(head, F.encode("text", "UTF-8")).alias("content"))
    return made.select("doc_id", files.mime_of(F.col("content"), F.lit(" text/plain ")).alias("mime"))


@query("src_02_format_of_mime", """WITH t(i, mime, format) AS (VALUES (0, 'application/pdf', 'pdf'), (1, 'image/png', 'image'), (2, 'image/jpeg', 'image'), (3, 'audio/mpeg', 'audio'), (4, 'audio/wav', 'audio'), (5, 'text/plain', NULL), (6, 'audio/aac', 'audio'),
(7, 'image/webp', 'image'), (8, 'application/octet-stream', 'audio'), (9, 'text/html', NULL), (10, 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', 'docx'), (11, 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet', 'xlsx'), (12, 'application/vnd.oasis.opendocument.spreadsheet', 'ods'))
SELECT page_id, mime, format FROM pages JOIN t ON t.i = page_id % 13""")
def src_02(spark, d):
    """The format of every page under a type that goes with it."""
    office = "application/vnd.openxmlformats-officedocument."
    names = ("application/pdf", "image/png", "image/jpeg", "audio/mpeg", "audio/wav", "text/plain", "audio/aac", "image/webp", "application/octet-stream", "text/html", office + "wordprocessingml.document", office + "spreadsheetml.sheet", "application/vnd.oasis.opendocument.spreadsheet")
    mime = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("page_id") % 13 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", mime.alias("mime")).withColumn("format", files.format_of(F.col("mime")))


@query("src_03_dispatch", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' ELSE 'xlsx' END AS format FROM nation")
def src_03(spark, d):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(files.write_pdf([t]), files.write_docx(t), files.write_xlsx({"s": [["a"], [t]]}))[k % 3] for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["n_nationkey", "content"])

    made = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name").mapInArrow(run, "n_nationkey long, content binary")
    read = files.ingest(made.withColumn("format", files.format_of(files.mime_of(F.col("content")))), keep="n_nationkey")
    return read.where("text <> ''").select("n_nationkey", "format")


@query("src_04_pdf", "SELECT doc_id, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS h FROM documents WHERE NOT regexp_matches(text, '[\\x{100}-\\x{10FFFF}]')")
def src_04(spark, d):
    t = docs(spark, d).where(~F.col("text").rlike(r"[\x{100}-\x{10FFFF}]")).select("doc_id", "text")
    read = files.ingest(_made(t, lambda x: files.write_pdf([x]), "doc_id", "long").withColumn("format", F.lit("pdf")), keep="doc_id")
    return read.select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))


@query("src_05_docx", _MD5)
def src_05(spark, d):
    return _read_back(spark, d, files.write_docx, "docx").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))


_SHEET = "SELECT r_regionkey, '# Sheet: ' || r_name || ' — columns: COLUMN_1 | COLUMN_2' || chr(10) || 'COLUMN_1' || chr(9) || 'COLUMN_2' || chr(10) || r_name || chr(9) || 'x' || chr(10) || 'y' AS text FROM region"


def _sheets(spark, d, write, fmt):
    def made(name: str) -> bytes:
        return write({name: [[None], ["a", "b"], [name, "x"], [None, "y"]], "empty": [[None]]})

    r = table(spark, d, "region").select("r_regionkey", "r_name")
    m = _made(r, made, "r_regionkey", "int").withColumn("format", files.format_of(files.mime_of(F.col("content"))))
    return files.ingest(m.where(F.col("format") == fmt), keep="r_regionkey").select("r_regionkey", "text")


@query("src_06_xlsx", _SHEET)
def src_06(spark, d):
    return _sheets(spark, d, files.write_xlsx, "xlsx")


@query("src_07_ods", _SHEET)
def src_07(spark, d):
    return _sheets(spark, d, files.write_ods, "ods")


@query("src_08_image_port", "SELECT doc_id, 'seen ' || (8 + strlen(text)) || ' bytes' AS text, 0.5::DOUBLE AS confidence FROM documents")
def src_08(spark, d):
    """Images that hold the documents' bytes, given to a recogniser that counts them."""
    content = F.concat(F.lit(bytearray(b"\x89PNG\r\n\x1a\n")), F.encode("text", "UTF-8"))
    png = docs(spark, d).select("doc_id", content.alias("content")).withColumn("format", files.format_of(files.mime_of(F.col("content"))))
    return files.ingest(png, recognise=lambda b: (f"seen {len(b)} bytes", 0.5), keep="doc_id").select("doc_id", "text", "confidence")


@query("src_09_audio_port", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'heard ' || (4 + strlen(text)) || ' bytes' ELSE '' END AS text, CASE WHEN doc_id % 2 = 1 THEN 'no reader for image' END AS warning FROM documents")
def src_09(spark, d):
    """Sounds that hold the documents' bytes, and images, for which there is no reader here."""
    head = F.when(F.col("doc_id") % 2 == 0, F.lit(bytearray(b"OggS"))).otherwise(F.lit(bytearray(b"\x89PNG\r\n\x1a\n")))
    f = docs(spark, d).select("doc_id", F.concat(head, F.encode("text", "UTF-8")).alias("content")).withColumn("format", files.format_of(files.mime_of(F.col("content"))))
    return files.ingest(f, transcribe=lambda b: (f"heard {len(b)} bytes", 0.9), keep="doc_id").select("doc_id", "text", "warning")


@query("src_10_ocr_layout", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || ' one  ' || source || ' two|below|right ' || lang || ' text|second right text|third right text' ELSE 'b  ' || lang || '|' || source END AS lines FROM documents")
def src_10(spark, d):
    """Boxes of words on pages of two widths: two columns with a gap, or lines close to each other; all moved down by a document's own number."""
    b = lambda y, left, right, text: F.struct((F.lit(y) + F.col("doc_id") % 50).cast("double").alias("y"), F.lit(left).alias("left"), F.lit(right).alias("right"), F.lit(10.0).alias("height"), text.alias("text"))
    say = lambda *parts: F.concat(*[F.col(p) if p in ("source", "lang") else F.lit(p) for p in parts])
    wide = F.array(b(10.0, 10.0, 90.0, say("source", " one")), b(12.0, 100.0, 190.0, say("source", " two")), b(40.0, 10.0, 90.0, say("below")), b(10.0, 600.0, 700.0, say("right ", "lang", " text")), b(30.0, 600.0, 700.0, say("second right text")), b(50.0, 600.0, 700.0, say("third right text")))
    close = F.array(b(50.0, 5.0, 20.0, say("source")), b(10.0, 5.0, 20.0, say("b")), b(11.0, 200.0, 220.0, say("lang")))
    even = F.col("doc_id") % 2 == 0
    pages = docs(spark, d).select("doc_id", F.when(even, 1000).otherwise(300).alias("width"), F.when(even, wide).otherwise(close).alias("boxes"))
    return pages.select("doc_id", F.array_join(files.layout_lines(F.col("boxes"), F.col("width")), "|").alias("lines"))


def _folder(spark) -> str:
    import uuid

    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


@query("src_11_plain_readers", "SELECT n_nationkey, n_name || chr(9) || n_regionkey AS text FROM nation")
def src_11(spark, d):
    """The nations as one CSV file for each, read back with cells by tabs."""
    path = _folder(spark)
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("k"), F.concat(F.lit('"'), "n_name", F.lit('",'), F.col("n_regionkey").cast("string")).alias("value"))
    n.write.partitionBy("k").text(path)
    read = files.read_plain(spark, f"{path}/*/*", "csv")
    return read.select(F.regexp_extract("path", "k=([0-9]+)", 1).cast("int").alias("n_nationkey"), "text")


@query("src_12_file_guard", "SELECT count(*) AS n FROM region")
def src_12(spark, d):
    path = _folder(spark)
    table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("k"), F.concat(F.lit("%PDF-1.4 "), "r_name").alias("value")).write.partitionBy("k").text(path)
    return files.scan_folder(spark, path, "*.txt").where("format = 'pdf'").agg(F.count("*").alias("n"))


@query("src_13_key_values", "SELECT c_custkey, 'Customer no' AS label, c_name AS value, 'identifier' AS field_type FROM customer UNION ALL SELECT c_custkey, 'Balance', CAST(c_custkey AS VARCHAR), CAST(NULL AS VARCHAR) FROM customer")
def src_13(spark, d):
    text = F.concat(F.lit("Customer no : "), "c_name", F.lit("\nno fields here\nBalance: "), F.col("c_custkey").cast("string"))
    return table(spark, d, "customer").select("c_custkey", F.explode(files.fields(text)).alias("f")).select("c_custkey", "f.*")


@query("src_14_table_scan", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3")
def src_14(spark, d):
    return table(spark, d, "customer").where("c_nationkey = 3").select("c_custkey", "c_name")


@query("src_15_ledger_scan", "SELECT event_id, event_type FROM events WHERE event_id % 10 <> 0")
def src_15(spark, d):
    path = _folder(spark)
    e = table(spark, d, "events")
    line = F.when(F.col("event_id") % 10 == 0, F.lit('{"event_id": 1, "event_ty')).otherwise(F.to_json(F.struct("event_id", "event_type")))
    e.select(line.alias("value")).write.text(path)
    return files.read_ledger(spark, path, "event_id long, event_type string")


#: Frequent short words by language, for a guess without a model.
COMMON = {"en": "the of and to in is that it for was on with as by this from are or be at".split(), "de": "der die das und ist von den mit zu im nicht des ein auf sich".split(), "fr": "le la les de des et est du en un une que pas pour sur au dans qui par".split(), "es": "el la los de que y en un una por con para del se las su es al".split()}


@query("src_18_language_guess", "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^\\s.,]+')) AS w FROM documents), s AS (SELECT doc_id, " + ", ".join("count(*) FILTER (w IN (" + ", ".join(f"'{x}'" for x in words) + f")) AS {lang}" for lang, words in COMMON.items()) + " FROM w GROUP BY 1) SELECT doc_id, CASE WHEN greatest(en, de, fr, es) = 0 OR en = greatest(en, de, fr, es) THEN 'en' WHEN de = greatest(en, de, fr, es) THEN 'de' WHEN fr = greatest(en, de, fr, es) THEN 'fr' ELSE 'es' END AS lang FROM s")
def src_18(spark, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([^\s.,]+)"), F.lit(1))
    t = docs(spark, d).select("doc_id", words.alias("w")).where(F.size("w") > 0)
    t = t.select("doc_id", *[F.size(F.filter("w", _among(v))).alias(k) for k, v in COMMON.items()])
    best = F.greatest(*COMMON)
    return t.select("doc_id", F.when((best == 0) | (F.col("en") == best), "en").when(F.col("de") == best, "de").when(F.col("fr") == best, "fr").otherwise("es").alias("lang"))


#: Sequences of three letters, weighed by language, from a quarter of the documents.
_PROFILES = r"""WITH t AS (SELECT doc_id, lang, ' ' || regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g') || ' ' AS t FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, lang, substr(t, i, 3) AS gram FROM (SELECT doc_id, lang, t, unnest(range(1, greatest(length(t) - 2, 1) + 1)) AS i FROM t)),
c AS (SELECT lang, gram, count(*) AS n FROM g WHERE doc_id % 4 = 0 AND lang IS NOT NULL GROUP BY 1, 2),
k AS (SELECT DISTINCT gram FROM (SELECT gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS nth FROM c) WHERE nth <= 2000),
l AS (SELECT lang, sum(n) AS total FROM c GROUP BY 1),
p AS (SELECT k.gram, l.lang, CAST(round(ln((coalesce(c.n, 0) + 0.5) / (l.total + 0.5)) * 1000000) AS BIGINT) AS weight FROM k CROSS JOIN l LEFT JOIN c ON c.gram = k.gram AND c.lang = l.lang),
s AS (SELECT g.doc_id, p.lang, sum(p.weight) AS w FROM g JOIN p USING (gram) GROUP BY 1, 2)
SELECT d.doc_id, coalesce(b.lang, 'en') AS lang FROM documents d LEFT JOIN (SELECT doc_id, lang FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, lang) = 1) b USING (doc_id)
"""


@query("src_18_ngram_profiles", _PROFILES)
def src_18_profiles(spark, d):
    """The language of every document by profiles learned from a quarter of them."""
    from ..operators import semantic

    t = docs(spark, d)
    return semantic.guess_language(t, semantic.profiles(t.where("doc_id % 4 = 0")))


def _among(words):
    return lambda w: w.isin(*words)


@query("src_19_corpus_generator", """SELECT doc_id, CASE doc_id % 20 WHEN 0 THEN 'user' || lpad(CAST((doc_id * 7919 + 1) % 1000000 AS VARCHAR), 6, '0') || '@host' || lpad(CAST((doc_id * 7927 + 2) % 1000 AS VARCHAR), 3, '0') || '.example.com'
WHEN 6 THEN 'MRN-' || lpad(CAST((doc_id * 7933 + 7) % 100000000 AS VARCHAR), 8, '0') WHEN 8 THEN 'https://shop.example.com/item/' || lpad(CAST((doc_id * 7937 + 9) % 1000000 AS VARCHAR), 6, '0') END AS original,
length(text) AS before FROM documents""")
def src_19(spark, d):
    """Where values are planted, and those of three types."""
    from ..operators import evaluate

    values = evaluate.planted(docs(spark, d))
    made = evaluate.documents(values, docs(spark, d)).select("doc_id", F.instr("text", evaluate.MARK).alias("at"))
    some = F.when(F.col("entity_type").isin("EMAIL_ADDRESS", "MEDICAL_RECORD_NUMBER", "URL"), F.col("original"))
    return values.join(made, "doc_id").select("doc_id", some.alias("original"), (F.col("at") - 1).alias("before"))


# --- sinks -----------------------------------------------------------------------------------------


@query("snk_03_persist_detections", DET + " SELECT entity_type, count(*) AS n FROM det GROUP BY 1")
def snk_03(spark, d):
    return cut(det(spark, d)).groupBy("entity_type").agg(F.count("*").alias("n"))


#: Chains by a recursive walk along each ledger.
_APPENDED = """WITH RECURSIVE b AS (SELECT user_id AS ledger, event_id AS seq, '{"event_type":"' || event_type || '"}' AS body, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
c AS (SELECT ledger, seq, i, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || body) AS hash FROM b WHERE i = 1
UNION ALL SELECT b.ledger, b.seq, b.i, c.hash, sha256(c.hash || b.body) FROM c JOIN b ON b.ledger = c.ledger AND b.i = c.i + 1)
SELECT ledger, seq, prev_hash, hash FROM c"""


@query("snk_04_chained_sink", _APPENDED)
def snk_04(spark, d):
    """Batches of events appended to a chained ledger as they come, each chained to the last hash of its user's ledger."""
    from ..streaming.sinks import append_batches

    return append_batches(table(spark, d, "events").select(F.col("user_id").alias("ledger"), F.col("event_id").alias("seq"), "event_type"), batches=3)


@query("snk_05_memory_sink", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def snk_05(spark, d):
    from ..streaming.queue import drain

    path = _folder(spark)
    table(spark, d, "events").select("event_id", "event_type").repartition(3).write.parquet(path)
    stream = spark.readStream.schema("event_id long, event_type string").parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))
    return drain(stream, "complete")


@query("snk_09_export_fan_in", "SELECT 'csv' AS kind, count(*) AS n FROM region UNION ALL SELECT 'ndjson', count(*) FROM region")
def snk_09(spark, d):
    from ..operators.ledger import csv_line, ndjson

    r = table(spark, d, "region")
    a = r.select(F.lit("csv").alias("kind"), csv_line([F.col("r_regionkey"), F.col("r_name")]).alias("line"))
    b = r.select(F.lit("ndjson").alias("kind"), ndjson(F.struct("r_regionkey", "r_name")).alias("line"))
    return a.unionByName(b).where("line <> ''").groupBy("kind").agg(F.count("*").alias("n"))


@query("snk_10_sealed_store", "SELECT doc_id, md5(text) AS h FROM documents")
def snk_10(spark, d):
    key, aad = F.lit(b"0123456789abcdef0123456789abcdef"), F.col("doc_id").cast("string")
    stored = cut(docs(spark, d).select("doc_id", T.encrypt(F.col("text"), key, aad).alias("sealed")))
    return stored.select("doc_id", F.md5(T.decrypt(F.col("sealed"), key, aad).cast("binary")).alias("h"))


# --- extension points ------------------------------------------------------------------------------


@query("udf_01_recogniser", "SELECT doc_id, CAST(len(regexp_extract_all(text, 'tion')) AS INTEGER) AS n FROM documents")
def udf_01(spark, d):
    """A recogniser of one's own: a rule row where a pattern will do."""
    from ..operators import rules, scan

    found = scan.scan(docs(spark, d), [rules.Rule("tion", "custom", "ENDING", "tion", 0.5)])
    n = found.groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))
    return docs(spark, d).select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("udf_02_validators", "SELECT o_orderkey, o_orderkey % 7 = 0 AS ok FROM orders")
def udf_02(spark, d):
    """A check of one's own beside the built-in ones."""
    from ..functions import ids

    checks = {**ids.CHECKS, "seven": lambda v: v.cast("long") % 7 == 0}
    return table(spark, d, "orders").select("o_orderkey", checks["seven"](F.col("o_orderkey").cast("string")).alias("ok"))


@query("udf_03_pandas_port", "SELECT doc_id, length(text) AS n FROM documents")
def udf_03(spark, d):
    @F.pandas_udf("long")
    def measured(s: pd.Series) -> pd.Series:
        return s.str.len()

    return docs(spark, d).select("doc_id", measured("text").alias("n"))


@query("udf_05_data_source", "SELECT c_custkey AS id, 'row ' || c_custkey || ' ' || c_name AS text FROM customer")
def udf_05(spark, d):
    """A source of one's own through the Python data source interface: a numbered line for every customer."""
    from ..sources.python_source import NumberedLines

    spark.dataSource.register(NumberedLines)
    customers = table(spark, d, "customer").select("c_custkey", "c_name")
    lines = spark.read.format("numbered_lines").option("rows", customers.count()).load()
    return lines.join(customers, F.col("id") == F.col("c_custkey")).select("id", F.concat_ws(" ", "text", "c_name").alias("text"))


@query("udf_06_config_tables", "SELECT n_nationkey, CAST(CASE n_regionkey WHEN 0 THEN 10 WHEN 1 THEN 6 WHEN 2 THEN 3 WHEN 3 THEN 3 ELSE 2 END AS BIGINT) AS n FROM nation")
def udf_06(spark, d):
    """Rules as a table, and the nations' choice of them as another."""
    from ..operators import rules

    chosen = ("gdpr", "kvkk", "hipaa", "lgpd", "ccpa")
    rows = [(r.pack, r.name, r.entity_type, r.pattern, r.score) for p in chosen for r in rules.PACKS[p]]
    table_of = spark.createDataFrame(rows, "pack string, name string, entity_type string, pattern string, score double")
    wanted = table(spark, d, "nation").select("n_nationkey", F.element_at(F.array(*[F.lit(p) for p in chosen]), (F.col("n_regionkey") + 1).cast("int")).alias("pack"))
    return wanted.join(table_of, "pack").groupBy("n_nationkey").agg(F.count("*").alias("n"))


@query("udf_07_third_party_pack", "SELECT doc_id FROM documents WHERE source = 'src3'")
def udf_07(spark, d):
    """Rules of another package, joined to the catalogue by their table."""
    from ..operators import rules, scan

    own = (rules.Rule("acme_source", "acme", "SOURCE_CODE", r"\bsrc3\b", 0.9),)
    t = docs(spark, d).select("doc_id", F.concat(F.lit("from "), "source", F.lit(" 1")).alias("text"))
    return scan.scan(t, rules.distinct([*rules.BASELINE, *own]), types={"SOURCE_CODE"}).select("doc_id")
