"""Detection and masking queries: rules, packs, span algebra, placeholders."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import keywords, mask, resolve, rules, scan
from ..operators.lineage import spread
from .base import ORACLE_SQL, QUERIES, query, table
from .relational import DET, det, docs

#: The baseline rules' names by query; those whose pattern another engine reads alike have SQL.
_BASELINE = {
    "det_01_phone": ("phone",), "det_02_iban": ("iban",), "det_03_person": ("name_after_label",), "det_04_address": ("address",), "det_05_card": ("card",), "det_06_birth_date": ("birth_date",),
    "det_07_mac": ("mac",), "det_08_url": ("url",), "det_09_coordinates": ("coordinates", "coordinates_dms"), "det_10_cookie": ("cookie_ga", "cookie_uuid"), "det_11_device": ("device_imei", "device_uuid", "device_serial"),
    "det_12_ssn": ("ssn",), "det_13_cpf": ("cpf",), "det_14_passport": ("passport",), "det_15_license": ("drivers_license",), "det_16_tax": ("tax",), "det_17_plate": ("plate",),
}


def spans_sql(source: str, pattern: str, where: str = "true") -> str:
    """All matches with places, from (id, text); where filters (id, start, end, value)."""
    p = pattern.replace("'", "''")
    return f"""WITH src AS ({source}), s AS (SELECT id, regexp_extract_all(text, '{p}') AS v, string_split_regex(text, '{p}') AS g FROM src),
    m AS (SELECT id, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS "start",
    CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(v[1:i], lambda x: length(x))) AS INTEGER) AS "end", v[i] AS value
    FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM s))
    SELECT id, "start", "end", value FROM m WHERE {where}"""


def _probed(spark, d):
    """documents beside a line made from the row, which gives every rule something to find."""
    k = F.col("doc_id")
    made = F.format_string(
        "IBAN DE89370400440532013000 or DE%02d370400440532013000\nName:\n Anna \nAddress : Main ST 12 NO:%d Floor\nborn on 12.03.19%02d mac 00:1a:2b:3c:4d:%02x at 41.%04d, 2.%04d "
        "cookie=123e4567-e89b-12d3-a456-426614174000 IMEI: 3569380356438%02d SSN 078-05-11%02d cpf 529.982.247-%02d passport P12345%02d driver's license D12345%02d tax id 12-34567%02d plate no 34 ABC %02d see https://ex.example.com/a/%02d, or not",
        (k % 90 + 10), k, (k % 90 + 10), (k % 200), (k % 9000 + 1000), (k % 8000 + 1000), (k % 90 + 10), (k % 90 + 10), (k % 90 + 10), (k % 90 + 10), (k % 90 + 10), (k % 90 + 10), (k % 90 + 10), (k % 90 + 10),
    )
    return docs(spark, d).select("doc_id", F.concat("text", F.lit("\n"), made).alias("text"))


def _probe(spark, d, names: tuple[str, ...]):
    t = _probed(spark, d)
    found = scan.scan(t, [r for r in rules.BASELINE if r.name in names])
    return found.select(F.col("doc_id").alias("id"), "start", "end", "value", "entity_type", "score")


for _name, _rules in _BASELINE.items():

    def _run(spark, d, _rules=_rules):
        return _probe(spark, d, _rules)

    QUERIES[_name] = _run

#: Page sources hold urls; ASCII-only surroundings make borders of words alike in all engines.
_PAGES = "SELECT page_id AS id, html || ' mac 00:1a:2b:3c:4d:' || lpad(CAST(page_id % 90 + 10 AS VARCHAR), 2, '0') || ' _ga=GA1.2.3.' || page_id || ' https://shop.example.com/item/' || page_id || ' ' AS text FROM pages"


def _pages(spark, d):
    k = F.col("page_id")
    return table(spark, d, "pages").select(k.alias("id"), F.concat("html", F.format_string(" mac 00:1a:2b:3c:4d:%02d _ga=GA1.2.3.%d https://shop.example.com/item/%d ", k % 90 + 10, k, k)).alias("text"))


def _plain(spark, d, names):
    found = scan.scan(_pages(spark, d), [r for r in rules.BASELINE if r.name in names], "id", "text")
    return found.select("id", "start", "end", "value")


for _name, _rule in {"det_07_mac_pages": "mac", "det_08_url_pages": "url", "det_10_cookie_pages": "cookie_ga"}.items():

    def _run_plain(spark, d, _rule=_rule):
        return _plain(spark, d, (_rule,))

    QUERIES[_name] = _run_plain
    ORACLE_SQL[_name] = spans_sql(_PAGES, next(r for r in rules.BASELINE if r.name == _rule).pattern)


# --- every baseline rule with a plain pattern over lines made of ASCII, where all engines agree on the borders of words --

_FORMAT = (
    "Call +1 (555) 123-%04d or 0505 182 37 %02d. Card 4111 1111 1111 %04d. Date of birth: 12.03.19%02d and 7 March 19%02d. At 41.%04d, 2.%04d. cookie=123e4567-e89b-12d3-a456-4266141740%02d "
    "IMEI: 3569380356438%02d device_id=123e4567-e89b-12d3-a456-4266141740%02d serial no: AB12CD%02d SSN 078-05-11%02d. passport P12345%02d. driver license D12345%02d. tax id 12-34567%02d. plate no 34 ABC %03d."
)
_DIVISORS = (10000, 100, 10000, 100, 100, 10000, 10000, 100, 100, 100, 100, 100, 100, 100, 100, 1000)
_MADE_SQL = "SELECT c_custkey AS id, printf('" + _FORMAT + "', " + ", ".join(f"c_custkey % {n}" for n in _DIVISORS) + ") AS text FROM customer"


def _rule_sql(rule: rules.Rule) -> str:
    flag = "(?i)" if rule.ignore_case else ""
    where = ["true"]
    if rule.digits:
        where.append(f"length(regexp_replace(value, '[^0-9]', '', 'g')) BETWEEN {rule.digits[0]} AND {rule.digits[1]}")
    if rule.shape == "digit":
        where.append("regexp_matches(value, '[0-9]')")
    if rule.before:
        before = rule.before.replace("'", "''")
        where.append(f"regexp_matches(substring(text, greatest(\"start\" - {rule.window}, 0) + 1, least(\"start\", {rule.window})), '(?i){before}')")
    sql = spans_sql(_MADE_SQL, flag + rule.pattern, " AND ".join(where))
    return sql.replace("SELECT id, regexp_extract_all", "SELECT id, text, regexp_extract_all").replace("m AS (SELECT id,", "m AS (SELECT id, text,")


def _dealt(spark, d):
    """Their keys, dealt over tasks: the file is small and one task's, what is done for each of them is not."""
    return spread(table(spark, d, "customer").select("c_custkey"), "c_custkey")


def _made_lines(spark, d):
    k = F.col("c_custkey")
    return _dealt(spark, d).select(k.alias("id"), F.format_string(_FORMAT, *[k % n for n in _DIVISORS]).alias("text"))


for _name, _rule in {
    "det_01_phone_made": "phone", "det_05_card_made": "card", "det_06_birth_date_made": "birth_date", "det_09_coordinates_made": "coordinates", "det_10_cookie_made": "cookie_uuid", "det_11_imei_made": "device_imei",
    "det_11_device_made": "device_uuid", "det_11_serial_made": "device_serial", "det_14_passport_made": "passport", "det_15_license_made": "drivers_license", "det_16_tax_made": "tax", "det_17_plate_made": "plate",
}.items():

    def _run_made(spark, d, _rule=_rule):
        return scan.scan(_made_lines(spark, d), [r for r in rules.BASELINE if r.name == _rule], "id", "text").select("id", "start", "end", "value")

    QUERIES[_name] = _run_made
    ORACLE_SQL[_name] = _rule_sql(next(r for r in rules.BASELINE if r.name == _rule))


@query("det_12_ssn_made", _rule_sql(next(r for r in rules.BASELINE if r.name == "ssn")).replace('SELECT id, "start", "end", value FROM m', "SELECT id, value, CASE WHEN substring(value, 8) <> '0000' THEN 0.92::DOUBLE ELSE 0.55 END AS score FROM m"))
def det_12_made(spark, d):
    return scan.scan(_made_lines(spark, d), [r for r in rules.BASELINE if r.name == "ssn"], "id", "text").select("id", "value", "score")


@query("det_13_cpf_made", "WITH x AS (SELECT c_custkey AS id, '529.982.247-' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') AS value FROM customer) SELECT id, value, CASE WHEN value = '529.982.247-25' THEN 0.95::DOUBLE ELSE 0.55 END AS score FROM x WHERE id % 2 = 0 OR value = '529.982.247-25'")
def det_13_made(spark, d):
    k = F.col("c_custkey")
    t = _dealt(spark, d).select(k.alias("id"), F.concat(F.when(k % 2 == 0, "CPF ").otherwise("no. "), F.format_string("529.982.247-%02d", k % 100)).alias("text"))
    return scan.scan(t, [r for r in rules.BASELINE if r.name == "cpf"], "id", "text").select("id", "value", "score")


@query("det_02_iban_made", "WITH x AS (SELECT c_custkey AS id, 'DE' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || '370400440532013000' AS v FROM customer) SELECT id, substring(v, 1, coalesce(n, 22)) AS value, CASE WHEN n IS NULL THEN 0.65::DOUBLE ELSE 0.96 END AS score FROM (SELECT id, v, list_max(list_filter(range(15, 23), lambda n: CAST(substring(v, 5, n - 4) || '1314' || substring(v, 3, 2) AS HUGEINT) % 97 = 1)) AS n FROM x)")
def det_02_made(spark, d):
    t = _dealt(spark, d).select(F.col("c_custkey").alias("id"), F.format_string("IBAN DE%02d370400440532013000.", F.col("c_custkey") % 100).alias("text"))
    return scan.scan(t, [r for r in rules.BASELINE if r.name == "iban"], "id", "text").select("id", "value", "score")


@query("det_03_person_made", "SELECT c_custkey AS id, 6 AS \"start\", 'Ann' || chr(97 + CAST(c_custkey % 26 AS INTEGER)) AS value FROM customer WHERE c_custkey % 2 = 0")
def det_03_made(spark, d):
    k = F.col("c_custkey")
    name = F.concat(F.when(k % 2 == 0, "Ann").otherwise("ann"), F.char(97 + k % 26))
    t = _dealt(spark, d).select(k.alias("id"), F.concat(F.lit("Name:\n"), name, F.lit("\nrest")).alias("text"))
    return scan.scan(t, [r for r in rules.BASELINE if r.name == "name_after_label"], "id", "text").select("id", "start", "value")


@query("det_04_address_made", "SELECT c_custkey AS id, 'Main ST ' || c_custkey || ' NO:5' AS value, 0.82::DOUBLE AS score FROM customer UNION ALL SELECT c_custkey, 'CAD 7 KAT ' || c_custkey, 0.78 FROM customer UNION ALL SELECT c_custkey, 'Address: Main ST ' || c_custkey || ' NO:5', 0.78 FROM customer")
def det_04_made(spark, d):
    k = F.col("c_custkey").cast("string")
    t = _dealt(spark, d).select(F.col("c_custkey").alias("id"), F.concat(F.lit("Address: Main ST "), k, F.lit(" NO:5\nnothing here\nCAD 7 KAT "), k).alias("text"))
    return scan.scan(t, [r for r in rules.BASELINE if r.name == "address"], "id", "text").select("id", "value", "score")


@query("udf_04_prompt_rules", "SELECT doc_id AS id, CAST(length(text) + 4 AS INTEGER) AS \"start\", 'SECRET_PROJECT' AS entity_type, 0.8::DOUBLE AS score FROM documents")
def udf_04(spark, d):
    """Custom rules by prompt need a factory that turns them into rules; without one they are left out."""
    ask = rules.Custom("ask", "SECRET_PROJECT", "llm_prompt")
    made = rules.from_custom([ask], lambda c: rules.Rule(c.name, "custom", c.entity_type, "zq project [0-9]+", 0.8))
    assert rules.from_custom([ask]) == []
    t = docs(spark, d).select("doc_id", F.concat("text", F.lit(" ## zq project "), F.col("doc_id").cast("string")).alias("text"))
    return scan.scan(t, made).select(F.col("doc_id").alias("id"), "start", "entity_type", "score")


# --- packs: each pack's own rules over documents with a made line, and one query for pure formats with SQL --

_FORMATS = {
    "pack_02_kvkk_format": ("kvkk_national_id", r"\b[1-9][0-9]{10}\b"), "pack_03_hipaa_format": ("hipaa_insurance", None), "pack_04_lgpd_format": ("lgpd_cnpj", None), "pack_05_ccpa_format": ("ccpa_license", None),
    "pack_06_cpra_format": ("cpra_license", None), "pack_07_uk_gdpr_format": ("uk_gdpr_nino", None), "pack_08_pipeda_format": ("pipeda_sin", None), "pack_09_pdpa_th_format": ("pdpa_th_national_id", None),
    "pack_10_pdpa_sg_format": ("pdpa_sg_nric", None), "pack_11_appi_format": ("appi_my_number", None), "pack_12_pipl_format": ("pipl_resident", None), "pack_13_popia_format": ("popia_national_id", None),
    "pack_14_dpdp_format": ("dpdp_aadhaar", None), "pack_15_pdpl_sa_format": ("pdpl_sa_national_id", None), "pack_16_nzpa_format": ("nzpa_ird", None), "pack_17_australia_format": ("australia_pa_medicare", None),
}
#: One line of every format, with numbers made from the customer key.
_LINE = "'A1234567 AB123456C MRN-' || n8 || ' CA' || n8 || ' ' || n8 || '1234 ' || n8 || '999 1-' || substring(n8, 1, 4) || '-56789-01-2 S1234567D ' || substring(n8, 1, 4) || '-5678-9012 ' || n8 || '12345678X 80' || substring(n8, 1, 4) || '-5009-087 2' || substring(n8, 1, 3) || ' 5678 9012 1' || n8 || '1 12.345.678/0001-' || substring(n8, 1, 2) || ' 123-456-7' || substring(n8, 1, 2) || ' 4123 45678 9'"
_CUSTOMERS = f"SELECT c_custkey AS id, {_LINE} AS text FROM (SELECT c_custkey, lpad(CAST((c_custkey * 104729) % 90000000 + 10000000 AS VARCHAR), 8, '0') AS n8 FROM customer)"


def _customers(spark, d):
    n8 = F.lpad(((F.col("c_custkey") * 104729) % 90000000 + 10000000).cast("string"), 8, "0")
    s = lambda a, n: F.substring(n8, a, n)
    text = F.concat(
        F.lit("A1234567 AB123456C MRN-"), n8, F.lit(" CA"), n8, F.lit(" "), n8, F.lit("1234 "), n8, F.lit("999 1-"), s(1, 4), F.lit("-56789-01-2 S1234567D "), s(1, 4), F.lit("-5678-9012 "), n8, F.lit("12345678X 80"), s(1, 4),
        F.lit("-5009-087 2"), s(1, 3), F.lit(" 5678 9012 1"), n8, F.lit("1 12.345.678/0001-"), s(1, 2), F.lit(" 123-456-7"), s(1, 2), F.lit(" 4123 45678 9"),
    )
    return _dealt(spark, d).select(F.col("c_custkey").alias("id"), text.alias("text"))


_BY_NAME = {r.name: r for p in rules.PACKS.values() for r in p}
for _name, (_rule, _) in _FORMATS.items():

    def _run_format(spark, d, _rule=_rule):
        return scan.scan(_customers(spark, d), [_BY_NAME[_rule]], "id", "text").select("id", "start", "end", "value")

    QUERIES[_name] = _run_format
    ORACLE_SQL[_name] = spans_sql(_CUSTOMERS, _BY_NAME[_rule].pattern)


_N8 = "lpad(CAST((c_custkey * 104729) % 90000000 + 10000000 AS VARCHAR), 8, '0')"


def _residents(spark, d):
    n8 = F.lpad(((F.col("c_custkey") * 104729) % 90000000 + 10000000).cast("string"), 8, "0")
    line = F.concat(F.lit("ID "), n8, n8, F.lit("1X, not "), n8, n8, F.lit("X or A"), n8, n8, F.lit("12"))
    t = _dealt(spark, d).select(F.col("c_custkey").alias("id"), line.alias("text"))
    return scan.scan(t, [_BY_NAME["pipl_resident"]], "id", "text").select("id", "start", "end", "value")


QUERIES["pack_12_pipl_format"] = _residents
ORACLE_SQL["pack_12_pipl_format"] = f"SELECT c_custkey AS id, 3 AS \"start\", 21 AS \"end\", {_N8} || {_N8} || '1X' AS value FROM customer"


@query("pack_01_gdpr_ipv4", spans_sql("SELECT event_id AS id, 'from ' || (event_id % 300) || '.' || (event_id % 256) || '.0.' || (event_id % 7) || ' end' AS text FROM events", rules.IPV4))
def pack_01(spark, d):
    k = F.col("event_id")
    t = table(spark, d, "events").select(k.alias("id"), F.format_string("from %d.%d.0.%d end", k % 300, k % 256, k % 7).alias("text"))
    return scan.scan(t, [_BY_NAME["gdpr_ipv4"]], "id", "text").select("id", "start", "end", "value")


@query("pack_01_gdpr_context_rules")
def pack_01_context(spark, d):
    """The context rules of the pack over made lines."""
    k = F.col("doc_id")
    line = F.format_string("Personalausweis Nr. T220001%02d; Steuer-ID 77 523 164 8%02d; RV-Nr 65 170839 J 0%02d; DNI 123456%02dZ; NIE X12345%02dL; Seguridad Social 28 12 345678 %02d; NIR 1 85 05 78 006 084 %02d; SIREN 834 291 0%02d", *[k % 90 + 10] * 8)
    t = docs(spark, d).select("doc_id", line.alias("text"))
    return scan.scan(t, [r for r in rules.PACKS["gdpr"] if r.group]).select("doc_id", "start", "end", "entity_type", "score", "value")


#: What stands before a value, the value, and what each rule of the pack is to make of it: type and score. Near misses give nothing.
_CASES = {
    "pack_01_gdpr": [
        ("", "a.b@host.example.org", [("EMAIL_ADDRESS", 0.8)]), ("", "10.20.30.40", [("IP_ADDRESS", 0.8)]), ("", "10.20.30.400", []), ("Personalausweis Nr. ", "T22000129", [("NATIONAL_ID", 0.75)]), ("Personal ", "T22000129", []),
        ("Steuer-ID ", "77 523 164 817", [("TAX_ID", 0.8)]), ("RV-Nr ", "65 170839 J 012", [("NATIONAL_ID", 0.8)]), ("DNI ", "12345678Z", [("NATIONAL_ID", 0.8)]), ("DNI ", "1234567Z", []), ("NIE ", "X1234567L", [("NATIONAL_ID", 0.8)]),
        ("NIE ", "A1234567L", []), ("Seguridad Social ", "28 12 345678 40", [("SOCIAL_SECURITY_NUMBER", 0.8)]), ("NIR ", "1 85 05 78 006 084 36", [("SOCIAL_SECURITY_NUMBER", 0.85)]), ("SIREN ", "834 291 012", [("TAX_ID", 0.75)]), ("SIRE ", "834 291 012", []),
    ],
    "pack_02_kvkk": [
        ("", "10000000146", [("NATIONAL_ID", 1.0)]), ("", "10000000147", [("NATIONAL_ID", 0.55)]), ("", "00000000146", []), ("TCKN ", "10000000146", [("NATIONAL_ID", 1.0), ("NATIONAL_ID", 1.0)]), ("Kimlik No ", "10000000146", [("NATIONAL_ID", 1.0)] * 3),
        ("passport ", "123456789", [("NATIONAL_ID", 0.5)]), ("passing ", "123456789", []), ("VKN ", "1234567890", [("TAX_ID", 0.6)]), ("VK ", "1234567890", []), ("Müşteri No: ", "AB-2024-00123", [("CUSTOMER_REFERENCE_ID", 0.75)]), ("Müşteri No: ", "AB-1", []), ("", "a@b.example.org", [("EMAIL_ADDRESS", 0.8)]),
    ],
    "pack_03_hipaa": [("", "MRN-12345678", [("MEDICAL_RECORD_NUMBER", 0.8)]), ("", "MRN-12345", []), ("", "AB123456", [("HEALTH_INSURANCE_ID", 0.75)]), ("", "AB12345", []), ("", "ABC123456", []), ("", "a@b.example.org", [("EMAIL_ADDRESS", 0.8)])],
    "pack_04_lgpd": [("", "11.222.333/0001-81", [("TAX_ID", 0.6)]), ("", "11.222.333/0001-8", []), ("RG ", "12.345.678-9", [("NATIONAL_ID", 0.8)]), ("RH ", "12.345.678-9", []), ("", "a@b.example.org", [("EMAIL_ADDRESS", 0.8)])],
    "pack_14_dpdp": [("", "2341 2341 2346", [("NATIONAL_ID", 1.0)]), ("", "2341 2341 2347", [("NATIONAL_ID", 0.55)]), ("", "1341 2341 2346", []), ("", "a@b.example.org", [("EMAIL_ADDRESS", 0.8)])],
    "pack_17_australia_pa": [("", "123 456 782", [("TAX_ID", 0.55)]), ("", "123 456 7", []), ("", "2123 45670 1", [("HEALTH_INSURANCE_ID", 0.6)]), ("", "2123 4567 1", []), ("", "a@b.example.org", [("EMAIL_ADDRESS", 0.8)])],
}

for _name, _cases in _CASES.items():

    def _run_cases(spark, d, _pack=_name[8:], _cases=_cases):
        said = F.element_at(F.array(*[F.lit(a + v) for a, v, _ in _cases]), (F.col("doc_id") % len(_cases) + 1).cast("int"))
        t = docs(spark, d).select("doc_id", F.concat("source", F.lit(" "), said, F.lit(" .")).alias("text"))
        return scan.scan(t, rules.PACKS[_pack]).select("doc_id", "start", "end", "entity_type", "score", "value")

    QUERIES[f"{_name}_every_rule"] = _run_cases
    _found = ", ".join(f"({i}, '{a}', '{v}', '{t}', {x}::DOUBLE)" for i, (a, v, hits) in enumerate(_cases) for t, x in hits)
    ORACLE_SQL[f"{_name}_every_rule"] = (
        f"SELECT doc_id, CAST(length(source) + 1 + length(a) AS INTEGER) AS \"start\", CAST(length(source) + 1 + length(a) + length(v) AS INTEGER) AS \"end\", t AS entity_type, x AS score, v AS value FROM documents JOIN (VALUES {_found}) c(i, a, v, t, x) ON c.i = doc_id % {len(_cases)}"
    )


CUSTOM = (
    rules.Custom("codes", "PROJECT_CODE", "regex", pattern=r"src[0-9]+"), rules.Custom("words", "TEAM_NAME", "keyword_list", keywords=("src3", "src7")), rules.Custom("broken", "X", "regex", pattern="([a"), rules.Custom("off", "Y", "regex", pattern="src", active=False),
)


@query("pack_18_custom_rules", spans_sql("SELECT doc_id AS id, source || ' and ' || source AS text FROM documents", "src[0-9]+").replace("SELECT id, \"start\", \"end\", value FROM m WHERE true", "SELECT id, \"start\", value, 'PROJECT_CODE' AS entity_type FROM m UNION ALL SELECT id, \"start\", value, 'TEAM_NAME' FROM m WHERE value IN ('src3', 'src7')"))
def pack_18(spark, d):
    t = docs(spark, d).select(F.col("doc_id").alias("id"), F.concat("source", F.lit(" and "), "source").alias("text"))
    return scan.scan(t, rules.from_custom(CUSTOM), "id", "text").select("id", "start", "value", "entity_type")


#: Every customer's name stands in a document, some in capitals, some with a sign that makes another word of it.
_NAMED = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'For ' || upper(c_name) || '.' WHEN 1 THEN c_name || '1 and ' || c_name || ', x' ELSE text || ' ' || c_name END AS text, c_name, c_custkey FROM documents JOIN customer ON c_custkey = doc_id + 1"


@query("pack_18_keyword_list", "WITH t AS (" + _NAMED + ") SELECT doc_id, CAST(CASE doc_id % 4 WHEN 0 THEN 4 WHEN 1 THEN length(c_name) + 6 ELSE length(text) - length(c_name) END AS INTEGER) AS \"start\", CASE doc_id % 4 WHEN 0 THEN upper(c_name) ELSE c_name END AS value FROM t WHERE c_custkey % 3 <> 0 AND text IS NOT NULL")
def pack_18_list(spark, d):
    """The names of two thirds of the customers as one list."""
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    named = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("For "), F.upper("c_name"), F.lit("."))).when(F.col("doc_id") % 4 == 1, F.concat("c_name", F.lit("1 and "), "c_name", F.lit(", x")))
    t = docs(spark, d).join(c, F.col("c_custkey") == F.col("doc_id") + 1).select("doc_id", named.otherwise(F.concat("text", F.lit(" "), "c_name")).alias("text"))
    found = keywords.keyword_spans(t, c.where("c_custkey % 3 <> 0").select(F.col("c_name").alias("keyword")))
    return found.select(F.col("id").alias("doc_id"), "start", "value")


#: Rules of all packs as rows, for the SQL.
_RULE_ROWS = "rule_rows(pack, t, p) AS (VALUES " + ", ".join(f"('{r.pack}', '{r.entity_type}', '{hashlib.md5(r.pattern.encode()).hexdigest()}')" for p in rules.PACKS.values() for r in p) + ")"
_PACK_NAMES = tuple(rules.PACKS)
_CHOICE = "choice AS (SELECT user_id, unnest([user_id % 17, (user_id * 5 + 3) % 17, (user_id // 17) % 17]) AS i FROM (SELECT DISTINCT user_id FROM events)), names(i, pack) AS (VALUES " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(_PACK_NAMES)) + ")"


def _choices(spark, d):
    """Three packs for every user, some of them twice."""
    u = F.col("user_id")
    every = F.array(*[F.lit(p) for p in _PACK_NAMES])
    users = table(spark, d, "events").select("user_id").distinct()
    return users.select("user_id", F.array_distinct(F.transform(F.array(u % 17, (u * 5 + 3) % 17, F.floor(u / 17) % 17), lambda i: F.element_at(every, (i + 1).cast("int")))).alias("packs"))


@query("pack_19_rule_dedup", f"WITH {_RULE_ROWS}, {_CHOICE} SELECT user_id, count(DISTINCT t || p) AS n, count(DISTINCT p) FILTER (t = 'EMAIL_ADDRESS') AS emails FROM choice JOIN names USING (i) JOIN rule_rows USING (pack) GROUP BY 1")
def pack_19(spark, d):
    """Rules that remain of the packs that each user has chosen; the choices are few, and each is composed once."""
    chosen = _choices(spark, d)
    composed = [(list(c), len(kept), sum(r.entity_type == "EMAIL_ADDRESS" for r in kept)) for (c,) in chosen.select("packs").distinct().toLocalIterator() for kept in [rules.distinct([r for p in c for r in rules.PACKS[p]])]]
    return chosen.join(spark.createDataFrame(composed, "packs array<string>, n long, emails long"), "packs").select("user_id", "n", "emails")


@query("pack_20_catalogue", "WITH t(i, pack, n) AS (VALUES (0, 'gdpr', 30::BIGINT), (1, 'kvkk', 33), (2, 'hipaa', 17), (3, 'lgpd', 19), (4, 'ccpa', 25), (5, 'cpra', 28), (6, 'uk_gdpr', 30), (7, 'pipeda', 24), (8, 'pdpa_th', 29), (9, 'pdpa_sg', 15), (10, 'appi', 20), (11, 'pipl', 20), (12, 'popia', 21), (13, 'dpdp', 17), (14, 'pdpl_sa', 20), (15, 'nzpa', 20), (16, 'australia_pa', 20)) SELECT n_nationkey, pack, n FROM nation JOIN t ON t.i = n_nationkey % 17")
def pack_20(spark, d):
    """The pack of each nation and how many types it names."""
    listed = spark.createDataFrame([(i, p, len(set(rules.PACK_TYPES[p]))) for i, p in enumerate(rules.catalogue(""))], "i int, pack string, n long")
    return table(spark, d, "nation").join(listed, F.col("i") == F.col("n_nationkey") % 17).select("n_nationkey", "pack", "n")


@query("pack_21_policy_types", "WITH t(pack, t) AS (VALUES " + ", ".join(f"('{p}', '{t}')" for p in ("gdpr", "kvkk", "hipaa", "lgpd", "dpdp") for t in rules.PACK_TYPES[p]) + ") SELECT n_nationkey, count(DISTINCT t) + 2 AS n, count(DISTINCT t) FILTER (t LIKE '%NUMBER') AS numbers FROM nation JOIN t ON t.pack = CASE n_regionkey WHEN 0 THEN 'gdpr' WHEN 1 THEN 'kvkk' WHEN 2 THEN 'lgpd' WHEN 3 THEN 'gdpr' ELSE 'hipaa' END OR (t.pack = 'dpdp' AND n_nationkey % 2 = 0) GROUP BY 1")
def pack_21(spark, d):
    """The types of each nation's policy: the pack of its region, another for every second nation, and rules of its own."""
    packs = ("gdpr", "kvkk", "lgpd", "gdpr", "hipaa")
    made = [(r, even, t) for r in range(5) for even in (0, 1) for t in rules.compose([packs[r], *(["dpdp"] if even == 0 else [])], CUSTOM).types]
    types = spark.createDataFrame(made, "r int, odd int, t string")
    n = table(spark, d, "nation").join(types, (F.col("r") == F.col("n_regionkey")) & (F.col("odd") == F.col("n_nationkey") % 2))
    return n.groupBy("n_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("t").endswith("NUMBER")).alias("numbers"))


@query("pack_22_try_rule", "SELECT doc_id, CAST(length(text) + 9 AS INTEGER) AS \"start\", CAST(length(text) + 15 AS INTEGER) AS \"end\", 'ZQ-' || (100 + doc_id % 900) AS value FROM documents")
def pack_22(spark, d):
    """A rule tried on every document, each with a ticket at its end."""
    sample = docs(spark, d).select("doc_id", F.concat("text", F.lit(" Ticket: ZQ-"), (F.col("doc_id") % 900 + 100).cast("string"), F.lit(", open")).alias("text"))
    return scan.scan(sample, rules.from_custom([rules.Custom("try", "TICKET", "regex", pattern=r"\bZQ-[0-9]{3}\b")])).select("doc_id", "start", "end", "value")


@query("det_23_type_aliases", "WITH t(i, entity_type) AS (VALUES (0, 'IBAN'), (0, 'IBAN_CODE'), (1, 'CITY'), (1, 'LOCATION'), (2, 'BANK_ACCOUNT_NUMBER'), (2, 'IBAN'), (3, 'CREDIT_CARD_NUMBER'), (3, 'CREDIT_CARD'), (4, 'URL')) SELECT user_id, t.entity_type, count(*) AS n FROM events JOIN t ON t.i = event_id % 5 GROUP BY ALL")
def det_23(spark, d):
    """What the types asked for by each user's events are found as."""
    asked = ("IBAN", "CITY", "BANK_ACCOUNT_NUMBER", "CREDIT_CARD_NUMBER", "URL")
    meant = spark.createDataFrame([(i, t) for i, a in enumerate(asked) for t in rules.expand_types([a])], "i int, entity_type string")
    return table(spark, d, "events").join(meant, F.col("i") == F.col("event_id") % 5).groupBy("user_id", "entity_type").agg(F.count("*").alias("n"))


@query("det_24_coverage", "SELECT c_custkey, CASE c_custkey % 7 WHEN 1 THEN 'LIBRARY_CARD' ELSE 'FAN_CLUB_NUMBER' END AS entity_type FROM customer WHERE c_custkey % 7 IN (1, 4)")
def det_24(spark, d):
    """Types wanted by customers that no rule, model or parent type covers."""
    found = spark.createDataFrame([(r.entity_type,) for r in rules.compose(rules.PACKS).rules] + [(t,) for t in (*rules.MODEL_TYPES, *rules.CONTEXTUAL, *rules.PARENTS)], "entity_type string").distinct()
    kinds = ("URL", "LIBRARY_CARD", "CITY", "DIAGNOSIS", "FAN_CLUB_NUMBER", "IBAN", "PERSON_NAME")
    wanted = table(spark, d, "customer").select("c_custkey", F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("c_custkey") % 7 + 1).cast("int")).alias("entity_type"))
    return wanted.join(found, "entity_type", "left_anti").select("c_custkey", "entity_type")


@query("det_27_numeric_gate", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) SELECT doc_id, count(*) FILTER (regexp_matches(l, '^[0-9 .,:/%-]+$')) >= 0.4 * count(*) FILTER (trim(l) <> '') AS numeric FROM l GROUP BY doc_id")
def det_27(spark, d):
    lines = F.split("text", "\n", -1)
    numeric = F.size(F.filter(lines, lambda x: x.rlike(r"^[0-9 .,:/%-]+\z")))
    return docs(spark, d).select("doc_id", (numeric >= 0.4 * F.size(F.filter(lines, lambda x: F.trim(x) != ""))).alias("numeric"))


@query("det_28_baseline_rules", """WITH t(i, t) AS (VALUES (0, 'PHONE_NUMBER'), (1, 'IBAN'), (2, 'PERSON_NAME'), (3, 'POSTAL_ADDRESS'), (4, 'CREDIT_CARD_NUMBER'), (5, 'DATE_OF_BIRTH'), (6, 'MAC_ADDRESS'), (7, 'URL'), (8, 'COORDINATES'), (9, 'COORDINATES'), (10, 'COOKIE_ID'), (11, 'COOKIE_ID'),
(12, 'DEVICE_ID'), (13, 'DEVICE_ID'), (14, 'DEVICE_ID'), (15, 'SOCIAL_SECURITY_NUMBER'), (16, 'CPF'), (17, 'PASSPORT_NUMBER'), (18, 'DRIVERS_LICENSE'), (19, 'TAX_ID'), (20, 'LICENSE_PLATE'))
SELECT t AS entity_type, count(*) AS n, count(DISTINCT i) AS n_rules FROM customer JOIN t ON t.i = c_custkey % 21 GROUP BY 1""")
def det_28(spark, d):
    """Customers dealt out over the built-in rules, by the type that each finds."""
    listed = spark.createDataFrame([(i, r.entity_type) for i, r in enumerate(rules.BASELINE)], "i int, entity_type string")
    c = table(spark, d, "customer").join(listed, F.col("i") == F.col("c_custkey") % len(rules.BASELINE))
    return c.groupBy("entity_type").agg(F.count("*").alias("n"), F.count_distinct("i").alias("n_rules"))


@query("det_18_title_case")
def det_18(spark, d):

    @F.pandas_udf("string")
    def titled(s: pd.Series) -> pd.Series:
        return s.map(scan.title_case_segments, na_action="ignore")

    return docs(spark, d).select("doc_id", titled("text").alias("text"))


_GATE = """WITH n AS (SELECT doc_id, lang, unnest(string_split(text, ' ')) AS w, (doc_id % 21) / 100.0 + 0.8 AS s,
  CASE doc_id % 3 WHEN 0 THEN 'PERSON_NAME' WHEN 1 THEN 'LOCATION' ELSE 'ORGANIZATION_NAME' END AS entity_type FROM documents)
SELECT doc_id, entity_type, CAST(round(s, 2) AS DOUBLE) AS score, count(*) AS n FROM n
WHERE length(w) >= CASE WHEN lang IN ('zh', 'ja', 'ko', 'th') THEN 2 ELSE 3 END AND round(s, 2) >= CASE WHEN entity_type = 'PERSON_NAME' THEN 0.80 ELSE 0.95 END
GROUP BY ALL"""


@query("det_20_ner_gate", _GATE)
def det_20(spark, d):
    k = F.col("doc_id")
    kind = F.when(k % 3 == 0, "PERSON_NAME").when(k % 3 == 1, "LOCATION").otherwise("ORGANIZATION_NAME").alias("entity_type")
    n = docs(spark, d).select("doc_id", "lang", F.explode(F.split("text", " ", -1)).alias("w"), kind, F.round((k % 21) / 100.0 + 0.8, 2).alias("score"))
    return gate(n).groupBy("doc_id", "entity_type", "score").agg(F.count("*").alias("n"))


def gate(found):
    """Model findings (w, lang, entity_type, score) that are sure enough; single words of places and organisations must be surer."""
    single = ~F.contains("w", F.lit(" "))
    least = F.when(F.col("entity_type") == "PERSON_NAME", 0.80).when(F.col("entity_type").isin("LOCATION", "ORGANIZATION_NAME") & single, 0.95).otherwise(0.85)
    short = F.when(F.col("lang").isin("zh", "ja", "ko", "th"), 2).otherwise(3)
    return found.where((F.length("w") >= short) & (F.col("score") >= least))


@query("det_22_result_filter", DET + " SELECT doc_id, entity_type, value FROM det WHERE NOT (entity_type = 'PHONE_NUMBER' AND regexp_matches(value, '[./]') AND length(regexp_replace(value, '[^0-9]', '', 'g')) <= 8)")
def det_22(spark, d):
    few = F.length(F.regexp_replace("value", "[^0-9]", "")) <= 8
    return det(spark, d).where(~((F.col("entity_type") == "PHONE_NUMBER") & F.col("value").rlike("[./]") & few)).select("doc_id", "entity_type", "value")


# --- span algebra ----------------------------------------------------------------------------------

#: Spans made from the detections: some become places, names of organisations and addresses, widened.
_TYPES = "CASE \"start\" % 4 WHEN 0 THEN 'LOCATION' WHEN 1 THEN 'ORGANIZATION_NAME' WHEN 2 THEN 'POSTAL_ADDRESS' ELSE entity_type END"
_SPANS = DET + f", sp AS (SELECT doc_id, \"start\", \"end\" + (\"start\" % 5) * 20 AS \"end\", {_TYPES} AS entity_type, 0.5 + (\"start\" % 10) / 20.0 AS score FROM det)"


def made_spans(spark, d):
    k = F.col("start") % 4
    kind = F.when(k == 0, "LOCATION").when(k == 1, "ORGANIZATION_NAME").when(k == 2, "POSTAL_ADDRESS").otherwise(F.col("entity_type"))
    return det(spark, d).select("doc_id", "start", (F.col("end") + (F.col("start") % 5) * 20).cast("int").alias("end"), kind.alias("entity_type"), (0.5 + (F.col("start") % 10) / 20.0).alias("score"))


def _by_doc(spans):
    return spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "entity_type", "score"))).alias("spans"))


_ABSORB = " OR ".join(f"(o.entity_type = '{o}' AND i.entity_type IN ({', '.join(repr(x) for x in inner)}))" for o, inner in rules.ABSORBS.items())


@query("jn_01_absorption", _SPANS + f" SELECT i.doc_id, i.\"start\", i.entity_type FROM sp i WHERE NOT EXISTS (SELECT 1 FROM sp o WHERE o.doc_id = i.doc_id AND i.\"start\" < o.\"end\" AND i.\"end\" > o.\"start\" AND ({_ABSORB}))")
def jn_01(spark, d):
    return _by_doc(made_spans(spark, d)).select("doc_id", F.explode(resolve.absorb_array(F.col("spans"))).alias("s")).select("doc_id", "s.start", "s.entity_type")


@query("jn_02_low_against_high", _SPANS + f" SELECT i.doc_id, i.\"start\", i.entity_type FROM sp i WHERE i.entity_type NOT IN ({', '.join(repr(t) for t in rules.PRIORITY)}) AND NOT EXISTS (SELECT 1 FROM sp o WHERE o.doc_id = i.doc_id AND i.\"start\" < o.\"end\" AND i.\"end\" > o.\"start\" AND o.entity_type IN ({', '.join(repr(t) for t in rules.PRIORITY)}))")
def jn_02(spark, d):
    high = list(rules.PRIORITY)
    spans = F.col("spans")
    kept = F.filter(spans, lambda s: ~s["entity_type"].isin(*high) & ~F.exists(spans, lambda o: o["entity_type"].isin(*high) & resolve.overlaps(s, o)))
    return _by_doc(made_spans(spark, d)).select("doc_id", F.explode(kept).alias("s")).select("doc_id", "s.start", "s.entity_type")


@query("jn_03_identity_join", _SPANS + " SELECT doc_id, \"start\", \"end\", entity_type FROM sp WHERE \"end\" - \"start\" > 20")
def jn_03(spark, d):
    s = made_spans(spark, d)
    keep = s.where("end - start > 20").select("doc_id", "start", "end", "entity_type", "score")
    return s.join(keep, ["doc_id", "start", "end", "entity_type", "score"], "left_semi").select("doc_id", "start", "end", "entity_type")


@query("win_03_greedy_dedup")
def win_03(spark, d):
    return _by_doc(made_spans(spark, d)).select("doc_id", F.explode(resolve.dedup_array(F.col("spans"))).alias("s")).select("doc_id", "s.*")


@query("win_05_name_expansion")
def win_05(spark, d):
    """Names of one word that stand before other capitalised words, expanded."""

    @F.pandas_udf("string")
    def expanded(text: pd.Series) -> pd.Series:
        def one(t: str) -> str:
            end = len(t.split(" ", 1)[0])
            (a, b, *_) = resolve.expand_names(t, [(0, end, "PERSON_NAME", 0.9)])[0]
            return t[a:b]

        return text.map(one, na_action="ignore")

    return docs(spark, d).select("doc_id", expanded(F.initcap("text")).alias("name"))


@query("det_19_word_snap")
def det_19(spark, d):
    """Spans widened to the letters and digits around them."""
    before = F.length(F.regexp_extract(F.expr("substring(text, 1, start)"), r"(?U)(\w*)\z", 1))
    after = F.length(F.regexp_extract(F.expr("substring(text, end + 1, 64)"), r"(?U)^(\w*)", 1))
    s = det(spark, d).join(docs(spark, d).select("doc_id", "text"), "doc_id")
    return s.select("doc_id", "entity_type", (F.col("start") - before).alias("start"), (F.col("end") + after).alias("end"))


@query("flt_01_non_pii_rules", DET + " SELECT doc_id, \"start\", value FROM det JOIN documents USING (doc_id) WHERE NOT (documents.lang = 'en' AND entity_type = 'IP_ADDRESS' AND regexp_matches(value, '^1')) AND NOT (entity_type = 'PHONE_NUMBER' AND 0.8 >= 0.75)".replace("FROM det JOIN documents USING (doc_id)", "FROM (SELECT doc_id, entity_type, \"start\", value FROM det) det JOIN documents USING (doc_id)"))
def flt_01(spark, d):
    found = det(spark, d).join(docs(spark, d).select("doc_id", "lang"), "doc_id").withColumn("score", scores.weight(F.col("entity_type")))
    return harmless_removed(found, [("regex", "^1", ("en",), ("IP_ADDRESS",), None), ("regex", r"\d", (), ("PHONE_NUMBER",), 0.75), ("regex", "([bad", (), (), None)]).select("doc_id", "start", "value")


def harmless_removed(found, rows):
    """Findings without those that a rule (kind, pattern, languages, types, least score) declares harmless; bad patterns are ignored."""
    import re

    drop = F.lit(False)
    for kind, pattern, langs, types, least in rows:
        try:
            re.compile(pattern)
        except re.error:
            continue
        test = F.lower("value") == pattern.lower() if kind == "token" else F.lower("value").rlike(pattern)
        test = test & (F.lower("lang").isin(*langs) if langs else F.lit(True)) & (F.col("entity_type").isin(*types) if types else F.lit(True))
        drop = drop | (test & (F.col("score") >= (least or 0.0)))
    return found.where(~drop)


# --- masking ---------------------------------------------------------------------------------------


@query("msk_01_span_replacement", "SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+', '[EMAIL_ADDRESS]', 'g'), '[0-9]{16}', '[CREDIT_CARD_NUMBER]', 'g')) AS h FROM documents")
def msk_01(spark, d):
    mail, card = (scan.find_all(F.col("text"), p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "[0-9]{16}"))
    named = lambda kind: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("placeholder"))
    spans = F.array_sort(F.concat(F.transform(mail, named("[EMAIL_ADDRESS]")), F.transform(card, named("[CREDIT_CARD_NUMBER]"))))
    return docs(spark, d).select("doc_id", "text", spans.alias("s")).select("doc_id", F.md5(resolve.replace_array(F.col("text"), F.col("s")).cast("binary")).alias("h"))


_ALL = rules.compose(rules.PACKS)


@query("msk_09_sanitise")
def msk_09(spark, d):
    done = mask.mask_documents(docs(spark, d), _ALL)
    return done.select("doc_id", "masked", "n_masked", F.array_join(F.transform("entities", lambda e: e["placeholder"]), ",").alias("placeholders"))


@query("msk_06_unmask_round_trip", "SELECT doc_id, md5(text) AS h FROM documents")
def msk_06(spark, d):
    done = mask.mask_documents(docs(spark, d), _ALL, changes=True)
    return done.select("doc_id", F.md5(mask.restore(F.col("masked"), F.col("changes")).cast("binary")).alias("h"))


@query("msk_07_toggle", "SELECT doc_id, doc_id % 2 = 0 AS restored FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z]{2,}')")
def msk_07(spark, d):
    done = mask.mask_documents(docs(spark, d).where(F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}")), _ALL, changes=True)
    shown = F.when(F.col("doc_id") % 2 == 0, mask.restore(F.col("masked"), F.col("changes"))).otherwise(F.col("masked"))
    return done.select("doc_id", (shown == F.col("text")).alias("restored"))


@query("msk_02_map_of_document")
def msk_02(spark, d):
    done = mask.mask_documents(docs(spark, d), _ALL)
    return done.select("doc_id", F.posexplode("map").alias("ord", "m")).select("doc_id", "ord", "m.original", "m.placeholder")


_PEOPLE = [(1, 0, "Ahmet Yilmaz met Ahmet and Sarah Connor."), (1, 1, "sarah called Connor's office."), (2, 0, "Jane Doe wrote to Jane.")]


@query("msk_03_coreference", "SELECT doc_id, unnest(['Ahmet Yilmaz', 'Ahmet', 'Sarah Connor', 'Connor']) AS original, unnest(['[PERSON_NAME_1]', '[PERSON_NAME_1]', '[PERSON_NAME_2]', '[PERSON_NAME_2]']) AS placeholder FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, unnest(['Jane Doe', 'Jane']), unnest(['[PERSON_NAME_1]', '[PERSON_NAME_1]']) FROM documents WHERE doc_id % 2 = 1")
def msk_03(spark, d):
    """Values as they are met, in order; each document's map is built in its own row."""
    met = F.when(F.col("doc_id") % 2 == 0, F.array(*[F.lit(v) for v in ("Ahmet Yilmaz", "Ahmet", "Sarah Connor", "Connor")])).otherwise(F.array(F.lit("Jane Doe"), F.lit("Jane")))

    @F.pandas_udf("array<string>")
    def assign(values: pd.Series) -> pd.Series:
        def one(row):
            known = mask.Placeholders("en")
            return [known.add(o, "PERSON_NAME") for o in row]

        return values.map(one)

    rows = docs(spark, d).select("doc_id", met.alias("o")).withColumn("p", assign("o"))
    return rows.select("doc_id", F.explode(F.arrays_zip("o", "p")).alias("x")).select("doc_id", F.col("x.o").alias("original"), F.col("x.p").alias("placeholder"))


@query("msk_04_token_blocklist", "WITH w AS (SELECT c_nationkey AS doc_id, c_custkey AS ord, unnest(string_split(lower(c_name), '#')) AS token FROM customer) SELECT doc_id, token, max(ord) AS last FROM w WHERE length(token) > 2 GROUP BY ALL")
def msk_04(spark, d):
    w = table(spark, d, "customer").select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("ord"), F.explode(F.split(F.lower("c_name"), "#", -1)).alias("token"))
    return w.where("length(token) > 2").groupBy("doc_id", "token").agg(F.max_by("ord", "ord").alias("last"))


@query("msk_05_apply_blocklist", "SELECT doc_id, '[PERSON_NAME_1] called [ALIAS_1] and the [PERSON_NAME_1] of ' || source || '.' AS masked FROM documents")
def msk_05(spark, d):

    @F.pandas_udf("string")
    def apply(s: pd.Series) -> pd.Series:
        known = mask.Placeholders("en")
        known.add("Sarah Connor", "PERSON_NAME")
        return s.map(known.mask_words)

    return docs(spark, d).select("doc_id", apply(F.concat(F.lit("SARAH called [ALIAS_1] and the Connor of "), "source", F.lit("."))).alias("masked"))


@query("msk_10_session_maps")
def msk_10(spark, d):
    """Conversations as sessions: turns are masked in order with one map for each."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("index"), "text")
    return mask.mask_chunks(c, _ALL)


@query("msk_11_tools", "SELECT c_custkey AS id, unnest(['mask_text', 'unmask_response', 'list_regulations']) AS tool, true AS ok, unnest(['[EMAIL_ADDRESS_1] wrote', 'user' || c_custkey || '@example.com wrote', '17']) AS data FROM customer")
def msk_11(spark, d):
    """A request of every customer to each of three tools."""
    from ..functions.tools import answer

    request = _dealt(spark, d).select(F.col("c_custkey").alias("id"), F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@example.com wrote")).alias("text"), F.lit("en").alias("lang"))
    done = mask.mask_documents(request, _ALL)
    data = {"mask_text": F.col("masked"), "unmask_response": mask.unmask(F.col("masked"), F.col("map")), "list_regulations": F.lit(str(len(rules.PACKS)))}
    out = done.select("id", F.explode(F.array(*[F.struct(F.lit(t).alias("tool"), answer(x)) for t, x in data.items()])).alias("a")).select("id", "a.tool", "a.r")
    return out.select("id", "tool", "r.ok", "r.data")


@query("fn_31_rename_placeholders", "SELECT doc_id, source || ' [P_2] met [P_1], [P_2' || doc_id || '] and [P_1]' AS text FROM documents")
def fn_31(spark, d):
    """Placeholders swapped in one pass, so that none is renamed twice."""
    names = F.array(*[F.struct(F.lit(b).alias("original"), F.lit(a).alias("placeholder")) for a, b in (("[P_1]", "[P_2]"), ("[P_2]", "[P_1]"))])
    text = F.concat(F.col("source"), F.lit(" [P_1] met [P_2], [P_2"), F.col("doc_id").cast("string"), F.lit("] and [P_2]"))
    return docs(spark, d).select("doc_id", mask.unmask(text, names).alias("text"))


@query("fn_32_longest_first")
def fn_32(spark, d):
    """Known values replaced, longest first, in chunks of the documents."""
    done = mask.mask_documents(docs(spark, d), _ALL).where("n_masked > 0").select("doc_id", "text", "map")
    return keywords.replace_known(done).select("doc_id", F.md5(F.col("replaced").cast("binary")).alias("h"))


@query("fn_32_known_values", "SELECT doc_id, md5(replace(replace(replace(source || ' ' || lang || ' ' || source || '-x ' || text, source || '-x', '[A_1]'), source, '[B_1]'), lang, '[C_1]')) AS h FROM documents")
def fn_32_known(spark, d):
    """Three known values in each document, one the beginning of another, one within many words."""
    known = lambda value, name: F.struct(value.alias("original"), F.lit(name).alias("placeholder"))
    values = F.array(known(F.col("lang"), "[C_1]"), known(F.col("source"), "[B_1]"), known(F.concat("source", F.lit("-x")), "[A_1]"))
    rows = docs(spark, d).select("doc_id", F.concat_ws(" ", "source", "lang", F.concat("source", F.lit("-x")), "text").alias("text"), values.alias("map"))
    return keywords.replace_known(rows).select("doc_id", F.md5(F.col("replaced").cast("binary")).alias("h"))


@query("fn_39_highlights")
def fn_39(spark, d):
    """Texts as plain and marked pieces."""
    done = mask.mask_documents(docs(spark, d), _ALL).where("n_masked > 0")
    e = F.col("entities")

    def pieces(s, i):
        start = F.when(i == 0, 0).otherwise(F.element_at(e, F.greatest(i, F.lit(1)))["end"])
        text = F.col("text")
        return F.array(F.struct(F.lit(False).alias("marked"), F.substring(text, start + 1, s["start"] - start).alias("piece")), F.struct(F.lit(True).alias("marked"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("piece")))

    return done.select("doc_id", F.posexplode(F.flatten(F.transform(e, pieces))).alias("i", "p")).select("doc_id", "i", "p.*")


@query("win_11_title_merge", "SELECT doc_id, CAST(unnest([0, 1]) AS INTEGER) AS i, unnest(['T' || doc_id, NULL]) AS title, unnest(['Title' || chr(10) || source || ' body', lang || ' tail']) AS text FROM documents")
def win_11(spark, d):
    from ..operators.chunk import merge_titles

    chunk = lambda title, text: F.struct(title.cast("string").alias("title"), text.alias("text"))
    none = F.lit(None)
    c = F.array(chunk(F.concat(F.lit("T"), F.col("doc_id").cast("string")), F.lit("Title")), chunk(none, F.concat("source", F.lit(" body"))), chunk(none, F.concat("lang", F.lit(" tail"))))
    return docs(spark, d).select("doc_id", F.posexplode(merge_titles(c)).alias("i", "m")).select("doc_id", "i", "m.title", "m.text")


@query("fn_25_structured_chunks")
def fn_25(spark, d):
    from ..operators.chunk import structured

    return structured(docs(spark, d).select("doc_id", "text"))


#: Sentences, each with its neighbours, as counts of letters; distances, their gradient, and parts between those above the percentile.
_BY_MEANING = """WITH s0 AS (SELECT doc_id, text, string_split_regex(regexp_replace(text, '([.?!])[ \\n\\t\\r]+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM documents WHERE trim(text) <> ''),
s1 AS (SELECT doc_id, text, len(s) AS m, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS x FROM s0),
a AS (SELECT doc_id, text, m, i, x, concat_ws(' ', lag(x) OVER w, x, lead(x) OVER w) AS y FROM s1 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
v AS (SELECT *, list_transform(range(97, 123), lambda c: CAST(strlen(lower(y)) - strlen(replace(lower(y), chr(CAST(c AS INTEGER)), '')) AS DOUBLE)) AS e FROM a),
d AS (SELECT doc_id, m, i, 1 - coalesce(list_inner_product(e, n) / nullif(sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(n, n)), 0), 0) AS d
  FROM (SELECT *, lead(e) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM v) WHERE n IS NOT NULL AND m > 2),
g AS (SELECT doc_id, i, CASE WHEN i = 1 THEN n - d WHEN i = m - 1 THEN d - p ELSE (n - p) / 2 END AS g
  FROM (SELECT *, lag(d) OVER (PARTITION BY doc_id ORDER BY i) AS p, lead(d) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM d)),
b AS (SELECT g.doc_id, g.i FROM g JOIN (SELECT doc_id, quantile_cont(g, 0.95) AS q FROM g GROUP BY 1) q USING (doc_id) WHERE g.g > q.q + 1e-12),
t AS (SELECT s1.doc_id, s1.text, s1.i, s1.x, coalesce(sum(CASE WHEN b.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY s1.doc_id ORDER BY s1.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN m = 2 THEN s1.i ELSE 0 END AS part
  FROM s1 LEFT JOIN b ON b.doc_id = s1.doc_id AND b.i = s1.i),
p AS (SELECT doc_id, text, part, string_agg(x, ' ' ORDER BY i) AS x FROM t GROUP BY 1, 2, 3),
k AS (SELECT doc_id, part, x FROM p WHERE length(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) >= 100)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS INTEGER) AS i, md5(x) AS h FROM (SELECT * FROM k UNION ALL SELECT DISTINCT doc_id, 0, text FROM p WHERE doc_id NOT IN (SELECT doc_id FROM k))
"""


@query("fn_26_split_by_meaning", _BY_MEANING)
def fn_26_meaning(spark, d):
    """Every text split where the letters of its sentences change most, counts of letters standing for a model."""
    from ..operators import semantic

    found = semantic.split_by_meaning(docs(spark, d), semantic.letter_counts)
    return found.select("doc_id", F.col("index").alias("i"), F.md5(F.col("text").cast("binary")).alias("h"))


@query("fn_26_packed_paragraphs")
def fn_26_packed(spark, d):
    """Paragraphs of every text packed, as without a model; lines count as paragraphs here."""
    from ..operators import semantic

    t = docs(spark, d).select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return semantic.split_by_meaning(t, None).select("doc_id", F.col("index").alias("i"), F.md5(F.col("text").cast("binary")).alias("h"))


@query("fn_26_paragraph_fallback", "WITH p AS (SELECT doc_id, text FROM documents WHERE length(text) <= 1200 AND NOT regexp_matches(text, '\\n\\s*\\n') AND trim(text) <> '') SELECT doc_id, 0 AS i, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS h FROM p")
def fn_26(spark, d):
    from ..operators.chunk import pack_paragraphs

    t = docs(spark, d).where((F.length("text") <= 1200) & ~F.col("text").rlike(r"\n\s*\n") & (F.trim("text") != ""))
    return t.select("doc_id", F.posexplode(pack_paragraphs(F.col("text"))).alias("i", "p")).select("doc_id", "i", F.md5(F.col("p").cast("binary")).alias("h"))


_ENSEMBLE = """WITH t AS (SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(n + 1 AS INTEGER) AS "start", CAST(n + 9 AS INTEGER) AS "end", 'PERSON_NAME' AS entity_type, 0.96::DOUBLE AS score FROM t
UNION ALL SELECT doc_id, CAST(n + 14 AS INTEGER), CAST(n + 21 AS INTEGER), 'LOCATION', 0.96 FROM t"""


@query("det_21_model_ensemble", _ENSEMBLE)
def det_21(spark, d):
    """Two passes of two pluggable models, united by place and type; here lists of capitalised words stand for the models, and
    each text ends in two of them."""
    from ..functions.ports import Gazetteer, run_models

    made = docs(spark, d).select("doc_id", F.concat("text", F.lit(" Zaqthion and Zaqonth.")).alias("text"), "lang")
    return run_models(made, [Gazetteer({"Zaqthion": "PERSON_NAME", "Zaqonth": "LOCATION"}), Gazetteer({"Zaqthion": "PERSON_NAME"})])


@query("det_25_semantic_validation", DET + ' SELECT doc_id, entity_type, "start", "end", value FROM det')
def det_25(spark, d):
    """A port that confirms findings; with the null port all stay."""
    from ..functions.ports import NullPort, validate

    return validate(det(spark, d), NullPort())


class _Alias:
    """Names one alias, and one that occurs twice, which is no alias."""

    enabled = True

    def aliases(self, text: str) -> list[str]:
        return ["Zaqthion the Elder", "Zaqonth"]


@query("det_26_semantic_port", "SELECT doc_id, CAST(length(text) + 3 AS INTEGER) AS \"start\", CAST(length(text) + 21 AS INTEGER) AS \"end\", 'ALIAS' AS entity_type, 0.85::DOUBLE AS score FROM documents WHERE length(text) > 50")
def det_26(spark, d):
    from ..functions.ports import detect_aliases

    line = F.concat("text", F.lit(" ; Zaqthion the Elder, of Zaqonth, and Zaqonth again ;"))
    return detect_aliases(docs(spark, d).where(F.length("text") > 50).select("doc_id", line.alias("text")), _Alias())


