import random

import pytest
from pyspark.sql import functions as F

from veilframe.functions import ids
from veilframe.operators import evaluate, mask, resolve, rules, scan


def found(text, packs=(), **kw):
    policy = rules.compose(packs, **kw)
    s = scan.Scanner(policy.rules)
    return [(k, text[a:b]) for a, b, k, *_ in s.find(text)]


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("Hesap: DE89 3704 0044 0532 0130 00 aktif.", "IBAN", "DE89 3704 0044 0532 0130 00"),
        ("TR94 0006 2000 1010 0007 1234 56 IBAN numarali", "IBAN", "TR94 0006 2000 1010 0007 1234 56"),
        ("Hesap: TR99 0006 2000 1010 0007 1234 56 BANK ", "IBAN", "TR99 0006 2000 1010 0007 1234 56"),
        ("call +49 151 2345678 now", "PHONE_NUMBER", "+49 151 2345678"),
        ("mac 00:1A:2b:3c:4d:5e.", "MAC_ADDRESS", "00:1A:2b:3c:4d:5e"),
        ("see https://example.com/a?b=1, then", "URL", "https://example.com/a?b=1"),
        ("born on 12 March 1980", "DATE_OF_BIRTH", "12 March 1980"),
        ("passport no P1234567", "PASSPORT_NUMBER", "P1234567"),
    ],
)
def test_baseline(text, kind, value):
    if kind == "PASSPORT_NUMBER":
        assert (kind, value) in found(text) or any(k == kind for k, _ in found(text))
    else:
        assert (kind, value) in found(text)


@pytest.mark.parametrize("text", ["Reference: 701040108923", "101048293", "7408125800082"])
def test_bare_digits_are_no_phone(text):
    assert all(k != "PHONE_NUMBER" for k, _ in found(text))


@pytest.mark.parametrize("text", ["Müşteri No (varsa): : ETP-2021-00489", "Üye Numarası: CRM-2024-1234", "CRM No: ABC-123-456", "Hesap No: HSP-9999-12345"])
def test_customer_references(text):
    assert any(k == "CUSTOMER_REFERENCE_ID" for k, _ in found(text, ["kvkk"]))


def test_checksums(spark):
    rows = [
        ("tckn", "10000000146", True), ("tckn", "10000000078", True), ("tckn", "10000000145", False), ("cpf", "529.982.247-25", True), ("cpf", "529.982.247-24", False), ("cpf", "111.111.111-11", False),
        ("iban", "TR330006100519786457841326", True), ("iban", "DE89370400440532013000", True), ("iban", "GB82 WEST 1234 5698 7654 32", True), ("iban", "FR1420041010050500013M02606", True), ("iban", "DE89 2004 1010 0540 1420 00", False),
        ("ssn", "000-12-3456", False), ("ssn", "078-05-1120", True), ("luhn", "4111 1111 1111 1111", True), ("luhn", "4111 1111 1111 1112", False), ("tckn", None, None), ("iban", "", False),
    ]
    df = spark.createDataFrame(rows, "kind string, v string, ok boolean")
    for kind, check in ids.CHECKS.items():
        for r in df.where(F.col("kind") == kind).select("v", "ok", check(F.col("v")).alias("got")).collect():
            assert r.got == r.ok, (kind, r)


def test_verhoeff_generator(spark):
    df = spark.createDataFrame([("23456789012",), ("98765432109",)], "v string")
    full = df.select(F.concat("v", ids.verhoeff_digit(F.col("v")).cast("string")).alias("v"))
    assert [r.ok for r in full.select(ids.aadhaar(F.col("v")).alias("ok")).collect()] == [True, True]
    assert [mask._passes("aadhaar", r.v) for r in full.collect()] == [True, True]


def test_absorption_and_choice():
    assert resolve.dedup(resolve.absorb([(0, 7, "LOCATION", 0.95), (0, 22, "ORGANIZATION_NAME", 0.9)])) == [(0, 22, "ORGANIZATION_NAME", 0.9)]
    assert [s[2] for s in resolve.absorb([(0, 8, "LOCATION", 0.95), (2, 25, "ORGANIZATION_NAME", 0.9)])] == ["ORGANIZATION_NAME"]
    assert len(resolve.absorb([(0, 7, "LOCATION", 0.95), (20, 42, "ORGANIZATION_NAME", 0.9)])) == 2
    assert [s[2] for s in resolve.dedup([(0, 10, "PHONE_NUMBER", 0.8), (0, 10, "NATIONAL_ID", 0.6)])] == ["NATIONAL_ID"]


def test_name_expansion():
    assert resolve.expand_names("John Smith works here.", [(0, 4, "PERSON_NAME", 0.9)]) == [(0, 10, "PERSON_NAME", 0.9)]
    text = "Ad Soyad:\nFatma Nur Öztürk\nAdres:"
    a = text.index("Fatma")
    assert resolve.expand_names(text, [(a, a + 16, "PERSON_NAME", 0.9)]) == [(a, a + 16, "PERSON_NAME", 0.9)]
    assert resolve.merge_names("Ann Lee", [(0, 3, "PERSON_NAME", 0.5), (4, 7, "PERSON_NAME", 0.7)]) == [(0, 7, "PERSON_NAME", 0.7)]


def test_arrays_agree_with_python(spark):
    rng = random.Random(5)
    kinds = [*rules.PRIORITY, "PERSON_NAME", "LOCATION", "ORGANIZATION_NAME", "POSTAL_ADDRESS", "STREET_ADDRESS"]
    docs = [(i, sorted({(a := rng.randrange(60), a + rng.randrange(1, 20), rng.choice(kinds), rng.choice((0.5, 0.8, 0.9))) for _ in range(rng.randrange(12))})) for i in range(300)]
    df = spark.createDataFrame(docs, "id int, s array<struct<start:int,end:int,entity_type:string,score:double>>")
    got = df.select("id", resolve.absorb_array(F.col("s")).alias("a"), resolve.dedup_array(F.col("s")).alias("d")).collect()
    for (_, spans), r in zip(docs, sorted(got, key=lambda r: r.id), strict=True):
        assert [tuple(x) for x in r.a] == resolve.absorb(spans)
        assert sorted(tuple(x) for x in r.d) == sorted(resolve.dedup(spans))


def test_coreference_and_blocklist():
    m = mask.Placeholders("tr")
    assert m.add("Ahmet Yılmaz", "PERSON_NAME") == m.add("Ahmet", "PERSON_NAME") == "[PERSON_NAME_1]"
    assert m.add("İstanbul", "CITY") == "[CITY_1]" and "istanbul" not in m.words
    assert m.mask_words("Daha sonra Ahmet geldi.") == "Daha sonra [PERSON_NAME_1] geldi."
    en = mask.Placeholders("en")
    assert en.add("Alexander", "PERSON_NAME") == en.add("Alexander", "FIRST_NAME")
    assert en.add("John  Doe", "PERSON_NAME") == en.add("john doe", "PERSON_NAME")


@pytest.mark.parametrize(("lang", "given", "want"), [("en", "Smith's", "Smith"), ("en", "workers'", "worker"), ("tr", "Ahmet'in", "Ahmet"), ("tr", "Ayşe'nin", "Ayşe"), ("en", "AB", "AB")])
def test_possessive(spark, lang, given, want):
    from veilframe.functions import text as T

    assert mask.without_possessive(given, lang) == want
    assert spark.createDataFrame([(given, lang)], "v string, l string").select(T.strip_possessive(F.col("v"), F.col("l")).alias("x")).first().x == want


def test_unmask_short_forms(spark):
    pairs = [("Ann", "[PERSON_NAME_1]"), ("Acme", "[ORGANIZATION_NAME_2]"), ("a@b.org", "[EMAIL_ADDRESS_1]")]
    df = spark.createDataFrame([("[PERSON_1] of [ORGANIZATION_2], [EMAIL_ADDRESS_1], [URL_9]", pairs)], "t string, m array<struct<original:string,placeholder:string>>")
    assert df.select(mask.unmask(F.col("t"), F.col("m")).alias("x")).first().x == "Ann of Acme, a@b.org, [URL_9]"


def test_round_trip_and_nulls(spark):
    rows = [(1, "Mail a.b@example.com or +49 151 2345678", "en"), (2, None, None), (3, "", "tr"), (None, "ip 10.0.0.1", "de")]
    done = mask.mask_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rules.compose(rules.PACKS))
    got = {r.doc_id: r for r in done.withColumn("back", mask.unmask(F.col("masked"), mask.last_of_each(F.col("map")))).collect()}
    assert got[1].masked == "Mail [EMAIL_ADDRESS_1] or [PHONE_NUMBER_1]" and got[1].back == rows[0][1]
    assert got[2].masked is None and got[3].masked == "" and got[None].masked == "ip [IP_ADDRESS_1]"
    assert mask.mask_documents(spark.createDataFrame([], "doc_id long, text string"), rules.compose(["gdpr"])).count() == 0


def test_non_pii_rules():
    rule = {"pattern_type": "token", "pattern": "Acme", "languages": ["en"], "entity_types": ["ORGANIZATION_NAME"], "min_score": 0.5}
    spans = [(0, 4, "ORGANIZATION_NAME", 0.9), (5, 8, "PERSON_NAME", 0.9)]
    assert mask.non_pii("Acme the", "en", spans, [rule]) == []
    assert mask.non_pii("Acme Bob", "de", spans, [rule]) == spans
    assert mask.non_pii("Acme Bob", "en", spans, [{"pattern_type": "regex", "pattern": "("}]) == spans


def test_shared_map_of_chunks(spark):
    chunks = spark.createDataFrame([(1, 0, "write a@b.org"), (1, 1, "a@b.org again, c@d.org"), (2, 0, "c@d.org")], "doc_id long, index int, text string")
    got = {(r.doc_id, r["index"]): r.masked for r in mask.mask_chunks(chunks, rules.compose(["gdpr"])).collect()}
    assert got == {(1, 0): "write [EMAIL_ADDRESS_1]", (1, 1): "[EMAIL_ADDRESS_1] again, [EMAIL_ADDRESS_2]", (2, 0): "[EMAIL_ADDRESS_1]"}


def test_policy():
    p = rules.compose(["hipaa"], [rules.Custom("x", "CODE", "regex", pattern="[")])
    assert "CODE" not in p.types and rules.uncovered(rules.compose(rules.PACKS)) == []
    with pytest.raises(ValueError):
        rules.catalogue("gdpr,nope")


def test_planted_recall(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("A text of its own.").alias("text"))
    values = evaluate.planted(docs)
    counts = evaluate.hits(values, mask.mask_documents(evaluate.documents(values, docs), rules.compose(rules.PACKS))).collect()
    assert len(counts) == 20 and [(r["entity_type"], r.fn) for r in counts if r.fn] == []


def test_planted_in_documents_of_large_numbers(spark):
    """Products of a document's number run beyond 64 bits; the values stay those of whole numbers."""
    ids = [149_244, 149_243, 102_400_003, 10**12 + 4, 10**15 + 18, 2**63 - 4, 4, 3]
    docs = spark.createDataFrame([(i,) for i in ids], "doc_id long").withColumn("text", F.lit("A text of its own."))
    got = {r.doc_id: (r.entity_type, r.original) for r in evaluate.planted(docs).collect()}
    for i in ids:
        kind, value = got[i]
        assert kind == evaluate.TYPES[i % 20] and value is not None
        if kind == "IBAN":
            assert value[4:] == str((i * 61_803_398_874_989 + 11) % 10**18).zfill(18) and int(value[4:] + "1314" + value[2:4]) % 97 == 1
        elif kind == "CREDIT_CARD_NUMBER":
            assert value[1:15] == str((i * 90_071_992_547 + 3) % 10**14).zfill(14)
    counts = evaluate.hits(evaluate.planted(docs), mask.mask_documents(evaluate.documents(evaluate.planted(docs), docs), rules.compose(rules.PACKS))).collect()
    assert sum(r.tp for r in counts) == len(ids) and sum(r.fn for r in counts) == 0


def test_restored_sign_by_sign(spark):
    """Spellings that share a placeholder, placeholders in the text itself, words of persons, and texts that were not composed."""
    texts = [
        "A.B@x.org, a.b@x.org and A.B@X.org", "[EMAIL_ADDRESS_1] is not a.b@x.org", "Name:\n Anna \nand anna, ANNA's café", "éé a.b@x.org é +49 151 2345678 é", "", "IBAN DE89370400440532013000 or de89 3704 0044 0532 0130 00", None,
        "가 a.b@x.orǵ", "card 4111 1111 1111 1111 or 4111-1111-1111-1111 \U0001f600 a@b.org",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = {r.doc_id: r.masked for r in mask.mask_documents(df, rules.compose(rules.PACKS)).collect()}
    done = mask.mask_documents(df, rules.compose(rules.PACKS), changes=True).withColumn("back", mask.restore(F.col("masked"), F.col("changes")))
    for r in done.collect():
        assert (r.back, r.masked) == (texts[r.doc_id], plain[r.doc_id])


def test_edits_one_after_another():
    import random
    import unicodedata

    rng = random.Random(3)

    def some(text):
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randrange(4))))
        return [(a, b, "".join(rng.choice("xyz") for _ in range(rng.randrange(3)))) for a, b in zip(cuts[::2], cuts[1::2], strict=False)]

    for _ in range(500):
        text = "".join(rng.choice("abé̈ 가") for _ in range(rng.randrange(12)))
        assert mask.rewritten(text, mask.composing_edits(text)) == unicodedata.normalize("NFC", text)
        first = some(text)
        now = mask.rewritten(text, first)
        second = some(now)
        edits = mask.followed(text, first, second)
        shown = mask.rewritten(now, second)
        assert mask.rewritten(text, edits) == shown
        back = [(c["start"], c["start"] + len(c["shown"]), c["original"]) for c in mask.changes_of(text, edits)]
        assert mask.rewritten(shown, back) == text


def test_rules_of_chunks_are_compiled_once():
    policy = tuple(rules.compose(["gdpr"]).rules)
    assert mask._scanner(policy) is mask._scanner(tuple(rules.compose(["gdpr"]).rules))


def test_layers_are_what_each_policy_finds_alone(spark, sf):
    """Each policy masked a table of its own, texts and all."""
    docs = evaluate.planted_documents(spark.read.parquet(f"{sf}/documents.parquet"))
    policies = {"packs": rules.compose(rules.PACKS, baseline=False), "all": rules.compose(rules.PACKS)}
    layers = mask.mask_layers(docs, policies)
    assert layers.columns == ["doc_id", "entity_type", "original", "lang", *policies]
    got = {r["doc_id"]: r for r in layers.collect()}
    for name, policy in policies.items():
        alone = mask.mask_documents(docs, policy).select("doc_id", "masked", "entities").collect()
        assert len(alone) == len(got) and all((r["masked"], r["entities"]) == (got[r["doc_id"]][name]["masked"], got[r["doc_id"]][name]["entities"]) for r in alone)
    values = evaluate.planted(spark.read.parquet(f"{sf}/documents.parquet"))
    apart = evaluate.hits(values, mask.mask_documents(docs, policies["packs"])).groupBy().sum("tp", "fn", "fp").collect()[0]
    assert tuple(evaluate.layer_hits(layers, ["packs"]).collect()[0])[1:] == tuple(apart)
    assert [r["layers"] for r in evaluate.layer_hits(layers.where("false"), ["packs", "all"]).collect()] == ["packs", "all"]
    nothing = spark.createDataFrame([(1, None, "en"), (2, "", None)], "doc_id long, text string, lang string")
    assert [(r["doc_id"], r["all"]["masked"], r["all"]["entities"]) for r in mask.mask_layers(nothing, policies).sort("doc_id").collect()] == [(1, None, []), (2, "", [])]
