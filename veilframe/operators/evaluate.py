"""Detection quality: values planted in documents, and precision and recall against them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids

#: What is planted by turns, one value in each document, and the words around it; {} takes the value.
FRAMES = {
    "EMAIL_ADDRESS": "Please contact us at {} for details.", "PHONE_NUMBER": "Send the form to {} before Friday.", "IP_ADDRESS": "Our files show {} since last spring.", "CREDIT_CARD_NUMBER": "The record lists {} as the main entry.",
    "IBAN": "Reference {} was confirmed by the clerk.", "NATIONAL_ID": "The record lists {} as the main entry.", "MEDICAL_RECORD_NUMBER": "Reference {} was confirmed by the clerk.", "MAC_ADDRESS": "Our files show {} since last spring.",
    "URL": "see {} for more.", "COORDINATES": "It lies at {} in the hills.", "COOKIE_ID": "Sent with {} today.", "DEVICE_ID": "IMEI: {} of the phone.", "SOCIAL_SECURITY_NUMBER": "SSN {} on file.", "CPF": "cpf {} on file.",
    "PASSPORT_NUMBER": "passport {} on file.", "DRIVERS_LICENSE": "driver's license {} on file.", "TAX_ID": "tax id {} on file.", "LICENSE_PLATE": "plate no {} on file.", "DATE_OF_BIRTH": "born on {} in town.", "POSTAL_ADDRESS": "Address : {}",
}
TYPES = tuple(FRAMES)
#: What stands between a document's own text and what is planted.
MARK = "\n\u2016 "


def _number(factor: int, plus: int, digits: int) -> Column:
    """Digits that follow from the document's number, whatever its size: the number is reduced first, and what the product may
    need beyond 64 bits is decimal."""
    i = F.pmod(F.col("id"), F.lit(10**digits))
    i = i.cast("decimal(19,0)") if factor * 10**digits + plus >= 2**63 else i.cast("long")
    return F.lpad(F.pmod(i * F.lit(factor) + F.lit(plus), F.lit(10**digits)).cast("string"), digits, "0")


#: Lines that name nobody; # stands for a small number.
CLEAN = (
    "The committee met at 10:30 in room #, and adjourned before noon.", "Chapter #: the harvest was better than in the years before.", "Add # grams of flour, stir for # minutes: the dough should be soft.",
    "Version 2.#.1 fixes 14 faults; see section 3.#.", "The train leaves from platform # at 18:05.", "Revenue rose by #.5 % while costs fell by 2.1 %.", "Score at half time: # to 2.", "Figure #: share of renewable energy by year, 1990 to 2020.",
    "Im Jahr 1848 wurden # neue Schulen eröffnet.", "La température moyenne était de #,4 degrés.", "El puente mide # metros de largo y 12 de ancho.", "Note: # of the 40 samples were discarded.", "Ratio 3:#, tolerance +/- 0.2 mm, see table #.",
    "Toplantı saat 14:00'te # numaralı salonda yapıldı.", "In 2019/20 the team won # games and lost 7.",
)


def _check_digit(digits: Column, n: int) -> Column:
    """The digit that modulo 11 adds to n digits, weights falling to 2."""
    total = sum((F.substring(digits, i + 1, 1).cast("int") * (n + 1 - i) for i in range(n)), F.lit(0))
    return F.concat(digits, F.pmod(F.pmod(total * 10, F.lit(11)), F.lit(10)).cast("string"))


def planted(docs: DataFrame, id_col: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, entity_type, original) and the columns to keep: a value for each document, of its types by turns, made from its number; numbers pass
    their checks."""
    rows = docs.select(F.col(id_col).alias("id"), *keep).withColumn("entity_type", F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.pmod("id", F.lit(len(TYPES))) + 1).cast("int")))
    card = F.concat(F.lit("4"), _number(90_071_992_547, 3, 14))
    tckn9 = F.concat(F.lit("1"), _number(48_271_331, 5, 8))
    digit = lambda i: F.substring(tckn9, i, 1).cast("int")
    d10 = F.pmod((digit(1) + digit(3) + digit(5) + digit(7) + digit(9)) * 7 - (digit(2) + digit(4) + digit(6) + digit(8)), F.lit(10))
    d11 = (sum((digit(i) for i in range(2, 10)), digit(1)) + d10) % 10
    account = _number(61_803_398_874_989, 11, 18)
    check = F.lpad((98 - ids.iban_remainder(F.concat(F.lit("DE00"), account))).cast("string"), 2, "0")
    byte = lambda i: F.pmod(F.pmod("id", F.lit(256)) * (7919 + 2 * i) + 31 * i, F.lit(256))
    two = (F.pmod("id", F.lit(90)) + 10).cast("string")
    value = {
        "EMAIL_ADDRESS": F.concat(F.lit("user"), _number(7919, 1, 6), F.lit("@host"), _number(7927, 2, 3), F.lit(".example.com")),
        "PHONE_NUMBER": F.concat(F.lit("+1 ("), _number(7879, 4, 3), F.lit(") "), _number(7883, 6, 3), F.lit("-"), _number(7901, 8, 4)),
        "IP_ADDRESS": F.concat_ws(".", *[byte(i).cast("string") for i in range(4)]),
        "CREDIT_CARD_NUMBER": F.concat(card, ids.luhn_digit(card).cast("string")),
        "IBAN": F.concat(F.lit("DE"), check, account),
        "NATIONAL_ID": F.concat(tckn9, d10.cast("string"), d11.cast("string")),
        "MEDICAL_RECORD_NUMBER": F.concat(F.lit("MRN-"), _number(7933, 7, 8)),
        "MAC_ADDRESS": F.concat_ws(":", *[F.lpad(F.lower(F.hex(byte(i))), 2, "0") for i in range(6)]),
        "URL": F.concat(F.lit("https://shop.example.com/item/"), _number(7937, 9, 6)),
        "COORDINATES": F.concat(F.lit("41."), _number(7949, 1, 4), F.lit(", 2."), _number(7951, 2, 4)),
        "COOKIE_ID": F.concat(F.lit("_ga=GA1.2.3."), F.col("id").cast("string")),
        "DEVICE_ID": F.concat(F.lit("3569380356438"), two),
        "SOCIAL_SECURITY_NUMBER": F.concat(F.lit("078-05-"), (F.pmod("id", F.lit(9000)) + 1000).cast("string")),
        "CPF": _check_digit(_check_digit(_number(5_550_003, 123_456_789, 9), 9), 10),
        "PASSPORT_NUMBER": F.concat(F.lit("P"), _number(7963, 3, 7)),
        "DRIVERS_LICENSE": F.concat(F.lit("D"), _number(7993, 4, 7)),
        "TAX_ID": F.concat(F.lit("12-"), _number(8009, 5, 7)),
        "LICENSE_PLATE": F.concat(F.lit("34 ABC "), two),
        "DATE_OF_BIRTH": F.concat(F.lit("12.03.19"), two),
        "POSTAL_ADDRESS": F.concat(F.lit("Main ST 12 NO:"), two, F.lit(" Floor")),
    }
    original = F.lit(None).cast("string")
    for kind, v in value.items():
        original = F.when(F.col("entity_type") == kind, v).otherwise(original)
    return rows.select(F.col("id").alias("doc_id"), "entity_type", original.alias("original"), *keep)


def documents(values: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, lang): the documents, each with its planted value in a sentence at the end."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_own"))
    return own.join(values, "doc_id").select("doc_id", _with_line("_own"), F.lit("en").alias("lang"))


def _with_line(own: str) -> Column:
    frames = F.create_map(*[F.lit(x) for kv in FRAMES.items() for x in kv])
    line = F.replace(F.element_at(frames, F.col("entity_type")), F.lit("{}"), F.col("original"))
    return F.concat(own, F.lit(MARK), line).alias("text")


def planted_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, entity_type, original, text, lang): each document with the value of its own, without a join. Those without a number are left out."""
    own = docs.where(F.col(id_col).isNotNull()).select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_own"))
    return planted(own, id_col, ["_own"]).select("doc_id", "entity_type", "original", _with_line("_own"), F.lit("en").alias("lang"))


def layer_hits(masked: DataFrame, layers: Sequence[str]) -> DataFrame:
    """(layers, tp, fn, fp) over all documents, from ``mask.mask_layers`` of planted documents: as ``hits``, counted where texts were masked."""
    rows = masked.select(*[F.struct((~F.contains(F.col(n)["masked"], F.col("original"))).alias("hit"), F.size(F.filter(F.col(n)["entities"], lambda e: e["entity_type"] == F.col("entity_type"))).alias("n")).alias(n) for n in layers])

    def counts(n: str) -> Column:
        hit = F.col(n)["hit"]
        surplus = F.when(hit, F.greatest(F.col(n)["n"] - 1, F.lit(0))).otherwise(0)
        return F.struct(F.lit(n).alias("layers"), F.sum(hit.cast("long")).alias("tp"), F.sum((~hit).cast("long")).alias("fn"), F.sum(surplus).alias("fp"))

    return rows.agg(F.array(*[counts(n) for n in layers]).alias("l")).select(F.inline("l"))


def hits(values: DataFrame, masked: DataFrame) -> DataFrame:
    """(entity_type, tp, fn, fp): a planted value is found if it is gone from the masked text; what else was masked counts as
    false only for types already found in that document."""
    j = values.join(masked.select("doc_id", "masked", "entities"), "doc_id")
    j = j.withColumn("hit", ~F.contains("masked", F.col("original")))
    by_doc = j.groupBy("doc_id", "entity_type").agg(F.count_if("hit").alias("tp"), F.count_if(~F.col("hit")).alias("fn"))
    found = masked.select("doc_id", F.explode("entities").alias("e")).groupBy("doc_id", F.col("e.entity_type").alias("entity_type")).agg(F.count("*").alias("n"))
    both = by_doc.join(found, ["doc_id", "entity_type"], "left")
    surplus = F.when(F.col("tp") > 0, F.greatest(F.coalesce("n", F.lit(0)) - F.col("tp"), F.lit(0))).otherwise(0)
    return both.groupBy("entity_type").agg(F.sum("tp").alias("tp"), F.sum("fn").alias("fn"), F.sum(surplus).alias("fp"))


def strict_hits(values: DataFrame, spans: DataFrame) -> DataFrame:
    """(entity_type, tp, fn, fp) by exact value and type in the document; every other span is false."""
    a = values.select("doc_id", "entity_type", F.col("original").alias("value")).distinct().withColumn("gold", F.lit(1))
    b = spans.select("doc_id", "entity_type", "value").distinct().withColumn("found", F.lit(1))
    j = a.join(b, ["doc_id", "entity_type", "value"], "full")
    return j.groupBy("entity_type").agg(F.count_if(F.col("gold").isNotNull() & F.col("found").isNotNull()).alias("tp"), F.count_if(F.col("found").isNull()).alias("fn"), F.count_if(F.col("gold").isNull()).alias("fp"))


def rates(counts: DataFrame) -> DataFrame:
    """precision, recall and f1 beside the counts; 0 where undefined."""
    p = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), F.lit(0.0))
    return counts.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6)})
