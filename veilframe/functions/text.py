"""Text functions as column expressions; only Unicode normalisation needs Arrow."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow import each

#: Words that are never masked on their own.
STOP_WORDS = ("the", "a", "an", "of", "in", "at")
#: Suffixes of possession by language, then for all languages, in order of trial.
POSSESSIVE = {"tr": ("'ın", "'in", "'un", "'ün", "'nın", "'nin", "'nun", "'nün"), "az": ("'ın", "'in", "'un", "'ün")}
POSSESSIVE_ALL = ("'s", "s'")
#: Fixed value: what a token of the entity index is.
INDEX_WORD = "[a-z0-9çğıöşü]{3,}"
#: Punctuation that the entity index ignores, and words that never count in it.
INDEX_PUNCTUATION = r"""[\.,;:!?/\\\-\(\)\[\]\{\}"'`]+"""
INDEX_STOP_WORDS = tuple("and ile için the cad cd sok sk sokak mah mh mahalle blok kat daire no apt apartmani merkezi merkez tic ltd sti san anonim".split())


def nfc(value: Column) -> Column:
    """Composed Unicode form; texts of plain ASCII never cross to Python's normaliser, others a few at a time."""

    @F.arrow_udf("string")
    def composed(s: pa.Array) -> pa.Array:
        return each(s, lambda t: unicodedata.normalize("NFC", t), pa.string())

    # Spark runs the function on all rows, whatever the condition: a null is what it gets for a text that needs nothing
    plain = value.rlike(r"^\p{ASCII}*$")
    return F.when(plain, value).otherwise(composed(F.when(~plain, value)))


def strip_controls(value: Column) -> Column:
    """Without control, format and unassigned characters, but for tab, line feed and carriage return."""
    return F.regexp_replace(value, r"[\p{C}&&[^\t\r\n]]", "")


def locale_lower(value: Column, lang: Column) -> Column:
    return F.lower(F.when(lang.isin("tr", "az"), F.translate(value, "İI", "ii")).otherwise(value))


def collapse(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def comparison_key(value: Column, lang: Column) -> Column:
    return collapse(locale_lower(nfc(value), lang))


def strip_possessive(value: Column, lang: Column) -> Column:
    """Without the first suffix that fits; texts under three characters stay."""
    out = value
    for suffix in reversed(POSSESSIVE_ALL):
        out = F.when(value.endswith(suffix), F.substring(value, F.lit(1), F.length(value) - len(suffix))).otherwise(out)
    for code, suffixes in POSSESSIVE.items():
        for suffix in reversed(suffixes):
            out = F.when((lang == code) & value.endswith(suffix), F.substring(value, F.lit(1), F.length(value) - len(suffix))).otherwise(out)
    return F.when(F.length(value) < 3, value).otherwise(out)


def starts_upper(value: Column) -> Column:
    """The first character is a capital, or a letter without case."""
    c = F.substring(value, 1, 1)
    return c.rlike(r"^\p{L}") & (c == F.upper(c))


def index_value(value: Column) -> Column:
    """Lower case, punctuation as blanks, blanks collapsed."""
    return collapse(F.regexp_replace(F.lower(F.trim(value)), INDEX_PUNCTUATION, " "))


def index_tokens(value: Column, stop_words=INDEX_STOP_WORDS) -> Column:
    """Tokens of three and more characters, first occurrence first."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(value), F.lit(f"({INDEX_WORD})"), F.lit(1)))
    return F.array_except(found, F.array(*[F.lit(w) for w in stop_words]))


def split_words(value: Column) -> Column:
    """Lower-cased words between blanks; no word for an empty text."""
    return F.filter(F.split(F.lower(value), r"\s+"), lambda w: w != "")


def normalise_by_rules(value: Column, rules: list[tuple[int, int, str, str]]) -> Column:
    """Replacement rules (priority, id, pattern, replacement), applied by priority, then id. Replacements
    name groups as \\1; a pattern that Java cannot compile is left out."""
    import re

    for _, _, pattern, replacement in sorted(rules):
        try:
            re.compile(pattern)
        except re.error:
            continue
        value = F.regexp_replace(value, pattern, re.sub(r"\\(\d)", r"$\1", replacement.replace("$", r"\$")))
    return value


def path_template(path: Column) -> Column:
    """Numbers between slashes as {id}."""
    return F.regexp_replace(path, r"/[0-9]+(?=/|$)", "/{id}")


def slices(value: Column, size: int = 256) -> Column:
    """The text in pieces of ``size`` characters; an empty text has none."""
    n = F.ceil(F.length(value) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substring(value, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def placeholder_parts(token: Column) -> Column:
    """[TYPE_n] as a struct of type and number; null parts for anything else."""
    shape = r"^\[([A-Z][A-Z_]*)_([0-9]+)\]$"
    kind = F.regexp_extract(token, shape, 1)
    return F.struct(F.nullif(kind, F.lit("")).alias("entity_type"), F.nullif(F.regexp_extract(token, shape, 2), F.lit("")).cast("int").alias("number"))


def is_heading(line: Column) -> Column:
    """5 to 150 characters, ended by a colon or with more than 70 % of its letters capital."""
    upper, letters = F.length(F.regexp_replace(line, r"\P{Lu}", "")), F.length(F.regexp_replace(line, r"\P{L}", ""))
    return F.length(line).between(5, 150) & (line.endswith(":") | ((letters > 0) & (upper > 0.7 * letters)))


def hmac_sha256(value: Column, key: bytes) -> Column:
    """Hex HMAC-SHA256 of a text under a key, in JVM expressions."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    blob = lambda b: F.unhex(F.lit(b.hex()))
    return F.sha2(F.concat(blob(outer), F.unhex(F.sha2(F.concat(blob(inner), F.encode(value, "UTF-8")), 256))), 256)


def encrypt(value: Column, key: Column, aad: Column) -> Column:
    """AES-GCM: nonce, ciphertext and tag in one binary; bound to ``aad``."""
    return F.aes_encrypt(value.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), aad)


def decrypt(value: Column, key: Column, aad: Column) -> Column:
    """The text, or null under a wrong key or aad."""
    return F.try_aes_decrypt(value, key, F.lit("GCM"), F.lit("DEFAULT"), aad).cast("string")
