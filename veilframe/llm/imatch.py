"""I-Match fingerprints with randomised lexicons.

A document's terms are its distinct lower-cased words (runs of signs that are neither blanks nor punctuation), as 64-bit
hashes in sorted order. Document frequencies are counted for every term over all documents. The lexicon keeps terms within a band of
inverse document frequency, that is, those found in ``least_share`` to ``most_share`` of all documents. A band of shares is the same
however large the corpus, and holds at most (mean number of terms of a document) / ``least_share`` terms, so it can be
looked up in a literal. A fingerprint holds one hash for each
of several random subsets of the lexicon: the hash of the sorted terms that the document has in it.
Subsets come in grades, each a quarter as dense as the one before, so that short and very long
documents alike have subsets in which they keep about one term. A subset without a term gives "-".

Likeness is the share of equal hashes among the subsets in which either text has a term; sparse
grades count more, since one changed term spoils every dense subset.

Nulls count as empty; a text without words is its own only term; a text with no term in the
lexicon uses all of its terms. Equal texts have equal fingerprints and likeness 1. Ids are whole numbers (others raise
an error); null ids come last, repeated ones by the text's hash. An empty table gives no rows; columns other than id and text are not read.
All of it is DataFrame expressions.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..operators.lineage import cut

#: Lists of the literal that holds the lexicon; a term is looked up in one of them.
BUCKETS = 1 << 14
SUBSETS = 32
#: Of a grade's 1 / density of subsets; SUBSETS of them are used.
GRADES = (32, 128, 512, 2048)
_SPLIT = 8


def term_hashes(text: Column) -> Column:
    """Sorted distinct hashes of the terms of a text that is not null."""
    words = F.split(F.lower(text), r"[^0-9a-z\u00c0-\u1fff\u2c00-\u2dff\u3040-\x{10ffff}]+", -1)
    hashes = F.array_remove(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))
    return F.sort_array(F.when(F.size(hashes) > 0, hashes).otherwise(F.array(F.xxhash64(text))))


def lexicon(docs: DataFrame, text_col: str = "text", least_share: float = 0.001, most_share: float = 0.1) -> list[int]:
    """The terms in the band, at least in two documents. What reaches the driver is bounded by the mean number of terms of a document / ``least_share``."""
    n = docs.count()
    seen = docs.select(F.explode(term_hashes(F.coalesce(F.col(text_col), F.lit("")))).alias("h")).groupBy("h").count()
    least = max(2.0, least_share * n)
    return sorted(r.h for r in seen.where((F.col("count") >= least) & (F.col("count") <= max(least, most_share * n))).select("h").collect())


def in_lists(terms: list[int]) -> Column:
    """A literal of BUCKETS lists, each term in the list of its lowest bits."""
    lists: list[list[int]] = [[] for _ in range(BUCKETS)]
    for h in terms:
        lists[h % BUCKETS].append(h)
    return F.from_json(F.lit(json.dumps(lists)), "array<array<bigint>>")


def fingerprint(text: Column, lists: Column) -> Column:
    """An array of hashes, null where the subset has no term of the text. text: not null; lists: of ``in_lists``."""

    def of(terms: Column) -> Column:
        kept = F.filter(terms, lambda h: F.array_contains(F.element_at(lists, h.bitwiseAND(BUCKETS - 1).cast("int") + 1), h))
        return F.element_at(F.transform(F.array(kept), lambda k: _subsets(F.when(F.size(k) > 0, k).otherwise(terms))), 1)

    return F.element_at(F.transform(F.array(term_hashes(text)), of), 1)


def _subsets(terms: Column) -> Column:
    # the upper bits choose the subset, the lower ones the list
    return _grades(F.transform(terms, lambda h: F.shiftrightunsigned(h, 20)), 0)


def _grades(keys: Column, at: int) -> Column:
    """Hashes of the subsets of this grade and all sparser ones; a grade's terms lie within those of the denser one."""
    m = GRADES[at]

    def falls_in(i: int, modulus: int):
        return lambda h: h.bitwiseAND(modulus - 1) == i

    def share(terms: Column, rest: int) -> Column:
        """The subsets whose number leaves ``rest``: split twice, so that a term is looked at less often."""
        subsets = lambda part: F.array(*[F.filter(part, falls_in(i, m)) for i in range(rest, SUBSETS, _SPLIT)])
        return F.element_at(F.transform(F.array(F.filter(terms, falls_in(rest, _SPLIT))), subsets), 1)

    def of(terms: Column) -> Column:
        hashes = F.transform(F.flatten(F.array(*[share(terms, r) for r in range(_SPLIT)])), lambda s: F.when(F.size(s) > 0, F.hash(s)))
        return F.concat(hashes, _grades(terms, at + 1)) if at + 1 < len(GRADES) else hashes

    inside = F.filter(keys, lambda h: h.bitwiseAND(m - 1) < SUBSETS) if m > SUBSETS else keys
    return F.element_at(F.transform(F.array(inside), of), 1)


def shown(fingerprint_: Column) -> Column:
    return F.array_join(F.transform(fingerprint_, lambda h: F.coalesce(F.lower(F.hex(h.cast("long").bitwiseAND(0xFFFFFFFF))), F.lit("-"))), ":")


def likeness(a: Column, b: Column) -> Column:
    total, hits = F.lit(0.0), F.lit(0.0)
    for g in range(len(GRADES)):
        x, y = F.slice(a, g * SUBSETS + 1, SUBSETS), F.slice(b, g * SUBSETS + 1, SUBSETS)
        agree = F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda same: same))
        either = F.size(F.filter(F.zip_with(x, y, lambda p, q: F.coalesce(p, q)), lambda v: v.isNotNull()))
        weight = (SUBSETS + 1 - either) / float(SUBSETS)
        total, hits = total + weight * either, hits + weight * agree
    return F.when(a == b, 1.0).when(total > 0, hits / total).otherwise(0.0)


def with_next(docs: DataFrame, blocks: int, made: dict[str, Column] | None = None, id_col: str = "doc_id") -> DataFrame:
    """docs (id, text not null): adds the columns ``made``, and next, a struct of the row that follows in descending order of id
    (nulls last, equal ids by the text's hash); the first follows the last. Rows are dealt into ``blocks`` ranges of
    nearly equal size by quantiles of the id; each range is given the first row of the range after it."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise ValueError(f"{id_col} must be a whole number")
    marks = docs.agg(F.percentile_approx(id_col, [i / blocks for i in range(1, blocks)] or [0.5], 20 * blocks)).first()[0]
    marks = sorted(set(marks or []))
    step = 64
    bounds = F.from_json(F.lit(json.dumps(marks)), "array<bigint>")
    coarse = F.from_json(F.lit(json.dumps(marks[step - 1 :: step])), "array<bigint>")
    wholes = F.size(F.filter(coarse, lambda m: m <= F.col(id_col)))
    fine = F.size(F.filter(F.slice(bounds, wholes * step + 1, step), lambda m: m <= F.col(id_col)))
    h = F.xxhash64("text")
    # rows without an id form ranges of their own, after all others, by hash
    block = F.when(F.col(id_col).isNull(), F.shiftright(h, 58).cast("int") - 1000).otherwise(wholes * step + fine)
    keyed = docs.select(F.col(id_col).alias("id"), "text", h.alias("h"), block.alias("block"))
    # one row for each range: its first id, then its first text
    place = F.struct(F.coalesce("id", F.lit(-(1 << 63))).alias("at"), "h")
    first = cut(keyed.groupBy("block").agg(F.max(place).alias("p"))).select("block", F.col("p.at").alias("at"), F.col("p.h").alias("h"))
    around = Window.partitionBy(F.lit(1))
    following = F.coalesce(F.lead("block").over(Window.orderBy(F.desc("block"))), F.max("block").over(around))
    wanted = first.select(F.col("block").alias("for"), following.alias("block")).join(first, "block")
    # at most as many rows as there are ranges
    found = keyed.withColumn("at", place["at"]).join(F.broadcast(wanted), ["block", "at", "h"])
    ends = cut(found.groupBy("for").agg(F.max(F.struct("id", "text", "h")).alias("r"))).select("r.*", F.col("for").alias("block"), F.lit(1).alias("end"))
    both = keyed.withColumn("end", F.lit(0)).unionByName(ends).repartition("block")
    both = both.withColumns(made or {})  # after the exchange, which moves texts only
    order = Window.partitionBy("block").orderBy("end", F.col("id").desc_nulls_last(), F.desc("h"))
    names = ["text", *(made or {})]
    return both.withColumn("next", F.lead(F.struct(*names)).over(order)).where("end = 0").select(F.col("id").alias(id_col), *names, "next")


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **band) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: every text against its
    own edit, in which the last third is replaced by the beginning of the next document, and against that document."""
    lists = in_lists(lexicon(docs, text_col, **band))
    texts = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blocks = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paired = with_next(texts, blocks, {"fp": fingerprint(F.col("text"), lists)}, id_col)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next.text", F.lit(1), third))
    made = paired.select(id_col, n.cast("long").alias("n_chars"), edited.alias("edited"), F.col("fp").alias("a"), F.col("next.fp").alias("c"))
    made = made.select(id_col, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "a", fingerprint(F.col("edited"), lists).alias("b"), "c")
    return made.select(
        id_col, "n_chars", "edited_sha256", shown(F.col("a")).alias("fingerprint"), shown(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"),
    )
