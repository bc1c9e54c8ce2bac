"""Splitting texts where their meaning turns: sentence vectors, the gradient of their distances, and break points within each text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import pieces
from .chunk import LEAST, MOST, pack_paragraphs

#: Where a sentence ends, how many neighbours are read with it, and the percentile of gradients above which a text is broken.
SENTENCE_END = re.compile(r"(?<=[.?!])\s+")
NEIGHBOURS, PERCENTILE = 1, 95.0
#: Fixed value: gradients that differ by no more are equal, so that how sums round breaks no text.
SAME = 1e-12

#: Texts to a matrix of a row each: a model behind a port.
Embed = Callable[[list[str]], np.ndarray]


def letter_counts(texts: list[str]) -> np.ndarray:
    """A port without a model: how often each letter from a to z stands in a text."""
    return np.array([[t.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts], float).reshape(-1, 26)


def hashed_words(texts: list[str], size: int = 256) -> np.ndarray:
    """A port without a model: words counted by hash."""
    import zlib

    out = np.zeros((len(texts), size))
    for row, t in zip(out, texts, strict=True):
        for w in t.lower().split():
            row[zlib.crc32(w.encode()) % size] += 1
    return out


def distances(vectors: np.ndarray) -> np.ndarray:
    """1 - cosine of each row and the next; 1 where one of them is zero."""
    n = np.linalg.norm(vectors, axis=1)
    both = n[:-1] * n[1:]
    dot = (vectors[:-1] * vectors[1:]).sum(axis=1)
    return 1 - np.where(both > 0, dot / np.where(both > 0, both, 1), 0.0)


def breaks(found: np.ndarray, percentile: float = PERCENTILE) -> list[int]:
    """Places behind which a text is broken: where the gradient of the distances lies above its percentile by more than SAME."""
    if len(found) < 2:
        return []
    slope = np.gradient(found)
    return [int(i) for i in np.flatnonzero(slope > np.percentile(slope, percentile) + SAME)]


def split_text(text: str, embed: Embed, percentile: float = PERCENTILE) -> list[str]:
    """The parts of a text; sentences of a part are joined by one space."""
    sentences = SENTENCE_END.split(text)
    if len(sentences) <= 2:
        return sentences
    around = [" ".join(sentences[max(0, i - NEIGHBOURS) : i + NEIGHBOURS + 1]) for i in range(len(sentences))]
    out, start = [], 0
    for i in breaks(distances(embed(around)), percentile):
        out.append(" ".join(sentences[start : i + 1]))
        start = i + 1
    return [*out, " ".join(sentences[start:])] if start < len(sentences) else out


def split_by_meaning(docs: DataFrame, embed: Embed | None, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, percentile: float = PERCENTILE) -> DataFrame:
    """(id, index, text): parts of at least ``least`` signs without white space around them, the text itself where none is left. Without a
    model, and for texts on
    which it fails, paragraphs are packed instead. Each text is split by itself, so nothing is exchanged. Null and blank texts give nothing."""
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length(F.trim("text")) > 0)
    if embed is None:
        parts = base.select("id", F.lit(None).cast("array<string>").alias("parts"), "text")
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found, texts = [], b["text"].to_pylist()
                for t in texts:
                    try:
                        long = [p for p in split_text(t, embed, percentile) if len(p.strip()) >= least]
                        found.append(long or [t])
                    except Exception:  # noqa: BLE001 - whatever a model does, the text is split
                        found.append(None)
                rest = [t if f is None else None for t, f in zip(texts, found, strict=True)]
                yield pa.RecordBatch.from_arrays([b["id"], pa.array(found, pa.list_(pa.string())), pa.array(rest, pa.string())], ["id", "parts", "text"])

        parts = base.mapInArrow(run, f"id {kind}, parts array<string>, text string")
    whole = F.coalesce("parts", pack_paragraphs(F.col("text"), MOST))
    return parts.select(F.col("id").alias(id_col), F.posexplode(whole).alias("index", "text"))


# --- language ---------------------------------------------------------------------------------------

#: Sequences of letters that a profile keeps for each language, and the count that stands for none.
PROFILE_GRAMS, UNSEEN = 2000, 0.5
#: Languages whose profiles are shipped to a task at once.
PROFILE_LANGS = 32
_MICRO = 1_000_000


def _letters(text: F.Column) -> F.Column:
    """Letters in lower case and single spaces, one at either end."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "), F.lit(" "))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The sequences of three signs of all texts as numbers, 21 bits a sign, and how many each text has: one at least, which
    in a shorter text is filled up with zeros."""
    texts = [t.ljust(3, "\0") for t in texts]
    lens = np.array([len(t) for t in texts], np.int64)
    signs = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
    inside = np.ones(len(signs), bool)
    ends = np.cumsum(lens)
    inside[ends - 1] = inside[ends - 2] = False
    return (signs[:-2] | signs[1:-1] << 21 | signs[2:] << 42)[inside[:-2]], lens - 2


def _code(gram: str) -> int:
    return sum(ord(c) << 21 * i for i, c in enumerate(gram))


def _gram(code: int) -> str:
    return "".join(chr(c) for c in (code & 0x1FFFFF, code >> 21 & 0x1FFFFF, code >> 42) if c)


def gram_counts(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, gram, n): how often each sequence of three occurs in the texts of each language. Each task counts what it reads."""
    kind = labelled.schema[lang_col].dataType.simpleString()
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), _letters(F.col(text_col)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            codes, many = _codes(b["text"].to_pylist())
            coded = b["lang"].dictionary_encode()
            lang = np.repeat(coded.indices.to_numpy(), many)
            for i in range(len(coded.dictionary)):
                found, n = np.unique(codes[lang == i], return_counts=True)
                names = coded.dictionary.take(pa.array(np.full(len(found), i)))
                yield pa.RecordBatch.from_arrays([names, pa.array([_gram(c) for c in found.tolist()], pa.string()), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    return rows.mapInArrow(run, f"lang {kind}, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", keep: int = PROFILE_GRAMS) -> DataFrame:
    """(gram, lang, weight): for every sequence that is among the ``keep`` most frequent of some language, its log-probability in each language in
    millionths. A table of languages x sequences, whatever the number of texts."""
    from pyspark.sql import Window

    from .lineage import cut

    counts = cut(gram_counts(labelled, lang_col, text_col))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    kept = counts.withColumn("nth", first).where(F.col("nth") <= keep).select("gram").distinct()
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    # every language for every kept sequence: the sequences carry the list of languages, which is as short as the profile's
    langs = totals.agg(F.collect_list(F.struct("lang", "total")).alias("langs"))
    each = kept.join(F.broadcast(langs)).select("gram", F.explode("langs").alias("l")).select("gram", "l.lang", "l.total")
    known = each.join(counts, ["lang", "gram"], "left")
    share = (F.coalesce("n", F.lit(0)) + UNSEEN) / (F.col("total") + UNSEEN)
    return known.select("gram", "lang", F.round(F.log(share) * _MICRO).cast("long").alias("weight"))


def guess_language(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", fallback: str = "en") -> DataFrame:
    """(id, lang): the language under which a text's sequences are likeliest, ties to the first by name; ``fallback`` where none of them is
    known. A text is weighed where it is read, by the profiles of PROFILE_LANGS languages at a time, which are as large as one
    task needs; what is dealt out is a row for each text and language."""
    from .lineage import cut

    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = base.where("text is not null").select("id", _letters(F.col("text")).alias("text"))
    found = cut(found)
    langs = sorted(r[0] for r in found.select("lang").distinct().collect())
    sums = None
    for lo in range(0, len(langs), PROFILE_LANGS):
        some = langs[lo : lo + PROFILE_LANGS]
        part = _weighed(rows, found.where(F.col("lang").isin(some)).toArrow(), some, kind)
        sums = part if sums is None else sums.unionByName(part)
    if sums is None:
        return base.select(F.col("id").alias(id_col), F.lit(fallback).alias("lang"))
    sums = sums.groupBy("id", "lang").agg(F.sum("weight").alias("weight"))
    best = sums.groupBy("id").agg(F.min_by("lang", F.struct(-F.col("weight"), "lang")).alias("lang"))
    return base.select("id").join(best, "id", "left").select(F.col("id").alias(id_col), F.coalesce("lang", F.lit(fallback)).alias("lang"))


def _weighed(rows: DataFrame, profile: pa.Table, langs: list[str], kind: str) -> DataFrame:
    """(id, lang, weight) of texts that hold a sequence of the profile: the sum over all such sequences."""
    names = profile["gram"].combine_chunks().dictionary_encode()
    codes = np.array([_code(g) for g in names.dictionary.to_pylist()], np.int64)
    order = np.argsort(codes)
    known, place = codes[order], np.argsort(order)
    lang = pc.index_in(profile["lang"].combine_chunks(), pa.array(langs)).to_numpy()
    weights = np.zeros((len(langs), len(known)), np.int64)
    weights[lang, place[names.indices.to_numpy()]] = profile["weight"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            found, many = _codes(b["text"].to_pylist())
            at = np.minimum(np.searchsorted(known, found), len(known) - 1)
            hit = known[at] == found
            of = np.repeat(np.arange(b.num_rows), many)[hit]
            if not len(of):
                continue
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            ids, at = b["id"].take(pa.array(of[starts])), at[hit]
            for name, weight in zip(langs, weights, strict=True):
                yield pa.RecordBatch.from_arrays([ids, pa.array([name] * len(ids), pa.string()), pa.array(np.add.reduceat(weight[at], starts))], ["id", "lang", "weight"])

    return rows.mapInArrow(run, f"id {kind}, lang string, weight long")
