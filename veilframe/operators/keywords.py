"""Lists of keywords and known values, found by an automaton (Aho and Corasick) in one pass over each text."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keywords of one automaton; longer lists take several passes, whose findings are settled together.
LIST_MOST = 100_000


def _fold(text: str) -> str:
    """Lower case, sign by sign, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def automaton(words: tuple[str, ...]):
    """Over distinct words; each carries its place in the list."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, w in enumerate(words):
        if w and w not in found:
            found.add_word(w, i)
    found.make_automaton()
    return found


@functools.lru_cache(maxsize=4)
def kept_automaton(words: tuple[str, ...]):
    """One for all batches and tasks of a worker."""
    return automaton(words)


def _is_word(text: str, i: int) -> bool:
    return 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")


def occurrences(text: str, words: tuple[str, ...], found) -> list[tuple[int, int, int]]:
    """(start, place in the list, end) of all words that begin and end at a border of words, in the order in which an alternation would try them."""
    if not len(found):
        return []
    out = []
    for last, i in found.iter(_fold(text)):
        start, end = last + 1 - len(words[i]), last + 1
        if _is_word(text, start - 1) != _is_word(text, start) and _is_word(text, end - 1) != _is_word(text, end):
            out.append((start, i, end))
    return sorted(out)


def _apart(hits: Iterator[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The first of what begins at a place, then what begins behind it."""
    out, free = [], 0
    for start, i, end in hits:
        if start >= free:
            out.append((start, i, end))
            free = end
    return out


def keyword_spans(docs: DataFrame, keywords: DataFrame, id_col: str = "doc_id", text_col: str = "text", keyword_col: str = "keyword") -> DataFrame:
    """(id, start, end, value) of the keywords in each text: whole words, whatever their case, from left to right without overlap; of
    several at one place the first of
    the sorted list. Keywords are distinct rows of a table, dealt into automata of at most LIST_MOST; with one the result needs no
    exchange, with more what they
    found is settled document by document in order, so that no document gathers in memory. Null texts and empty keywords give nothing."""
    kind = docs.schema[id_col].dataType.simpleString()
    listed = keywords.select(F.lower(keyword_col).alias("w")).where("w <> ''").distinct()
    n = listed.count()
    parts = max(1, -(-n // LIST_MOST))
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    schema = f"id {kind}, start int, end int, value string"

    def passes(words: tuple[str, ...], settle: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = kept_automaton(words)
            for b in batches:
                rows = []
                for i, text in zip(b["id"].to_pylist(), b["text"].to_pylist(), strict=True):
                    hits = occurrences(text, words, found)
                    rows += [(i, s, e, text[s:e]) for s, _, e in (_apart(hits) if settle else hits)]
                columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
                kinds = [b.schema.field("id").type, pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "start", "end", "value"])

        return run

    def words_of(part: int) -> tuple[str, ...]:
        # LIST_MOST of them on average: one automaton's words pass through the driver at a time
        mine = listed.where(F.pmod(F.xxhash64("w"), F.lit(parts)) == part) if parts > 1 else listed
        return tuple(sorted(_fold(r[0]) for r in mine.toLocalIterator()))

    if parts == 1:
        return base.mapInArrow(passes(words_of(0), True), schema)
    every = None
    for p in range(parts):
        some = base.mapInArrow(passes(words_of(p), False), schema)
        every = some if every is None else every.unionByName(some)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, free = None, 0
        for b in batches:
            keep = []
            for i, start, end in zip(b["id"].to_pylist(), b["start"].to_pylist(), b["end"].to_pylist(), strict=True):
                free = free if last == (i,) else 0
                last = (i,)
                keep.append(start >= free)
                free = end if keep[-1] else free
            yield b.filter(pa.array(keep, pa.bool_())).select(["id", "start", "end", "value"])

    in_order = every.withColumn("low", F.lower("value")).repartition("id").sortWithinPartitions("id", "start", "low")
    return in_order.mapInArrow(settle, schema)


def replaced(text: str, known: list[tuple[str, str]]) -> str:
    """text with known values replaced by their placeholders: the longest first, each from left to right; what has been replaced is not looked
    at again."""
    words = tuple(dict.fromkeys(k for k, _ in known if k))
    if not words:
        return text
    places: dict[int, list[int]] = {}
    for last, i in automaton(words).iter(text):
        places.setdefault(i, []).append(last + 1 - len(words[i]))
    to, taken, spans = dict(reversed(known)), bytearray(len(text)), []
    for i in sorted(places, key=lambda i: (-len(words[i]), i)):
        n = len(words[i])
        for start in places[i]:
            if not any(taken[start : start + n]):
                taken[start : start + n] = b"\x01" * n
                spans.append((start, start + n, to[words[i]]))
    out, at = [], 0
    for start, end, new in sorted(spans):
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]])


def replace_known(docs: DataFrame, map_col: str = "map", text_col: str = "text", into: str = "replaced") -> DataFrame:
    """docs with ``into``: each text with the values of its own map (original, placeholder) replaced; without a map as it is, null for null."""
    plain = docs.withColumn(into, F.col(text_col))
    names = plain.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [[(m["original"], m["placeholder"]) for m in row or []] for row in b[map_col].to_pylist()]
            new = [None if t is None else replaced(t, p) for t, p in zip(b[text_col].to_pylist(), pairs, strict=True)]
            yield pa.RecordBatch.from_arrays([b[c] if c != into else pa.array(new, pa.string()) for c in names], names)

    return plain.mapInArrow(run, plain.schema)
