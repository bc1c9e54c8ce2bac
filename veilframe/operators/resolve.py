"""Span algebra: absorption, choice among overlaps, name expansion and merging, on one document's
spans in Python and on arrays of spans in the JVM."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import ABSORBS, PRIORITY

#: (start, end, entity type, score)
Span = tuple[int, int, str, float]
PERSON = "PERSON_NAME"


def _meets(disjoint: list[tuple[int, int]], a: int, b: int) -> bool:
    """Does [a, b) overlap one of the sorted disjoint intervals?"""
    k = bisect_left(disjoint, (b,))
    return k > 0 and disjoint[k - 1][1] > a


def _union(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def absorb(spans: list[Span]) -> list[Span]:
    """Without spans that overlap one of a type which absorbs theirs."""
    cover = {inner: _union([s[:2] for s in spans if inner in ABSORBS.get(s[2], ())]) for inner in {t for ts in ABSORBS.values() for t in ts}}
    return [s for s in spans if not _meets(cover.get(s[2], []), s[0], s[1])]


def _greedy(spans: list[Span]) -> list[Span]:
    out, free = [], -1
    for s in sorted(spans, key=lambda s: (s[0], s[0] - s[1], -PRIORITY.get(s[2], 50), -s[3])):
        if s[0] >= free:
            out.append(s)
            free = s[1]
    return out


def dedup(spans: list[Span], high: frozenset[str] = frozenset(PRIORITY)) -> list[Span]:
    """Disjoint spans: identifiers first, then what does not overlap them. Within either, by start, length,
    priority of the type, score, and order of input."""
    strong = _greedy([s for s in spans if s[2] in high])
    taken = [s[:2] for s in strong]
    weak = _greedy([s for s in spans if s[2] not in high and not _meets(taken, s[0], s[1])])
    return sorted(strong + weak, key=lambda s: s[0])


def _name_like(token: str) -> bool:
    return len(token) >= 2 and token.isalpha() and token[0].isupper()


def expand_names(text: str, spans: list[Span]) -> list[Span]:
    """Person names with one neighbouring capitalised word on each side, on the same line and free of other spans."""
    taken = _union([s[:2] for s in spans])
    out = []
    for a, b, kind, score in spans:
        own = text[a:b]
        if kind == PERSON and len(own.strip()) >= 2 and own[0].isalpha() and own[0].isupper() and not any(c.isdigit() or c == "_" for c in own):
            line_end = next((i for i in range(b, len(text)) if text[i] in "\r\n" or not text[i].isspace()), len(text))
            if line_end < len(text) and text[line_end] not in "\r\n":
                word = text[line_end:].split(None, 1)[0] if not text[line_end].isspace() else ""
                if _name_like(word) and not _meets(taken, line_end, line_end + len(word)):
                    b = line_end + len(word)
            k = a
            while k > 0 and text[k - 1].isspace() and text[k - 1] not in "\r\n":
                k -= 1
            if k > 0 and not text[k - 1].isspace():
                first = k
                while first > 0 and not text[first - 1].isspace():
                    first -= 1
                # the neighbour is tested with the blank run that follows it, so a blank makes it no name
                if _name_like(text[first:k]) and not _meets(taken, first, k):
                    a = first
        out.append((a, b, kind, score))
    return sorted(out, key=lambda s: (s[0], s[0] - s[1], -s[3]))


def merge_names(text: str, spans: list[Span]) -> list[Span]:
    """Person names that only blanks of one line part, as one span with the best score."""
    out: list[Span] = []
    people = sorted((s for s in spans if s[2] == PERSON), key=lambda s: s[0])
    for s in people:
        if out and not (gap := text[out[-1][1] : s[0]]).strip() and "\n" not in gap and "\r" not in gap:
            out[-1] = (out[-1][0], s[1], PERSON, max(out[-1][3], s[3]))
        else:
            out.append(s)
    return sorted([s for s in spans if s[2] != PERSON] + out, key=lambda s: s[0])


def resolve(text: str, spans: list[Span]) -> list[Span]:
    return merge_names(text, expand_names(text, dedup(absorb(spans))))


# --- the same on arrays of struct(start, end, entity_type, score) ------------------------------


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


def absorb_array(spans: Column) -> Column:
    def absorbed(s: Column) -> Column:
        rule = F.lit(False)
        for outer, inner in ABSORBS.items():
            rule = rule | (s["entity_type"].isin(*inner) & F.exists(spans, lambda o: (o["entity_type"] == outer) & overlaps(s, o)))
        return rule

    return F.filter(spans, lambda s: ~absorbed(s))


def _greedy_array(spans: Column) -> Column:
    rank = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    keyed = F.transform(
        spans,
        lambda s, i: F.struct(
            s["start"].alias("a"), (s["start"] - s["end"]).alias("b"), (-F.coalesce(F.try_element_at(rank, s["entity_type"]), F.lit(50))).alias("c"), (-s["score"]).alias("d"), i.alias("e"), s.alias("s")
        ),
    )
    state = F.struct(F.lit(-1).alias("free"), F.slice(spans, 1, 0).alias("out"))

    def take(acc: Column, e: Column) -> Column:
        s = e["s"]
        fits = s["start"] >= acc["free"]
        return F.struct(F.when(fits, s["end"]).otherwise(acc["free"]).alias("free"), F.when(fits, F.concat(acc["out"], F.array(s))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.array_sort(keyed), state, take)["out"]


def dedup_array(spans: Column) -> Column:
    high = list(PRIORITY)
    strong = _greedy_array(F.filter(spans, lambda s: s["entity_type"].isin(*high)))

    def rest(top: Column) -> Column:
        weak = F.filter(spans, lambda s: ~s["entity_type"].isin(*high) & ~F.exists(top, lambda t: overlaps(s, t)))
        return F.array_sort(F.concat(top, _greedy_array(weak)))

    return F.element_at(F.transform(F.array(strong), rest), 1)


def replace_array(text: Column, spans: Column) -> Column:
    """The text with each span's ``placeholder`` in its place; spans disjoint and sorted."""

    def piece(s: Column, i: Column) -> Column:
        start = F.when(i == 0, 0).otherwise(F.element_at(spans, F.greatest(i, F.lit(1)))["end"])
        return F.concat(F.substring(text, start + 1, s["start"] - start), s["placeholder"])

    tail = F.substring(text, F.coalesce(F.try_element_at(spans, F.lit(-1))["end"], F.lit(0)) + 1, F.length(text))
    return F.concat(F.array_join(F.transform(spans, piece), ""), tail)
