"""Scanning texts for rule matches: by Arrow batches for whole rule sets, by expressions for one plain pattern."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from .cues import Cues, Zones, digits_of, words_of
from .rules import ADDRESS_CUE, IBAN_LENGTHS, Rule

#: (start, end, entity type, score, rule, check)
Found = tuple[int, int, str, float, str, str | None]

_HAS_DIGIT = re.compile(r"\d")
_CUE = re.compile(ADDRESS_CUE, re.IGNORECASE)
_NUMBER = re.compile(r"\d+")


def _iban_rest(value: str) -> int:
    plain = re.sub(r"[\s.\-]", "", value).upper()
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}", plain):
        return -1
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def _cut_iban(value: str) -> tuple[int, bool] | None:
    """How much of a match is the account number, and whether its check digits are right. The longest right
    beginning counts; failing that, what the country's length allows."""
    value = value.rstrip()
    places = [i for i, c in enumerate(value) if c.isalnum()]
    for n in range(min(len(places), 34), 14, -1):
        if _iban_rest(value[: places[n - 1] + 1]) == 1:
            # blanks that follow in the match would count as well; they are never part of it
            return places[n - 1] + 1, True
    n = min(len(places), IBAN_LENGTHS.get(value[:2].upper(), len(places)))
    return (places[n - 1] + 1, False) if 15 <= n <= 34 else None


def _addresses(text: str, rule: Rule, pattern: re.Pattern, runs: list[tuple[int, int]]) -> Iterator[Found]:
    """runs: where digits stand; lines without any are not looked at."""
    taken = []
    for m in pattern.finditer(text) if ":" in text else ():
        value = m.group(2).strip()
        cues = len(_CUE.findall(value))
        if len(value) >= 10 and cues and (cues >= 2 or len(_NUMBER.findall(value)) >= 2):
            taken.append(m.span(2))
            yield (*m.span(2), rule.entity_type, rule.score, rule.name, None)
    end = -1
    for run, _ in runs:
        if run < end:
            continue
        start, end = text.rfind("\n", 0, run) + 1, text.find("\n", run)
        end = len(text) if end < 0 else end
        if len(_CUE.findall(text, start, end)) >= 2 and not any(a <= start and b >= end for a, b in taken):
            taken.append((start, end))
            yield start, end, rule.entity_type, rule.fallback, rule.name, None


class Scanner:
    """Compiled rules; made once for each Python worker."""

    def __init__(self, rules: Iterable[Rule]) -> None:
        rules = list(rules)
        # a rule runs on a text that may match its pattern and, where it needs one, what stands before
        self.cues = Cues([x for r in rules for x in (None if r.shape == "address" else r.pattern, r.before if r.before and not r.before_on_fail else None)])
        self.rules = [(r, re.compile(r.pattern, re.IGNORECASE if r.ignore_case else 0), re.compile(r.before, re.IGNORECASE) if r.before else None, self._sign(r)) for r in rules]
        self.needs = [digits_of(r.pattern) for r in rules]

    @staticmethod
    def _sign(rule: Rule) -> str:
        """Something that every match contains: a cheap test before the pattern."""
        if rule.entity_type == "EMAIL_ADDRESS":
            return "@"
        if rule.entity_type == "URL":
            return "://"
        if rule.shape == "capital":
            return ":"
        return "" if rule.pack == "custom" else "0"

    def find(self, text: str) -> list[Found]:
        return [f for found in self.find_each(text).values() for f in found]

    def find_each(self, text: str) -> dict[int, list[Found]]:
        """What each rule finds, by its number, in order of the rules; those that find nothing are left out."""
        every: dict[int, list[Found]] = {}
        zones = Zones(text)
        cues = self.cues.of(text)
        for i, (rule, pattern, before, sign) in enumerate(self.rules):
            if cues >> 2 * i & 3 != 3 or (sign == "0" and not zones.runs) or (sign not in ("", "0") and sign not in text):
                continue
            if found := list(_addresses(text, rule, pattern, zones.runs) if rule.shape == "address" else self._matches(text, rule, pattern, before, zones.of(self.needs[i]))):
                every[i] = found
        return every

    @staticmethod
    def _matches(text: str, rule: Rule, pattern: re.Pattern, before: re.Pattern | None, zones: list[tuple[int, int]]) -> Iterator[Found]:
        for zone in zones:
            for m in pattern.finditer(text, *zone):
                a, b = m.span(rule.group)
                value, score = text[a:b], rule.score
                if rule.digits and not rule.digits[0] <= sum(c.isdigit() for c in value) <= rule.digits[1]:
                    continue
                if before and not rule.before_on_fail and not before.search(text[max(0, m.start() - rule.window) : m.start()]):
                    continue
                if (rule.shape == "capital" and not value[:1].isupper()) or (rule.shape == "digit" and not _HAS_DIGIT.search(value)):
                    continue
                if rule.shape == "iban":
                    if (cut := _cut_iban(value)) is None:
                        continue
                    b, score = a + cut[0], rule.score if cut[1] else rule.fallback
                yield a, b, rule.entity_type, score, rule.name, rule.check


def scan(docs: DataFrame, rules: Iterable[Rule], id_col: str = "doc_id", text_col: str = "text", types: set[str] | None = None) -> DataFrame:
    """One row for each match: id, start, end (code points of the composed text), entity_type, score, rule, value.
    types: those wanted, None or empty for all. Null texts have none."""
    rules = [r for r in rules if not types or r.entity_type in types]
    kind = docs.schema[id_col].dataType.simpleString()
    gated = {r.name: r for r in rules if r.check}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            at, rows, before = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text:
                    text = unicodedata.normalize("NFC", text)
                    for f in scanner.find(text):
                        at.append(i)
                        rows.append((*f, text[f[0] : f[1]]))
                        rule = gated.get(f[4])
                        before.append(bool(rule and rule.before_on_fail and re.search(rule.before, text[max(0, f[0] - rule.window) : f[0]], re.IGNORECASE)))
            c = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(list(c[0]), pa.int32()), pa.array(list(c[1]), pa.int32()), pa.array(list(c[2]), pa.string()), pa.array(list(c[3]), pa.float64()), pa.array(list(c[4]), pa.string()), pa.array(list(c[5]), pa.string()), pa.array(list(c[6]), pa.string()), pa.array(before, pa.bool_())],
                names=["id", "start", "end", "entity_type", "score", "rule", "check", "value", "before"],
            )

    found = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, start int, end int, entity_type string, score double, rule string, check string, value string, before boolean")
    # identity numbers are checked in the JVM
    score, keep = F.col("score"), F.lit(True)
    for name, rule in gated.items():
        passes = F.coalesce(ids.CHECKS[rule.check](F.col("value")), F.lit(False))
        mine = F.col("rule") == name
        score = F.when(mine, F.when(passes, rule.passed).otherwise(rule.fallback)).otherwise(score)
        if rule.fallback is None:
            keep = keep & (~mine | passes)
        if rule.before_on_fail:
            keep = keep & (~mine | passes | F.col("before"))
    return found.where(keep).select(F.col("id").alias(id_col), "start", "end", "entity_type", score.alias("score"), "rule", "value")


def find_all(text: Column, pattern: str) -> Column:
    """All matches of a pattern as an array of (start, end, value), in code points and in time linear in the matches; null gives null."""
    compiled = re.compile(pattern)

    @F.pandas_udf("array<struct<start:int,end:int,value:string>>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": m.start(), "end": m.end(), "value": m[0]} for m in compiled.finditer(t)], na_action="ignore")

    return found(text)


def plain_spans(docs: DataFrame, patterns: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, entity_type, start, end, value): all matches of a few plain patterns by type, in code points, in time linear in the matches.
    Only texts that may match
    one reach Python, and there only the patterns that may. Null texts have none."""
    kind = docs.schema[id_col].dataType.simpleString()
    marks = F.lit(False)
    for p in patterns.values():
        words = words_of(p)
        marks = marks | (F.col("text").rlike("[0-9]") if words is None else _any(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, cues = [(k, re.compile(p)) for k, p in patterns.items()], Cues(list(patterns.values()))
        for b in batches:
            at, rows = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                may = cues.of(text)
                for n, (name, pattern) in enumerate(compiled):
                    if may >> n & 1:
                        for m in pattern.finditer(text):
                            at.append(i)
                            rows.append((name, m.start(), m.end(), m[0]))
            c = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *[pa.array(x, k) for x, k in zip(c, kinds, strict=True)]], ["id", "entity_type", "start", "end", "value"])

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(marks)
    found = base.mapInArrow(run, f"id {kind}, entity_type string, start int, end int, value string")
    return found.withColumnRenamed("id", id_col)


def _any(words: Iterable[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.lower("text"), F.lit(w))
    return out


def title_case_segments(text: str) -> str:
    """Words all in capitals as title words of the same length."""

    def lowered(m: re.Match) -> str:
        w = m.group()
        return w[0] + w[1:].lower().replace("i̇", "i") if w.isupper() else w

    return re.sub(r"\b\w{2,}\b", lowered, text)
