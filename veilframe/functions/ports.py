"""Ports for models that are not part of this engine. Each is an object that runs in the Python workers, loaded once for
each; deterministic stand-ins are given."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators.scan import title_case_segments

#: Fixed value: shorter texts are not shown to a model.
LEAST_CHARS = 20
#: Types found by rule, which no model may veto.
SURE = frozenset(
    "PHONE_NUMBER NATIONAL_ID IBAN CREDIT_CARD_NUMBER CPF SOCIAL_SECURITY_NUMBER TAX_ID PASSPORT_NUMBER DRIVERS_LICENSE MEDICAL_RECORD_NUMBER HEALTH_INSURANCE_ID LICENSE_PLATE "
    "EMAIL_ADDRESS URL IP_ADDRESS MAC_ADDRESS DATE_OF_BIRTH COORDINATES COOKIE_ID DEVICE_ID POSTAL_ADDRESS STREET_ADDRESS CUSTOMER_REFERENCE_ID".split()
)


class Model(Protocol):
    def __call__(self, text: str, lang: str) -> list[tuple[int, int, str, float]]: ...


class Gazetteer:
    """Words with a type, found wherever they stand as words."""

    def __init__(self, words: dict[str, str], score: float = 0.96) -> None:
        self.words, self.score = words, score

    def __call__(self, text: str, lang: str) -> list[tuple[int, int, str, float]]:
        pattern = re.compile(rf"\b(?:{'|'.join(map(re.escape, self.words))})\b")
        return [(*m.span(), self.words[m.group()], self.score) for m in pattern.finditer(text)]


class SemanticPort(Protocol):
    enabled: bool

    def confirm(self, values: list[str], types: list[str]) -> list[bool] | None: ...

    def aliases(self, text: str) -> list[str]: ...


class NullPort:
    """No model: nothing is confirmed or denied, nothing is found."""

    enabled = False

    def confirm(self, values, types):
        return None

    def aliases(self, text):
        return []


def run_models(docs: DataFrame, models: list[Model]) -> DataFrame:
    """(doc_id, start, end, entity_type, score) of all models on a text and on its title-cased form; the first to find a
    place and type gives the score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for i, (text, lang) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if text is None or len(text.strip()) < LEAST_CHARS:
                    continue
                found: dict[tuple[int, int, str], float] = {}
                for form in dict.fromkeys((text, title_case_segments(text))):
                    for model in models:
                        for a, e, kind, score in model(form, lang or "en"):
                            found.setdefault((a, e, kind), score)
                at += [i] * len(found)
                out += [(*k, s) for k, s in found.items()]
            c = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(list(c[0]), pa.int32()), pa.array(list(c[1]), pa.int32()), pa.array(list(c[2]), pa.string()), pa.array(list(c[3]), pa.float64())], names=["doc_id", "start", "end", "entity_type", "score"])

    return docs.select("doc_id", "text", "lang").mapInArrow(run, "doc_id long, start int, end int, entity_type string, score double")


def validate(found: DataFrame, port: SemanticPort) -> DataFrame:
    """Findings (doc_id, entity_type, start, end, value) that the port confirms; sure types pass, and so does everything
    where the port is off, answers nothing or fails."""
    if not port.enabled:
        return found
    names = found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            types = b.column(names.index("entity_type")).to_pylist()
            ask = [i for i, t in enumerate(types) if t not in SURE]
            values = b.column(names.index("value")).to_pylist()
            try:
                said = port.confirm([values[i] for i in ask], [types[i] for i in ask]) or [True] * len(ask)
            except Exception:  # noqa: BLE001 - a failing model must not lose findings
                said = [True] * len(ask)
            keep = [True] * len(types)
            for i, ok in zip(ask, said, strict=True):
                keep[i] = ok
            yield b.filter(pa.array(keep, pa.bool_()))

    return found.mapInArrow(run, found.schema)


def detect_aliases(docs: DataFrame, port: SemanticPort) -> DataFrame:
    """(doc_id, start, end, entity_type, score) of aliases that the port names, where they occur once as whole words."""
    schema = "doc_id long, start int, end int, entity_type string, score double"
    if not port.enabled:
        return docs.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, spans = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                for alias in port.aliases(text) if text and len(text) >= 80 else ():
                    hits = [m.span() for m in re.finditer(rf"(?<!\w){re.escape(alias)}(?!\w)", text, re.IGNORECASE)]
                    if len(hits) == 1:
                        at.append(i)
                        spans.append(hits[0])
            n = len(at)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array([a for a, _ in spans], pa.int32()), pa.array([e for _, e in spans], pa.int32()), pa.array(["ALIAS"] * n, pa.string()), pa.array([0.85] * n, pa.float64())], names=["doc_id", "start", "end", "entity_type", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


