"""Placeholders: assignment with coreference, masking, and restoring."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import pieces
from ..functions.text import POSSESSIVE, POSSESSIVE_ALL, STOP_WORDS
from .resolve import Span, resolve
from .rules import PERSON_TYPES, Policy, Rule, alike, distinct
from .scan import Found, Scanner


def without_possessive(text: str, lang: str) -> str:
    if len(text) >= 3:
        for suffix in (*POSSESSIVE.get(lang, ()), *POSSESSIVE_ALL):
            if text.endswith(suffix):
                return text[: -len(suffix)]
    return text


def key_of(text: str, lang: str) -> str:
    text = unicodedata.normalize("NFC", text)
    if lang in ("tr", "az"):
        text = text.replace("İ", "i").replace("I", "i")
    return re.sub(r"\s+", " ", text.lower()).strip()


#: (start, end, new): a part of a text and what takes its place; lists are in order and without overlaps.
Edit = tuple[int, int, str]


def rewritten(text: str, edits: list[Edit]) -> str:
    out, at = [], 0
    for a, b, new in edits:
        out += (text[at:a], new)
        at = b
    return "".join(out) + text[at:]


def composing_edits(text: str) -> list[Edit]:
    """The edits that make the composed form. A sign of ASCII never joins what stands before it, so texts are composed between them."""
    if text.isascii() or unicodedata.is_normalized("NFC", text):
        return []
    found = ((m, unicodedata.normalize("NFC", m[0])) for m in re.finditer(r"[\x00-\x7f]?[^\x00-\x7f]+", text))
    return [(*m.span(), new) for m, new in found if new != m[0]]


def followed(text: str, first: list[Edit], second: list[Edit]) -> list[Edit]:
    """The edits of ``text`` that do what ``first`` does and then, at places of its outcome, ``second``; those that overlap become one."""
    if not first or not second:
        return first or second
    now, marks, shift = rewritten(text, first), [(a, b, 0, new) for a, b, new in second], 0
    for a, b, new in first:
        marks.append((a + shift, a + shift + len(new), b - a - len(new), None))
        shift += len(new) - (b - a)
    groups: list[list] = []
    for m in sorted(marks, key=lambda m: m[:2]):
        if groups and m[0] < groups[-1][1]:
            groups[-1][1] = max(groups[-1][1], m[1])
            groups[-1][2].append(m)
        else:
            groups.append([m[0], m[1], [m]])
    out, shift = [], 0
    for lo, hi, group in groups:
        wider = sum(m[2] for m in group)
        out.append((lo + shift, hi + shift + wider, rewritten(now[lo:hi], [(a - lo, b - lo, new) for a, b, _, new in group if new is not None])))
        shift += wider
    return out


def changes_of(text: str, edits: list[Edit]) -> list[dict]:
    """What stands where in the edited text, and what stood there."""
    out, shift = [], 0
    for a, b, new in edits:
        out.append({"start": a + shift, "shown": new, "original": text[a:b]})
        shift += len(new) - (b - a)
    return out


class Placeholders:
    """What stands for what in one document. Values whose words are among another's share its placeholder,
    the earliest such value deciding; words of up to two characters do not count."""

    def __init__(self, lang: str = "en") -> None:
        self.lang = lang
        self.originals: dict[str, str] = {}
        self.words: dict[str, str] = {}
        self._numbers: dict[str, int] = {}
        self._keys: dict[str, int] = {}
        self._having: dict[str, list[int]] = {}
        self._known: list[tuple[frozenset[str], str]] = []

    def _earlier(self, key: str, long: frozenset[str]) -> str | None:
        first = self._keys.get(key)
        near = {i for w in long for i in self._having.get(w, ())}
        for i in sorted(near):
            if first is not None and i >= first:
                break
            other = self._known[i][0]
            if long <= other or other <= long:
                first = i
                break
        return None if first is None else self._known[first][1]

    def add(self, original: str, kind: str) -> str:
        bare = without_possessive(original, self.lang)
        key = key_of(bare, self.lang)
        long = frozenset(w for w in key.split() if len(w) > 2)
        found = self._earlier(key, long)
        if found is None:
            self._numbers[kind] = self._numbers.get(kind, 0) + 1
            found = f"[{kind}_{self._numbers[kind]}]"
        if original not in self.originals:
            self.originals[original] = found
            n = len(self._known)
            self._known.append((long, self.originals[original]))
            self._keys.setdefault(key, n)
            for w in long:
                self._having.setdefault(w, []).append(n)
        if kind in PERSON_TYPES:
            for w, _ in zip(key.split(), bare.split(), strict=False):
                if len(w) > 2 and w not in STOP_WORDS:
                    self.words[w] = found
        return found

    def mask_words(self, text: str) -> str:
        """The text with words of known persons masked wherever they stand, outside of brackets."""
        return rewritten(text, self.word_edits(text))

    def word_edits(self, text: str) -> list[Edit]:
        """What ``mask_words`` puts where."""
        if not self.words:
            return []
        found = ((m, self.words.get(key_of(m[0], self.lang))) for m in re.finditer(r"\[[^\]]+\]|\w+", text) if m[0][0] != "[")
        return [(*m.span(), p) for m, p in found if p is not None]

    def mask(self, text: str, spans: list[Span]) -> tuple[str, list[tuple[int, int, str, float, str]]]:
        """The text with spans replaced from left to right, and what replaced them. Spans that begin within
        an earlier one stay; blank ones vanish."""
        edits, done = self.span_edits(text, spans)
        return rewritten(text, edits), done

    def span_edits(self, text: str, spans: list[Span]) -> tuple[list[Edit], list[tuple[int, int, str, float, str]]]:
        """What ``mask`` puts where, and what replaced the spans."""
        edits, done, at = [], [], 0
        for a, b, kind, score in sorted(spans, key=lambda s: s[0]):
            if a < at:
                continue
            at, p = b, ""
            if text[a:b].strip():
                p = self.add(text[a:b], kind)
                done.append((a, b, kind, score, p))
            edits.append((a, b, p))
        return edits, done


def non_pii(text: str, lang: str, spans: list[Span], rules: list[dict]) -> list[Span]:
    """Without stop-words and what an active rule declares harmless."""
    out = []
    for s in spans:
        key = key_of(text[s[0] : s[1]].strip(), lang)
        if key and (key in STOP_WORDS or any(_harmless(r, key, lang, s) for r in rules)):
            continue
        out.append(s)
    return out


def _harmless(rule: dict, key: str, lang: str, span: Span) -> bool:
    if not rule.get("active", True) or (rule.get("languages") and lang not in {x.lower() for x in rule["languages"]}):
        return False
    if (rule.get("entity_types") and span[2] not in rule["entity_types"]) or span[3] < (rule.get("min_score") or 0):
        return False
    if rule["pattern_type"] == "token":
        return key == key_of(rule["pattern"], lang)
    try:
        return re.search(rule["pattern"], key) is not None
    except re.error:
        return False


_CHANGES = "changes array<struct<start:int,shown:string,original:string>>"
_RESULT = "masked string, n_masked int, entities array<struct<start:int,end:int,entity_type:string,score:double,placeholder:string>>, map array<struct<original:string,placeholder:string>>"


def _sanitise(text: str, lang: str, scanner: Scanner, checks: dict, allowed: set[str] | None, harmless: list[dict], known: Placeholders) -> tuple:
    """The masked text, what replaced its spans, and a call that gives all edits that lead from the text to the masked one."""
    composed = composing_edits(text)
    whole = rewritten(text, composed)
    return _resolved(text, composed, whole, scanner.find(whole), lang, checks, allowed, harmless, known)


def _resolved(own: str, composed: list[Edit], text: str, found: list[Found], lang: str, checks: dict, allowed: set[str] | None, harmless: list[dict], known: Placeholders) -> tuple:
    """``_sanitise`` for what was found in the composed text."""
    spans: list[Span] = []
    for a, b, kind, score, rule, check in found:
        if check:
            r: Rule = checks[rule]
            ok = _passes(check, text[a:b])
            if not ok and (r.fallback is None or (r.before_on_fail and not re.search(r.before, text[max(0, a - r.window) : a], re.IGNORECASE))):
                continue
            score = r.passed if ok else r.fallback
        if allowed is None or kind in allowed:
            spans.append((a, b, kind, score))
    spans = resolve(text, non_pii(text, lang, spans, harmless))
    spans = [s for s in spans if key_of(text[s[0] : s[1]].strip(), lang) not in STOP_WORDS]
    edits, done = known.span_edits(text, spans)
    masked = rewritten(text, edits)
    words = known.word_edits(masked)
    return rewritten(masked, words), done, lambda: followed(own, followed(own, composed, edits), words)


def _passes(check: str, value: str) -> bool:
    d = re.sub(r"[\s.\-]", "", value)
    if not d.isdigit() or not d.isascii():
        return False
    n = [int(c) for c in d]
    if check == "tckn":
        return len(n) == 11 and n[0] > 0 and (sum(n[0:9:2]) * 7 - sum(n[1:8:2])) % 10 == n[9] and sum(n[:10]) % 10 == n[10]
    if check == "cpf":
        digit = lambda k: sum((k + 1 - i) * n[i] for i in range(k)) * 10 % 11 % 10
        return len(n) == 11 and len(set(n)) > 1 and digit(9) == n[9] and digit(10) == n[10]
    if check == "ssn":
        return re.fullmatch(r"(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}", d) is not None
    if check == "aadhaar":
        from ..functions.ids import _PLACE, _dihedral

        c = 0
        for i, x in enumerate(reversed(n)):
            c = _dihedral(c, _PLACE[i % 8][x])
        return len(n) == 12 and n[0] > 1 and c == 0
    raise ValueError(check)


def mask_documents(docs: DataFrame, policy: Policy, text_col: str = "text", lang_col: str = "lang", harmless: Iterable[dict] = (), only_policy_types: bool = False, changes: bool = False) -> DataFrame:
    """Detects, resolves and masks each row as a document of its own: one narrow stage, no shuffle. Adds masked,
    n_masked, entities and map. A null text stays null, with nothing found. changes: whether to add what ``restore`` needs as well:
    by the map a placeholder leads to one spelling, though it may stand for several."""
    names = docs.columns
    at, lang_at = names.index(text_col), names.index(lang_col) if lang_col in names else None
    rules, harmless = tuple(policy.rules), list(harmless)
    allowed = set(policy.types) if only_policy_types else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, checks = _scanner(rules)
        for batch in batches:
            langs = batch.column(lang_at).to_pylist() if lang_at is not None else [None] * batch.num_rows
            rows = []
            for text, lang in zip(batch.column(at).to_pylist(), langs, strict=True):
                known = Placeholders(lang or "en")
                masked, done, edits = (None, [], list) if text is None else _sanitise(text, lang or "en", scanner, checks, allowed, harmless, known)
                keys = ("start", "end", "entity_type", "score", "placeholder")
                rows.append((masked, len(done), [dict(zip(keys, d, strict=True)) for d in done], [{"original": o, "placeholder": p} for o, p in known.originals.items()], changes_of(text, edits()) if changes else None))
            c = list(zip(*rows, strict=True)) or [[]] * 5
            entity = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("entity_type", pa.string()), ("score", pa.float64()), ("placeholder", pa.string())]))
            pair = pa.list_(pa.struct([("original", pa.string()), ("placeholder", pa.string())]))
            added = {"masked": pa.array(list(c[0]), pa.string()), "n_masked": pa.array(list(c[1]), pa.int32()), "entities": pa.array(list(c[2]), entity), "map": pa.array(list(c[3]), pair)}
            if changes:
                added["changes"] = pa.array(list(c[4]), pa.list_(pa.struct([("start", pa.int32()), ("shown", pa.string()), ("original", pa.string())])))
            yield pa.RecordBatch.from_arrays([*batch.columns, *added.values()], names=[*names, *added])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{ddl}, {_RESULT}" + f", {_CHANGES}" * changes)


def mask_layers(docs: DataFrame, policies: dict[str, Policy], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """What ``mask_documents`` finds by each of several policies, as a column (masked, entities) named for each; the text is not kept. Rules that
    policies share run once. A null text stays null, with nothing found."""
    names = docs.columns
    at, lang_at, rest = names.index(text_col), names.index(lang_col) if lang_col in names else None, [i for i, n in enumerate(names) if n != text_col]
    rules = tuple(distinct(r for p in policies.values() for r in p.rules))
    if len({r.name for r in rules if r.check}) < sum(r.check is not None for r in rules):
        raise ValueError("rules with checks share a name")
    number = {alike(r): i for i, r in enumerate(rules)}
    orders = {name: [number[alike(r)] for r in distinct(p.rules)] for name, p in policies.items()}
    entity = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("entity_type", pa.string()), ("score", pa.float64()), ("placeholder", pa.string())])
    layer, keys = pa.struct([("masked", pa.string()), ("entities", pa.list_(entity))]), tuple(f.name for f in entity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, checks = _scanner(rules)
        for batch in pieces(batches):
            langs = batch.column(lang_at).to_pylist() if lang_at is not None else [None] * batch.num_rows
            out: dict[str, list] = {name: [] for name in orders}
            for text, lang in zip(batch.column(at).to_pylist(), langs, strict=True):
                composed = composing_edits(text or "")
                whole = rewritten(text or "", composed)
                every = scanner.find_each(whole) if text is not None else {}
                for name, order in orders.items():
                    masked, done = text, []
                    if text is not None:
                        masked, done, _ = _resolved(text, composed, whole, [f for i in order for f in every.get(i, ())], lang or "en", checks, None, [], Placeholders(lang or "en"))
                    out[name].append({"masked": masked, "entities": [dict(zip(keys, d, strict=True)) for d in done]})
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), *(pa.array(v, layer) for v in out.values())], names=[*(names[i] for i in rest), *out])

    ddl = [f"`{docs.schema[i].name}` {docs.schema[i].dataType.simpleString()}" for i in rest]
    kind = "struct<masked:string,entities:array<struct<start:int,end:int,entity_type:string,score:double,placeholder:string>>>"
    return docs.mapInArrow(run, ", ".join([*ddl, *(f"`{name}` {kind}" for name in orders)]))


@lru_cache(maxsize=8)
def _scanner(rules: tuple[Rule, ...]) -> tuple[Scanner, dict]:
    """The compiled rules and those with checks, made once for each Python worker and set of rules."""
    return Scanner(rules), {r.name: r for r in rules if r.check}


def mask_chunks(chunks: DataFrame, policy: Policy, doc_col: str = "doc_id", index_col: str = "index", text_col: str = "text", lang: str = "en") -> DataFrame:
    """Masks chunks with one map for each document, in chunk order: (doc, index, masked, n_masked). A document's
    chunks meet in one task, as its map is built in order; documents are the unit of distribution."""
    rules = tuple(policy.rules)
    kind, order = chunks.schema[doc_col].dataType.simpleString(), chunks.schema[index_col].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        (scanner, checks), known = _scanner(rules), Placeholders(lang)
        out = []
        for doc, i, text in pdf.sort_values("i").itertuples(index=False):
            masked, done, _ = _sanitise(text or "", lang, scanner, checks, None, [], known)
            out.append((doc, i, masked, len(done)))
        return pd.DataFrame(out, columns=["doc", "i", "masked", "n_masked"])

    keyed = chunks.select(F.col(doc_col).alias("doc"), F.col(index_col).alias("i"), F.col(text_col).alias("text"))
    done = keyed.groupBy("doc").applyInPandas(run, f"doc {kind}, i {order}, masked string, n_masked int")
    return done.select(F.col("doc").alias(doc_col), F.col("i").alias(index_col), "masked", "n_masked")


def unmask(text: Column, mapping: Column) -> Column:
    """The text with placeholders restored in one pass. mapping: array of (original, placeholder), the last entry of a
    placeholder counting; [PERSON_n] and [ORGANIZATION_n] stand for the long forms. Unknown ones stay."""
    full = F.map_from_entries(F.transform(mapping, lambda e: F.struct(e["placeholder"], e["original"])))
    shape = r"\[[A-Z][A-Z_]*_[0-9]+\]"
    tokens = F.regexp_extract_all(text, F.lit(f"({shape})"), F.lit(1))
    gaps = F.split(text, shape, -1)
    longer = lambda t: F.regexp_replace(t, r"^\[(PERSON|ORGANIZATION)_([0-9]+)\]$", "[$1_NAME_$2]")
    back = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(full, t), F.try_element_at(full, longer(t)), t))
    return F.array_join(F.zip_with(gaps, back, lambda g, b: F.concat(g, F.coalesce(b, F.lit("")))), "")


def restore(masked: Column, changes: Column) -> Column:
    """The text from which ``mask_documents`` made an untouched masked one, sign by sign: every change is undone in its place. A masked text
    that was altered since goes to ``unmask``."""
    end = lambda c: c["start"] + F.length(c["shown"])
    before = lambda i: F.coalesce(end(F.try_element_at(changes, F.nullif(i, F.lit(0)))), F.lit(0))
    parts = F.transform(changes, lambda c, i: F.concat(F.substring(masked, before(i) + 1, c["start"] - before(i)), c["original"]))
    return F.concat(F.array_join(parts, ""), F.substring(masked, before(F.size(changes)) + 1, F.length(masked)))


def last_of_each(mapping: Column) -> Column:
    """A mapping with the last entry of each placeholder only, as map_from_entries demands."""
    turned = F.reverse(mapping)
    return F.reverse(F.filter(turned, lambda e, i: ~F.exists(F.slice(turned, 1, i), lambda x: x["placeholder"] == e["placeholder"])))
