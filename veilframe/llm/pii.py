"""Personal data: exact base rules, and a semi-Markov conditional random field that adds spans.

Base kinds (email, ip, card, phone) are found by fixed rules and always kept. The semi-Markov model
looks at the neighbourhoods of digits, ``@``, ``=`` and words such as "password:": it scores candidate segments as wholes (digit
grouping, checksum, shape, keyword before it, ...) for each kind, and a dynamic program over token
positions picks the best non-overlapping set, so borders and kinds are chosen jointly. An entity is
at most ``MAX_WORDS`` words and signs long, a run of letters and digits being one whatever its length, and so is a value after a keyword
and its sign (``password=``), up to a blank, quote, bracket or further ``=`` or ``:``. Weights maximise the conditional likelihood of generated
sentences (forward and backward sums over segmentations). Its spans are added where they overlap no base span.

Offsets are code points, ends exclusive. Nulls and empty texts have no spans; equal texts have equal
spans; a very long text is scanned whole, in time linear in its length.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ._common import bounded_batches
from ._words import as_strings

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
MAX_WORDS = 24
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match never begins inside a run of digits, so a run is tried once
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_KEYWORD = r"(?:pass(?:word|wd|phrase)?|pwd|token|secret|api[_-]?key|key|auth|bearer)"
_TRIGGER = re.compile(rf"[0-9@=]|[(\[](?:at|AT)[)\]]|(?i:(?<![^\W_]){_KEYWORD}[\"']?\s?:)")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, those that fail their test dropped; by kind, then start."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > free and text[lo - 1] in _LOCAL:
            lo -= 1
        if lo < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", lo, m.end()))
            free = m.end()
        # no sign before this @ can begin a later match, for @ itself is not part of a name
        free = max(free, at + 1)
        at = text.find("@", free)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return out


# --- the semi-Markov model ---------------------------------------------------------------------

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|.", re.S)
_WORD_SIGN = re.compile(r"[^\W_]")
_WORD = re.compile(r"[^\W_]*")
_JOIN_OK = re.compile(r"[0-9+().\-/ ]+$")
_AT = r"(?:@|\s?[(\[](?:at|AT)[)\]]\s?)"
_DOT = r"(?:\.|\s?[(\[](?:dot|DOT)[)\]]\s?)"
_EMAIL_SHAPE = re.compile(rf"[A-Za-z0-9._%+-]+{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+$")
_IP_SHAPE = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")
_IP_ODD = re.compile(r"[0-9]{1,3}(?:\s?[(\[]?(?:\.|dot)[)\]]?\s?[0-9]{1,3}){3}$")
_HEX = re.compile(r"[0-9a-f]+$|[0-9A-F]+$")
_KEY = re.compile(rf"(?<![^\W_]){_KEYWORD}[\"']?\s*[=:]?\s*[\"']?$", re.I)
#: Before letters alone; "key: value" is no sign of a secret.
_ASSIGNED = re.compile(r"(?<![^\W_])(?:pass(?:word|wd|phrase)?|pwd|token|secret|(?:api|access|secret)[_-]?key)[\"']?\s*[=:]\s*[\"']?$", re.I)
#: What a keyword may be given, whatever signs it holds; none of it can hold a further keyword and sign.
_VALUE = re.compile(r"[^\s\"'<>=:\\]+={0,2}")
_JOINED = re.compile(r"[A-Za-z0-9]+(?:[+/_.-]+[A-Za-z0-9]+)+$")
_TEL = re.compile(r"(?:tel|phone|call|fax|mobile|mobil|telefon|teléfono|téléphone)\W*$", re.I)
_PAY = re.compile(r"(?:card|visa|mastercard|amex|karte|carte|tarjeta)\W*(?:no|number|nr)?\W*$", re.I)
_NET = re.compile(r"(?:ip|host|address|server|from)\W*$", re.I)

FEATURES = (
    "bias", "email", "email_at", "ip", "ip_odd", "ip_over", "luhn", "card_len", "groups_4", "groups_many", "plus", "paren", "phone_len", "digits_only", "digits_long", "digits_short", "date", "separators", "mixed_case_key",
    "hex_long", "alnum_long", "akia", "key_before", "tel_before", "pay_before", "net_before", "quoted", "edge_left", "edge_right", "grows_left", "grows_right", "has_space", "letters", "letters_only", "assigned", "joined", "joined_long", "joined_mixed", "dotted",
    "opens_more", "closes_more", "value", "value_part", "signs", "signs_mixed",
)
_AT_FEATURE = {name: i for i, name in enumerate(FEATURES)}


def _segment_features(text: str, a: int, b: int) -> list[int]:
    """Indices of the features that hold for text[a:b] as a whole."""
    s, left, right = text[a:b], text[max(0, a - 24) : a], text[b : b + 2]
    digits = "".join(_DIGIT.findall(s))
    groups = re.findall(r"[0-9]+", s)
    plain = bool(_JOIN_OK.match(s))
    n, on = len(digits), ["bias"]
    if "@" in s or "(" in s or "[" in s:
        if _EMAIL_SHAPE.match(s):
            on.append("email" if "@" in s else "email_at")
    if _IP_SHAPE.match(s):
        on.append("ip" if all(int(g) <= 255 for g in groups) else "ip_over")
    elif len(groups) == 4 and _IP_ODD.match(s) and all(int(g) <= 255 for g in groups):
        on.append("ip_odd")
    if plain and n:
        if 13 <= n <= 19:
            on.append("card_len")
            if luhn(digits):
                on.append("luhn")
        if len(groups) >= 4 and all(len(g) == 4 for g in groups[:3]):
            on.append("groups_4")
        if len(groups) >= 3:
            on.append("groups_many")
        if s[0] == "+":
            on.append("plus")
        if "(" in s and s.count("(") == s.count(")"):
            on.append("paren")
        if 9 <= n <= 15:
            on.append("phone_len")
        if s.isdigit():
            on.append("digits_only")
        on += ["digits_long"] if n > 15 else ["digits_short"] if n < 9 else []
        if re.match(r"(?:(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./](?:19|20)?[0-9]{2})$", s):
            on.append("date")
        if len(groups) > 1:
            on.append("separators")
    elif s.isalnum():
        on.append("letters" if n else "letters_only")
        if len(s) >= 16 and n:
            on.append("hex_long" if _HEX.match(s) else "alnum_long")
            if s[:4] in ("AKIA", "ASIA") and s.isupper():
                on.append("akia")
        if s != s.lower() and s != s.upper() and n >= 2 and len(s) >= 12:
            on.append("mixed_case_key")
    elif _JOINED.match(s):
        on.append("joined")
        if len(s) >= 16:
            on.append("joined_long")
        if n and s != s.lower() and s != s.upper():
            on.append("joined_mixed")
        if "." in s:
            on.append("dotted")
    elif " " not in s:
        on.append("signs")
        if sum((n > 0, s != s.lower(), s != s.upper())) >= 2:
            on.append("signs_mixed")
    # does the word go on beyond a sign that keys may hold?
    if left[-1:] in ("+", "/", "_", "-", ".") and left[-2:-1].isalnum():
        on.append("opens_more")
    if right[:1] in ("+", "/", "_", "-", ".") and right[1:].isalnum():
        on.append("closes_more")
    for name, rule in (("assigned", _ASSIGNED), ("key_before", _KEY), ("tel_before", _TEL), ("pay_before", _PAY), ("net_before", _NET)):
        if left and rule.search(left):
            on.append(name)
            if name == "assigned":
                on.append("value" if b == _value_end(text, a) else "value_part")
    if left[-1:] in ("'", '"') and left[-1:] == right[:1]:
        on.append("quoted")
    if not left or not left[-1].isalnum():
        on.append("edge_left")
    if not right or not right[0].isalnum():
        on.append("edge_right")
    # does a longer span offer itself?
    if re.search(r"[0-9+][ ().\-]?$", left):
        on.append("grows_left")
    if re.match(r"[ ().\-]?[0-9]", right):
        on.append("grows_right")
    if " " in s:
        on.append("has_space")
    return [_AT_FEATURE[x] for x in on]


def _value_end(text: str, a: int) -> int:
    """Where a value that begins at a ends, without the signs that close a sentence or a bracket."""
    m = _VALUE.match(text, a)
    return a + len(m.group().rstrip(".,;)]}")) if m else a


def _candidates(text: str, lo: int, hi: int) -> tuple[list[int], list[tuple[int, int, list[int]]]]:
    """Token borders of text[lo:hi], and (first token, end token, features) of candidate segments."""
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, lo, hi)]
    cuts = [a for a, _ in tokens] + [hi]
    out = []
    for i, (a, _) in enumerate(tokens):
        c = text[a]
        given = not c.isspace() and text[a - 1 : a] in ("=", ":", '"', "'", " ") and bool(_ASSIGNED.search(text[max(0, a - 24) : a]))
        value = _value_end(text, a) if given else a
        if a < value <= hi and not text[a:value].isalnum():
            j = bisect_left(cuts, value, i + 1)
            if cuts[j] == value:
                out.append((i, j, _segment_features(text, a, value)))
        if not (c.isalnum() or c in "+(") or (a > 0 and c.isalnum() and text[a - 1].isalnum()):
            continue
        # after a keyword and its sign letters will do; elsewhere a digit or @ is needed
        has, seen = c.isalnum() and given, 0
        for j in range(i, len(tokens)):
            x, y = tokens[j]
            t = text[x:y]
            # letters and digits that touch are one word
            seen += j == i or not (t[0].isalnum() and text[x - 1].isalnum())
            if seen > MAX_WORDS:
                break
            if t == "\n" or t in "=,;:\"'<>{}|!?*#&$~^`\\":
                break
            has = has or t[0].isdigit() or t == "@" or t in ("at", "AT")
            if t == " ":
                # a blank joins groups of digits, or stands by a written-out sign
                if not (text[x - 1] in "0123456789)]" or text[y : y + 1] in "([") or not (text[y : y + 1].isdigit() or text[y : y + 1] in "([" or text[x - 1] in ")]"):
                    break
                continue
            if not has or not (t[-1].isalnum() or t in ")]") or text[y : y + 1].isalnum() and t[-1].isalnum() or y == value and not text[a:y].isalnum():
                continue
            out.append((i, j + 1, _segment_features(text, a, y)))
    return cuts, out


def _regions(text: str, reach: int = 40, join: int = 24) -> Iterator[tuple[int, int]]:
    """Disjoint stretches around triggers, widened to the ends of words; outside them nothing can be an entity."""
    done = 0
    for lo, hi in _stretches(text, join + reach):
        a, b = max(done, lo - reach), min(len(text), hi + reach)
        while a < lo and a > 0 and not text[a - 1].isspace():
            a += 1
        if b < len(text) and text[b - 1].isalnum():
            b = _WORD.match(text, b).end()
        if b > a:
            yield a, b
            done = b


def _stretches(text: str, gap: int) -> Iterator[tuple[int, int]]:
    """Triggers, together where no more than ``gap`` signs part them; a word that holds one belongs to it as a whole."""
    lo = hi = -1
    for m in _TRIGGER.finditer(text):
        if m.start() < hi:
            continue
        start, end = m.start(), _WORD.match(text, m.end()).end() if m.group().isalnum() else m.end()
        while m.group().isalnum() and start > max(hi, 0) and _WORD_SIGN.match(text, start - 1):
            start -= 1
        if lo >= 0 and start - hi <= gap:
            hi = end
            continue
        if lo >= 0:
            yield lo, hi
        lo, hi = start, end
    if lo >= 0:
        yield lo, hi


@dataclass
class SegmentModel:
    """weights: kinds by features; leaving a token outside of all entities scores 0."""

    weights: np.ndarray

    def _scored(self, text: str, lo: int, hi: int):
        cuts, found = _candidates(text, lo, hi)
        return cuts, [(i, j, self.weights[:, f].sum(1)) for i, j, f in found], found

    def decode(self, text: str, lo: int, hi: int) -> list[Span]:
        """The best segmentation of text[lo:hi]."""
        cuts, scored, _ = self._scored(text, lo, hi)
        if not scored:
            return []
        ends: dict[int, list] = {}
        for i, j, s in scored:
            k = int(s.argmax())
            if s[k] > 0:
                ends.setdefault(j, []).append((i, float(s[k]), k))
        n = len(cuts) - 1
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for i, s, k in ends.get(j, ()):
                if best[i] + s > best[j]:
                    best[j], back[j] = best[i] + s, (i, k)
        out, j = [], n
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                i, k = back[j]
                a, b = cuts[i], cuts[j]
                out.append((KINDS[k], a, b))
                j = i
        return out[::-1]

    def spans(self, text: str) -> list[Span]:
        return [s for lo, hi in _regions(text) for s in self.decode(text, lo, hi)]


def _gradient(model: SegmentModel, text: str, gold: set[Span], grad: np.ndarray) -> float:
    """Adds d log p(gold | text) / d weights; returns the log likelihood."""
    total = 0.0
    for lo, hi in _regions(text):
        cuts, scored, found = model._scored(text, lo, hi)
        n = len(cuts) - 1
        ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        ahead[0] = behind[n] = 0
        at_end: dict[int, list] = {}
        at_start: dict[int, list] = {}
        for i, j, s in scored:
            m = np.logaddexp.reduce(s)
            at_end.setdefault(j, []).append((i, m))
            at_start.setdefault(i, []).append((j, m))
        for j in range(1, n + 1):
            ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[i] + m for i, m in at_end.get(j, ()))])
        for i in range(n - 1, -1, -1):
            behind[i] = np.logaddexp.reduce([behind[i + 1], *(behind[j] + m for j, m in at_start.get(i, ()))])
        total -= ahead[n]
        for (i, j, s), (_, _, f) in zip(scored, found, strict=True):
            grad[:, f] -= np.exp(ahead[i] + s + behind[j] - ahead[n])[:, None]
            for k, kind in enumerate(KINDS):
                if (kind, cuts[i], cuts[j]) in gold:
                    grad[k, f] += 1
                    total += s[k]
    return total


def _example(rng: np.random.Generator) -> tuple[str, set[Span]]:
    """A generated sentence with entities and look-alikes."""
    pick = lambda *xs: xs[rng.integers(len(xs))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda n=None: "".join(pick(*"abcdefghijklmnoprstuvwz") for _ in range(n or rng.integers(2, 10)))
    hexes = lambda n: "".join(pick(*"0123456789abcdef") for _ in range(n))
    base64 = lambda n: "".join(pick(*"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    letters = lambda n: "".join(pick(*"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") for _ in range(n))
    # keys that hold a few signs between letters and digits
    signed = lambda n: "".join(base64(rng.integers(4, 24)) + pick("+", "/", "_", "-") for _ in range(max(1, n // 16))) + base64(4)

    # passwords as people make them: words and digits with signs among them
    password = lambda: "".join(pick(word(), letters(rng.integers(2, 8)), digits(rng.integers(1, 5))) + pick(*"!#$%&*~^@?+-_.!#$") for _ in range(rng.integers(1, 4))) + pick(digits(2), word(3), letters(4), "")

    def card() -> str:
        body = pick("4", "51", "37") + digits(13)
        body = body[: pick(14, 15)]
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))

    def entity() -> tuple[str, str, str]:
        kind = pick(*KINDS)
        if kind == "email":
            at, dot = pick(("@", "."), ("@", "."), ("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", "."))
            return "", word() + pick("", "." + word(4), digits(2), "_" + word(3)) + at + word() + dot + pick("com", "org", "net", "de", "io"), kind
        if kind == "ip":
            sep = pick(".", ".", ".", "[.]", "(dot)")
            return pick("", "", "ip ", "host: "), sep.join(str(x) for x in rng.integers(0, 256, 4)), kind
        if kind == "card":
            c = card()
            sep = pick("", "", "-", " ")
            return pick("", "", "card ", "visa: "), sep.join(c[i : i + 4] for i in range(0, len(c), 4)), kind
        if kind == "phone":
            n = (digits(3), digits(3), digits(4))
            form = pick("+1 ({}) {}-{}", "+49 {} {}{}", "+{}{}{}", "({}) {}-{}", "tel {}-{}-{}", "phone: {} {} {}", "+33 {} {} {}", "+1-{}-{}-{}", "call {}.{}.{}")
            text = form.format(*n)
            lead = re.match(r"(?:tel |phone: |call )?", text).group()
            return lead, text[len(lead) :], kind
        lead = pick("password=", "password: ", "passwd = ", "pwd: ", "token = \"", "token=", "api_key: ", "api_key=\"", "secret=", "secret: \"", "key=", "Bearer ")
        long = rng.integers(16, 129)
        value = pick(word(rng.integers(6, 40)), letters(rng.integers(6, 40)), hexes(pick(18, 32, 40, 64, 128, long)), base64(pick(16, 20, 24, 32, 64, 100, long)), signed(long), signed(long), word(6) + digits(4))
        if rng.random() < 0.3 and lead[0] in "pts":
            value = password().rstrip(".")
            value += "" if len(value) >= 6 else "!" + word(5)
        if lead == "Bearer " and value.islower():
            value = base64(32)
        if rng.random() < 0.1:
            lead, value = "", "AKIA" + "".join(pick(*"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(14)) + digits(2)
        return lead, value, kind

    def other() -> str:
        return pick(
            digits(rng.integers(1, 8)), digits(4), digits(2) + "." + digits(1), f"{digits(1)}.{digits(1)}.{digits(2)}", f"20{digits(2)}-0{rng.integers(1, 10)}-1{digits(1)}", f"1{digits(1)}/0{rng.integers(1, 10)}/20{digits(2)}", digits(rng.integers(10, 19)),
            f"{digits(2)},{digits(3)}.{digits(2)}", word() + digits(2), "x=" + word(), "n=" + digits(2), f"{rng.integers(300, 999)}.{digits(2)}.{digits(3)}.{digits(2)}", f"§{digits(2)}", f"({digits(4)})", "@" + word(), f"{digits(2)}:{digits(2)}", f"{digits(1)}-{digits(2)}", word() + " 4.0", "http://" + word() + ".com/" + digits(4), f"{digits(3)}-{digits(2)}", f"{digits(4)} {digits(4)}",
            word() + ": " + word(), "key " + word(), "token " + word(), "the password " + word(), word() + "-" + word() + " " + digits(2), word() + "/" + word() + digits(1), f"{word()}_{word()} = {digits(1)}",
        )

    text, gold = "", set()
    for _ in range(rng.integers(1, 4)):
        text += " ".join(word() for _ in range(rng.integers(1, 6))) + pick(" ", " ", ", ", ".\n")
        if rng.random() < 0.6:
            lead, value, kind = entity()
            gold.add((kind, len(text) + len(lead), len(text) + len(lead) + len(value)))
            text += lead + value + ('"' if lead.endswith('"') else "") + pick(" ", ", ", ". ", " ")
        else:
            text += other() + pick(" ", ", ", ". ")
    return text + word(), gold


def train(examples: int = 900, epochs: int = 6, rate: float = 0.25, decay: float = 1e-3, seed: int = 2) -> SegmentModel:
    """Adaptive gradient ascent on the regularised conditional likelihood of generated sentences."""
    rng = np.random.default_rng(seed)
    data = [_example(rng) for _ in range(examples)]
    model = SegmentModel(np.zeros((len(KINDS), len(FEATURES))))
    model.weights[:, 0] = -3.0
    size = np.full_like(model.weights, 1e-3)
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            grad = -decay * model.weights
            _gradient(model, *data[i], grad)
            size += grad**2
            model.weights += rate * grad / np.sqrt(size)
    return model


def find(text: str | None, model: SegmentModel | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: base and those added by the model; both by kind, then start."""
    if not text:
        return [], []
    base = base_spans(text)
    added = []
    if model is not None:
        taken = sorted((a, b) for _, a, b in base)
        starts = [a for a, _ in taken]
        top = np.maximum.accumulate([b for _, b in taken]) if taken else []
        for kind, a, b in model.spans(text):
            k = int(np.searchsorted(starts, b, "left"))  # those before k begin before b
            if k == 0 or top[k - 1] <= a:
                added.append((kind, a, b))
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(base + added, key=lambda s: (order[s[0]], s[1]))


def digest(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def mask(text: str, spans: list[Span]) -> str:
    """Replaces every span by its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, model: SegmentModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, base counts by kind, SHA-256 of the base spans, all spans."""
    bounded_batches(docs)
    schema = StructType([docs.schema[id_col], *[StructField(f"n_{k}", LongType()) for k in BASE], StructField("base_sha256", StringType()), StructField("spans", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in as_strings(batch.column(1)).to_pylist():
                base, spans = find(text, model)
                rows.append((*[sum(s[0] == k for s in base) for k in BASE], hashlib.sha256(digest(base).encode()).hexdigest(), digest(spans)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), pa.int64()) for c in columns[:4]], *[pa.array(list(c), pa.string()) for c in columns[4:]]], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def redact(docs: DataFrame, model: SegmentModel, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows with every span masked and the length set anew; a null text stays null. Other columns pass through."""
    bounded_batches(docs)
    names, length = docs.columns, docs.columns.index(length_col) if length_col in docs.columns else None
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else mask(t, find(t, model)[1]) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if length is not None:
                columns[length] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(batch.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
