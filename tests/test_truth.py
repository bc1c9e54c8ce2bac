"""Queries whose results SQL cannot give, against plain versions written from what they are to do."""

import re
import unicodedata

import pytest

from veilframe.functions.text import POSSESSIVE, POSSESSIVE_ALL, STOP_WORDS
from veilframe.operators import mask, rules
from veilframe.plans.registry import QUERIES

LINE = "\nIBAN DE89370400440532013000\nName:\n Anna \nAddress : Main ST 12 NO:7 Floor\nborn on 12.03.1970 IMEI: 356938035643812 SSN 078-05-1120 cpf 529.982.247-25 passport P1234567 Anna Bergmann driver's license D1234567 tax id 12-3456789 plate no 34 ABC 12 +49 (30) 123-4567 4111 1111 1111 1111 x@y.example.org anna's"


def plain_find(text, policy):
    """Every rule over the text, one after another; what matches must pass."""
    out = []
    digits = lambda s: sum(c.isdigit() for c in s)
    for r in policy.rules:
        flags = re.I if r.ignore_case else 0
        if r.shape == "address":
            cues = lambda s: len(re.findall(rules.ADDRESS_CUE, s, re.I))
            whole = []
            for m in re.finditer(r.pattern, text, flags):
                v = m[2].strip()
                if len(v) >= 10 and (cues(v) >= 2 or (cues(v) == 1 and len(re.findall(r"\d+", v)) >= 2)):
                    whole.append((*m.span(2), r.entity_type, r.score))
            for m in re.finditer(r"[^\n]+", text):
                if re.search(r"\d", m[0]) and cues(m[0]) >= 2 and not any(a <= m.start() and m.end() <= b for a, b, *_ in whole):
                    whole.append((*m.span(), r.entity_type, r.fallback))
            out += whole
            continue
        for m in re.finditer(r.pattern, text, flags):
            a, b = m.span(r.group)
            v, score = text[a:b], r.score
            near = re.search(r.before, text[max(0, m.start() - r.window) : m.start()], re.I) if r.before else True
            if r.digits and not r.digits[0] <= digits(v) <= r.digits[1]:
                continue
            if r.before and not r.before_on_fail and not near:
                continue
            if (r.shape == "capital" and not v[:1].isupper()) or (r.shape == "digit" and not digits(v)):
                continue
            if r.shape == "iban":
                kept = plain_iban(v)
                if kept is None:
                    continue
                b, score = a + kept[0], r.score if kept[1] else r.fallback
            if r.check:
                ok = plain_check(r.check, text[a:b])
                near = re.search(r.before, text[max(0, a - r.window) : a], re.I) if r.before else True
                if not ok and (r.fallback is None or (r.before_on_fail and not near)):
                    continue
                score = r.passed if ok else r.fallback
            out.append((a, b, r.entity_type, score))
    return out


def plain_check(kind, v):
    """Identity numbers by their definitions."""
    d = re.sub(r"[\s.\-]", "", v)
    if not re.fullmatch("[0-9]+", d):
        return False
    n = [int(c) for c in d]
    if kind == "tckn":
        return len(n) == 11 and n[0] != 0 and ((n[0] + n[2] + n[4] + n[6] + n[8]) * 7 - (n[1] + n[3] + n[5] + n[7])) % 10 == n[9] and sum(n[:10]) % 10 == n[10]
    if kind == "cpf":
        first = sum(n[i] * (10 - i) for i in range(9)) * 10 % 11 % 10 if len(n) == 11 else -1
        return len(n) == 11 and d != d[0] * 11 and first == n[9] and sum(n[i] * (11 - i) for i in range(10)) * 10 % 11 % 10 == n[10]
    if kind == "ssn":
        return len(n) == 9 and d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    # the dihedral group of the pentagon: turns below 5, reflections above
    times = lambda a, b: (a + b) % 5 if a < 5 and b < 5 else (a + b - 5) % 5 + 5 if a < 5 else (a - 5 - b) % 5 + 5 if b < 5 else (a - b) % 5
    shift = {0: 1, 1: 5, 2: 7, 3: 6, 4: 2, 5: 8, 6: 3, 7: 0, 8: 9, 9: 4}
    c = 0
    for i, x in enumerate(reversed(n)):
        for _ in range(i % 8):
            x = shift[x]
        c = times(c, x)
    return len(n) == 12 and n[0] > 1 and c == 0


def plain_iban(v):
    v = v.rstrip()
    ends = [i + 1 for i, c in enumerate(v) if c.isalnum()]

    def right(s):
        s = re.sub(r"[\s.\-]", "", s).upper()
        return bool(re.fullmatch("[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}", s)) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1

    for n in range(34, 14, -1):
        if n <= len(ends) and right(v[: ends[n - 1]]):
            return ends[n - 1], True
    n = min(len(ends), rules.IBAN_LENGTHS.get(v[:2].upper(), len(ends)))
    return (ends[n - 1], False) if 15 <= n <= 34 else None


def meets(s, t):
    return s[0] < t[1] and t[0] < s[1]


def plain_dedup(spans):
    kept = []
    rank = lambda s: rules.PRIORITY.get(s[2], 50)
    for strong in (True, False):
        before = list(kept)
        group = [s for s in spans if (s[2] in rules.PRIORITY) == strong and not any(meets(s, t) for t in before)]
        taken = []
        for s in sorted(group, key=lambda s: (s[0], -(s[1] - s[0]), -rank(s), -s[3])):
            if not any(meets(s, t) for t in taken):
                taken.append(s)
        kept += taken
    return sorted(kept, key=lambda s: s[0])


def name_like(w):
    return len(w) >= 2 and w.isalpha() and w[0].isupper()


def plain_expand(text, spans):
    out = []
    for a, b, kind, score in spans:
        v = text[a:b]
        if kind == "PERSON_NAME" and len(v.strip()) >= 2 and v[0].isalpha() and v[0].isupper() and not re.search(r"[\d_]", v):
            behind = re.match(r"([^\S\r\n]*)(\S+)", text[b:])
            if behind and name_like(behind[2]) and not any(meets((b + behind.start(2), b + behind.end(2)), t) for t in spans):
                new_b = b + behind.end(2)
            else:
                new_b = b
            ahead = re.search(r"(\S+)([^\S\r\n]*)\Z", text[:a])
            if ahead and name_like(ahead[1] + ahead[2]) and not any(meets((ahead.start(1), a), t) for t in spans):
                a = ahead.start(1)
            b = new_b
        out.append((a, b, kind, score))
    return sorted(out, key=lambda s: (s[0], -(s[1] - s[0]), -s[3]))


def plain_merge(text, spans):
    people, rest = sorted(s for s in spans if s[2] == "PERSON_NAME"), [s for s in spans if s[2] != "PERSON_NAME"]
    i = 0
    while i + 1 < len(people):
        gap = text[people[i][1] : people[i + 1][0]]
        if gap.strip() == "" and "\n" not in gap and "\r" not in gap:
            people[i : i + 2] = [(people[i][0], people[i + 1][1], "PERSON_NAME", max(people[i][3], people[i + 1][3]))]
        else:
            i += 1
    return sorted(rest + people, key=lambda s: s[0])


def plain_key(v, lang):
    v = unicodedata.normalize("NFC", v)
    v = v.replace("İ", "i").replace("I", "i") if lang in ("tr", "az") else v
    return " ".join(v.lower().split())


class PlainMap:
    def __init__(self, lang):
        self.lang, self.entries, self.counts, self.words = lang, [], {}, {}

    def add(self, v, kind):
        bare = v
        for s in [*POSSESSIVE.get(self.lang, ()), *POSSESSIVE_ALL]:
            if len(v) >= 3 and v.endswith(s):
                bare = v[: -len(s)]
                break
        key = plain_key(bare, self.lang)
        long = {w for w in key.split() if len(w) > 2}
        for _, other, words, p in self.entries:
            if other == key or (long and words and (long <= words or words <= long)):
                break
        else:
            self.counts[kind] = self.counts.get(kind, 0) + 1
            p = f"[{kind}_{self.counts[kind]}]"
        if all(o != v for o, *_ in self.entries):
            self.entries.append((v, key, long, p))
        if kind in rules.PERSON_TYPES:
            self.words |= {w: p for w in key.split() if len(w) > 2 and w not in STOP_WORDS}
        return p

    def sanitise(self, text, policy):
        text = unicodedata.normalize("NFC", text)
        stop = lambda s: plain_key(text[s[0] : s[1]].strip(), self.lang) in STOP_WORDS
        spans = [s for s in plain_find(text, policy) if not stop(s)]
        spans = [s for s in spans if not any(meets(s, o) and s[2] in rules.ABSORBS.get(o[2], ()) for o in spans)]
        spans = [s for s in plain_merge(text, plain_expand(text, plain_dedup(spans))) if not stop(s)]
        out, at, used = "", 0, []
        for a, b, kind, _ in sorted(spans, key=lambda s: s[0]):
            if a >= at:
                out += text[at:a]
                if text[a:b].strip():
                    used.append(self.add(text[a:b], kind))
                    out += used[-1]
                at = b
        out += text[at:]
        masked = re.sub(r"\[[^\]]+\]|\w+", lambda m: m[0] if m[0][0] == "[" else self.words.get(plain_key(m[0], self.lang), m[0]), out)
        return masked, used


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def sanitised(docs):
    policy = rules.compose(rules.PACKS)
    out = {}
    for i, text, lang in docs:
        known = PlainMap(lang or "en")
        out[i] = (*known.sanitise(text, policy), known)
    return out


def test_sanitised_documents(spark, sf, sanitised):
    got = {r["doc_id"]: (r["masked"], r["n_masked"], r["placeholders"]) for r in QUERIES["msk_09_sanitise"](spark, sf).collect()}
    assert got == {i: (masked, len(used), ",".join(used)) for i, (masked, used, _) in sanitised.items()}
    assert sum(n for _, n, _ in got.values()) > 10


def test_maps_of_documents(spark, sf, sanitised):
    got = sorted((r["doc_id"], r["ord"], r["original"], r["placeholder"]) for r in QUERIES["msk_02_map_of_document"](spark, sf).collect())
    assert got == sorted((i, n, e[0], e[3]) for i, (_, _, known) in sanitised.items() for n, e in enumerate(known.entries))


def test_a_line_that_every_rule_finds(spark):
    """Names, addresses and numbers side by side, in pieces that end anywhere."""
    policy = rules.compose(rules.PACKS)
    texts = [LINE[:n] + LINE[m:] for n in range(0, len(LINE), 23) for m in range(n, len(LINE), 71)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["masked"], r["n_masked"]) for r in mask.mask_documents(df, policy).collect()}
    for i, t in enumerate(texts):
        masked, used = PlainMap("en").sanitise(t, policy)
        assert got[i] == (masked, len(used)), t


def test_session_maps(spark, sf):
    policy = rules.compose(rules.PACKS)
    turns = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["text"] or ""))
    want = []
    for c, rows in turns.items():
        known = PlainMap("en")
        for turn, text in sorted(rows):
            masked, used = known.sanitise(text, policy)
            want.append((c, turn, masked, len(used)))
    got = QUERIES["msk_10_session_maps"](spark, sf).select("doc_id", "index", "masked", "n_masked").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_greedy_dedup(spark, sf):
    from veilframe.plans.detection import made_spans

    by_doc = {}
    for r in made_spans(spark, sf).collect():
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["entity_type"], r["score"]))
    want = sorted((d, *s) for d, spans in by_doc.items() for s in plain_dedup(sorted(spans)))
    got = QUERIES["win_03_greedy_dedup"](spark, sf).select("doc_id", "start", "end", "entity_type", "score").collect()
    assert sorted(map(tuple, got)) == want and want


def test_expanded_names(spark, sf, docs):
    from pyspark.sql import functions as F

    title = dict(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.initcap("text")).collect()))
    want = {}
    for i, t in title.items():
        end = len(t.split(" ", 1)[0])
        a, b, *_ = plain_expand(t, [(0, end, "PERSON_NAME", 0.9)])[0]
        want[i] = t[a:b]
    assert {r["doc_id"]: r["name"] for r in QUERIES["win_05_name_expansion"](spark, sf).collect()} == want


def test_title_case(spark, sf, docs):
    def titled(t):
        out = []
        for w in re.split(r"(\w+)", t):
            out.append(w[0] + w[1:].lower() if re.fullmatch(r"\w{2,}", w) and w.isupper() else w)
        return "".join(out)

    assert {r["doc_id"]: r["text"] for r in QUERIES["det_18_title_case"](spark, sf).collect()} == {i: titled(t) for i, t, _ in docs}


def test_snapped_spans(spark, sf, docs):
    from veilframe.operators.audit import PLAIN

    want = []
    for i, t, _ in docs:
        for kind, p in PLAIN.items():
            for m in re.finditer(p, t):
                a, b = m.span()
                while a > 0 and re.match(r"\w", t[a - 1]):
                    a -= 1
                while b < min(len(t), m.end() + 64) and re.match(r"\w", t[b]):
                    b += 1
                want.append((i, kind, a, b))
    got = QUERIES["det_19_word_snap"](spark, sf).select("doc_id", "entity_type", "start", "end").collect()
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_highlights(spark, sf, docs, sanitised):
    got = {}
    for r in QUERIES["fn_39_highlights"](spark, sf).collect():
        got.setdefault(r["doc_id"], []).append((r["i"], r["marked"], r["piece"]))
    text = {i: unicodedata.normalize("NFC", t) for i, t, _ in docs}
    for i, pieces in got.items():
        pieces.sort()
        whole = "".join(p for _, _, p in pieces)
        assert text[i].startswith(whole) and [m for _, m, _ in pieces] == [False, True] * (len(pieces) // 2)
        masked = "".join(p if not m else u for (_, m, p), u in zip(pieces, [x for y in sanitised[i][1] for x in ("", y)], strict=True))
        assert mask.Placeholders().mask_words(masked) == masked
        assert len(pieces) == 2 * len(sanitised[i][1])
    assert set(got) == {i for i, (_, used, _) in sanitised.items() if used}


def test_structured_chunks(spark, sf, docs):
    from veilframe.operators.chunk import SECTION_STARTS

    def heading(s):
        letters = [c for c in s if unicodedata.category(c)[0] == "L"]
        upper = [c for c in s if unicodedata.category(c) == "Lu"]
        return 5 <= len(s) <= 150 and (s.endswith(":") or (bool(letters) and len(upper) > 0.7 * len(letters)))

    def packed(t):
        out = []
        for p in (p.strip() for p in re.split(r"\n\s*\n", t)):
            if p and out and len(out[-1]) + len(p) + 2 <= 1200:
                out[-1] += "\n\n" + p
            elif p:
                out.append(p)
        return out

    want = []
    for i, t, _ in docs:
        parts, found = [], [[None, []]]
        if len(t) < 100:
            want.append((i, 0, None, t))
            continue
        for line in t.split("\n"):
            s = line.strip(" ")
            if s and (any(re.search(p, s, re.I) for p in SECTION_STARTS) or heading(s)):
                found.append([s[:100] if len(s) < 200 else None, []])
            found[-1][1].append(line)
        for title, lines in found:
            body = "\n".join(lines).strip()
            if body:
                parts += [(title, p) for p in (packed(body) if len(body) > 1200 else [body])]
        want += [(i, n, title, p) for n, (title, p) in enumerate(parts)]
    got = QUERIES["fn_25_structured_chunks"](spark, sf).select("doc_id", "index", "title", "text").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("name", [f"det_{i:02d}" for i in range(1, 18)])
def test_built_in_rules(spark, sf, name):
    """Each built-in rule over the documents and a line that it is to find something in."""
    from veilframe.plans import detection

    (query, wanted), *_ = [(q, n) for q, n in detection._BASELINE.items() if q.startswith(name)]
    policy = rules.Policy((), (), tuple(r for r in rules.BASELINE if r.name in wanted))
    got = QUERIES[query](spark, sf).select("id", "start", "end", "entity_type", "score").collect()
    texts = {r["doc_id"]: unicodedata.normalize("NFC", r["text"]) for r in detection._probed(spark, sf).collect()}
    assert sorted(map(tuple, got)) == sorted((i, *f) for i, t in texts.items() for f in plain_find(t, policy)) and len(got) >= len(texts)


def test_context_rules(spark, sf):
    got = QUERIES["pack_01_gdpr_context_rules"](spark, sf).collect()
    policy = rules.Policy((), (), tuple(r for r in rules.PACKS["gdpr"] if r.group))
    of = {}
    for r in got:
        of.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["entity_type"], r["score"]))
    for k, spans in of.items():
        n = k % 90 + 10
        line = f"Personalausweis Nr. T220001{n}; Steuer-ID 77 523 164 8{n}; RV-Nr 65 170839 J 0{n}; DNI 123456{n}Z; NIE X12345{n}L; Seguridad Social 28 12 345678 {n}; NIR 1 85 05 78 006 084 {n}; SIREN 834 291 0{n}"
        assert sorted(spans) == sorted(plain_find(line, policy)) and len(spans) == 8
    assert len(of) == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_known_values_in_documents(spark, sf, docs, sanitised):
    import hashlib

    want = {}
    for i, t, _ in docs:
        known = sanitised[i][2].entries
        if sanitised[i][1]:
            for original, _, _, p in sorted(known, key=lambda e: -len(e[0])):
                t = t.replace(original, p)
            want[i] = hashlib.md5(t.encode()).hexdigest()
    assert {r["doc_id"]: r["h"] for r in QUERIES["fn_32_longest_first"](spark, sf).collect()} == want


def test_packed_paragraphs(spark, sf, docs):
    import hashlib

    want = []
    for i, t, _ in docs:
        out = []
        for p in (p.strip() for p in re.split(r"\n\s*\n", t.replace("\n", "\n\n"))):
            if p and out and len(out[-1]) + len(p) + 2 <= 1200:
                out[-1] += "\n\n" + p
            elif p:
                out.append(p)
        want += [(i, n, hashlib.md5(p.encode()).hexdigest()) for n, p in enumerate(out)]
    got = QUERIES["fn_26_packed_paragraphs"](spark, sf).select("doc_id", "i", "h").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_layers(spark, sf):
    """With the built-in rules every planted value goes; packs alone miss the types that only those know."""
    got = {r["layers"]: r for r in QUERIES["eval_04_layer_ablation"](spark, sf).collect()}
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert (got["packs_and_baseline"]["tp"], got["packs_and_baseline"]["fn"]) == (n, 0)
    assert got["packs"]["tp"] + got["packs"]["fn"] == n and got["packs"]["fn"] > 0
    strict = {r["entity_type"]: r["recall"] for r in QUERIES["eval_01_strict_spans"](spark, sf).collect()}
    assert len(strict) >= 20 and sum(v == 1.0 for v in strict.values()) >= 13, strict
