"""What patterns must hold, and that nothing is lost by asking for it first."""

import random
import re

import pyarrow.parquet as pq
import pytest

from veilframe.operators import cues, rules, scan


@pytest.mark.parametrize(
    ("pattern", "words"),
    [
        (r"(?:SSN|social\s*security)", {"ssn", "security"}), (r"https?://[^\s]+", {"http"}), (r"\d{4}-\d{2}", {"-"}), (r"[A-Z]{2}\d+", None), (r"(?:abc)?x+", None), (r"(?:abc|de)+f", {"abc", "de"}), (r"a@b|cd", {"a@b", "cd"}), (r"(?=abc)\w+", None),
    ],
)
def test_words(pattern, words):
    assert cues.words_of(pattern) == (None if words is None else frozenset(words))


def test_every_match_holds_a_word():
    rng = random.Random(1)
    every = [r for p in rules.PACKS.values() for r in p] + list(rules.BASELINE)
    known = [(re.compile(x, re.I), w) for r in every for x in (r.pattern, r.before) if x and (w := cues.words_of(x))]
    assert len(known) > 20
    texts = ["ssn İMEİ: 356938035643812 ıMEI=", "ſsn SOCIAL  SECURITY Führerschein VERGİ no", "PASSPORT паспорт ПАСПОРТ DRIVER'S LICENSE d.o.b. Tax ID kart MRN-1 Health Insurance"]
    words = sorted({w for _, ws in known for w in ws})
    texts += [" ".join(rng.choice([w, w.upper(), w.title()]) for w in rng.sample(words, 5)) + " 12345678" for _ in range(500)]
    for t in texts:
        for pattern, ws in known:
            if pattern.search(t):
                assert any(w in cues.fold(t) for w in ws), (pattern.pattern, t)


def test_scans_are_the_same_without_cues(sf):
    """All rules over the documents, each beside a line that gives rules something to find."""
    every = rules.compose(rules.PACKS).rules
    fast, slow = scan.Scanner(every), scan.Scanner(every)
    slow.cues.of = lambda text: -1
    line = "\nIBAN DE89370400440532013000\nName:\n Anna \nborn on 12.03.1970 IMEI: 356938035643812 SSN 078-05-1120 cpf 529.982.247-25 passport P1234567 driver's license D1234567 tax id 12-3456789 plate no 34 ABC 12 TC kimlik 10000000146 MRN-12345678"
    for i, t in enumerate(pq.read_table(f"{sf}/documents.parquet", columns=["text"])["text"].to_pylist()):
        t = (t or "") + (line[: 20 * (i % 20)] if i % 2 else "")
        assert fast.find(t) == slow.find(t)


@pytest.mark.parametrize(
    ("pattern", "need"),
    [
        (r"\b\d{17}[\dXx]\b", (17, 32, False)), (r"2[0-4]\d|[A-Z]\d{3,5}", (3, 8, False)), (r"\d{1,3}(?:\.\d{4})+", None), (r"\d{1,2}\s*\d{4}", (5, 32, True)), (r"[A-Z0-9]{5}", None), (r"(?<!x)\d{4}", None), (r"(?:ab)?\d{2}", (2, 4, False)), (r"\d{0,3}x", None),
    ],
)
def test_digits(pattern, need):
    assert cues.digits_of(pattern) == (need if need is None or not need[2] else (4, *need[1:]))


def test_zones_lose_and_add_nothing():
    """Rules that need digits searched whole texts, however few digits those had."""
    rng = random.Random(5)
    every = rules.compose(rules.PACKS).rules
    fast, slow = scan.Scanner(every), scan.Scanner(every)
    assert sum(n is not None for n in fast.needs) > 35
    slow.needs = [None] * len(every)
    parts = ["born on", "TC Kimlik No", "national", "passport", "tax id", "SSN", "cpf", "plate no", "+1", "(", ")", "-", ".", "/", ":", ",", "\n", " ", "  ", " " * 15, " " * 40, "." * 18, "DE", "MRN", "A", "x", "word und mehr text " * 9, "march", "de", "41.", "IMEI=", "٣٤٥٦٧٨٩٠"]
    found = 0
    for _ in range(4000):
        t = "".join(rng.choice(parts) if rng.random() < 0.5 else "".join(rng.choices("0123456789", k=rng.choice([1, 2, 2, 3, 3, 4, 5, 7, 8, 10, 11, 18]))) for _ in range(rng.randrange(1, 30)))
        got = fast.find(t)
        assert got == slow.find(t), t
        found += len(got)
    assert found > 1000
    spread = "word " * 2000 + "on 12.03.1970 " + "word " * 2000
    assert sum(b - a for a, b in cues.Zones(spread).of(cues.digits_of(rules.BIRTH_DATE))) < 600
