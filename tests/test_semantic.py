"""Splitting by meaning against a plain version, and guesses of the language."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from veilframe.operators import semantic


def plain_split(text, least):
    s = re.split(r"(?<=[.?!])\s+", text)
    if len(s) > 2:
        v = [semantic.hashed_words([" ".join(s[max(i - 1, 0) : i + 2])])[0] for i in range(len(s))]
        d = [1 - float(a @ b) / float(np.sqrt(a @ a) * np.sqrt(b @ b)) for a, b in zip(v, v[1:], strict=False)]
        g = [d[1] - d[0]] + [(d[i + 1] - d[i - 1]) / 2 for i in range(1, len(d) - 1)] + [d[-1] - d[-2]]
        o = sorted(g)
        at = 0.95 * (len(o) - 1)
        q = o[int(at)] + (o[min(int(at) + 1, len(o) - 1)] - o[int(at)]) * (at - int(at))
        parts, now = [], []
        for i, x in enumerate(s):
            now.append(x)
            if i < len(g) and g[i] > q + 1e-12:
                parts.append(" ".join(now))
                now = []
        s = parts + ([" ".join(now)] if now else [])
    long = [p for p in s if len(p.strip()) >= least]
    return long or [text]


def test_split_against_plain(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    texts = ["".join(rng.choice(words[20 * (n // 9) : 20 * (n // 9) + 20]) + rng.choice([" "] * 6 + [". ", "?\n"]) for n in range(rng.randrange(1, 27)) for _ in range(6)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(100, None), (101, " "), (102, "One."), (103, "One. Two.")], "doc_id long, text string")
    got = {}
    for r in semantic.split_by_meaning(df, semantic.hashed_words, least=10).orderBy("doc_id", "index").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got == {i: plain_split(t, 10) for i, t in [*enumerate(texts), (102, "One."), (103, "One. Two.")]}
    assert sum(len(v) > 1 for v in got.values()) > 30


def test_a_model_that_fails_gives_paragraphs(spark):
    def broken(texts):
        raise RuntimeError("no model")

    text = "\n\n".join(f"Paragraph {i}. " + "x" * 500 for i in range(5))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for embed in (broken, None):
        got = [r["text"] for r in semantic.split_by_meaning(df, embed).orderBy("index").collect()]
        assert len(got) == 3 and "\n\n".join(got) == text and all(len(t) <= 1200 for t in got)


def test_guesses(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 200")
    found = semantic.guess_language(docs, semantic.profiles(docs.where("doc_id % 2 = 0"))).withColumnRenamed("lang", "guess").join(docs, "doc_id").where("doc_id % 2 = 1")
    right = found.agg(F.avg((F.col("guess") == F.col("lang")).cast("int"))).first()[0]
    assert right > 0.95, right


def test_equal_gradients_break_nothing():
    """Gradients that are equal but for rounding: only one above the percentile by more than that breaks a text."""
    found = np.array([0.1, 0.3, 0.1 + 0.2 + 0.2, 0.7, 0.1 + 0.8, 1.1, 1.3])
    slope = np.gradient(found)
    assert len(set(slope)) > 1 and np.ptp(slope) < 1e-12
    assert semantic.breaks(found) == []
    assert semantic.breaks(np.array([0.1, 0.1, 0.1, 0.9, 0.5])) == [2]


def test_profiles_against_plain(spark, monkeypatch):
    """Short texts, repeated ids, letters beyond the first plane, null languages; languages one at a time. No row is made for a sequence."""
    import collections
    import math
    import re

    from pyspark.sql import functions as F

    from veilframe.operators import semantic

    monkeypatch.setattr(semantic, "PROFILE_LANGS", 1)
    data = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, "", "de"), (4, "x", None), (5, None, "en"), (6, "𐐀𐐨 the 12", "en"), (6, "und der", "de"), (7, "!?", "en"), (8, "qqqq", None)]
    docs = spark.createDataFrame(data, "doc_id int, text string, lang string")
    cut = lambda t: (lambda x: [x[i : i + 3] for i in range(max(len(x) - 2, 1))])(" " + re.sub(r"[\W\d_]+", " ", t.lower()) + " ")
    n = collections.defaultdict(collections.Counter)
    for _, t, lang in data:
        if t is not None and lang:
            n[lang].update(cut(t))
    found = semantic.gram_counts(docs)
    assert {(r.lang, r.gram): r.n for r in found.collect()} == {(k, g): c for k, v in n.items() for g, c in v.items()}
    kept = {g for v in n.values() for g in v}
    weight = {k: {g: round(math.log((v[g] + 0.5) / (sum(v.values()) + 0.5)) * 1_000_000) for g in kept} for k, v in n.items()}
    sums = collections.defaultdict(collections.Counter)
    for i, t, _ in data:
        for k in weight if t is not None else ():
            if known := [weight[k][g] for g in cut(t) if g in kept]:
                sums[i][k] += sum(known)
    want = sorted((i, min(sums[i], key=lambda k: (-sums[i][k], k)) if sums[i] else "en") for i, _, _ in data)
    guess = semantic.guess_language(docs, semantic.profiles(docs))
    assert sorted((r.doc_id, r.lang) for r in guess.collect()) == want
    assert "Generate" not in guess._jdf.queryExecution().toString()
    assert [r.lang for r in semantic.guess_language(docs.limit(1), semantic.profiles(docs.limit(0))).select(F.col("lang")).collect()] == ["en"]
