"""Keyword lists and known values against alternations and plain replacement."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veilframe.operators import keywords


@pytest.mark.parametrize("most", [100_000, 40])
def test_lists_against_alternation(spark, monkeypatch, most):
    """Words within words, signs at borders, letters of two cases; one automaton and several."""
    monkeypatch.setattr(keywords, "LIST_MOST", most)
    rng = random.Random(5)
    signs = "abcAB-. é_1"
    words = sorted({"".join(rng.choice("abc-.é1 ") for _ in range(rng.randrange(1, 6))).lower() for _ in range(150)})
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(80))) for _ in range(200)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("w", F.lit(1))
    got = keywords.keyword_spans(docs, spark.createDataFrame([(w,) for w in words] + [("",), (None,), (words[0].upper(),)], "keyword string")).collect()
    pattern = re.compile(r"\b(?:" + "|".join(map(re.escape, words)) + r")\b", re.I)
    want = [(i, m.start(), m.end(), m[0]) for i, t in enumerate(texts) for m in pattern.finditer(t or "")]
    assert sorted(map(tuple, got)) == sorted(want)


def test_known_values_against_plain():
    rng = random.Random(6)
    for _ in range(500):
        known = [("".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))), f"[{i}]") for i in range(rng.randrange(6))]
        text = "".join(rng.choice("abc ") for _ in range(60))
        want = text
        for k in sorted(dict(known), key=len, reverse=True):
            want = want.replace(k, dict(reversed(known))[k])
        assert keywords.replaced(text, known) == want


def test_placeholders_are_not_looked_into():
    assert keywords.replaced("Anna met A", [("Anna", "[A_1]"), ("A", "[X]")]) == "[A_1] met [X]"


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None), (2, "x", None), (3, "aa", [("a", "b"), ("", "z")])], "doc_id long, text string, map array<struct<original:string,placeholder:string>>")
    assert [r["replaced"] for r in keywords.replace_known(df).orderBy("doc_id").collect()] == [None, "x", "bb"]
    assert keywords.keyword_spans(df, df.select(F.lit(None).cast("string").alias("keyword"))).collect() == []
