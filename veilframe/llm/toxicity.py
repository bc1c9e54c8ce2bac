"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities of a seed lexicon and of a lexicon learned from the training rows
(words and word beginnings far more frequent in toxic texts), distance of second-person words to
lexicon words, shares of capitals, punctuation and digits, and rates of obfuscation (signs inside
words, digits for letters, letters spaced out, stretched letters). Trees are grown in numpy over
binned features; isotonic regression on rows kept apart from the trees maps margins to probabilities.

Nulls and empty texts have all features 0 and are scored like any other row. Equal texts score
equally. With no labelled row (or an empty table) the score is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ._common import bounded_batches, bounded_sample, crc_mod, one_text_each
from ._words import as_strings

#: Words of insult and of address.
INSULTS = frozenset("""
    idiot idiots moron morons stupid dumb fool fools loser losers clown clowns trash garbage scum worthless pathetic disgusting
    imbecile cretin jerk creep freak vermin filth filthy coward liar ugly useless hate kill die shut crap damn bastard
    idiota imbecil estupido estúpido basura asco inútil tonto payaso cerdo
    idiote imbécile crétin stupide ordure déchet minable connard salaud dégoûtant
    idiot trottel dummkopf abschaum müll versager widerlich erbärmlich schwachkopf dreckig
""".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes".split())
LEET = str.maketrans("013457@$!", "oieastasi")

_WORD = re.compile(r"[^\W\d_]+")
_SIGNS_WITHIN = re.compile(r"[^\W\d_][0-9@$!*]+[^\W\d_]")
_SPACE = re.compile(r"\s")
_SPACED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?![^\W\d_])")
_NEAR = 6


def _kind(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_CAPITAL = _kind(bytes(range(65, 91)))
_LETTER = _CAPITAL | _kind(bytes(range(97, 123))) | _kind(bytes(range(128, 256)))
_DIGIT = _kind(b"0123456789")
_SIGN = ~(_LETTER | _DIGIT | _kind(b"_ ") | _kind(bytes(range(0, 32))))
_FOR_LETTER = _DIGIT | _kind(b"@$!*")
_BETWEEN = _kind(b" .-_*")

FEATURES = ("seed", "seed_any", "learned", "learned_any", "learned_weight", "stem", "stem_any", "hidden", "hidden_any", "you", "you_near", "capitals", "shouted", "signs", "exclaimed", "digits", "mixed", "spaced", "stretched", "log_words")


@dataclass
class Lexicon:
    """Learned words and word beginnings with their log odds."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)


STEMS = (4, 5, 6)


def _look_up(word: str, lexicon: Lexicon, known: dict) -> tuple[bool, bool, float, bool]:
    """Seed, learned, its weight, stem; known: what was looked up before."""
    if (got := known.get(word)) is None:
        if len(known) > 200_000:
            known.clear()
        got = known[word] = (word in INSULTS, word in lexicon.words, lexicon.words.get(word, 0.0), any(word[:k] in lexicon.stems for k in STEMS))
    return got


def mixed_words(text: str) -> list[str]:
    """Words between blanks in which signs or digits stand between letters; linear however long a word is."""
    out, at = [], 0
    while m := _SIGNS_WITHIN.search(text, at):
        a, after = m.start(), _SPACE.search(text, m.end())
        while a > at and not text[a - 1].isspace():
            a -= 1
        at = after.start() if after else len(text)
        out.append(text[a:at])
    return out


def features(text: str, lexicon: Lexicon, known: dict | None = None) -> list[float]:
    known = {} if known is None else known
    low = _WORD.findall(text.lower())
    counts = Counter(low)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n, chars = max(1, len(low)), max(1, raw.size)
    seed = hits = stem = 0
    weight = 0.0
    marked = set()
    for w, c in counts.items():
        a, b, odds, st = _look_up(w, lexicon, known)
        if a or b or st:
            seed, hits, stem, weight = seed + a * c, hits + b * c, stem + st * c, weight + odds * min(c, 3)
            if a or b:
                marked.add(w)
    letter, between, instead, capital = _LETTER[raw], _BETWEEN[raw], _FOR_LETTER[raw], _CAPITAL[raw]
    mixed = mixed_words(text) if (instead[:-1] & letter[1:]).any() else []
    spaced = []
    if raw.size > 6 and (letter[:-6] & between[1:-5] & letter[2:-4] & between[3:-3] & letter[4:-2] & between[5:-1] & letter[6:]).any():
        spaced = _SPACED.findall(text)
    hidden = sum(any(x in INSULTS or x in lexicon.words for x in _WORD.findall(h)) for h in [m.lower().translate(LEET) for m in mixed] + [re.sub(r"[ .\-_*]", "", m).lower() for m in spaced])
    spoken, near = sum(counts[w] for w in SECOND_PERSON & counts.keys()), 0
    if spoken and marked:
        marks = np.array([i for i, w in enumerate(low) if w in marked])
        you = np.array([i for i, w in enumerate(low) if w in SECOND_PERSON])
        at = np.searchsorted(marks, you)
        near = int((np.minimum(abs(marks[np.minimum(at, len(marks) - 1)] - you), abs(marks[np.maximum(at - 1, 0)] - you)) <= _NEAR).sum())
    stretched = (letter[2:] & (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2])).sum() if raw.size > 2 else 0
    return [
        seed / n, min(seed, 5), hits / n, min(hits, 5), min(20.0, weight), stem / n, min(stem, 5), hidden / n, min(hidden, 5),
        spoken / n, near / n, capital.sum() / chars, (capital[1:] & capital[:-1]).sum() / chars, _SIGN[raw].sum() / chars, text.count("!") / chars,
        _DIGIT[raw].sum() / chars, len(mixed) / n, len(spaced) / n, stretched / n, float(np.log1p(len(low))),
    ]


def learn_lexicon(counts: list[tuple[str, str, int, int]], toxic: int, clean: int, least_rows: int = 5, least_odds: float = 2.5, most: int = 5000) -> Lexicon:
    """From (kind, term, rows of toxic texts, rows of clean texts)."""
    out = Lexicon()
    scored = []
    for kind, term, a, b in counts:
        odds = float(np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1)))
        if a >= least_rows and odds >= least_odds:
            scored.append((-odds, kind, term))
    for odds, kind, term in sorted(scored)[:most]:
        (out.words if kind == "word" else out.stems)[term] = -odds
    return out


@dataclass
class Boosted:
    """Trees as arrays: feature, threshold, left, right, value; a leaf has feature -1."""

    base: float
    trees: list[tuple[np.ndarray, ...]]
    knots: tuple[np.ndarray, np.ndarray]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                inner = np.flatnonzero(feature[at] >= 0)
                if not inner.size:
                    break
                node = at[inner]
                at[inner] = np.where(x[inner, feature[node]] <= threshold[node], left[node], right[node])
            out += value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots[0]):
            return np.zeros(len(x))
        return np.interp(self.margin(x), *self.knots)


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; the knots run through the middle of each block, ends slightly inside 0 and 1."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # rows, sum of y, sum of margins
    for m, t in zip(margin[order], y[order], strict=True):
        blocks.append([1.0, float(t), float(m)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n, s, z = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n, blocks[-1][1] + s, blocks[-1][2] + z]
    at, p = np.array([b[2] / b[0] for b in blocks]), np.array([(b[1] + 0.05) / (b[0] + 0.1) for b in blocks])
    return at, np.maximum.accumulate(p)


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, penalty: float = 1.0, least: int = 8, calibrate: float = 0.3, seed: int = 10) -> Boosted:
    """Second-order boosting of the logistic loss. A share ``calibrate`` of the rows only calibrates."""
    if not len(y):
        return Boosted(0.0, [], (np.zeros(0), np.zeros(0)))
    y = y.astype(float)
    apart = np.random.default_rng(seed).random(len(y)) < calibrate
    if len(set(y[~apart])) < 2 or len(set(y[apart])) < 2:
        return Boosted(0.0, [], (np.zeros(1), np.array([y.mean()])))
    tx, ty = x[~apart], y[~apart]
    cuts = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, bins)[1:-1])) for c in tx.T]
    code = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, tx.T, strict=True)], 1)
    base = float(np.log(ty.mean() / (1 - ty.mean())))
    f, trees = np.full(len(ty), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = p - ty, p * (1 - p)
        feature, threshold, left, right, value = [-1], [0.0], [0], [0], [0.0]
        open_nodes = [(0, np.arange(len(ty)), 0)]
        while open_nodes:
            node, rows, level = open_nodes.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            value[node] = -rate * gs / (hs + penalty)
            best = (1e-6, -1, -1)
            for j, c in enumerate(cuts if level < depth and len(rows) >= 2 * least else []):
                if not c.size:
                    continue
                k = code[rows, j]
                gl, hl, nl = (np.cumsum(np.bincount(k, w, c.size + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                gain = gl**2 / (hl + penalty) + (gs - gl) ** 2 / (hs - hl + penalty) - gs**2 / (hs + penalty)
                gain[(nl < least) | (len(rows) - nl < least)] = -1
                if gain.max() > best[0]:
                    best = (float(gain.max()), j, int(gain.argmax()))
            if best[1] >= 0:
                _, j, k = best
                feature[node], threshold[node] = j, float(cuts[j][k])
                low = code[rows, j] <= k
                for side, part in ((left, rows[low]), (right, rows[~low])):
                    side[node] = len(feature)
                    for a, v in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (value, 0.0)):
                        a.append(v)
                    open_nodes.append((side[node], part, level + 1))
        tree = tuple(np.array(a) for a in (feature, threshold, left, right, value))
        trees.append(tree)
        f = f + Boosted(0.0, [tree], (np.zeros(0), np.zeros(0))).margin(tx)
    model = Boosted(base, trees, (np.zeros(0), np.zeros(0)))
    model.knots = isotonic(model.margin(x[apart]), y[apart])
    return model


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: Boosted

    def score(self, texts: pa.Array) -> np.ndarray:
        out, known = np.zeros(len(texts)), {}
        for lo in range(0, len(texts), 512):
            part = texts.slice(lo, 512).to_pylist()
            out[lo : lo + len(part)] = self.trees.probability(np.array([features(t, self.lexicon, known) for t in part]).reshape(-1, len(FEATURES)))
        return out


def terms(text: str) -> set[tuple[str, str]]:
    words = {w.lower() for w in _WORD.findall(text) if len(w) <= 40}
    return {("word", w) for w in words} | {("stem", w[:k]) for w in words for k in STEMS if len(w) >= k}


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", mod: int = 5, held_out: int = 0, rows_per_class: int = 3000, seed: int = 10) -> ToxicityModel:
    """Learns from labelled rows whose crc32(id) mod ``mod`` is not ``held_out``, at most ``rows_per_class``
    of each class (drawn by hash). The lexicon comes from one half of them, the trees from the other, so that
    lexicon features are as good in training as on new texts. An id labelled more than once counts by its
    largest label, and of rows that repeat an id the text of least hash is learned. Ids may be of any type that can be joined."""
    bounded_batches(docs)
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    known = known.where((crc_mod(F.col("_id"), mod) != held_out) & F.col("_y").isin(0, 1))
    picked = bounded_sample(known, "_y", "_id", rows_per_class, seed).groupBy("_id").agg(F.max("_y").alias("_y"), F.min("_u").alias("_u"))
    rows = one_text_each(docs, picked, id_col, text_col)
    rows = rows.withColumn("_half", F.pmod(F.xxhash64(F.lit(seed + 1), "_id"), F.lit(2))).select("_id", "_y", "_half", "_text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], list[int]] = {}
        for batch in batches:
            for y, text in zip(batch.column(1).to_pylist(), as_strings(batch.column(3)).to_pylist(), strict=True):
                for t in terms(text):
                    seen.setdefault(t, [0, 0])[1 - y] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], names=["kind", "term", "a", "b"])

    half = rows.where("_half = 0")
    sizes = {r._y: r["count"] for r in picked.withColumn("_half", F.pmod(F.xxhash64(F.lit(seed + 1), "_id"), F.lit(2))).where("_half = 0").groupBy("_y").count().collect()}
    counted = half.mapInArrow(count, "kind string, term string, a long, b long").groupBy("kind", "term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a >= 5 and a > 2 * b")
    lexicon = learn_lexicon([tuple(r) for r in counted.collect()], sizes.get(1, 0), sizes.get(0, 0))

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            x = [features(t, lexicon, known) for t in as_strings(batch.column(3)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["id", "y", "x"])

    schema = StructType([StructField("id", rows.schema["_id"].dataType), StructField("y", IntegerType()), StructField("x", ArrayType(DoubleType()))])
    got = rows.where("_half = 1").mapInArrow(dense, schema).collect()
    got.sort(key=lambda r: (r.id, r.x))
    return ToxicityModel(lexicon, boost(np.array([r.x for r in got]).reshape(-1, len(FEATURES)), np.array([r.y for r in got])))
