"""Quality classification with supervised subword embeddings.

A document is the average of learned vectors of its hashed words and hashed character n-grams; a
softmax layer reads the label off the average. Vectors and layer are trained together by stochastic
gradient descent in numpy. The layer is linear, so at scoring time each bucket's vector is first
reduced to its difference of logits: scoring is one table look-up per n-gram of the whole text.

Nulls and empty texts have no n-gram and score by the bias alone. Equal texts score equally. With no
labelled row (or an empty table) the score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

from ._common import bounded_batches, bounded_sample, crc_mod, one_text_each
from ._words import U64, as_strings, mix, slices, split

ORDERS = (3, 5)
#: Bucket of the word pairs that repeat one word.
REPEAT = 12345


def grams(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word and every character n-gram of the texts."""
    n = len(texts)
    words = split(texts)
    rows, found = [words.doc], [(mix(words.hash, 101) % U64(buckets)).astype(np.int64)]
    same = np.flatnonzero((words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])) + 1
    rows.append(words.doc[same])  # a word pair is one n-gram more if it is the same word twice
    found.append(np.full(same.size, REPEAT % buckets, np.int64))
    strings = texts.to_pylist()
    sizes = np.fromiter(map(len, strings), np.int64, n)
    symbols = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(n), sizes)
    with np.errstate(over="ignore"):
        base = mix(symbols.astype(U64), 102)
        run, width, power = base, 1, U64(0xD6E8FEB86659FD93)
        for order in ORDERS:
            while width < order and run.size:
                run = run[:-1] * power + base[width:]
                width += 1
            if run.size and width == order:
                ok = doc[: run.size] == doc[width - 1 :]
                rows.append(doc[: run.size][ok])
                found.append(((run[ok] ^ (run[ok] >> U64(29))) * U64(0xBF58476D1CE4E5B9) >> U64(33)).astype(np.int64) % buckets)
    return np.concatenate(rows), np.concatenate(found)


@dataclass
class SubwordModel:
    """logit: per bucket, the difference of the two classes' logits; bias likewise."""

    logit: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.empty(len(texts))
        for lo, hi in slices(texts):
            row, bucket = grams(texts.slice(lo, hi - lo), self.logit.size)
            n = np.bincount(row, minlength=hi - lo)
            z = np.bincount(row, weights=self.logit[bucket], minlength=hi - lo) / np.maximum(n, 1) + self.bias
            out[lo:hi] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return out


def train(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, buckets: int, dim: int = 16, epochs: int = 8, rate: float = 0.5, seed: int = 4) -> SubwordModel:
    """Stochastic gradient descent over (buckets, shares) of each document. Classes weigh alike."""
    labels = np.asarray(labels, np.int64)
    if len(set(labels.tolist())) < 2:
        return SubwordModel(np.zeros(buckets, np.float32), 0.0 if not len(labels) else 4.0 * (2 * labels[0] - 1))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    layer, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    weight = len(labels) / (2 * np.bincount(labels, minlength=2))
    steps, done = epochs * len(labels), 0
    for _ in range(epochs):
        for i in rng.permutation(len(labels)):
            ids, share = examples[i]
            step = rate * (1 - done / steps) * weight[labels[i]]
            done += 1
            hidden = share @ vectors[ids] if ids.size else np.zeros(dim, np.float32)
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = layer @ p
            layer -= step * np.outer(hidden, p)
            bias -= 0.1 * step * p
            if ids.size:
                # each bucket moves by its share, as if its n-grams were met one by one
                vectors[ids] -= (step * share * min(ids.size, 64))[:, None] * back
    return SubwordModel((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", mod: int = 4, held_out: int = 2, rows_per_class: int = 1500, buckets: int = 1 << 16, seed: int = 4, buckets_per_row: int = 1 << 13) -> SubwordModel:
    """Learns from labelled rows whose crc32(id) mod ``mod`` is not ``held_out``, ``rows_per_class``
    of each class at most (drawn by hash). A row's n-grams are counted on the executors, over its whole text; the
    driver gets the counts of ``buckets_per_row`` buckets for a row at most, of a longer text those of least hash, which
    differ from row to row: 8 bytes each, 0.23 GB in all if every row is that long. An id labelled more than once counts by its
    largest label, and of rows that repeat an id the text of least hash is learned. Ids may be of any type that can be joined."""
    bounded_batches(docs)
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    known = known.where((crc_mod(F.col("_id"), mod) != held_out) & F.col("_y").isin(0, 1))
    picked = bounded_sample(known, "_y", "_id", rows_per_class, seed).groupBy("_id").agg(F.max("_y").alias("_y"))
    rows = one_text_each(docs, picked, id_col, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_strings(batch.column(2))
            for lo, hi in slices(texts):
                row, bucket = grams(texts.slice(lo, hi - lo), buckets)
                key, n = np.unique(row * buckets + bucket, return_counts=True)
                cut = np.searchsorted(key, np.arange(hi - lo + 1) * buckets)
                ids, counts = (key % buckets).astype(np.uint32), n.astype(np.float32)
                parts = []
                for i in range(hi - lo):
                    own = slice(cut[i], cut[i + 1])
                    if cut[i + 1] - cut[i] > buckets_per_row:
                        salted = mix(ids[own].astype(U64) ^ U64(ids[own].sum(dtype=np.uint64)), 105)
                        own = np.sort(cut[i] + np.argsort(salted, kind="stable")[:buckets_per_row])
                    parts.append((ids[own].tobytes(), counts[own].tobytes()))
                packed = [pa.array([p[k] for p in parts], pa.binary()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in (0, 1)), *packed], names=["id", "y", "ids", "counts"])

    rows = rows.select("_id", "_y", "_text")
    schema = StructType([StructField("id", rows.schema["_id"].dataType), StructField("y", IntegerType()), StructField("ids", BinaryType()), StructField("counts", BinaryType())])
    got = rows.mapInArrow(count, schema).collect()
    got.sort(key=lambda r: (r.id, r.ids))
    examples = []
    for r in got:
        c = np.frombuffer(r.counts, np.float32)
        examples.append((np.frombuffer(r.ids, np.uint32).astype(np.int64), c / max(c.sum(), 1)))
    return train(examples, np.array([r.y for r in got], np.int64), buckets, seed=seed)


def score(docs: DataFrame, model, text_col: str = "text", score_as: str = "score") -> DataFrame:
    """Adds the probability of label 1; any model with score(texts) will do. Other columns pass through."""
    bounded_batches(docs)
    kept = [f for f in docs.schema.fields if f.name != score_as]
    at = next(i for i, f in enumerate(kept) if f.name == text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(as_strings(batch.column(at))), pa.float64())], names=[f.name for f in kept] + [score_as])

    return docs.select(*[f.name for f in kept]).mapInArrow(run, StructType([*kept, StructField(score_as, DoubleType())]))
