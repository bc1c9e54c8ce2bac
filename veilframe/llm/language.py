"""Language identification by compression.

Each language has a raw-content dictionary, cut from a bounded sample of labelled texts. A text, lower-cased, is
compressed block by block with every dictionary; the language that makes it smallest wins. Blocks
are short, so the dictionary, not the text's own past, explains most of a block even in very long
texts; the sizes of all blocks of the whole text are added up.

The margin is the share by which the best code is shorter than the second best. What margin is narrow is learned for
each length: texts without a language (the letters of labelled pieces in random order, and random letters) are encoded as
well, and margins that all but one in a hundred of them stay below are rejected, yet no margin that one in two hundred
labelled pieces, kept out of the dictionaries, stays below.

Nulls, empty texts and texts without a letter are ``und`` with score 0 and rejected. Equal sizes go
to the language with more training rows, then by name. Repeated rows get equal results. With no
labelled row (or an empty table) every text is ``und``. Columns other than the named ones pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from ._common import bounded_batches, bounded_sample, crc_mod
from ._words import as_strings, buffers

UNDETERMINED = "und"
#: Margins below this are narrow at any length.
LEAST_MARGIN = 0.002


@dataclass
class CompressionModel:
    """langs in order of preference on ties; one dictionary for each."""

    langs: list[str]
    dictionaries: list[bytes]
    block: int = 1024
    level: int = 3
    #: (bytes, margin) ascending: texts of up to so many bytes are rejected below that margin; the last one holds for longer texts.
    narrow: list[tuple[int, float]] = field(default_factory=list)
    _coders: list | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_coders": None}

    def coders(self) -> list:
        if self._coders is None:
            self._coders = []
            for raw in self.dictionaries:
                d = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
                params = zstd.ZstdCompressionParameters(
                    compression_level=self.level, window_log=20, hash_log=18, chain_log=18, min_match=3, strategy=zstd.STRATEGY_LAZY, search_log=4,
                    write_content_size=False, write_checksum=False, write_dict_id=False,
                )
                d.precompute_compress(compression_params=params)
                self._coders.append(zstd.ZstdCompressor(dict_data=d, compression_params=params))
        return self._coders

    def sizes(self, text: bytes) -> np.ndarray:
        """Compressed bytes by language, summed over all blocks, without what every frame costs."""
        view, out = memoryview(text), np.zeros(len(self.langs), np.int64)
        if not self.langs:
            return out
        for at in range(0, len(text), self.block):
            part = view[at : at + self.block]
            out += [len(c.compress(part)) - 4 for c in self.coders()]
        return out

    def narrow_below(self, size: int) -> float:
        """The margin below which a text of so many bytes is rejected."""
        return next((m for most, m in self.narrow if size <= most), self.narrow[-1][1] if self.narrow else LEAST_MARGIN)

    def classify(self, text: bytes) -> tuple[str, float]:
        """The language and the share by which its code is shorter than the runner-up's."""
        s = self.sizes(text)
        if s.size == 0:
            return UNDETERMINED, 0.0
        order = np.argsort(s, kind="stable")
        if s.size == 1:
            return self.langs[0], 1.0
        best, second = int(s[order[0]]), int(s[order[1]])
        return self.langs[order[0]], float(min(1.0, max(0.0, (second - best) / max(second, 1))))


def narrow_margins(model: CompressionModel, pieces: list[tuple[str, str]], seed: int = 7, least: int = 32) -> list[tuple[int, float]]:
    """(bytes, margin) for lengths that double from ``least`` to that of the longest piece. pieces: text and language, none of them in a dictionary."""
    rng, out, size = np.random.default_rng(seed), [], least
    letters = sorted({c for text, _ in pieces for c in text if c.isalpha()})
    longest = max((len(text.encode()) for text, _ in pieces), default=0)
    while letters and size <= longest:
        right, without = [], []
        for text, lang in pieces:
            if len(text.encode()) < size:
                continue
            part = text.encode()[:size].decode(errors="ignore")
            found, margin = model.classify(part.encode())
            right += [margin] if found == lang else []
            without.append(model.classify("".join(rng.permutation(list(part))).encode())[1])
            without.append(model.classify("".join(rng.choice(letters, len(part))).encode())[1])
        if right:
            out.append((size, max(LEAST_MARGIN, float(min(np.quantile(without, 0.99) + 1e-9, np.quantile(right, 0.005))))))
        size *= 2
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out_mod: int = 5, rows_per_lang: int = 800, dictionary_bytes: int = 200 << 10, seed: int = 7, apart: int = 8) -> CompressionModel:
    """Learns from rows with a language whose crc32(id) mod ``held_out_mod`` is not 0, at most
    ``rows_per_lang`` of each language (by hash), a piece from a place in each chosen by hash, and ``dictionary_bytes`` of their
    text. One sampled row in ``apart`` (and so many pieces at most that all languages have 400 together) is kept out of the
    dictionaries and tells which margins are narrow. Languages beyond the 256 most frequent are not learned, which bounds the model. The
    sample is cut on the executors, so the driver gets at most rows x bytes / rows of each."""
    bounded_batches(docs)
    each = max(256, 2 * dictionary_bytes // rows_per_lang)
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = known.where((crc_mod(F.col("id"), held_out_mod) != 0) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # a piece from anywhere in the text, so that a common opening is not all that is learned
    start = 1 + F.pmod(F.xxhash64(F.lit(seed), "id"), F.greatest(F.length("text") - each, F.lit(0)) + 1).cast("int")
    rows = bounded_sample(known.select("id", "lang", F.substring("text", start, F.lit(each)).alias("text")), "lang", "id", rows_per_lang, seed).collect()
    by_lang: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r._u, r.id, r.text)):
        by_lang.setdefault(r.lang, []).append(r.text.lower())
    share = {k: len(v) for k, v in by_lang.items()}
    langs = sorted(by_lang, key=lambda k: (-share[k], k))
    each_apart = -(-400 // max(1, len(langs)))
    kept_out = {k: by_lang[k][apart - 1 :: apart][:each_apart] for k in langs}
    learned = {k: [x for i, x in enumerate(by_lang[k]) if i % apart != apart - 1 or i // apart >= each_apart] for k in langs}
    model = CompressionModel(langs, ["\n".join(learned[k][:rows_per_lang]).encode()[:dictionary_bytes] for k in langs])
    model.narrow = narrow_margins(model, [(x, k) for k in langs for x in kept_out[k]], seed)
    return model


def identify(docs: DataFrame, model: CompressionModel, text_col: str = "text", min_margin: float | None = None, lang_as: str = "lang_pred", score_as: str = "score", rejected_as: str = "rejected") -> DataFrame:
    """Adds the language, the margin and whether the row is rejected: no letter, or a margin below the one learned
    for its length (``min_margin``, if given, for all lengths)."""
    bounded_batches(docs)
    extra = [StructField(lang_as, StringType()), StructField(score_as, DoubleType()), StructField(rejected_as, BooleanType())]
    kept = [f for f in docs.schema.fields if f.name not in (lang_as, score_as, rejected_as)]
    at = next(i for i, f in enumerate(kept) if f.name == text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.utf8_lower(as_strings(batch.column(at)))
            letters = pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False)
            raw, off = buffers(texts)
            langs, scores = [], np.zeros(len(texts))
            for i in range(len(texts)):
                lang, scores[i] = model.classify(raw[off[i] : off[i + 1]].tobytes()) if letters[i] else (UNDETERMINED, 0.0)
                langs.append(lang)
            least = np.array([model.narrow_below(n) for n in np.diff(off)]) if min_margin is None else min_margin
            rejected = np.array([x == UNDETERMINED for x in langs], bool) | (scores < least)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected)], names=[f.name for f in [*kept, *extra]])

    return docs.select(*[f.name for f in kept]).mapInArrow(run, StructType([*kept, *extra]))
