"""Token files: ids of a public tokenizer, each document compressed by itself with one dictionary for all.

A file holds documents in ascending order of their id:

    magic | frames | index | footer

A frame is a document's ids, as little-endian unsigned integers of 2 bytes (4 where the vocabulary needs them), compressed
by zstandard with the dictionary of the folder. The index is an Arrow stream with a row for each document: doc_id (of the
table's own type), offset and length of its frame, start (ids of the file before it) and n_tokens. The footer has the
place of the index, the width and the SHA-256 of the dictionary, without which a file is not read. So one short document costs the
footer, the index and its own frame. The folder's ``manifest`` (Parquet) lists the files in order with the ids before each.

The dictionary is trained on the serialized ids of a sample of bounded size (``SAMPLE_DOCS`` pieces of at most ``PIECE`` code points,
drawn by hash). Everything else covers all documents. Texts are dealt out by ranges of doc_id, encoded, compressed and
written where they lie; only counts of files are summed up. A task that is repeated writes the same files anew: each appears
whole, under a name that its range gives.

The ids are those that the library gives for the whole text. Where the tokenizer's file says that it takes words one by one, a task has
each word encoded once and remembers it (a bounded number of them); any other tokenizer gets whole texts.

Nulls: a null text is an empty one; null ids come first. Rows that repeat an id are ordered by their texts' hash. An empty
table gives a folder without files. Names of other columns do not matter.
"""

from __future__ import annotations

import array
import functools
import hashlib
import io
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage import shared_dir
from ._common import bounded_batches, draw

MAGIC = b"VFTOKEN1"
_FOOTER = struct.Struct("<QQI32s8s")
#: Frames of a file, in bytes; a document that is larger has a file of its own.
FILE_BYTES = 16 << 20
SAMPLE_DOCS, PIECE, DICTIONARY_BYTES, LEVEL = 2000, 4096, 112_640, 3
#: What a task remembers of words and of what lies between two spaces: so many of each, none longer than so many signs.
KNOWN, KNOWN_SIGNS = 500_000, 64

#: How a tokenizer says that it drops white space, lowers case and takes words, digits and signs one by one.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = ("NFC", "Replace", "Lowercase")
#: The same words among signs about which all libraries agree: ASCII, Latin-1 letters and common punctuation.
_SPACE = re.compile("[\t-\r ]+")
_PLAIN = re.compile("[\t-\r -~¡-©«-±´¶-¸»¿-ÿœŒ–—‘-‟…€]*")
_PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿœ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿœ]+")


def _takes_words(config: dict) -> bool:
    """Whether the tokenizer is of the kind that _WORDS describes."""
    normal, before = config.get("normalizer") or {}, config.get("pre_tokenizer") or {}
    steps = before.get("pretokenizers") or [{}]
    replaced = [x for x in normal.get("normalizers") or [] if x["type"] == "Replace"]
    return (
        tuple(x["type"] for x in normal.get("normalizers") or ()) == _NORMALIZERS and all(x["pattern"] == {"Regex": r"\s+"} and x["content"] == " " for x in replaced)
        and [x.get("type") for x in steps] == ["Split", "ByteLevel"] and (steps[0]["pattern"], steps[0]["behavior"], steps[0]["invert"]) == ({"Regex": _WORDS}, "Removed", True)
        and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"] and not config.get("post_processor")
    )


class Encoder:
    """Text to the bytes of its ids, ``width`` each: always those that the library gives for the whole text. Where the tokenizer
    takes words one by one, each word is encoded once and remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = _takes_words(json.loads(self.tokenizer.to_str()))
        self.specials = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = "H" if self.width == 2 else "I"
        before = self.tokenizer.pre_tokenizer
        #: How the tokenizer writes each plain sign for its model, as it says itself.
        self.signs = {ord(c): w[0][0] for c in map(chr, range(0x2100)) if self.by_word and _PLAIN.fullmatch(c) and (w := before.pre_tokenize_str(c))}
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _bytes(self, ids: list[int]) -> bytes:
        return array.array(self.kind, ids).tobytes()

    def _library(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def _plain(self, text: str) -> bytes:
        """Ids of a text of plain signs without special tokens."""
        words, known = _PLAIN_WORDS.findall(text.lower()), self.words
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            new = [w for w in dict.fromkeys(words) if w not in known]
        if len(known) + len(new) > KNOWN:
            known.clear()
            new = list(dict.fromkeys(words))
        # a word is what the library's own steps would hand to its model
        model, table = self.tokenizer.model, self.signs
        known.update((w, self._bytes([t.id for t in model.tokenize(w.translate(table))])) for w in new)
        out = b"".join(map(known.__getitem__, words))
        for w in new:
            if len(w) > KNOWN_SIGNS:
                del known[w]
        return out

    def _is_plain(self, text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and not any(x in text for x in self.specials)

    def __call__(self, text: str) -> bytes:
        if not self.by_word:
            return self._library(text)
        if self._is_plain(text):
            return self._plain(text)
        # what lies between two spaces is encoded by itself; only what holds other signs goes to the library as it is
        out, known = [], self.chunks
        for c in _SPACE.split(text):
            if (ids := known.get(c)) is None:
                ids = self._plain(c) if self._is_plain(c) else self._library(c)
                if len(c) <= KNOWN_SIGNS:
                    if len(known) >= KNOWN:
                        known.clear()
                    known[c] = ids
            out.append(ids)
        return b"".join(out)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _place(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    """The store and the path in it: any that pyarrow knows."""
    return arrow_fs.FileSystem.from_uri(folder)


def _put(store: arrow_fs.FileSystem, path: str, content: bytes) -> None:
    """content appears whole: it is written under another name first."""
    own = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(own) as f:
        f.write(content)
    store.move(own, path)


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict:
    """A trained dictionary carries zstandard's own magic; anything else is taken as raw content."""
    trained = content[:4] == b"\x37\xa4\x30\xec"
    return zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


def train(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", seed: int = 11) -> bytes:
    """The dictionary: trained on serialized ids of a sample; where zstandard finds too little to train on, the sample itself."""
    n = docs.count()
    whole = F.coalesce(F.col(text), F.lit(""))
    u = draw(seed, F.col(key), F.xxhash64(whole))
    at = (draw(seed + 1, F.col(key), F.xxhash64(whole)) * F.greatest(F.length(whole) - PIECE, F.lit(0))).cast("int") + 1
    pieces = docs.where(u < 3.0 * SAMPLE_DOCS / max(n, 1)).select(u.alias("u"), F.substring(whole, at, F.lit(PIECE)).alias("piece")).distinct()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([to_ids(x) for x in b["piece"].to_pylist()], pa.binary())], ["ids"])

    drawn = pieces.orderBy("u", "piece").limit(SAMPLE_DOCS)
    sample = [bytes(r[0]) for r in drawn.mapInArrow(encode, "ids binary").collect() if r[0]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except (zstandard.ZstdError, ValueError, TypeError):
        return b"".join(sample)[:DICTIONARY_BYTES] or bytes(8)


class FileWriter:
    """One file in the making: frames in a buffer of bounded size."""

    def __init__(self, kind: pa.DataType, width: int, dictionary_sha: bytes):
        self.kind, self.width, self.sha = kind, width, dictionary_sha
        self.frames, self.size, self.tokens = [], 0, 0
        self.rows: tuple[list, list, list, list, list] = ([], [], [], [], [])

    def add(self, key, frame: bytes, n: int) -> None:
        for column, v in zip(self.rows, (key, len(MAGIC) + self.size, len(frame), self.tokens, n), strict=True):
            column.append(v)
        self.frames.append(frame)
        self.size += len(frame)
        self.tokens += n

    def content(self) -> bytes:
        kinds = [self.kind, pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        table = pa.table([pa.array(c, k) for c, k in zip(self.rows, kinds, strict=True)], ["doc_id", "offset", "length", "start", "n_tokens"])
        out = io.BytesIO()
        with pa.ipc.new_stream(out, table.schema) as w:
            w.write_table(table)
        index = out.getvalue()
        return b"".join([MAGIC, *self.frames, index, _FOOTER.pack(len(MAGIC) + self.size, len(index), self.width, self.sha, MAGIC)])


def write(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = 1) -> str:
    """Writes docs as token files into ``folder`` (a URI that driver and executors share); ``end`` is put behind each document."""
    bounded_batches(docs)
    dictionary = train(docs, tokenizer, key, text)
    sha = hashlib.sha256(dictionary).digest()
    store, top = _place(folder)
    store.create_dir(top, recursive=True)
    _put(store, f"{top}/dictionary-{sha.hex()}", dictionary)
    kind = docs.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(tokenizer)
        store, top = _place(folder)
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))
        last = np.array([end], f"<u{to_ids.width}").tobytes()
        now, no, part, schema = None, 0, 0, None

        def close() -> pa.RecordBatch:
            name = f"tokens-{part:06d}-{no:06d}"
            _put(store, f"{top}/{name}", content := now.content())
            row = [part, no, name, now.rows[0][0], now.rows[0][-1], len(now.rows[0]), now.tokens, len(content)]
            kinds = [pa.int32(), pa.int32(), pa.string(), schema, schema, pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["part", "no", "name", "first", "last", "docs", "tokens", "bytes"])

        for b in batches:
            schema = b.schema.field("key").type
            for k, t, part in zip(b["key"].to_pylist(), b["text"], b["part"].to_pylist(), strict=True):  # noqa: B007 - close() reads part
                ids = to_ids(t.as_py()) + last
                frame = squeeze.compress(ids)
                if now is not None and now.size + len(frame) > FILE_BYTES:
                    yield close()
                    now, no = None, no + 1
                if now is None:
                    now = FileWriter(schema, to_ids.width, sha)
                now.add(k, frame, len(ids) // to_ids.width)
        if now is not None:
            yield close()

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("key"), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").withColumn("part", F.spark_partition_id())
    found = dealt.mapInArrow(encode, f"part int, no int, name string, first {kind}, last {kind}, docs long, tokens long, bytes long")
    found.write.parquet(f"{folder}/files")
    # a row for each file: their counts alone are summed in one order
    before = Window.orderBy("part", "no").rowsBetween(Window.unboundedPreceding, -1)
    files = docs.sparkSession.read.parquet(f"{folder}/files")
    files.select("*", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"), F.lit(sha.hex()).alias("dictionary")).write.parquet(f"{folder}/manifest")
    return folder


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(part, no, name, first, last, docs, tokens, bytes, base, dictionary) of each file; base: ids of all files before it."""
    return spark.read.parquet(f"{folder}/manifest")


def _open(store: arrow_fs.FileSystem, path: str) -> tuple[pa.NativeFile, pa.Table, int, bytes]:
    """(file, index, width, SHA-256 of its dictionary), from footer and index alone."""
    f = store.open_input_file(path)
    size = f.size()
    f.seek(size - _FOOTER.size)
    at, length, width, sha, magic = _FOOTER.unpack(f.read(_FOOTER.size))
    if magic != MAGIC:
        raise ValueError(f"{path} is not a token file")
    f.seek(at)
    return f, pa.ipc.open_stream(f.read(length)).read_all(), width, sha


def _unpacker(store: arrow_fs.FileSystem, top: str):
    """sha -> decompressor; a dictionary whose hash is not the one asked for is refused."""
    known = {}

    def of(sha: bytes) -> zstandard.ZstdDecompressor:
        if sha not in known:
            with store.open_input_file(f"{top}/dictionary-{sha.hex()}") as f:
                content = f.read()
            if hashlib.sha256(content).digest() != sha:
                raise ValueError(f"the dictionary of {top} is not the one its files were written with")
            known[sha] = zstandard.ZstdDecompressor(dict_data=_dictionary(content))
        return known[sha]

    return of


def _ids(frame: bytes, unpack: zstandard.ZstdDecompressor, width: int) -> np.ndarray:
    return np.frombuffer(unpack.decompress(frame), f"<u{width}").astype("<u4")


def read(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document: start counts the ids of all documents before it. Files are read frame by
    frame, some documents to a batch."""
    files = manifest(spark, folder)
    kind = files.schema["first"].dataType.simpleString()
    chunk = 256 if ids else 4096

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _place(folder)
        unpackers = _unpacker(store, top)
        for b in batches:
            for name, base in zip(b["name"].to_pylist(), b["base"].to_pylist(), strict=True):
                f, index, width, sha = _open(store, f"{top}/{name}")
                unpack = unpackers(sha)
                with f:
                    f.seek(len(MAGIC))
                    for i in range(0, len(index), chunk):
                        part = index.slice(i, chunk).combine_chunks()
                        sums, wholes = [], []
                        for length in part["length"].to_pylist():
                            found = _ids(f.read(length), unpack, width)
                            sums.append(zlib.crc32(found.tobytes()))
                            if ids:
                                wholes.append(found.astype("<i4"))
                        start = pc.add(part["start"], base).combine_chunks()
                        columns = [part["doc_id"].combine_chunks(), start, part["n_tokens"].combine_chunks(), pa.array(sums, pa.int64())]
                        if ids:
                            columns.append(pa.array(wholes, pa.list_(pa.int32())))
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    n = files.count()
    dealt = files.select("name", "base").repartition(max(1, min(n, 20_000)))
    return dealt.mapInArrow(decode, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long{', ids array<int>' if ids else ''}")


def index(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, name, offset, length, start, n_tokens) of every document, from footers and indexes alone."""
    files = manifest(spark, folder)
    kind = files.schema["first"].dataType.simpleString()

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _place(folder)
        for b in batches:
            for name, base in zip(b["name"].to_pylist(), b["base"].to_pylist(), strict=True):
                f, found, _, _ = _open(store, f"{top}/{name}")
                f.close()
                found = found.set_column(3, "start", pc.add(found["start"], base)).append_column("name", pa.array([name] * len(found), pa.string()))
                yield from found.select(["doc_id", "name", "offset", "length", "start", "n_tokens"]).to_batches()

    dealt = files.select("name", "base").repartition(max(1, min(files.count(), 20_000)))
    return dealt.mapInArrow(entries, f"doc_id {kind}, name string, offset long, length long, start long, n_tokens long")


def lookup(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents whose doc_id is in ``wanted`` (one column): of their files only footers, indexes and
    the frames asked for are read."""
    entries = index(spark, folder)
    kind = entries.schema["doc_id"].dataType.simpleString()
    asked = wanted.distinct().toDF("_wanted")
    hits = entries.join(asked, F.col("doc_id").eqNullSafe(F.col("_wanted")), "left_semi")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _place(folder)
        unpackers, now, name = _unpacker(store, top), None, None
        for b in batches:
            out = []
            for path, at, length in zip(b["name"].to_pylist(), b["offset"].to_pylist(), b["length"].to_pylist(), strict=True):
                if path != name:
                    if now:
                        now[0].close()
                    name, now = path, _open(store, f"{top}/{path}")
                now[0].seek(at)
                out.append(_ids(now[0].read(length), unpackers(now[3]), now[2]).astype("<i4"))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["start"], b["n_tokens"], pa.array(out, pa.list_(pa.int32()))], ["doc_id", "start", "n_tokens", "ids"])
        if now:
            now[0].close()

    near = hits.repartition("name").sortWithinPartitions("name", "offset")
    return near.mapInArrow(fetch, f"doc_id {kind}, start long, n_tokens long, ids array<int>")


def new_folder(spark: SparkSession) -> str:
    """A folder for token files that all executors share; it goes when the application ends."""
    import atexit

    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            store, top = _place(folder)
            store.delete_dir(top)
        except OSError:
            pass

    atexit.register(drop)
    return folder
