"""Token files: ids against the library's on whole texts, exact round trips, access to single documents."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyarrow import fs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilframe.llm import queries, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def plain(library, texts):
    return [x.ids + [1] for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_words_are_encoded_as_whole_texts(library):
    rng = random.Random(2)
    signs = "abzAZ09 \t\n\r\x0b\x0c\x1c\x85\xa0éÉßİıǅΣςσ'’́̈ 　中文한ﬁ½²ª🙂_-.,!<|>"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["", " ", "it's WE'LL don't 's", "a<|endoftext|>b <|startoftext|> x", "x" * 5000, "é ́e", "A  B"]
    encode = tokens.Encoder(PATH)
    for t in texts:
        assert np.frombuffer(encode(t), "<u2").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_ids_of_the_whole_table(library):
    import pyarrow.parquet as pq

    encode = tokens.Encoder(PATH)
    for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist():
        assert np.frombuffer(encode(t), "<u2").tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokenizers_of_both_kinds(name):
    """A tokenizer that keeps spaces gets whole texts."""
    path = public_tokenizers.path(name)
    library, encode = Tokenizer.from_file(path), tokens.Encoder(path)
    assert encode.by_word == name.startswith("word")
    for t in ("Two  spaces, it's\n\nfine. ", " élan – 12", "a<|endoftext|>b", "x\u0301 中文"):
        assert np.frombuffer(encode(t), "<u2").tolist() == library.encode(t, add_special_tokens=False).ids


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN", 50)
    encode = tokens.Encoder(PATH)
    for i in range(40):
        encode(" ".join("w" * j for j in range(i, i + 5)) + " " + "y" * 100)
        encode(" ".join("ж" * j for j in range(i, i + 5)) + " " + "z" * 100)
        for known in (encode.words, encode.chunks):
            assert len(known) <= 50 and all(len(w) <= tokens.KNOWN_SIGNS for w in known)


def test_op11(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id")
    got = queries.op11_tokens(spark, sf).toPandas().sort_values("start").reset_index(drop=True)
    ids = plain(library, docs["text"])
    assert got["doc_id"].tolist() == docs["doc_id"].tolist()
    assert got["n_tokens"].tolist() == [len(x) for x in ids]
    assert got["start"].tolist() == np.cumsum([0] + [len(x) for x in ids])[:-1].tolist()
    assert got["ids_crc32"].tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]


def test_files_and_single_documents(spark, tmp_path, library, monkeypatch):
    """Files of a few kilobytes, ids of strings, nulls and repeated ids; single documents come from their frames."""
    monkeypatch.setattr(tokens, "FILE_BYTES", 3000)
    rng = random.Random(3)
    data = [(f"d{i:04d}", " ".join(rng.choice(["Haus", "tree", "l'été", "x1", "."]) for _ in range(rng.randrange(80)))) for i in range(500)]
    data += [(None, "no id"), (None, None), ("d0007", "again"), ("d0007", "again"), ("e", ""), ("f", " \n"), ("g", "long " * 30_000)]
    df = spark.createDataFrame(data, "doc_id string, text string").withColumns({"part": F.lit(1), "name": F.lit("n"), "start": F.lit(0)}).repartition(5)
    folder = tokens.write(df, f"file://{tmp_path}/out", PATH)
    files = tokens.manifest(spark, folder).orderBy("part", "no").collect()
    assert len(files) > 4 and sum(r["docs"] for r in files) == len(data)
    got = tokens.read(spark, folder, ids=True).collect()
    want = [(k, plain(library, [t])[0]) for k, t in data]
    assert sorted(str((r["doc_id"], r["ids"])) for r in got) == sorted(map(str, want))
    in_order = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] or "" for r in in_order] == sorted(k or "" for k, _ in data)
    assert [r["start"] for r in in_order] == np.cumsum([0] + [r["n_tokens"] for r in in_order])[:-1].tolist()
    asked = spark.createDataFrame([("d0007",), ("g",), (None,), ("none",)], "x string")
    some = tokens.lookup(spark, folder, asked).collect()
    assert sorted(str((r["doc_id"], r["ids"])) for r in some) == sorted(str(x) for x in want if x[0] in ("d0007", "g", None))
    starts = {str((r["doc_id"], r["start"])) for r in got}
    assert all(str((r["doc_id"], r["start"])) in starts for r in some)


def test_another_dictionary_is_refused(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text of {i} words") for i in range(50)], "doc_id long, text string")
    folder = tokens.write(df, f"file://{tmp_path}/out", PATH)
    store, top = fs.FileSystem.from_uri(folder)
    (name,) = [x.path for x in store.get_file_info(fs.FileSelector(top)) if "dictionary-" in x.path]
    with store.open_output_stream(name) as f:
        f.write(b"something else")
    with pytest.raises(Exception, match="not the one its files were written with"):
        tokens.read(spark, folder).collect()


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    folder = tokens.write(df, f"file://{tmp_path}/out", PATH)
    assert tokens.read(spark, folder).collect() == [] and tokens.lookup(spark, folder, df.select("doc_id")).collect() == []
