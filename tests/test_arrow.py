"""Arrow batches in pieces, and Python's memory while they are worked off."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from veilframe.functions import arrow
from veilframe.functions import text as T


def test_pieces_are_the_same_rows():
    b = pa.RecordBatch.from_pydict({"i": list(range(1000)), "t": ["x" * (i % 50) for i in range(1000)]})
    parts = list(arrow.pieces([b, b.slice(0, 0), b.slice(990)], 2000))
    assert pa.Table.from_batches(parts).to_pydict() == pa.Table.from_batches([b, b.slice(990)]).to_pydict()
    assert len(parts) > 10 and list(arrow.pieces([b.slice(0, 2)], 1))[0].num_rows == 1


def test_each_holds_few_values():
    values = pa.array(["ä" * 50_000, None, ""] * 100)
    tracemalloc.start()
    got = arrow.each(values, str.upper, pa.string())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == ["Ä" * 50_000, None, ""] * 100
    assert peak < 4 << 20  # all values at once take 5 MB as they come and 5 MB as they go
    assert arrow.each(pa.array([], pa.string()), str.upper, pa.string()).to_pylist() == []


def test_composed_form(spark):
    data = [(0, "e\u0301 and E\u0301"), (1, "plain"), (2, None), (3, ""), (4, "\u1100\u1161 A\u030a")]
    got = spark.createDataFrame(data, "i int, t string").select("i", T.nfc(F.col("t")).alias("t")).collect()
    assert sorted((r.i, r.t) for r in got) == [(0, "\u00e9 and \u00c9"), (1, "plain"), (2, None), (3, ""), (4, "\uac00 \u00c5")]


def test_files_are_read_a_few_at_a_time(spark):
    """A reader meets pieces of a batch, whatever the number of files in it."""
    import sys

    from veilframe.sources import files

    content = F.concat(F.lit(bytearray(b"\x89PNG")), F.repeat(F.lit("x"), 100_000).cast("binary"))
    made = spark.range(0, 200, 1, 1).select(F.col("id").alias("path"), content.alias("content"), F.lit("image").alias("format"))
    seen = files.ingest(made, recognise=lambda _: (str(sys._getframe(1).f_locals["b"].num_rows), 0.5)).collect()
    assert sorted(r["path"] for r in seen) == list(range(200))
    assert max(int(r["text"]) for r in seen) <= 20
