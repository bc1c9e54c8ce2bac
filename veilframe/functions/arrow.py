"""Arrow batches in small pieces, so that Python objects are made for few rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

#: Bytes of a piece. Spark fills a batch with up to 64 MB; as Python objects that is several times as much, for each task.
PIECE_BYTES = 1 << 20


def pieces(batches: Iterable[pa.RecordBatch], size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about ``size`` bytes, one row at least; no rows are copied."""
    size = size or PIECE_BYTES
    for b in batches:
        step = max(1, b.num_rows * size // max(b.nbytes, 1))
        yield from (b.slice(i, step) for i in range(0, b.num_rows, step))


def each(values: pa.Array, f: Callable, kind: pa.DataType) -> pa.Array:
    """f of every value, nulls kept."""
    parts = [pa.array([None if v is None else f(v) for v in p.column(0).to_pylist()], kind) for p in pieces([pa.RecordBatch.from_arrays([values], ["v"])])]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)
