"""Vectorised word and n-gram hashing over Arrow string batches.

Everything works on whole texts. Memory follows the slice in hand (``slices``), not the batch, so
a batch of long documents is worked through piece by piece. A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
#: ASCII blanks: the complement of ``[^\x20\x09-\x0D]``.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        z = x + U64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
        return z ^ (z >> U64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as uniform numbers in (0, 1)."""
    return ((x >> U64(11)).astype(np.float64) + 0.5) / 2.0**53


def as_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the n + 1 offsets into them."""
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges that hold about ``most`` bytes each, one row at least."""
    _, off = buffers(texts)
    at, n = 0, len(texts)
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


@dataclass
class Words:
    """Words of a slice in reading order; ``first[d]:first[d + 1]`` are those of row d."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def split(texts: pa.Array, hashed: bool = True, trim: np.ndarray | None = None) -> Words:
    """trim: bytes to leave out at the ends of words (a table of 256); words of nothing else go."""
    raw, off = buffers(texts)
    n = len(off) - 1
    inside = ~_BLANK[raw]
    if not raw.size:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(n + 1, np.int64), np.zeros(0, U64))
    edge = np.zeros(raw.size + 1, bool)
    edge[off] = True
    before = np.empty(raw.size, bool)
    before[0], before[1:] = False, inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(raw.size, bool)
    after[-1], after[:-1] = False, inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    if trim is not None:
        for edge_of, step in ((start, 1), (end, -1)):
            loose = np.arange(start.size)
            while loose.size:
                loose = loose[(start[loose] < end[loose]) & trim[raw[np.clip(edge_of[loose] - (step < 0), 0, raw.size - 1)]]]
                edge_of[loose] += step
        left = start < end
        start, end = start[left], end[left]
    doc = np.searchsorted(off, start, "right") - 1
    first = np.searchsorted(doc, np.arange(n + 1))
    return Words(doc, start, end, first, _span_hash(raw, start, end) if hashed else np.zeros(0, U64))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS.get("p", np.zeros(0)).size < n:
        with np.errstate(over="ignore"):
            p = np.full(n, _BASE, U64)
            q = np.full(n, U64(pow(int(_BASE), -1, 2**64)), U64)
            p[0] = q[0] = 1
            _POWERS.update(p=np.cumprod(p), q=np.cumprod(q))
    return _POWERS["p"], _POWERS["q"]


_SYMBOL = mix(np.arange(256, dtype=U64), 17)


def _span_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 1 << 21) -> np.ndarray:
    """A hash of each of the disjoint ascending byte spans, from differences of prefix sums."""
    out = np.empty(start.size, U64)
    at = 0
    with np.errstate(over="ignore"):
        while at < start.size:
            lo = start[at]
            to = max(at + 1, int(np.searchsorted(end, lo + block, "right")))
            hi = int(end[to - 1])
            p, q = _powers(hi - lo)
            total = np.zeros(hi - lo + 1, U64)
            np.cumsum(_SYMBOL[raw[lo:hi]] * p[: hi - lo], out=total[1:])
            s, e = start[at:to] - lo, end[at:to] - lo
            out[at:to] = (total[e] - total[s]) * q[s]
            at = to
    return mix(out, 3)


def ngrams(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of n words, document borders ignored; max(0, len - n + 1) of them."""
    m = hashes.size - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    base = int(mix(np.array([seed], U64), 5)[0]) | 1
    with np.errstate(over="ignore"):
        out, have, run, width = None, 0, mix(hashes, seed + 11), 1
        power = base
        while True:  # widths double; the binary digits of n choose which are taken
            if n & width:
                out = run.copy() if out is None else out[: hashes.size - have - width + 1] + run[have : hashes.size - width + 1] * U64(pow(base, have, 2**64))
                have += width
            if have == n:
                return mix(out[:m], seed + 13)
            run = run[: run.size - width] + run[width:] * U64(power)
            power, width = power * power % 2**64, width * 2


def whole(words: Words, n: int) -> np.ndarray:
    """Which runs of n words lie within one document."""
    m = words.doc.size - n + 1
    return words.doc[:m] == words.doc[n - 1 :] if m > 0 else np.zeros(0, bool)
