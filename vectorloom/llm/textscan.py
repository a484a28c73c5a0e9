"""Words, lines and their fingerprints for a whole Arrow column at once, in numpy over the UTF-8 bytes.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which is the pattern [^\\x20\\x09-\\x0D]+ on code points,
since UTF-8 uses those bytes for nothing else.  Fingerprints are 64-bit: a polynomial over the bytes modulo 2**64, read
off one running sum for any span, then a bijective mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 2**64)
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_powers = [np.ones(1, U), np.ones(1, U)]

CHUNK_BYTES = 512 << 10


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose outputs look random."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BACK)):
            steps = np.full(n, base, U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U)
    return _powers[0], _powers[1]


class Texts:
    """Texts of one chunk: bytes, the offsets of each text, and its words."""

    def __init__(self, column: pa.Array, fold: bool = False):
        column = column.cast(pa.large_string()).fill_null("") if len(column) else pa.array([], pa.large_string())
        column = pa.concat_arrays([column])
        _, offsets, data = column.buffers()
        off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
        self.off = off - off[0]
        self.n = len(column)
        self.bytes = FOLD[raw] if fold else raw
        self._sum = None

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and texts of all words, in order."""
        solid = ~SPACE[self.bytes]
        edge = np.zeros(len(solid) + 1, bool)
        edge[self.off] = True
        before = np.empty_like(solid)
        before[1:] = solid[:-1]
        before[:1] = False
        after = np.empty_like(solid)
        after[:-1] = solid[1:]
        after[-1:] = False
        starts = np.flatnonzero(solid & (~before | edge[:-1]))
        ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
        return starts, ends, np.searchsorted(self.off, starts, "right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self._sum is None:
            up, _ = _power(len(self.bytes) + 1)
            self._sum = np.zeros(len(self.bytes) + 1, U)
            np.cumsum(_TABLE[self.bytes] * up[: len(self.bytes)], out=self._sum[1:])
        down = _power(len(self.bytes) + 1)[1]
        return mix((self._sum[ends] - self._sum[starts]) * down[starts] + (ends - starts).astype(U))

    def per_text(self, texts: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(texts, weights, self.n).astype(np.int64)


def grams(hashes: np.ndarray, texts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of n consecutive words, and where each starts (an index of words)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    at = np.flatnonzero(texts[:m] == texts[n - 1 :])
    found = np.zeros(m, U)
    for k in range(n):
        found = found * U(0xD1342543DE82EF95) + hashes[k : k + m]
    return mix(found[at] + U(n)), at


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices with about size bytes of text each; a text is never cut."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
    lengths = np.nan_to_num(np.asarray(pa.compute.binary_length(col).to_numpy(zero_copy_only=False), float))
    bins = (np.cumsum(lengths) // size).astype(np.int64)
    at = [0, *(np.flatnonzero(np.diff(bins)) + 1), batch.num_rows]
    for a, b in zip(at, at[1:]):
        yield batch.slice(a, b - a)


def int64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == U else x.astype(np.int64))
