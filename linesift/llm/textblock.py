"""Vectorised kernels over blocks of UTF-8 texts: word spans, 64-bit span hashes, word windows.

A block is the bytes of some whole documents of an Arrow batch, cut at document ends, so that memory follows the
block size (or one document) and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a block, unless one document alone has more.
BLOCK_BYTES = 1 << 20
U64 = np.uint64
#: Fixed odd multipliers of the hashes (arbitrary, but part of the stored values' meaning).
BASE, STEP = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Block:
    lo: int  # rows of the batch
    hi: int
    data: np.ndarray  # uint8
    offs: np.ndarray  # int64, one more than documents

    @property
    def n(self) -> int:
        return self.hi - self.lo

    def text(self, i: int) -> bytes:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes()


def blocks(batch: pa.RecordBatch, column: str = "text", max_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of a batch; a null text is an empty one."""
    arr = pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()), "")
    offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    buf = arr.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(arr):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1)
        yield Block(lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    p, q = np.full(n, BASE, U64), np.full(n, pow(BASE, -1, 1 << 64), U64)
    p[0] = q[0] = 1
    return np.cumprod(p, dtype=U64), np.cumprod(q, dtype=U64)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; equal bytes give equal hashes wherever they stand."""
    n = len(data)
    size = 1 << max(20, int(n).bit_length())
    p, q = _powers(size)
    run = np.zeros(n + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * p[:n], out=run[1:])
    return mix((run[ends] - run[starts]) * q[starts] + (ends - starts).astype(U64) * U64(STEP))


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased; other bytes stay."""
    return _LOWER[data]


def word_spans(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document index of the words ``[^\\x20\\x09-\\x0D]+``."""
    n = len(b.data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    ws = _WS[b.data]
    cut = np.zeros(n + 1, bool)
    cut[b.offs] = True
    before, after = cut[:n].copy(), cut[1:].copy()
    before[1:] |= ws[:-1]
    after[:-1] |= ws[1:]
    starts, ends = np.flatnonzero(~ws & before), np.flatnonzero(~ws & after) + 1
    return starts, ends, np.searchsorted(b.offs, starts, "right") - 1


def windows(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k``-word windows inside documents, and each window's first word."""
    if len(h) < k:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    m = len(h) - k + 1
    out = np.zeros(m, U64)
    for j in range(k):
        out = out * U64(BASE) + h[j : j + m]
    at = np.flatnonzero(doc[:m] == doc[k - 1 :])
    return mix(out[at]), at


def per_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by document index."""
    return np.bincount(doc, weights=values, minlength=n).astype(np.int64)
