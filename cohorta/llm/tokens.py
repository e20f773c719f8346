"""Arrow / numpy text kernels shared by the operators (run inside Spark tasks).

Every kernel takes one bounded slice of rows (see ``slices``) and works on
whole texts.  Words are maximal runs of bytes outside space and 0x09-0x0D;
a null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once in a task; one longer text is a slice of its own.
SLICE_BYTES = 4 << 20

U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15)
_BASE = U64(0xD6E8FEB86659FD93)


class Words(NamedTuple):
    """Words of a slice: doc i holds ``ids[offsets[i]:offsets[i+1]]`` of ``vocab``."""

    offsets: np.ndarray
    ids: np.ndarray
    vocab: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def slices(batch: pa.RecordBatch, column: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice holds about ``limit`` text bytes (one row at least)."""
    n = batch.num_rows
    if n == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size.astype(np.int64))
    start = 0
    while start < n:
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_column(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The texts with null as empty, offsets starting at zero."""
    texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    return pa.concat_arrays([texts]) if texts.offset == 0 else pa.array(texts.to_pylist(), pa.large_string())


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a large_string array with offset 0."""
    _, offsets, data = texts.buffers()
    n = len(texts)
    off = np.frombuffer(offsets, np.int64, n + 1 + texts.offset)[texts.offset:] if offsets else np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between offsets, one figure per document."""
    total = np.zeros(len(values) + 1, dtype=np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def words(texts: pa.Array) -> Words:
    """Split on ASCII white space and encode the words by a slice dictionary."""
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    offsets = parts.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    coded = flat.dictionary_encode()
    vocab, ids = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # the splitter leaves an empty string beside leading or trailing white space
    blank = pc.index(vocab, pa.scalar("", vocab.type)).as_py() if len(vocab) else -1
    if blank >= 0:
        keep = ids != blank
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        ids = ids[keep]
    return Words(offsets, ids, vocab)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser (wraps modulo 2**64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * _MULT)


def hash_strings(values: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each string, the same in every task."""
    data, off = raw_bytes(values.cast(pa.large_string()))
    size = np.diff(off)
    if not len(size):
        return np.zeros(0, U64)
    longest = int(size.max())
    power = np.ones(max(longest, 1), U64)
    if longest > 1:
        power[1:] = np.multiply.accumulate(np.full(longest - 1, _BASE, U64))
    with np.errstate(over="ignore"):
        at = np.arange(len(data)) - np.repeat(off[:-1], size)
        total = np.zeros(len(data) + 1, U64)
        np.cumsum(_BYTE[data] * power[at], out=total[1:])
        return mix((total[off[1:]] - total[off[:-1]]) ^ (size.astype(U64) * _MULT) ^ U64(seed * 0x5851F42D4C957F2D % 2**64))


def windows(codes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k`` consecutive codes inside each document, with new offsets.

    ``codes`` are 64-bit word hashes (or ids, for keys used inside one slice).
    """
    n = np.diff(offsets)
    made = np.maximum(n - k + 1, 0)
    out_off = np.concatenate([[0], np.cumsum(made)])
    start = np.arange(out_off[-1]) - np.repeat(out_off[:-1], made) + np.repeat(offsets[:-1], made)
    codes = codes.astype(U64, copy=False)
    with np.errstate(over="ignore"):
        key = np.zeros(len(start), U64)
        for j in range(k):
            key = mix(key * _MULT + codes[start + j] + U64(j + 1))
    return key, out_off


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the runs ``starts[i] .. starts[i]+sizes[i]`` one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - sizes, sizes) + np.repeat(starts, sizes)
