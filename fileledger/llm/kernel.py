"""Array kernels over Arrow text batches, shared by the operators of this subpackage.

Texts arrive as Arrow string columns.  A batch is viewed as one byte array plus
document offsets and handled in slices of about a megabyte, so that the arrays
made here stay small whatever the batch size; one document longer than a slice
is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240601)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE_FOLDED = _BYTE.copy()
_BYTE_FOLDED[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SHINGLE = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) <= n:
        size = max(n + 1, SLICE_BYTES + 1024)
        for name, base in (("up", _BASE), ("down", _INV)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


@dataclass
class Slice:
    """Documents first..last of a batch; bounds[i]:bounds[i+1] are the bytes of one in data."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


def text_column(column: pa.Array) -> pa.Array:
    """The column as a gapless string array; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    return column


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), bounds


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    column = text_column(column)
    if not len(column):
        return
    data, bounds = byte_view(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1)
        cut = bounds[first : last + 1]
        yield Slice(first, data[cut[0] : cut[-1]], cut - cut[0])
        first = last


@dataclass
class Words:
    """Words of a slice: byte starts and ends, document of each, hashes, and words[i]:words[i+1] by document."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    by_doc: np.ndarray


def split_words(piece: Slice, fold_case: bool = False, separators: np.ndarray = _SPACE) -> Words:
    """Maximal runs of bytes other than separators (space and \\x09-\\x0D); words end with their document."""
    data, bounds = piece.data, piece.bounds
    n = len(data)
    inside = ~separators[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = bounds[:-1][bounds[:-1] < bounds[1:]]
    begins[full] = inside[full]
    last = bounds[1:][bounds[:-1] < bounds[1:]] - 1
    ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    by_doc = np.searchsorted(start, bounds)
    doc = np.repeat(np.arange(len(piece)), np.diff(by_doc))
    return Words(start, end, doc, substring_hashes(data, start, end, fold_case), by_doc)


def substring_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold_case: bool = False) -> np.ndarray:
    """64-bit hashes of data[start:end], the same wherever the bytes stand."""
    up, down = _power_tables(len(data))
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_FOLDED if fold_case else _BYTE)[data] * up[: len(data)], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def sliding_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """substring_hashes of the `width` bytes from each position."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(data))
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=prefix[1:])
    h = prefix[width:] - prefix[:-width]
    h *= down[:n]
    h += _U(width)
    return mix(h)


def shingles(words: Words, n_docs: int, size: int, short_whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `size` consecutive words and the document of each, repeats included.

    With short_whole, a document of fewer words (but at least one) has its whole
    word sequence as its only shingle.
    """
    h, doc = words.hash, words.doc
    count = np.diff(words.by_doc)
    at = np.arange(max(0, len(h) - size + 1))
    at = at[doc[at] == doc[at + size - 1]] if len(at) else at
    out = np.zeros(len(at), np.uint64)
    for j in range(size):
        out += h[at + j] * _SHINGLE[j]
    owner = doc[at]
    if short_whole:
        short = np.flatnonzero((count > 0) & (count < size))
        extra = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            has = count[short] > j
            extra[has] += h[words.by_doc[short[has]] + j] * _SHINGLE[j]
        extra += count[short].astype(np.uint64) * _SHINGLE[size]
        out, owner = np.concatenate([out, extra]), np.concatenate([owner, short])
    return mix(out), owner


def sorted_sets(values: np.ndarray, owner: np.ndarray, n_docs: int, major: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each owner in ascending order (of major first, if given), and bounds by owner."""
    order = np.lexsort((values, owner) if major is None else (values, major, owner))
    values, owner = values[order], owner[order]
    if len(values):
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(n_docs + 1))


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices start[0]..start[0]+length[0]-1, start[1]..., as one array."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total) - np.repeat(ends - length, length) + np.repeat(start, length)
