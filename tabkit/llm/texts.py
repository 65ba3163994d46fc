"""Whole columns of text as bytes: words, lines and hashes for a block of documents at once.

A block is a byte array with the offsets of its documents. A null text is an empty one. Nothing
crosses a document's end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20                                       # arrays of a block take some 60 times as much

_BASE = np.uint64(0x9E3779B97F4A7C15)                       # odd, so that it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = []


def blocks(batches, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows of about ``limit`` bytes of text; a longer text stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.diff(raw(batch.column(column))[1]))
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(first, last - first)
            first = last


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes, and where each document begins (one more offset at the end)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.string()) if column.type != pa.string() else column
    column = column.fill_null("") if column.null_count else column
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def is_space(data: np.ndarray) -> np.ndarray:
    """Bytes \\x20 and \\x09 to \\x0D."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each maximal run of marked bytes within one document."""
    before = np.zeros(len(inside) + 1, bool)
    before[1:] = inside
    before[offsets] = False                                 # a document's first byte follows nothing
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(inside) + 1, bool)
    after[:-1] = inside
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, owner(starts, offsets)


def owner(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The document that holds each position."""
    return np.searchsorted(offsets, positions, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return runs(~is_space(data), offsets)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, x))])
                      for x in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of a polynomial in the bytes: two of them give the hash of what lies between."""
    up, _ = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, the same wherever its bytes stand."""
    _, down = _power(len(sums))
    body = (sums[ends] - sums[starts]) * down[starts]
    return mixed(body + mixed((ends - starts).astype(np.uint64)))


def joined(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash of several in order."""
    out = np.zeros(len(hashes[0]), np.uint64)
    for h in hashes:
        out = mixed(out * _BASE + h)
    return out


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def shingles(hashes: np.ndarray, doc: np.ndarray, documents: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each run of ``size`` words; a document with fewer words gives its whole sequence."""
    n = len(hashes)
    out, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    if n >= size:
        whole = doc[size - 1:] == doc[:n - size + 1]
        out.append(joined([hashes[i:n - size + 1 + i] for i in range(size)])[whole])
        owners.append(doc[:n - size + 1][whole])
    counts = np.bincount(doc, minlength=documents)
    first = np.cumsum(counts) - counts
    for k in range(1, min(size, n + 1)):
        short = np.flatnonzero(counts == k)
        out.append(joined([hashes[first[short] + i] for i in range(k)]))
        owners.append(short)
    return np.concatenate(out), np.concatenate(owners)


def distinct_pairs(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (document, value) once, by document and value."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[keep], value[keep]
