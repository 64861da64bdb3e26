"""Words and shingles of whole Arrow batches as 64-bit hashes, by numpy over the UTF-8 bytes.

Words are ``[^\\x20\\x09-\\x0D]+``; A-Z count as a-z. Equal words always hash equally; different ones collide with a
probability of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes handled at once; a longer document is a slice of its own.
SLICE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    """Words of a slice: byte range, hash, and ``first``: where each document's words begin (one more at the end)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if column.offset:
        column = pa.concat_arrays([column])
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of about SLICE bytes."""
    data, at = raw(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + SLICE, "right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def words(data: np.ndarray, at: np.ndarray) -> Words:
    """The words of documents that lie in ``data`` at the offsets ``at``."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, none.astype(np.uint64), np.zeros(len(at), np.int64))
    black = ~IS_SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, black[:-1]
    before[at[:-1][at[:-1] < n]] = False
    start = np.flatnonzero(black & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, black[1:]
    after[at[1:][at[1:] > 0] - 1] = False
    end = np.flatnonzero(black & ~after) + 1
    if not len(start):
        return Words(start, end, start.astype(np.uint64), np.zeros(len(at), np.int64))
    size = end - start
    power = np.ones(int(size.max()), np.uint64)
    power[1:] = BASE
    power = np.multiply.accumulate(power)
    lead = np.concatenate(([0], np.cumsum(size)[:-1]))
    value = BYTE[LOWER[data[black]]] * power[np.arange(int(size.sum())) - np.repeat(lead, size)]
    return Words(start, end, mix(np.add.reduceat(value, lead) + size.astype(np.uint64)), np.searchsorted(start, at))


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each run of ``k`` words; a document of fewer words has its whole sequence as one."""
    count = np.diff(w.first)
    n = len(w.hash)
    doc = np.repeat(np.arange(len(count)), count)
    most = max(0, n - k + 1)
    value = np.zeros(most, np.uint64)
    for j in range(k):
        value = mix(value * BASE + w.hash[j : most + j])
    whole = doc[: len(value)] == doc[k - 1 :] if len(value) else np.zeros(0, bool)
    doc, value = doc[: len(value)][whole], value[whole]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.full(len(short), k, np.uint64)
        for j in range(k - 1):
            has = count[short] > j
            extra[has] = mix(extra[has] * BASE + w.hash[w.first[short[has]] + j])
        doc, value = np.concatenate((doc, short)), np.concatenate((value, mix(extra + np.uint64(1))))
    return doc, value


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct shingles, by document and then by hash."""
    doc, value = shingles(w, k)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list column with ``counts`` values in each row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), values)
