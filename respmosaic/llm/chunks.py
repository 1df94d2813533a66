"""Vectorised work on the UTF-8 bytes of Arrow text columns.

A batch is cut into slices of bounded bytes (a longer text makes a slice of its own), so memory in a
task follows the slice and the longest single text, never the batch or the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once.
SLICE = 1 << 18

# Workers live on between stages: memory that a stage has freed goes back to the system.
pa.set_memory_pool(pa.system_memory_pool())

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def text_column(batch: pa.RecordBatch, column: str) -> pa.Array:
    """A column by name, or a field of a struct column by ``column.field`` (so that a text need not be sent twice)."""
    name, _, field = column.partition(".")
    found = batch.column(batch.schema.get_field_index(name))
    return found.field(field) if field else found


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """``(rows, bytes, offsets)`` of consecutive row ranges; a null text has no bytes."""
    if not batch.num_rows:
        return
    text = text_column(batch, column)
    if text.null_count:  # the bytes under a null are undefined
        text = text.fill_null("")
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    buffers, n = text.buffers(), len(text)
    at = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[text.offset : text.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield batch.slice(first, last - first), data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, SLICE + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_values(fold_case: bool) -> np.ndarray:
    """A pseudo-random value per byte; A-Z share the values of a-z when ``fold_case``."""
    b = np.arange(256, dtype=np.uint64)
    if fold_case:
        b[65:91] = b[97:123]
    return mix((b + np.uint64(1)) * _ODD)


def prefix_hash(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Running polynomial sums from which :func:`span_hash` takes any span."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(len(data) + 1)[0][: len(data)], out=total[1:])
    return total


def span_hash(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal content wherever it stands."""
    back = powers(len(total))[1]
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64) * _ODD)


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of maximal runs of word bytes, and the index of each text's first run (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[offsets < n]
    begins[edges] |= inside[edges]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    edges = offsets[offsets > 0] - 1
    stops[edges] |= inside[edges]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each ``k`` consecutive items (positions that cross a text's end are the caller's to drop)."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - k + 1, np.uint64)
    weight = 1
    for j in range(k):
        out += hashes[j : len(hashes) - k + 1 + j] * np.uint64(weight)
        weight = weight * _BASE % (1 << 64)
    return mix(out + np.uint64(k * int(_ODD) % (1 << 64)))


def class_table(excluded: str) -> np.ndarray:
    """Table over bytes: True but for the given ASCII characters. Bytes of other characters are True."""
    table = np.ones(256, bool)
    table[np.frombuffer(excluded.encode("ascii"), np.uint8)] = False
    return table


#: Fixed: words are what stands between space, tab, line feed, vertical tab, form feed and carriage return.
SPACED = class_table(" \t\n\x0b\x0c\r")
#: Fixed: words are digits, letters and everything beyond ASCII.
ALPHANUMERIC = class_table("".join(chr(c) for c in range(128) if not chr(c).isalnum()))


def text_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Strings over a byte buffer (the caller keeps characters whole)."""
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
