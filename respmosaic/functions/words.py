"""Counts of overlapping words in one pass over a text, as Arrow-batched column functions.

Texts are read in parts of ``PART`` letters that overlap by a word less a letter, so a very long text needs
no array of its windows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PART = 1 << 20
#: Texts whose words are Python objects at a time, and the type of a word with its count.
TEXTS, WORD = 64, pa.struct([("w", pa.string()), ("n", pa.int64())])
_DENSE = 1 << 20


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _codes(letters: np.ndarray, alphabet: int, k: int) -> np.ndarray:
    """Number of the word at each start, most significant letter first."""
    out = np.zeros(max(0, len(letters) - k + 1), np.int64)
    for j in range(k):
        out = out * alphabet + letters[j : j + len(out)]
    return out


def count_words(text: str, k: int) -> dict[str, int]:
    """Counts of every ``k``-letter window of a text, whatever its letters."""
    found: Counter = Counter()
    for start in range(0, max(len(text) - k + 1, 0), PART):
        part = _letters(text[start : start + PART + k - 1])
        values, inverse = np.unique(part, return_inverse=True)
        if len(values) ** k >= 1 << 62:
            chars = text[start : start + PART + k - 1]
            found.update(chars[i : i + k] for i in range(len(chars) - k + 1))
            continue
        codes, n = np.unique(_codes(inverse.astype(np.int64), len(values), k), return_counts=True)
        digits = np.stack([codes // len(values) ** (k - 1 - j) % len(values) for j in range(k)], axis=1)
        names = values[digits].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        for i, c in enumerate(n.tolist()):
            found[names[i * k : i * k + k]] += c
    return found


def count_vector(text: str, k: int, letters: str) -> np.ndarray:
    """Counts of all ``len(letters) ** k`` words in the order of ``letters``; windows with other letters are skipped."""
    size = len(letters)
    table = np.full(256, size, np.int64)
    table[[ord(c) for c in letters]] = np.arange(size)
    out = np.zeros(size**k, np.int64)
    for start in range(0, max(len(text) - k + 1, 0), PART):
        part = _letters(text[start : start + PART + k - 1])
        code = np.where(part < 256, table[np.minimum(part, 255)], size)
        bad = np.concatenate([[0], np.cumsum(code == size)])
        words = _codes(code, size, k)[bad[k:] == bad[:-k]]
        if len(out) <= _DENSE:
            out += np.bincount(words, minlength=len(out))
        else:
            np.add.at(out, words, 1)
    return out


def word_counts(c: Column | str, k: int) -> Column:
    """``array<struct<w, n>>``: every distinct ``k``-letter window of a text with its count; empty for a null or shorter text.

    Words become Arrow columns ``TEXTS`` texts at a time; a batch never holds a Python object per word.
    """

    @F.arrow_udf("array<struct<w:string,n:bigint>>")
    def counted(texts: pa.Array) -> pa.Array:
        ends, parts = [0], [pa.array([], WORD)]
        for start in range(0, len(texts), TEXTS):
            words, n = [], []
            for t in texts.slice(start, TEXTS).to_pylist():
                found = count_words(t or "", k)
                words += sorted(found)
                n += [found[w] for w in words[len(n) :]]
                ends.append(ends[-1] + len(found))
            parts.append(pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], fields=list(WORD)))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(parts))

    return counted(c)


def vector_counts(c: Column | str, k: int, letters: str, places: Sequence[int] | None = None) -> Column:
    """``array<bigint>`` of :func:`count_vector`, or of some of its places; zeros for a null text. The vector has ``len(letters) ** k`` places."""
    pick = slice(None) if places is None else list(places)

    @F.pandas_udf("array<bigint>")
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series([count_vector(t or "", k, letters)[pick] for t in texts])

    return counted(c)


def vector_shares(c: Column | str, k: int, letters: str) -> Column:
    """``array<double>`` of :func:`count_vector` over its sum; zeros where the sum is zero."""

    @F.pandas_udf("array<double>")
    def shares(texts: pd.Series) -> pd.Series:
        counts = (count_vector(t or "", k, letters) for t in texts)
        return pd.Series([n / max(int(n.sum()), 1) for n in counts])

    return shares(c)
