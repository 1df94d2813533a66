"""Burrows-Wheeler transforms of small text collections, and their merge by iterative interleave refinement.

A symbol is a block of ``STRIDE`` bytes, as a code that is equal for equal blocks; the transform holds, for each suffix in
order, the block before it. The order of blocks is that of their codes, which serves as well as the alphabet's to bring equal
prefixes together. Every string ends in a terminator of its own, smaller than any block, earlier strings first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

STRIDE = 20


@dataclass
class Transform:
    """Symbols before the terminators (``STRIDE`` per string) and before the sorted suffixes (-1: none); start of each sorted suffix."""

    symbols: np.ndarray
    ends: int
    suffixes: np.ndarray


def block_codes(hash_of, first: np.ndarray) -> np.ndarray:
    """Dense codes of the block that starts at every byte; ``first`` holds each string's start and the total."""
    at = np.arange(first[-1])
    stop = np.repeat(first[1:], np.diff(first))
    return np.unique(hash_of(at, np.minimum(at + STRIDE, stop)), return_inverse=True)[1].astype(np.int32)


def transform(codes: np.ndarray, first: np.ndarray, a: int, b: int) -> Transform:
    """Transform of strings ``a`` to ``b``: suffixes are sorted by doubling the blocks compared."""
    lo, hi = first[a], first[b]
    n, strings = int(hi - lo), b - a
    stop = np.repeat(first[a + 1 : b + 1], np.diff(first[a : b + 1])) - lo
    owner = np.repeat(np.arange(strings), np.diff(first[a : b + 1]))
    rank = codes[lo:hi].astype(np.int64) + strings
    step, longest = STRIDE, int(np.diff(first[a : b + 1]).max(initial=0))
    while n:
        after = np.arange(n) + step
        inside = after < stop
        second = np.where(inside, rank[np.minimum(after, n - 1)], owner)
        # suffixes that end within the blocks compared so far are apart already: their last block is shorter, or ends in its own terminator
        rank = np.unique(rank * (n + strings + len(codes) + 1) + second, return_inverse=True)[1] + strings
        step *= 2
        if step >= longest + STRIDE:
            break
    order = np.argsort(rank, kind="stable")
    before = np.where(order - STRIDE >= (first[a : b + 1] - lo)[owner[order]], codes[lo + np.maximum(order - STRIDE, 0)], -1) if n else np.zeros(0, np.int32)
    tail = first[a + 1 : b + 1, None] - STRIDE + np.arange(STRIDE)[None, :]
    last = np.where(tail >= first[a:b, None], codes[np.maximum(tail, 0)], -1) if len(codes) else np.full((strings, STRIDE), -1)
    return Transform(np.concatenate([last.ravel(), before]).astype(np.int32), STRIDE * strings, order + lo)


def merge(x: Transform, y: Transform, rounds: int | None = None) -> tuple[Transform, np.ndarray]:
    """The transform of both collections and, per suffix, how many whole blocks it has in common with its predecessor.

    Round r knows from which collection each suffix comes when ``r`` blocks are compared. Reading the symbols in that order and sorting them
    stably gives round r + 1. A boundary that appears in round r parts suffixes that share r - 1 blocks. ``rounds`` stops early:
    the common prefixes are then right up to that many blocks. Without it, rounds go on until nothing changes.
    """
    ends, n = x.ends + y.ends, len(x.suffixes) + len(y.suffixes)
    side = np.zeros(ends + n, bool)  # True: from y
    side[x.ends : ends] = True
    side[ends + len(x.suffixes) :] = True
    block = np.zeros(ends + n, np.int64)  # nothing is compared yet, not even where strings end
    common = np.full(n, np.iinfo(np.int16).max, np.int16)
    done = 0
    while rounds is None or done < rounds:
        symbols = np.empty(ends + n, np.int32)
        symbols[~side], symbols[side] = x.symbols, y.symbols
        entries = np.flatnonzero(symbols >= 0)
        # symbol and place in one number: a plain sort is then stable, and much faster than sorting places
        keys = np.sort((symbols[entries].astype(np.int64) << 32) | entries)
        order = keys & 0xFFFFFFFF
        symbol, own = keys >> 32, block[order]
        fresh = np.ones(n, bool)
        fresh[1:] = (symbol[1:] != symbol[:-1]) | (own[1:] != own[:-1])
        common[fresh & (common == np.iinfo(np.int16).max)] = done
        moved = side[order]
        steady = rounds is None and done and np.array_equal(moved, side[ends:]) and int(block[-1]) - ends + 1 == int(fresh.sum())
        side[ends:] = moved
        block[:ends] = np.arange(ends)
        block[ends:] = ends + np.cumsum(fresh) - 1
        done += 1
        if steady:
            break
    symbols = np.empty(ends + n, np.int32)
    symbols[~side], symbols[side] = x.symbols, y.symbols
    suffixes = np.empty(n, np.int64)
    suffixes[~side[ends:]], suffixes[side[ends:]] = x.suffixes, y.suffixes
    return Transform(symbols, ends, suffixes), np.minimum(common, done)


def merged(codes: np.ndarray, first: np.ndarray, shards: list[tuple[int, int]], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of all strings and blocks in common with the predecessor (up to ``rounds``), from the transforms of the shards."""
    parts = [transform(codes, first, a, b) for a, b in shards]
    if len(parts) == 1:
        parts.append(Transform(np.zeros(0, np.int32), 0, np.zeros(0, np.int64)))
    while len(parts) > 2:
        parts = [merge(parts[i], parts[i + 1])[0] if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    whole, common = merge(*parts, rounds=rounds)
    return whole.suffixes, common
