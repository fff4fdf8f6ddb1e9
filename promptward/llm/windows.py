"""Hashes of sliding windows over token or byte sequences, in numpy.

The two substring operators look for equal windows of ``width`` units (words or
bytes).  ``runs`` cuts the windows of a batch of sequences into runs that share
one anchor: the least k-mer hash inside the window, leftmost where it repeats.
Which k-mer that is depends on the content of a window alone, so equal windows
have equal anchors and the same place of the anchor in the window; only runs whose anchor occurs
more than once can hold a repeated window.
"""

from __future__ import annotations

import numpy as np

#: Positions inside a piece fit into this many low bits of an anchor value.
PLACE_BITS = 20
#: Longer sequences are cut into overlapping pieces of this many units.
PIECE = 1 << 19
FACTOR = 0xD6E8FEB86659FD93
INVERSE = pow(FACTOR, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, factor: int) -> np.ndarray:
    """``factor ** i`` modulo 2**64 for i below n; those of usual texts are kept."""
    known = _POWERS.get(factor)
    if known is None or len(known) < n:
        out = np.full(max(n, 1 << 16), factor, dtype=np.uint64)
        out[0] = 1
        known = np.multiply.accumulate(out)
        if len(known) <= 2 * PIECE:
            _POWERS[factor] = known
    return known[:n]


def word_spans(data: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are no separators."""
    inside = np.concatenate(([False], ~separator, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, factor: int) -> np.ndarray:
    """A 64-bit hash of each byte span, from prefix sums of a polynomial."""
    inverse = pow(factor, -1, 1 << 64)
    total = np.concatenate(
        ([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data), factor)))
    )
    back = powers(len(data) + 1, inverse)
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def kmer_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive unit values, from prefix sums of a polynomial."""
    n = len(units)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(units * powers(n, FACTOR), out=total[1:])
    return mix((total[k:] - total[: n + 1 - k]) * powers(n + 1 - k, INVERSE))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    out, length = values, 1
    while length * 2 <= width:
        out = np.minimum(out[:-length], out[length:])
        length *= 2
    if length < width:
        out = np.minimum(out[: len(out) - (width - length)], out[width - length :])
    return out


def runs(units: np.ndarray, width: int, k: int) -> tuple[np.ndarray, ...]:
    """Anchor, place of the anchor, first and last window start of each run.

    ``units`` are the unit hashes of one piece; a window is ``width`` units, the
    anchor the least hash of ``k`` units in it.
    """
    n = len(units) - width + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    low = np.uint64((1 << PLACE_BITS) - 1)
    hashes = kmer_hashes(units, k)
    packed = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    least = sliding_min(packed, width - k + 1)
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    last = np.append(first[1:] - 1, n - 1)
    chosen = least[first]
    return (
        (chosen >> np.uint64(PLACE_BITS)).astype(np.int64),
        (chosen & low).astype(np.int64),
        first,
        last,
    )


def pieces(n: int, width: int) -> list[tuple[int, int]]:
    """Bounds of pieces whose windows are all windows of the sequence, each once."""
    if n <= PIECE:
        return [(0, n)]
    step = PIECE - width + 1
    return [(i, min(n, i + PIECE)) for i in range(0, n - width + 1, step)]
