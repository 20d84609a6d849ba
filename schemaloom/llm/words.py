"""Words `[^\\x20\\x09-\\x0D]+` of many texts at once, and 64-bit hashes of words and of word windows, in numpy."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
STEP = np.uint64(0xD6E8FEB86659FD93)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Kept(dict):
    """What a process worked out; it doesn't travel with the functions that use it."""

    def __reduce__(self):
        return Kept, ()


#: Powers that were worked out before, by base; a task uses them slice after slice.
KNOWN = Kept()
#: So many are kept at most; a longer run's are worked out for that run only.
MOST_KNOWN = (1 << 20) + 1
#: Bytes, or words, that are hashed in one go, so that work arrays stay small; a hash doesn't depend on where its span lies.
PIECE = 1 << 17


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    if n > MOST_KNOWN:
        return raised(base, n)
    if len(KNOWN.get(int(base), ())) < max(n, 1):
        KNOWN[int(base)] = raised(base, min(max(PIECE + 1, 2 * n), MOST_KNOWN))
    return KNOWN[int(base)][: max(n, 1)]


def raised(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all others (the finisher of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=out[1:])
    return out


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end in the bytes, and for each text the number of the first of its words (n + 1 numbers)."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~IS_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, in order of starts; equal spans have equal hashes."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + PIECE)))
        low, high = int(starts[at]), int(ends[at:end].max())
        c = sums((data[low:high].astype(np.uint64) + np.uint64(1)) * powers(BASE, high - low)[: high - low])
        first, last = starts[at:end] - low, ends[at:end] - low
        h = (c[last] - c[first]) * powers(inverse(BASE), high - low + 1)[first]
        out[at:end] = mixed(h ^ ((last - first).astype(np.uint64) << np.uint64(48)))
        at = end
    return out


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of width word hashes (len - width + 1 of them; text bounds are up to the caller)."""
    out = np.empty(max(len(hashes) - width + 1, 0), np.uint64)
    for at in range(0, len(out), PIECE):
        some = hashes[at : at + PIECE + width - 1]
        n = len(some) - width + 1
        c = sums(some * powers(STEP, len(some)))
        out[at : at + n] = mixed((c[width:] - c[:n]) * powers(inverse(STEP), len(some))[:n])
    return out
