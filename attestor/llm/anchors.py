"""Content anchors: a sound filter in front of exact repeat search.

A byte string of `window` bytes holds window - GRAM + 1 grams; the one of least (hash, place) is its anchor.
Equal strings have their anchor at the same place within them. So a string that occurs twice has an
anchor that occurs twice, and only windows under repeated anchors need be compared.
"""

from __future__ import annotations

import numpy as np

GRAM = 32
#: Places take the low bits of a gram's key, so that much text is held at once at most.
PLACE_BITS = 23
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_CACHED: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _CACHED or len(_CACHED[base]) < n:
        made = np.full(max(n, 1 << 16), base, np.uint64)
        made[0] = 1
        _CACHED[base] = np.multiply.accumulate(made)
    return _CACHED[base][:n]


def release() -> None:
    """Let go of the powers."""
    _CACHED.clear()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte times power, from which the hash of any range follows."""
    made = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=made[1:])
    return made


def range_hashes(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes lo to hi, alike wherever they stand."""
    return _mixed((prefix[hi] - prefix[lo]) * _powers(_INVERSE, len(prefix))[lo])


def anchors(data: np.ndarray, ends: np.ndarray, window: int, gram: int = GRAM, prefix: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the windows that lie within one of the texts laid end to end in `data` (at most 2^23 bytes).

    Places of the anchors, hashes of their grams, and the first and last window start that each serves.
    """
    none = np.zeros(0, np.int64)
    n_grams, span = len(data) - gram + 1, window - gram + 1
    n = n_grams - span + 1
    if n <= 0:
        return none, none.astype(np.uint64), none, none
    if len(data) > 1 << PLACE_BITS:
        raise ValueError("too much text at once")
    prefix = sums(data) if prefix is None else prefix
    hashes = _mixed((prefix[gram:] - prefix[:-gram]) * _powers(_INVERSE, n_grams))
    low = np.uint64((1 << PLACE_BITS) - 1)
    blocks = -(-n_grams // span)
    keys = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
    keys[:n_grams] = (hashes & ~low) | np.arange(n_grams, dtype=np.uint64)
    # least key of each run of `span` grams: suffix minima of one block meet prefix minima of the next
    folded = keys.reshape(blocks, span)
    before = np.minimum.accumulate(folded, axis=1).ravel()
    after = np.minimum.accumulate(folded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[:n], before[span - 1 : span - 1 + n])
    # windows across two texts are left out: the last window - 1 starts of each text
    whole = np.ones(n + window, bool)
    starts = np.concatenate(([0], ends[:-1]))
    edges = np.zeros(n + window + 1, np.int32)
    np.add.at(edges, np.minimum(np.maximum(starts, ends - window + 1), n + window), 1)
    np.add.at(edges, np.minimum(ends, n + window), -1)
    whole = np.cumsum(edges)[:n] == 0
    text = np.zeros(n + 1, np.int64)
    np.add.at(text, np.minimum(starts, n), 1)
    text = np.cumsum(text)[:n]
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | (whole[1:] != whole[:-1]) | (text[1:] != text[:-1])
    lo = np.flatnonzero(new)
    hi = np.concatenate((lo[1:], [n])) - 1
    lo, hi = lo[whole[lo]], hi[whole[lo]]
    at = (least[lo] & low).astype(np.int64)
    return at, hashes[at], lo, hi
