"""Word shingles as 64-bit hashes, and fast similarity sketches of shingle sets."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from .common import hash_words, mix, space_words

#: Coordinates of a sketch (a power of two), cut into bands.
COORDINATES, BANDS = 128, 32
ROWS = COORDINATES // BANDS
_P = np.uint64(0x9E3779B97F4A7C15)
#: A seed for each round: twice as many rounds as coordinates.
_SEEDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * _P)
_BITS = np.uint64(COORDINATES.bit_length() - 1)
_MASK = np.uint64(COORDINATES - 1)
_BAND_SEEDS = mix(np.arange(1001, 1001 + BANDS, dtype=np.uint64) * _P)


def shingle_sets(texts: Sequence[str | None], width: int) -> list[np.ndarray]:
    """Each text's sorted distinct ``width``-word shingles; a shorter text is one shingle."""
    words = [space_words(t) for t in texts]
    h = hash_words([w for own in words for w in own])
    chained = h.copy()
    with np.errstate(over="ignore"):
        for k in range(1, width):
            chained[:-k] = chained[:-k] * _P + h[k:] if len(h) > k else chained[:-k]
    out, at = [], 0
    for own in words:
        n = len(own)
        if n >= width:
            out.append(np.unique(mix(chained[at : at + n - width + 1])))
        elif n:
            whole = np.uint64(n)
            with np.errstate(over="ignore"):
                for x in h[at : at + n]:
                    whole = whole * _P + x
            out.append(mix(np.array([whole])))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def fingerprint(s: np.ndarray) -> int:
    """A 64-bit hash of a set, as a signed number."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s ^ _SEEDS[0]).sum() ^ mix(s ^ _SEEDS[1]).sum() * _P])).view(np.int64)[0])


def similarity_sketch(s: np.ndarray) -> np.ndarray:
    """Fast similarity sketching of a set that isn't empty.

    In round i each element falls into a random coordinate; one that is still empty
    takes the least hash that falls there. After as many rounds as coordinates, round
    t + j puts every element into coordinate j, so that each is filled. A coordinate
    agrees between two sets with the probability of their Jaccard similarity.
    """
    out = np.zeros(COORDINATES, np.uint64)
    empty = np.ones(COORDINATES, bool)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for i in range(COORDINATES):
        hashed = mix(s ^ _SEEDS[i])
        least = np.full(COORDINATES, top)
        np.minimum.at(least, (hashed & _MASK).astype(np.int64), hashed >> _BITS)
        new = empty & (least != top)
        out[new] = mix(least[new] ^ _SEEDS[i])
        empty &= ~new
        if not empty.any():
            return out
    for j in np.flatnonzero(empty):
        out[j] = mix(s ^ _SEEDS[COORDINATES + j]).min()
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One key per band, different between bands."""
    rows = sketch.reshape(BANDS, ROWS)
    key = _BAND_SEEDS.copy()
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            key = mix(key * _P + rows[:, r])
    return key.view(np.int64)
