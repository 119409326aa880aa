"""Word shingles, MinHash samples and odd sketches of one text, in numpy. Everything is a pure function of the text's
bytes, so retried tasks give the same values."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_SPLIT = np.array([_U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)])


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _SPLIT[1]
    x = (x ^ (x >> _U(27))) * _SPLIT[2]
    return x ^ (x >> _U(31))


def _stream(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _SPLIT[0] + _U(seed))


#: A random value for each byte, with A-Z as a-z, and the white space that parts words.
_BYTE = _stream(11, 256)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0xD6E8FEB86659FD93
_CHUNK = 1 << 16
_PLACE = _stream(23, 64) | _U(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    size = 1
    while size < n:
        step = _U(pow(base, size, 1 << 64))
        out[size : 2 * size] = out[: min(size, n - size)] * step
        size *= 2
    return out


_UP = _powers(_BASE, _CHUNK)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), _CHUNK)


def _hash_span(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the spans of at most _CHUNK bytes."""
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * _UP[: len(data)], out=total[1:])
    return (total[ends] - total[starts]) * _DOWN[starts]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, A-Z taken as a-z, in order."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    space = np.concatenate(([True], _SPACE[data], [True]))
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[0::2], edge[1::2]
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        upto = max(at + 1, int(np.searchsorted(ends, base + _CHUNK - 1, side="right")))
        if ends[upto - 1] - base >= _CHUNK:  # one word longer than a chunk
            value = _U(0)
            for lo in range(int(base), int(ends[at]), _CHUNK - 1):
                hi = min(lo + _CHUNK - 1, int(ends[at]))
                value = mix(_hash_span(data[lo:hi], np.array([0]), np.array([hi - lo])) + value)[0]
            out[at] = value
        else:
            out[at:upto] = _hash_span(data[base : ends[upto - 1]], starts[at:upto] - base, ends[at:upto] - base)
        at = upto
    return mix(out + (ends - starts).astype(np.uint64) * _PLACE[63])


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the text's word shingles: one for the whole sequence where it is shorter, none
    without words."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    hashes = word_hashes(text)
    if not len(hashes):
        return hashes
    size = min(words, len(hashes))
    n = len(hashes) - size + 1
    total = np.full(n, size, dtype=np.uint64) * _SPLIT[0]
    for k in range(size):
        total += hashes[k : k + n] * _PLACE[k]
    return np.unique(mix(total))


class Sketcher:
    """MinHash samples of shingle sets, their band keys, and odd sketches: the samples folded into a parity bitmap."""

    def __init__(self, bands: int = 40, rows: int = 5, bits: int = 1024, seed: int = 7):
        self.bands, self.rows, self.bits = bands, rows, bits
        k = bands * rows
        self.k = k
        self.factor = (_stream(seed, k) >> _U(32)).astype(np.uint32) | np.uint32(1)
        self.offset = (_stream(seed + 1, k) >> _U(32)).astype(np.uint32)
        self.slot = _stream(seed + 2, k)
        self.row = _stream(seed + 3, rows) | _U(1)
        self.band = _stream(seed + 4, bands)

    def samples(self, values: np.ndarray) -> np.ndarray:
        low = (values ^ (values >> _U(32))).astype(np.uint32)
        best = np.full(self.k, np.uint32(0xFFFFFFFF))
        for at in range(0, len(low), 512):
            part = low[at : at + 512, None] * self.factor[None, :]
            part += self.offset
            np.minimum(best, part.min(axis=0), out=best)
        return best

    def band_keys(self, samples: np.ndarray) -> np.ndarray:
        rows = mix(samples.astype(np.uint64).reshape(self.bands, self.rows) + self.row)
        return mix((rows * self.row).sum(axis=1, dtype=np.uint64) + self.band).view(np.int64)

    def odd_sketch(self, samples: np.ndarray) -> bytes:
        place = mix(samples.astype(np.uint64) + self.slot) % _U(self.bits)
        odd = np.bincount(place.astype(np.int64), minlength=self.bits) & 1
        return np.packbits(odd.astype(np.uint8)).tobytes()

    def most_odd(self, similarity: float) -> int:
        """The largest XOR population count that an estimate of this similarity or more may have."""
        left = (1 - 2 / self.bits) ** (2 * self.k * (1 - similarity))
        return int(np.ceil(self.bits / 2 * (1 - left)))


def popcounts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The XOR population counts of rows of 64-bit words."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
