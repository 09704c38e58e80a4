"""Word shingles of texts as 64-bit hashes, for whole batches of texts at once (numpy)."""

from __future__ import annotations

import hashlib

import numpy as np

#: Fixed values of the hash functions: an odd base with its inverse, and odd multipliers for the words of a shingle.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MULTIPLIERS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.empty(size, np.uint64), np.empty(size, np.uint64)
        up[0] = down[0] = 1
        up[1:], down[1:] = _BASE, _INVERSE
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, number of words of each text).  Words are runs of bytes other than ASCII white space, A-Z lowered."""
    if not texts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    data = np.frombuffer(b" ".join(texts).translate(_LOWER) + b" ", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    up, down = _power_table(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    words = mix((total[end] - total[start]) * down[start])
    stops = np.cumsum([len(t) + 1 for t in texts])
    return words, np.diff(np.searchsorted(start, stops, "left"), prepend=0)


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer than ``width`` words the whole sequence is one shingle."""
    words, counts = word_hashes(texts)
    n = max(0, len(words) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled += words[k : k + n] * _MULTIPLIERS[k]
    rolled = mix(rolled)
    out, at = [], 0
    for c in counts.tolist():
        if c >= width:
            out.append(np.unique(rolled[at : at + c - width + 1]))
        elif c:
            out.append(mix(np.array([(words[at : at + c] * _MULTIPLIERS[:c]).sum(dtype=np.uint64)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
        at += c
    return out


def set_digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


class MinHash:
    """Signatures of ``bands * rows`` minima of multiply-add hash functions with a fixed seed."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.size = bands, rows, bands * rows
        self.a = rng.integers(0, 1 << 32, self.size, np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, self.size, np.uint32)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """(texts, size) uint32; every set must hold something.  Blocks keep the work in cache."""
        out = np.empty((len(sets), self.size), np.uint32)
        at = 0
        while at < len(sets):
            end, n = at, 0
            while end < len(sets) and (end == at or n + len(sets[end]) <= 1 << 15):
                n += len(sets[end])
                end += 1
            x = (np.concatenate(sets[at:end]) >> np.uint64(32)).astype(np.uint32)
            starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[at : end - 1]]))).astype(np.int64)
            v = np.empty_like(x)
            for k in range(self.size):
                np.multiply(x, self.a[k], out=v)
                np.add(v, self.b[k], out=v)
                out[at:end, k] = np.minimum.reduceat(v, starts)
            at = end
        return out

    def band_keys(self, sigs: np.ndarray) -> np.ndarray:
        """(texts, bands) int64 keys."""
        x = sigs.reshape(len(sigs), self.bands, self.rows).astype(np.uint64)
        key = np.arange(1, self.bands + 1, dtype=np.uint64)[None, :] * np.uint64(_BASE)
        for k in range(self.rows):
            key = mix(key ^ (x[:, :, k] + np.uint64(k + 1)) * _MULTIPLIERS[k % 5])
        return key.view(np.int64)
