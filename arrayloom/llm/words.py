"""Words of texts as 64-bit hashes in one flat array, for the operators that work on word sequences.

All bytes of a slice of texts are hashed at once: with r a random value for each byte and P an odd number,
the running sum of r[byte_i] * P**i (modulo 2**64) gives any word's polynomial hash as a difference, moved
to the same exponent by the inverse of P. No Python object is made for a word.
"""

from __future__ import annotations

import string

import numpy as np

#: ASCII capitals to lower case; ASCII punctuation to spaces.
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
PLAIN = bytes.maketrans(string.ascii_uppercase.encode() + string.punctuation.encode(), string.ascii_lowercase.encode() + b" " * len(string.punctuation))
SPACE = np.ones(256, np.int8)
SPACE[[0x20, *range(0x09, 0x0E)]] = 0
BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of ``BASE`` and of its inverse, n of each at least."""
    if len(_POWERS[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words ``[^\\x20\\x09-\\x0D]+`` of the texts behind one another, and where each text's begin.

    The second array has one entry more than there are texts.
    """
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = SPACE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begins, ends = edges[0::2], edges[1::2]
    powers, inverses = _powers(len(data) + 1)
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * powers[: len(data)], out=running[1:])
    hashes = mix((running[ends] - running[begins]) * inverses[begins] + (ends - begins).astype(np.uint64))
    borders = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=borders[1:])
    return hashes, np.searchsorted(begins, borders)


def plain(text: str) -> bytes:
    """Lower-cased UTF-8 without ASCII punctuation."""
    return text.lower().encode().translate(PLAIN)


def odd_multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def window_hashes(words: np.ndarray, offsets: list[int], seed: int) -> np.ndarray:
    """For each start, a hash of the words at ``offsets`` from it."""
    n = len(words) - offsets[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for o, m in zip(offsets, odd_multipliers(len(offsets), seed), strict=True):
        out += words[o : o + n] * m
    return mix(out)
