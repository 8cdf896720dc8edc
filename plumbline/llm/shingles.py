"""Sets of hashed word shingles, a slice of texts at a time, in numpy.

Words are runs of bytes other than 0x20 and 0x09 to 0x0D, A-Z lower-cased. A word's hash is a polynomial over its bytes
modulo 2**64, finalised; a shingle's combines those of its words. A text with fewer words than a shingle has one shingle,
all its words; one without words has none. Shingles are compared by these 64-bit hashes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

WORDS = 5
LEAST_BITS = 1024  # of a sketch
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _BASE)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE[_SPACE] = 0
_PLACE = mix(np.arange(1, WORDS + 1, dtype=np.uint64) * _BASE) | np.uint64(1)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, back = np.full(n, _BASE), np.full(n, _BACK)
    up[0] = back[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(back)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each row begins and the last ends."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and where each row's words begin and the last end."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    inside = ~_SPACE[raw]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < len(raw)]
    start[heads] = inside[heads]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    up, back = _powers(1 << int(len(raw) - 1).bit_length() if len(raw) > 1 else 1)
    sums = np.add.reduceat(_VALUE[raw] * up[: len(raw)], starts)
    return mix(sums * back[starts]), np.searchsorted(starts, at)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """For each text, its distinct shingles in ascending order."""
    words, at = word_hashes(*text_bytes(column))
    n = len(words) - WORDS + 1
    every = np.zeros(0, np.uint64)
    if n > 0:
        every = words[:n] * _PLACE[0]
        for k in range(1, WORDS):
            every = every + words[k : k + n] * _PLACE[k]
        every = mix(every)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= WORDS:
            out.append(np.unique(every[a : b - WORDS + 1]))
        elif b > a:
            short = np.array([b - a], np.uint64)
            for k in range(b - a):
                short = mix(short + words[a + k : a + k + 1] * _PLACE[k])
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed 64-bit numbers."""
    import xxhash

    whole = xxhash.xxh3_128_intdigest(s.tobytes())
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return signed(whole >> 64), signed(whole & ((1 << 64) - 1))


_TURN = mix(np.arange(101, 107, dtype=np.uint64)) | np.uint64(1)


def signatures(s: np.ndarray) -> list[int]:
    """Three numbers that two sets share the likelier, the more alike they are: each of two minima under other orders."""
    least = [(s * t).min() for t in _TURN]
    return [int((mix(np.array([least[2 * k] ^ (least[2 * k + 1] >> np.uint64(1))], np.uint64))[0]) >> np.uint64(1)) for k in range(3)]


def parity_sketch(s: np.ndarray) -> bytes:
    """A bit per residue of the shingles: whether an odd number falls there. There are 2 to 4 times as many bits as shingles,
    ``LEAST_BITS`` at least, a power of two, so that a sketch folds to any smaller one."""
    bits = max(LEAST_BITS, 1 << int(2 * len(s) - 1).bit_length()) if len(s) else LEAST_BITS
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(a: bytes) -> np.ndarray:
    """A sketch as the words of one of ``LEAST_BITS``."""
    x = np.frombuffer(a, np.uint64)
    while 64 * len(x) > LEAST_BITS:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def least_difference(a: bytes, b: bytes) -> int:
    """The set difference of two sets is at least the number of bits in which their sketches differ."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())
