"""A blocked Bloom filter: all bits of a key lie in one 64-byte block, so a test touches one cache line."""

from __future__ import annotations

import numpy as np

BLOCK_WORDS = 8  # 64-bit words in a block
PROBES = 8


class BlockedBloom:
    """Bits over 64-bit hashes. ``bits_per_key`` of 16 gives about one false positive in a thousand; the size never
    exceeds ``max_bytes`` (beyond that only the share of false positives grows)."""

    def __init__(self, n_keys: int, bits_per_key: int = 16, max_bytes: int = 1 << 26):
        blocks = max(1, -(-n_keys * bits_per_key // (64 * BLOCK_WORDS)))
        self.blocks = min(blocks, max_bytes // (8 * BLOCK_WORDS))
        self.words = np.zeros(self.blocks * BLOCK_WORDS, np.uint64)

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers and masks, a row per key and a column per probe: one bit in each word of the block."""
        h = hashes.astype(np.uint64)
        block = ((h >> np.uint64(32)) % np.uint64(self.blocks)).astype(np.int64)
        salted = h[:, None] * (np.uint64(0x9E3779B97F4A7C15) + np.uint64(2) * np.arange(PROBES, dtype=np.uint64)[None, :] * np.uint64(0xC2B2AE3D27D4EB4F))
        words = block[:, None] * BLOCK_WORDS + np.arange(PROBES)[None, :] % BLOCK_WORDS
        return words, np.uint64(1) << (salted >> np.uint64(58))

    def add(self, hashes: np.ndarray) -> None:
        words, masks = self._places(hashes)
        np.bitwise_or.at(self.words, words.ravel(), masks.ravel())

    def might_contain(self, hashes: np.ndarray) -> np.ndarray:
        words, masks = self._places(hashes)
        return ((self.words[words] & masks) == masks).all(axis=1)
