"""MD5 of many short texts at once, for orders that a hash decides."""

from __future__ import annotations

import hashlib

import numpy as np

# arrays of no dimension: numpy would turn a number into one at each of some hundred steps
_K = [np.array(int(abs(np.sin(np.float64(i + 1))) * 2**32), np.uint32) for i in range(64)]
_TURN = [[(np.array(t, np.uint32), np.array(32 - t, np.uint32)) for t in turns] for turns in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))]
_WORD = [lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: (7 * i) % 16]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ONE_BLOCK = 55  # bytes that fit one block beside the padding
_AT_ONCE = 16384  # texts whose state stays in a core's cache, and enough that a step is more than its call


def _compressed(words: np.ndarray) -> np.ndarray:
    """Digests (n, 4) of padded single blocks, words (16, n)."""
    n = words.shape[1]
    a, b, c, d = (np.full(n, v, np.uint32) for v in _START)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        part = i // 16
        if part == 0:  # d ^ (b & (c ^ d))
            np.bitwise_xor(c, d, f)
            np.bitwise_and(f, b, f)
            np.bitwise_xor(f, d, f)
        elif part == 1:  # c ^ (d & (b ^ c))
            np.bitwise_xor(b, c, f)
            np.bitwise_and(f, d, f)
            np.bitwise_xor(f, c, f)
        elif part == 2:
            np.bitwise_xor(b, c, f)
            np.bitwise_xor(f, d, f)
        else:  # c ^ (b | ~d)
            np.invert(d, f)
            np.bitwise_or(f, b, f)
            np.bitwise_xor(f, c, f)
        np.add(a, f, a)
        np.add(a, words[_WORD[part](i)], a)
        np.add(a, _K[i], a)
        left, right = _TURN[part][i % 4]
        np.left_shift(a, left, g)
        np.right_shift(a, right, a)
        np.bitwise_or(a, g, a)
        np.add(a, b, a)
        a, b, c, d = d, a, b, c
    return np.stack([v + np.uint32(s) for v, s in zip((a, b, c, d), _START, strict=True)], axis=1)


class Md5:
    """Digests of prefix + tail for many tails and one prefix at a time, as two numbers that order as the hex text does."""

    def __init__(self, tails: list[bytes]):
        self.tails = tails
        self.size = np.array([len(t) for t in tails], dtype=np.int64)
        self.start = -1

    def _blocks(self, start: int) -> None:
        """Padded blocks with room for a prefix of ``start`` bytes; tails that need more blocks are hashed apart."""
        self.start = start
        short = self.size + start <= _ONE_BLOCK
        self.short, self.long = np.flatnonzero(short), np.flatnonzero(~short)
        size = self.size[self.short]
        block = np.zeros((len(self.short), 64), np.uint8)
        width = int(size.max(initial=0))
        if width:
            text = np.array([self.tails[k] for k in self.short], dtype=f"S{width}")
            block[:, start : start + width] = text.view(np.uint8).reshape(-1, width)
        block[np.arange(len(size)), start + size] = 0x80
        block[:, 56:64] = (8 * (size + start)).astype("<u8").view(np.uint8).reshape(-1, 8)
        self.words = np.ascontiguousarray(block.view("<u4").T, dtype=np.uint32)  # a row a word, the prefix's bytes zero
        self.opening = self.words[: -(-start // 4)].copy()

    def of(self, prefix: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(high, low) 64 bits of each digest."""
        if len(prefix) != self.start:
            self._blocks(len(prefix))
        np.bitwise_or(self.opening, np.frombuffer(prefix + bytes(-len(prefix) % 4), "<u4").astype(np.uint32)[:, None], self.words[: len(self.opening)])
        out = np.empty((len(self.tails), 4), "<u4")
        for k in range(0, len(self.short), _AT_ONCE):
            out[self.short[k : k + _AT_ONCE]] = _compressed(self.words[:, k : k + _AT_ONCE])
        for k in self.long:
            out[k] = np.frombuffer(hashlib.md5(prefix + self.tails[k]).digest(), "<u4")
        both = out.view(">u8").astype(np.uint64)
        return both[:, 0], both[:, 1]
