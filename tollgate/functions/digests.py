"""MD5 of many short texts at once, in numpy."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np

_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Bytes of a text that fit one block beside its padding.
_ONE_BLOCK = 55


def _mix(i: int, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    if i < 16:
        return d ^ (b & (c ^ d))
    if i < 32:
        return c ^ (d & (b ^ c))
    return b ^ c ^ d if i < 48 else c ^ (b | ~d)


class Digests:
    """MD5 of every head + tail, for many heads over the same ``tails``."""

    def __init__(self, tails: Sequence[bytes]):
        self.tails, self.longest = list(tails), max(map(len, tails))
        self.padded: dict[int, np.ndarray] = {}

    def _words(self, n: int) -> np.ndarray:
        """The 16 words of each tail's block behind a head of ``n`` bytes, with its padding."""
        if n not in self.padded:
            rows = b"".join((b"\0" * n + t + b"\x80").ljust(56, b"\0") + (8 * (n + len(t))).to_bytes(8, "little") for t in self.tails)
            self.padded[n] = np.ascontiguousarray(np.frombuffer(rows, "<u4").reshape(-1, 16).T)
        return self.padded[n]

    def halves(self, heads: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Both halves of the digests as big-endian numbers, heads x tails; the heads have one length.

        Digests compare as their pairs of halves do. Texts of one block are digested together, longer ones one by one.
        """
        n, shape = len(heads[0]), (len(heads), len(self.tails))
        if n + self.longest > _ONE_BLOCK:
            raw = np.frombuffer(b"".join(hashlib.md5(h + t).digest() for h in heads for t in self.tails), ">u8").reshape(*shape, 2)
            return raw[..., 0].astype(np.uint64), raw[..., 1].astype(np.uint64)
        first, rest = np.frombuffer(b"".join(h.ljust(64, b"\0") for h in heads), "<u4").reshape(-1, 16), self._words(n)
        words = [(first[:, k, None] + rest[k] if 4 * k < n else rest[k]) if 4 * k <= n + self.longest or k == 14 else None for k in range(16)]
        a, b, c, d = (np.full(shape, x, np.uint32) for x in _START)
        for i in range(64):
            f = _mix(i, b, c, d)
            f += a
            f += np.uint32(_SINES[i])
            if (w := words[_WORD[i]]) is not None:
                f += w
            turned = f << np.uint32(_TURNS[i])
            f >>= np.uint32(32 - _TURNS[i])
            turned |= f
            turned += b
            a, d, c, b = d, c, b, turned
        a, b, c, d = ((x + np.uint32(s)).byteswap().astype(np.uint64) for x, s in zip((a, b, c, d), _START))
        return a << np.uint64(32) | b, c << np.uint64(32) | d
