"""Numbered draws by hash, made by numpy on whole arrays: the first 32 bits of md5(prefix || i)."""

from __future__ import annotations

import hashlib
import math

import numpy as np

_CONSTANTS = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_SHIFTS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Numbers hashed at once: their dozen arrays stay in a core's cache.
CHUNK = 16_384


def _one_block(prefix: bytes, start: int, stop: int, digits: int) -> np.ndarray:
    """Numbers of as many `digits`, prefix and digits in one block of MD5."""
    size, m = len(prefix) + digits, stop - start
    block = bytearray(64)
    block[: len(prefix)], block[size] = prefix, 0x80
    block[56:64] = (8 * size).to_bytes(8, "little")
    fixed = [int.from_bytes(block[4 * w : 4 * w + 4], "little") for w in range(16)]
    moving: dict[int, np.ndarray] = {}
    rest = np.arange(start, stop, dtype=np.uint64)
    rest = rest.astype(np.uint32) if stop <= 2**32 else rest
    for at in range(size - 1, len(prefix) - 1, -1):
        tens = rest // rest.dtype.type(10)
        digit = (rest - tens * rest.dtype.type(10)).astype(np.uint32) + np.uint32(48)
        word = moving.setdefault(at // 4, np.zeros(m, np.uint32))
        word |= digit << np.uint32(8 * (at % 4))
        rest = tens
    a, b, c, d = (np.full(m, x, np.uint32) for x in _START)
    f, t = np.empty(m, np.uint32), np.empty(m, np.uint32)
    for i in range(61):  # the last three steps don't touch the first word
        turn = i // 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
            g = i
        elif turn == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
            g = (5 * i + 1) % 16
        elif turn == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
            g = (3 * i + 5) % 16
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
            g = 7 * i % 16
        np.add(a, f, out=a)
        np.add(a, np.uint32((_CONSTANTS[i] + fixed[g]) & 0xFFFFFFFF), out=a)
        if g in moving:
            np.add(a, moving[g], out=a)
        s = _SHIFTS[turn][i % 4]
        np.left_shift(a, np.uint32(s), out=t), np.right_shift(a, np.uint32(32 - s), out=a), np.bitwise_or(a, t, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return (b + np.uint32(_START[0])).byteswap()


def first_words(prefix: str, start: int, stop: int) -> np.ndarray:
    """The first eight hex digits of md5(prefix || i) as numbers, for i from start to stop - 1."""
    head, out = prefix.encode(), np.empty(max(stop - start, 0), np.uint32)
    at = start
    while at < stop:
        digits = len(str(at))
        end = min(stop, at + CHUNK, 10**digits)
        if len(head) + digits <= 55:
            out[at - start : end - start] = _one_block(head, at, end, digits)
        else:
            out[at - start : end - start] = [int.from_bytes(hashlib.md5(head + str(i).encode()).digest()[:4], "big") for i in range(at, end)]
        at = end
    return out


def picks(words: np.ndarray, n: int) -> np.ndarray:
    """words mod n."""
    if n >= 2**32:
        return words
    size = np.uint32(n)
    return words - words // size * size


def kind_counts(pick: np.ndarray, ends: list[int]) -> list[int]:
    """How many picks lie below each end and not below the one before; `ends` rise."""
    if len(ends) > 64:
        return np.bincount(np.searchsorted(np.array(ends, np.int64), pick, side="right"), minlength=len(ends)).tolist()
    below = [0, *(int(np.count_nonzero(pick < np.uint32(e))) if e < 2**32 else len(pick) for e in ends)]
    return [b - a for a, b in zip(below, below[1:])]
