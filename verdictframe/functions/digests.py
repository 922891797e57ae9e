"""md5 of numbered texts, many at once: what SQL hashes one by one, as NumPy arrays inside a task."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = tuple(int(abs(np.sin(i + 1)) * 2**32) for i in range(64))
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_MASK = 0xFFFFFFFF
_RUN_DIGITS = 4  # 10,000 texts at once, whose words stay in the processor's cache
_ONE_BLOCK = 55  # bytes of a text that md5 takes in one step


def first_words(prefix: str, start: int, stop: int) -> np.ndarray:
    """The first 32 md5 bits of ``prefix`` followed by each number of start .. stop - 1 in decimal digits."""
    out = np.empty(stop - start, dtype=np.uint32)
    head = prefix.encode()
    if len(head) + len(str(stop)) > _ONE_BLOCK:
        for i in range(start, stop):
            out[i - start] = int.from_bytes(hashlib.md5(head + str(i).encode()).digest()[:4], "big")
        return out
    for low, high, digits in _runs(start, stop):
        base = low // 10**digits
        _one_block(head + (str(base).encode() if base else b""), digits, low - base * 10**digits, high - base * 10**digits, out[low - start : high - start])
    return out


def _runs(start: int, stop: int) -> Iterator[tuple[int, int, int]]:
    """Numbers that differ in their last digits only, as (low, high, how many digits)."""
    while start < stop:
        digits = min(_RUN_DIGITS, len(str(start)))
        span = 10**digits
        high = min(stop, start - start % span + span)
        yield start, high, digits
        start = high


@lru_cache(maxsize=32)
def _digit_words(digits: int, shift: int) -> np.ndarray:
    """Words that hold all numbers of so many digits, leading zeros included, from byte ``shift`` on."""
    texts = np.zeros((10**digits, -(-(shift + digits) // 4) * 4), dtype=np.uint8)
    numbers = np.arange(10**digits)
    for place in range(digits):
        texts[:, shift + place] = 48 + numbers // 10 ** (digits - 1 - place) % 10
    return np.ascontiguousarray(texts.view("<u4").T)


def _one_block(head: bytes, digits: int, low: int, high: int, out: np.ndarray) -> None:
    length = len(head) + digits
    block = head + bytes(digits) + b"\x80" + bytes(_ONE_BLOCK - length) + (8 * length).to_bytes(8, "little")
    words: list = [int.from_bytes(block[i : i + 4], "little") for i in range(0, 64, 4)]
    for i, column in enumerate(_digit_words(digits, len(head) % 4), len(head) // 4):
        words[i] = column[low:high] | np.uint32(words[i])
    a, b, c, d = (np.full(high - low, x, dtype=np.uint32) for x in _START)
    mixed, turned = np.empty_like(a), np.empty_like(a)
    for i in range(61):  # the first word of the digest is ready three rounds before the last
        if i < 16:
            np.bitwise_xor(c, d, out=mixed)
            np.bitwise_and(mixed, b, out=mixed)
            np.bitwise_xor(mixed, d, out=mixed)
            word = words[i]
        elif i < 32:
            np.bitwise_xor(b, c, out=mixed)
            np.bitwise_and(mixed, d, out=mixed)
            np.bitwise_xor(mixed, c, out=mixed)
            word = words[(5 * i + 1) % 16]
        elif i < 48:
            np.bitwise_xor(b, c, out=mixed)
            np.bitwise_xor(mixed, d, out=mixed)
            word = words[(3 * i + 5) % 16]
        else:
            np.invert(d, out=mixed)
            np.bitwise_or(mixed, b, out=mixed)
            np.bitwise_xor(mixed, c, out=mixed)
            word = words[7 * i % 16]
        if isinstance(word, int):
            a += np.uint32((word + _SINES[i]) & _MASK)
        else:
            a += word
            a += np.uint32(_SINES[i])
        a += mixed
        turn = _SHIFTS[i // 16][i % 4]
        np.left_shift(a, np.uint32(turn), out=turned)
        np.right_shift(a, np.uint32(32 - turn), out=a)
        np.bitwise_or(a, turned, out=a)
        a += b
        a, b, c, d = d, a, b, c
    b += np.uint32(_START[0])
    out[:] = b.byteswap()
