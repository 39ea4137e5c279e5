"""The first four bytes of the MD5 of numbered texts, many texts at once.

Draws are numbered texts: a head that says for what is drawn, and the number of the draw.  Texts of
one length that differ in their last digits only go through the rounds of MD5 together, as whole arrays.
"""

from __future__ import annotations

import math

import numpy as np

try:  # twice as fast on short texts
    from _md5 import md5
except ImportError:
    from hashlib import md5

AT_ONCE = 33_334
LEAST = 2_000  # fewer are faster one by one
_LONGEST = 55  # bytes of a text that is one block
_ALL = 0xFFFFFFFF
_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNED = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_WORD = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ROUNDS = 61  # the first word takes no more
_LAST = 5  # digits that differ among texts
_DIGITS = (np.arange(10**_LAST) // 10 ** np.arange(_LAST - 1, -1, -1)[:, None] % 10 + ord("0")).astype(np.uint32)
_SHIFTS = np.arange(33, dtype=np.uint32)


def numbered_md5(head: bytes, first: int, last: int) -> np.ndarray:
    """The first four bytes, as a number, of the MD5 of ``head`` and each number from ``first`` to before ``last``."""
    parts, at = [], first
    while at < last:
        digits = min(len(str(at)), _LAST)
        end = min(last, at + AT_ONCE, (at // 10**_LAST + 1) * 10**_LAST, 10**digits if at < 10**_LAST else last)
        front = head + (b"%d" % (at // 10**_LAST) if at >= 10**_LAST else b"")
        if end - at < LEAST or len(front) + digits > _LONGEST:
            texts = [md5(head + b"%d" % d).digest() for d in range(at, end)]
            parts.append(np.frombuffer(b"".join(texts), ">u4")[::4].astype(np.uint32))
        else:
            varied = _DIGITS[_LAST - digits :, at % 10**_LAST : (end - 1) % 10**_LAST + 1]
            parts.append(_first_words(_words(front, varied)).byteswap())
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _words(front: bytes, varied: np.ndarray) -> list[int | np.ndarray]:
    """The 16 words of texts of ``front`` and digits, one row of them for each place; those without these digits are plain numbers."""
    length = len(front) + len(varied)
    text = front + bytes(len(varied)) + b"\x80" + bytes(_LONGEST - length) + (8 * length).to_bytes(8, "little")
    words: list[int | np.ndarray] = [int.from_bytes(text[i : i + 4], "little") for i in range(0, 64, 4)]
    for k, digit in enumerate(varied):
        word, byte = divmod(len(front) + k, 4)
        words[word] = (np.uint32(words[word]) if isinstance(words[word], int) else words[word]) | digit << _SHIFTS[8 * byte]
    return words


def _mixed(k: int, b: int, c: int, d: int) -> int:
    return ((d ^ (b & (c ^ d))), (c ^ (d & (b ^ c))), (b ^ c ^ d), (c ^ (b | (d ^ _ALL))))[k]


def _first_words(words: list[int | np.ndarray]) -> np.ndarray:
    a, b, c, d = _START
    i = 0
    while isinstance(words[_WORD[i]], int):  # alike for all texts
        x, turned = (a + _mixed(i // 16, b, c, d) + _ADDED[i] + words[_WORD[i]]) & _ALL, _TURNED[i // 16][i % 4]
        a, b, c, d = d, (b + (x << turned | x >> (32 - turned))) & _ALL, b, c
        i += 1
    n = max(np.size(w) for w in words)
    a, b, c, d = (np.full(n, x, np.uint32) for x in (a, b, c, d))
    t, u = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(i, _ROUNDS):
        k, word, turned = i // 16, words[_WORD[i]], _TURNED[i // 16][i % 4]
        if k == 0:
            np.bitwise_xor(c, d, out=t)
            np.bitwise_and(t, b, out=t)
            np.bitwise_xor(t, d, out=t)
        elif k == 1:
            np.bitwise_xor(b, c, out=t)
            np.bitwise_and(t, d, out=t)
            np.bitwise_xor(t, c, out=t)
        elif k == 2:
            np.bitwise_xor(b, c, out=t)
            np.bitwise_xor(t, d, out=t)
        else:
            np.invert(d, out=t)
            np.bitwise_or(t, b, out=t)
            np.bitwise_xor(t, c, out=t)
        np.add(a, t, out=a)
        if isinstance(word, int):
            np.add(a, np.uint32((_ADDED[i] + word) & _ALL), out=a)
        else:
            np.add(a, word, out=a)
            np.add(a, np.uint32(_ADDED[i]), out=a)
        np.left_shift(a, _SHIFTS[turned], out=t)
        np.right_shift(a, _SHIFTS[32 - turned], out=u)
        np.bitwise_or(t, u, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return b + np.uint32(_START[0])
