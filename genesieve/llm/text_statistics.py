"""Counts of whole texts: words, symbols, repeated lines and words, byte classes."""

from __future__ import annotations

import numpy as np

from .common import Texts, U, distinct_runs, mix, per_text

SYMBOLS = b"#*$%&|<>"

# Byte classes, in this order.
LOWER, UPPER, DIGIT, SPACE, NEWLINE, STOP, SYMBOL, OTHER, HIGH = range(9)
_CLASS = np.full(256, OTHER, dtype=np.int64)
_CLASS[ord("a") : ord("z") + 1] = LOWER
_CLASS[ord("A") : ord("Z") + 1] = UPPER
_CLASS[ord("0") : ord("9") + 1] = DIGIT
_CLASS[[9, 11, 12, 13, 32]] = SPACE
_CLASS[10] = NEWLINE
_CLASS[list(b".,;:!?'\"()-")] = STOP
_CLASS[list(SYMBOLS)] = SYMBOL
_CLASS[128:] = HIGH


class Words:
    """The words of texts, hashed once for all statistics."""

    def __init__(self, texts: Texts):
        self.texts = texts
        self.start, self.end, self.owner = texts.words()
        self.hash = texts.span_hash(self.start, self.end)
        self.salt = mix(np.arange(texts.n, dtype=U) + U(0x5851F42D4C957F2D))

    def counts(self) -> np.ndarray:
        return per_text(self.owner, self.texts.n).astype(np.int64)

    def code_points(self) -> np.ndarray:
        """Code points inside words: bytes that start a character and part no words."""
        d = self.texts.data
        own = (d & 0xC0) != 0x80
        own &= ~((d == 32) | ((d >= 9) & (d <= 13)))
        total = np.concatenate([[0], np.cumsum(own)])
        return np.diff(total[self.texts.bounds])

    def repeated(self, width: int = 3) -> np.ndarray:
        """Words that lie in a window of ``width`` words found twice or more in their text."""
        n = len(self.hash)
        covered = np.zeros(n, dtype=np.int64)
        if n >= width:
            m = n - width + 1
            key = self.salt[self.owner[:m]].copy()
            for k in range(width):
                key = mix(key ^ self.hash[k : k + m] ^ U(k + 1))
            whole = np.flatnonzero(self.owner[:m] == self.owner[width - 1 :])
            order, new = distinct_runs(key[whole])
            alone = new & np.append(new[1:], True)
            at = whole[order[~alone]]
            step = np.bincount(at, minlength=n + 1) - np.bincount(at + width, minlength=n + 1)
            covered = np.cumsum(step)[:n]
        return per_text(self.owner, self.texts.n, covered > 0).astype(np.int64)

    def distinct(self) -> np.ndarray:
        order, new = distinct_runs(self.hash ^ self.salt[self.owner])
        return per_text(self.owner[order[new]], self.texts.n).astype(np.int64)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word, and those of them that equal an earlier line of their text."""
        t = self.texts
        breaks = np.flatnonzero(t.data == 10)
        start = np.unique(np.concatenate([t.bounds[:-1][t.sizes > 0], breaks + 1]))
        start = start[start < len(t.data)]
        if not len(start):
            return np.zeros(t.n, np.int64), np.zeros(t.n, np.int64)
        end = np.append(start[1:], len(t.data))
        end = end - ((t.data[end - 1] == 10) & (end > start))
        first = np.searchsorted(self.start, start)
        wordy = (first < len(self.start)) & (np.append(self.start, len(t.data) + 1)[first] < end)
        start, end = start[wordy], end[wordy]
        owner = t.owner(start)
        order, new = distinct_runs(t.span_hash(start, end) ^ self.salt[owner])
        return per_text(owner, t.n).astype(np.int64), per_text(owner[order[~new]], t.n).astype(np.int64)


def symbols(texts: Texts) -> np.ndarray:
    hit = np.zeros(256, dtype=bool)
    hit[list(SYMBOLS)] = True
    total = np.concatenate([[0], np.cumsum(hit[texts.data])])
    return np.diff(total[texts.bounds])


FEATURES = (
    "log_words", "log_bytes", "word_length", "word_length_spread", "distinct_words", "repeated_words",
    "repeated_lines", "line_length", "lower", "upper", "digit", "space", "stop", "symbol", "other", "high",
    "byte_entropy",
)


def features(texts: Texts) -> np.ndarray:
    """One row of transformed statistics per text; shares enter as log odds, sizes as logs."""
    words, n = Words(texts), texts.n
    size, count = texts.sizes.astype(float), words.counts().astype(float)
    owner = np.repeat(np.arange(n), texts.sizes)
    class_of = np.bincount(owner * 9 + _CLASS[texts.data], minlength=9 * n).reshape(n, 9)
    length = (words.end - words.start).astype(float)
    mean = per_text(words.owner, n, length) / np.maximum(count, 1)
    spread = np.sqrt(np.maximum(per_text(words.owner, n, length**2) / np.maximum(count, 1) - mean**2, 0))
    lines, again = words.lines()
    odds = lambda part, whole: np.log((part + 0.5) / (whole - part + 0.5))
    share = class_of / np.maximum(size, 1)[:, None]
    entropy = -(share * np.log(np.maximum(share, 1e-12))).sum(axis=1)
    columns = [
        np.log1p(count), np.log1p(size), np.log1p(mean), np.log1p(spread),
        odds(words.distinct(), count), odds(words.repeated(), count), odds(again, lines),
        np.log1p(size / np.maximum(lines, 1)),
        *(odds(class_of[:, c], size) for c in (LOWER, UPPER, DIGIT, SPACE, STOP, SYMBOL, OTHER, HIGH)),
        entropy,
    ]
    return np.column_stack(columns) if n else np.zeros((0, len(FEATURES)))
