"""Byte-level BPE ids of whole texts, each different word of a slice encoded once.

A space between two other characters always starts a new word of the pattern, and so
does the first space of a run, or the last one before a word.  Texts are cut at such
spaces; words of a slice are told apart by two 64-bit hashes, new ones are encoded together
in one call, and known ones come, by their bytes, from a bounded cache of the task.  Texts with a space inside a run of
white space, and texts that contain a special token, go to the tokenizer whole.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import repeat

import numpy as np

from .common import Texts

CACHE_WORDS = 600_000
END = b"<|endoftext|>"
# bytes that are, or may begin or end, white space
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[*range(9, 14), *range(28, 33)]] = True
_MAY_BEGIN = _BLANK.copy()
_MAY_BEGIN[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_MAY_END = _BLANK.copy()
_MAY_END[0x80:0xC0] = True


class ByteBpe:
    """Ids of ``tokenizers``' byte-level BPE without added special tokens."""

    def __init__(self, ranks: str, whole: str):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(ranks), "rb") as lines:
            table = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        bpe = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self._plain = bpe.encode_ordinary
        self._bytes_of = np.zeros(max(table.values()) + 1, dtype=np.int64)
        for word, rank in table.items():
            self._bytes_of[rank] = len(word)
        self._whole, self._full = whole, None
        self._clear()

    def _clear(self) -> None:
        self._slot: dict[bytes, int] = {}
        self._ids = np.zeros(1 << 16, dtype=np.uint32)
        self._at = np.zeros(1 << 14, dtype=np.int64)  # word w has ids _at[w] .. _at[w + 1]

    def _learn(self, words: list[bytes]) -> None:
        """Words with their space in front: encoded as one text, since each space parts them."""
        ids = np.array(self._plain(b"".join(words).decode("utf-8")), dtype=np.uint32)
        ends = np.searchsorted(np.cumsum(self._bytes_of[ids]), np.cumsum([len(w) for w in words])) + 1
        self._store(words, ids, ends)

    def _learn_bare(self, words: list[bytes]) -> None:
        """Words at the start of a text, without a space to part them."""
        found = [self._plain(w.decode("utf-8")) for w in words]
        self._store(words, np.array([i for f in found for i in f], dtype=np.uint32), np.cumsum([len(f) for f in found]))

    def _store(self, words: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        known, base = len(self._slot), int(self._at[len(self._slot)])
        while base + len(ids) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        while known + len(words) >= len(self._at):
            self._at = np.concatenate([self._at, np.zeros_like(self._at)])
        self._ids[base : base + len(ids)] = ids
        self._at[known + 1 : known + len(words) + 1] = base + ends
        self._slot.update(zip(words, range(known, known + len(words)), strict=True))

    def _encode_whole(self, text: bytes) -> np.ndarray:
        if END not in text:
            return np.array(self._plain(text.decode("utf-8")), dtype=np.uint32)
        if self._full is None:
            import public_tokenizers
            from tokenizers import Tokenizer

            self._full = Tokenizer.from_file(public_tokenizers.path(self._whole))
        return np.array(self._full.encode(text.decode("utf-8"), add_special_tokens=False).ids, dtype=np.uint32)

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the bounds of each text's ids among them."""
        data, n = texts.data, texts.n
        raw = data.tobytes()
        if len(self._slot) > CACHE_WORDS:
            self._clear()
        space = np.flatnonzero(data == 32)
        owner = texts.owner(space)
        inner = space > texts.bounds[owner]
        ends = space + 1 == texts.bounds[owner + 1]
        padded = np.append(data, 32)
        odd = inner & _MAY_END[padded[space - 1]] & (ends | _MAY_BEGIN[padded[space + 1]])
        apart = np.zeros(n, dtype=bool)
        apart[owner[odd]] = True
        if END in raw:
            apart |= np.array([END in raw[a:b] for a, b in zip(texts.bounds[:-1], texts.bounds[1:], strict=True)], dtype=bool)

        plain = np.flatnonzero(~apart & (texts.sizes > 0))
        start = np.sort(np.concatenate([space[inner & ~apart[owner]], texts.bounds[plain]]))
        who = texts.owner(start)
        following = np.append(start[1:], len(data))
        end = np.minimum(following, texts.bounds[who + 1])
        key = texts.span_hash(start, end)
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        second = texts.span_hash(start, end, salt=1)
        apart[who[second != second[first][back]]] = True  # different words with one hash
        words = [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        slots = np.fromiter(map(self._slot.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        new = np.flatnonzero(slots < 0)
        bare = data[start[first[new]]] != 32
        for learn, group in ((self._learn, new[~bare]), (self._learn_bare, new[bare])):
            if len(group):
                slots[group] = len(self._slot) + np.arange(len(group))
                learn([words[i] for i in group.tolist()])
        slot = slots[back]
        length = self._at[slot + 1] - self._at[slot]
        place = np.concatenate([[0], np.cumsum(length)])
        ids = self._ids[np.repeat(self._at[slot] - place[:-1], length) + np.arange(place[-1])]
        counts = np.bincount(who, weights=length, minlength=n).astype(np.int64)[:n] if n else np.zeros(0, np.int64)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        if apart.any():
            pieces = [
                self._encode_whole(raw[texts.bounds[i] : texts.bounds[i + 1]]) if apart[i] else ids[bounds[i] : bounds[i + 1]]
                for i in range(n)
            ]
            ids = np.concatenate(pieces)
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        return ids, bounds


@lru_cache(maxsize=2)
def byte_bpe(ranks: str = "byte_bpe_50k.tiktoken", whole: str = "byte_bpe_50k.json") -> ByteBpe:
    """One per worker process; the files are read where the task runs."""
    return ByteBpe(ranks, whole)
