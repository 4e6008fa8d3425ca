"""Exact encoding with a tokenizers file, made fast by remembering the ids of words.

The tokenizer word_bpe_49k lower-cases, drops white space and encodes each word-like piece alone, so
the ids of a text are those of its pieces in order. Texts of common characters are cut into pieces
with numpy and looked up in a hash table that holds the pieces seen so far, compared character by
character; a new piece goes through the library's model. Any other text (other scripts, combining or
control characters, special-token strings) is given to the library as it stands.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

LETTER, DIGIT, SPACE, OTHER, RARE = 1, 2, 3, 4, 0
#: Ranges of characters whose lower case is one character, and which normal form C leaves alone.
COMMON = [(0x20, 0x7E), (0xA1, 0x12F), (0x132, 0x17F), (0x400, 0x45F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF)]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The class and the lower case of each 16-bit character."""
    kind, lower = np.zeros(65536, np.uint8), np.arange(65536, dtype=np.uint16)
    for a, b in COMMON:
        for c in range(a, b + 1):
            ch = chr(c)
            lower[c] = ord(ch.lower())
            kind[c] = LETTER if ch.isalpha() else DIGIT if ch.isnumeric() else OTHER
    kind[[0x20, 0x09, 0x0A, 0x0D]] = SPACE
    return kind, lower


KIND, LOWER = _tables()
#: Byte-level vocabularies write a byte as a visible character: itself, or the next free one from 256 on.
VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in VISIBLE)}
#: Longer texts are cut at spaces, so that what is looked up at once stays small.
LONG = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ODD and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
    one = np.ones(n, np.uint64)
    up, down = one.copy(), one.copy()
    up[1:], down[1:] = ODD, inverse
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _pieces(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased characters, and where each piece starts and ends. u ends with white space."""
    kind, low = KIND[u], LOWER[u]
    start = np.empty(len(u), bool)
    start[0] = kind[0] != SPACE
    start[1:] = (kind[1:] != SPACE) & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
    quote = np.flatnonzero((low == 39) & start)
    quote = quote[kind[np.minimum(quote + 1, len(u) - 1)] == LETTER]  # a lone apostrophe before a letter
    if len(quote):  # 's 't 'm 'd, then 're 've 'll
        a, b = low[quote + 1], low[np.minimum(quote + 2, len(u) - 1)]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        cut = quote[one | two]
        start[cut + 1] = False
        after = cut + np.where(one, 2, 3)[one | two]
        start[after] = kind[after] != SPACE
    bounds = np.flatnonzero(start | (kind == SPACE))
    at = np.flatnonzero(start[bounds])
    return low, bounds[at], bounds[at + 1]


class Encoder:
    """encode(texts) gives the ids of all texts, one after the other, and the number of ids of each."""

    def __init__(self, path: str, remember: int = 300_000, bits: int = 20) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer, self.remember, self.bits = Tokenizer.from_file(path), min(remember, 1 << (bits - 1)), bits
        top = max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.dtype = np.uint16 if top < 65536 else np.uint32
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, specials)) or "(?!)")
        self.powers = _powers(1 << 16)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.slots = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.known, self.used, self.spelt = 0, 0, 0
        self.starts, self.sizes = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.at, self.lengths = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids, self.chars = np.zeros(4096, self.dtype), np.zeros(4096, np.uint16)

    def library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _room(self, name: str, least: int) -> None:
        a = getattr(self, name)
        if least > len(a):
            setattr(self, name, np.concatenate([a, np.zeros(max(least, 2 * len(a)) - len(a), a.dtype)]))

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 if it is new."""
        out, left, mask = np.full(len(h), -1, np.int64), np.arange(len(h)), np.uint64((1 << self.bits) - 1)
        at = (h >> np.uint64(20)) & mask
        while len(left):
            there = self.keys[at]
            same = there == h[left]
            out[left[same]] = self.slots[at[same]]
            on = ~same & (there != 0)
            left, at = left[on], (at[on] + np.uint64(1)) & mask
        return out

    def _learn(self, h: np.ndarray, words: list[str]) -> None:
        """Adds pieces whose hashes are new and all different."""
        word = self.tokenizer.model.tokenize
        each = [[t.id for t in word(w.encode().decode("latin-1").translate(BYTES))] for w in words]
        n, k = self.known, len(words)
        for names, used, parts in ((("starts", "sizes", "ids"), "used", each), (("at", "lengths", "chars"), "spelt", words)):
            begin, size, flat = names
            sizes = np.fromiter(map(len, parts), np.int64, k)
            was, now = getattr(self, used), getattr(self, used) + int(sizes.sum())
            self._room(begin, n + k), self._room(size, n + k), self._room(flat, now)
            getattr(self, size)[n : n + k], getattr(self, begin)[n : n + k] = sizes, was + np.cumsum(sizes) - sizes
            getattr(self, flat)[was:now] = np.frombuffer("".join(words).encode("utf-16-le"), np.uint16) if parts is words else np.fromiter(chain.from_iterable(each), np.int64, now - was)
            setattr(self, used, now)
        mask, left = np.uint64((1 << self.bits) - 1), np.arange(k)
        at = (h >> np.uint64(20)) & mask
        while len(left):  # where two want one place, the last written has it
            free = self.keys[at] == 0
            self.keys[at[free]] = h[left[free]]
            got = free & (self.keys[at] == h[left])
            self.slots[at[got]] = n + left[got]
            left, at = left[~got], (at[~got] + np.uint64(1)) & mask
        self.known = n + k

    def _common(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and their number for texts of common characters; the numbers of texts that were not looked up right."""
        joined = "\n".join([*texts, ""])
        u = np.frombuffer(joined.encode("utf-16-le"), np.uint16)
        until = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        low, s, e = _pieces(u)
        if len(self.powers[0]) <= len(u):
            self.powers = _powers(1 << (len(u)).bit_length())
        up, down = self.powers
        sums = np.zeros(len(u) + 1, np.uint64)
        np.cumsum(low * up[: len(u)], out=sums[1:])
        h = (sums[e] - sums[s]) * down[s]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h |= np.uint64(1)
        slot = self._find(h)
        if len(new := np.flatnonzero(slot < 0)):
            some, first = np.unique(h[new], return_index=True)
            flat = low.tobytes().decode("utf-16-le")
            self._learn(some, [flat[s[i] : e[i]] for i in new[first]])
            slot[new] = self._find(h[new])
        size = e - s
        wrong = self.lengths[slot] != size
        size[wrong] = 0
        ends = np.cumsum(size)
        step = np.arange(ends[-1] if len(ends) else 0)
        differ = low[step + np.repeat(s - (ends - size), size)] != self.chars[step + np.repeat(self.at[slot] - (ends - size), size)]
        wrong[np.searchsorted(ends, np.flatnonzero(differ), "right")] = True
        n = self.sizes[slot]
        done = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(self.starts[slot] - done[:-1], n) + np.arange(done[-1])]
        counts = np.diff(done[np.concatenate([[0], np.searchsorted(s, until)])])
        return ids, counts, np.unique(np.searchsorted(until, s[wrong], "right"))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if self.known > self.remember:
            self._forget()
        counts, parts, common = np.zeros(len(texts), np.int64), {}, []
        for i, text in enumerate(texts):
            if text:
                if len(text) > LONG and not self.special.search(text) and " " in text:
                    parts[i] = np.concatenate([self.encode([p])[0] for p in self._cut(text)])
                elif len(text) > LONG or self.special.search(text) or not self._is_common(text):
                    parts[i] = np.asarray(self.library(text), np.uint32)
                else:
                    common.append(i)
        if common:
            ids, sizes, wrong = self._common([texts[i] for i in common])
            counts[common] = sizes
            for k in wrong:
                parts[common[k]] = np.asarray(self.library(texts[common[k]]), np.uint32)
            if not parts:
                return ids.astype(np.uint32), counts
            ends = np.cumsum(sizes)
            for k, i in enumerate(common):
                parts.setdefault(i, ids[ends[k] - sizes[k] : ends[k]])
        for i, p in parts.items():
            counts[i] = len(p)
        return np.concatenate([np.zeros(0, np.uint32), *(parts[i] for i in sorted(parts))]).astype(np.uint32), counts

    @staticmethod
    def _cut(text: str) -> list[str]:
        """Parts of a long text, cut at spaces, where no piece spans the cut."""
        parts, at = [], 0
        while len(text) - at > LONG // 2 and (space := text.find(" ", at + LONG // 4)) >= 0:
            parts.append(text[at:space])
            at = space
        return [*parts, text[at:]]

    @staticmethod
    def _is_common(text: str) -> bool:
        if text.isascii() and text.isprintable():
            return True
        units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)
        return bool(KIND[units].all())


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process, which keeps what it has seen across tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def path_of(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def default_path() -> str:
    return path_of("word_bpe_49k.json")
