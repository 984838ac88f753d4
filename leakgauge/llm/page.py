"""Batches of texts as arrays of code points and tokens, for operators that look at every word of every text.

All texts of a batch stand one behind the other, so one numpy call does for all
of them what a loop would do word by word. A token is a word (letters, with
apostrophes and hyphens inside), a number (digits) or a single sign. Words are
compared by 64-bit hashes, which are the same in every process.
"""

from __future__ import annotations

import functools

import numpy as np

SIGN, SMALL, CAPITAL, DIGIT, SPACE, LINE = range(6)
WORD, NUMBER, MARK = 1, 2, 3
_TABLE = 1 << 16
_BASE = 0x9E3779B97F4A7C55
_TYPES = np.array([MARK, WORD, WORD, NUMBER, 0, MARK], np.uint8)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S1, _S2 = np.uint64(29), np.uint64(32)


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Kind and small letter of every code point of the basic plane."""
    kind, low = np.zeros(_TABLE, np.uint8), np.arange(_TABLE, dtype=np.uint32)
    for o in range(_TABLE):
        c = chr(o)
        if c.isdecimal():
            kind[o] = DIGIT
        elif c.isalnum():
            kind[o] = CAPITAL if c.isupper() or c.istitle() else SMALL
            small = c.lower()
            if len(small) == 1:
                low[o] = ord(small)
        elif c.isspace():
            kind[o] = SPACE
    kind[ord("_")] = LINE
    return kind, low


@functools.lru_cache(maxsize=1)
def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, for hashes of any stretch from one running sum."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        powers = np.full(n, base, np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = _grown(1 << max(20, (n - 1).bit_length()))
    return power[:n], inverse[:n]


def mix(*parts) -> np.ndarray:
    """One hash of several (arrays of) hashes or small numbers, in their order."""
    out = np.zeros(1, np.uint64)
    for p in parts:
        p = np.frombuffer(p.encode().ljust(8)[:8], np.uint64) if isinstance(p, str) else np.atleast_1d(p).astype(np.uint64, copy=False)
        out = (out ^ (out >> _S1)) * _M1 + (p ^ (p >> _S2)) * _M2
    return out ^ (out >> _S2)


EDGE = mix("edge")[0]
ANY_NUMBER = mix("number")[0]


class Page:
    """Tokens of ``texts``: start, end, type, doc, raw and low (hashes as written, if asked for, and in small letters)."""

    def __init__(self, texts: list[str], raw: bool = True):
        kind, low = _tables()
        self.text = "\0".join(texts) + "\0"
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        cp = self.cp = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(cp)
        rare = np.flatnonzero(cp >= _TABLE)
        basic = np.minimum(cp, _TABLE - 1) if len(rare) else cp
        k, small = kind.take(basic), low.take(basic)
        self.kind = k
        if len(rare):
            k[rare] = [SMALL if chr(c).isalpha() else SIGN for c in cp[rare]]
            small[rare] = cp[rare]
        letter = (k == SMALL) | (k == CAPITAL)
        t = np.zeros(n + 2, np.uint8)  # one more at both ends, so that every token begins and ends
        here = t[1:-1]
        _TYPES.take(k, out=here)
        here[self.begin[1:] - 1] = 0
        here[self._joiners(letter)] = WORD
        alone = here == MARK
        self.start = np.flatnonzero((here != 0) & ((here != t[:-2]) | alone))
        self.end = np.flatnonzero((here != 0) & ((here != t[2:]) | alone)) + 1
        self.type = here[self.start]
        self.doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(self.start, self.begin)))
        power, inverse = _powers(n)
        size = self.end - self.start

        def hashes(chars: np.ndarray) -> np.ndarray:
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(chars * power, out=sums[1:])
            return mix((sums[self.end] - sums[self.start]) * inverse[self.start], size)

        number = self.type == NUMBER
        self.low, self.raw = hashes(small), hashes(cp) if raw else None
        for h in (self.low, self.raw)[: 1 + raw]:
            h[number] = ANY_NUMBER

    def _joiners(self, letter: np.ndarray) -> np.ndarray:
        """Apostrophes and hyphens inside a word: not before a possessive s, nor before a small letter in a word with a capital."""
        cp, k = self.cp, self.kind
        at = np.flatnonzero((cp[1:-1] == 0x27) | (cp[1:-1] == 0x2019) | (cp[1:-1] == 0x2D)) + 1
        at = at[letter[at - 1] & letter[at + 1]]
        if not len(at):
            return at
        starts = np.flatnonzero(letter & ~np.concatenate([[False], letter[:-1]]))
        capital = k[starts[np.searchsorted(starts, at - 1, side="right") - 1]] == CAPITAL
        behind = np.minimum(at + 2, len(cp) - 1)
        possessive = (cp[at] != 0x2D) & np.isin(cp[at + 1], (ord("s"), ord("S"))) & ~letter[behind]
        return at[~possessive & ~((k[at + 1] == SMALL) & capital)]

    def char(self, at: np.ndarray) -> np.ndarray:
        """Code points at positions, 0 outside the page."""
        inside = (at >= 0) & (at < len(self.cp))
        return np.where(inside, self.cp[np.clip(at, 0, len(self.cp) - 1)], 0)

    def around(self, token: np.ndarray, doc: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
        """Hashes of tokens by index, EDGE where the index leaves the text ``doc``."""
        hashes = self.raw if hashes is None else hashes
        if not len(hashes):
            return np.full(len(token), EDGE)
        safe = np.clip(token, 0, len(hashes) - 1)
        return np.where((token == safe) & (self.doc[safe] == doc), hashes[safe], EDGE)


@functools.cache
def _signs(signs: str) -> np.ndarray:
    table = np.zeros(_TABLE, bool)
    table[[ord(c) for c in signs]] = True
    return table


def among(chars: np.ndarray, signs: str) -> np.ndarray:
    """Whether code points are one of ``signs``."""
    return _signs(signs).take(chars, mode="clip")


def word_hashes(words) -> np.ndarray:
    """Sorted hashes of words in small letters, as a ``Page`` would hash them."""
    words = sorted(words)
    page = Page(words)
    whole = (page.end - page.start == page.sizes[page.doc]) if len(page.start) else np.zeros(0, bool)
    return np.unique(page.low[whole])


class Hashed:
    """A set of hashes with a number each, looked up by the hash's leading bits and a few steps from there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray | None = None):
        keys = np.asarray(keys, np.uint64)
        values = np.ones(len(keys), np.float32) if values is None else np.asarray(values, np.float32)
        bits = max(4, int(4 * len(keys) + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values, self.steps = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.float32), 1
        slot = (keys >> self.shift).astype(np.int64)
        while len(keys):
            free = self.keys[slot] == 0
            _, first = np.unique(slot[free], return_index=True)  # one key a slot, the others move on
            at = np.flatnonzero(free)[first]
            self.keys[slot[at]], self.values[slot[at]] = keys[at], values[at]
            rest = np.ones(len(keys), bool)
            rest[at] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & self.mask
            self.steps += len(keys) > 0

    def get(self, asked: np.ndarray, missing: float = 0.0) -> np.ndarray:
        slot = (asked >> self.shift).astype(np.int64)
        there = self.keys[slot]
        out = np.where(there == asked, self.values[slot], np.float32(missing))
        open_ = np.flatnonzero((there != asked) & (there != 0))
        for _ in range(self.steps - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & self.mask
            there = self.keys[slot[open_]]
            hit = there == asked[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (there != 0)]
        return out

    def has(self, asked: np.ndarray) -> np.ndarray:
        return self.get(asked) > 0


def member(sorted_hashes: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(sorted_hashes):
        return np.zeros(len(asked), bool)
    return sorted_hashes[np.minimum(np.searchsorted(sorted_hashes, asked), len(sorted_hashes) - 1)] == asked
