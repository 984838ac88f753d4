"""Personal information inside free text (problem 2).

High-recall generators propose overlapping spans for each kind: runs of
capitalised words, runs of words in any case behind a context that names stand
behind or with a known given name, numbers of a telling length, whatever holds
an at sign, and house numbers or boxes with the parts of an address behind
them. Boosted trees score every proposal by its format and context, thresholds
calibrated on held-out notes choose, and the best spans that do not overlap are
redacted. No proposal is dropped before the trees have seen it.

The trees, the context statistics and the thresholds are fitted on a bounded
sample of notes (``SAMPLE_NOTES``, ``SAMPLE_CHARS``, ``MOST_ROWS``). Its labels
come from facts, not from lists of cues: the persona of the note's subject says
which names, numbers, mail and address are personal. What no fact speaks of is
a counterexample only where its context or format has never gone with a fact
in the sample, else it takes no part. Given names, cities and the share of
notes in which a word stands in small letters are counted over all rows. Every
note is scored whole.

A name of more than ``MOST_WORDS`` words comes out as its accepted parts, which
are joined where only a blank or hyphen stands between them.

Defined results: a NULL note has no span and stays NULL, an empty one stays
empty; blanks, bracketed placeholders and stand-ins for an unknown number (one
digit repeated) are never proposed; without any persona there is no label and
nothing is found; an empty table gives no row.
"""

from __future__ import annotations

import bisect
import re
import warnings
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakgauge.llm import boosting
from leakgauge.llm.page import CAPITAL, DIGIT, SMALL, SPACE, WORD, Hashed, Page, among, member, mix, word_hashes
from leakgauge.session import ship, stable

KINDS = ("name", "email", "phone", "id", "address")
#: Names with a word in small letters have trees and a threshold of their own, so that the many words no name is made of do not move those of the others.
LOWER = "lower"
MODELS = (*KINDS, LOWER)
SAMPLE_NOTES = 6000
SAMPLE_CHARS = 6000
#: About as many labelled proposals of a kind are fitted; of more, whole notes are drawn by hash.
MOST_ROWS = 20_000
FOLDS = 3
#: Every so many notes are fitted once more with the contexts unknown.
MASKED = 8
#: A name left standing costs more than a word too many: thresholds are calibrated on this F score.
BETA = 2.0
MOST_WORDS = 4
#: Given names and cities in fewer than this share of the personas, and small words in fewer notes, are in no lexicon: a bound on their number at any size.
LEXICON_SHARE, SMALL_SHARE = 1e-5, 2e-4
#: A context seen so often and with a fact in at most this share of cases is a counterexample.
SEEN, NEVER = 10, 0.02
#: A cue: so many of the capitalised words behind it are known or strange names, and so many begin a persona's name. Names in small letters are proposed there too.
CUE, CUE_FACTS = 0.95, 0.005
PAGE_CHARS = 200_000

# Words that go with a name and are no part of it.
TITLES = frozenset("dr dres mr mrs ms mx miss prof professor sir md phd rn np pa do esq jr sr doctor frau herr sra srta señor señora mme mlle".split())
# Words for streets.
STREET = r"Street|Road|Avenue|Lane|Court|Row|Terrace|Boulevard|Drive|Close|Square|Way|Place|Walk|Crescent|Gardens|Hill|Park|Mews|St|Rd|Ave|Ln|Ct|Blvd|Dr|Ter"

_UP = "A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĔĖĘĚĜĞĠĢĤĦĨĪĬĮİĴĶĹĻĽĿŁŃŅŇŊŌŎŐŒŔŖŘŚŜŞŠŢŤŦŨŪŬŮŰŲŴŶŸŹŻŽ"
_DOT = r"(?:\.| ?[\(\[]dot[\)\]] ?| dot )"
_AT = r"(?: ?@ ?| ?[\(\[]at[\)\]] ?| at )"
_EMAIL = re.compile(rf"(?i)(?<![\w.+@-])[a-z0-9_%+\-]+(?:{_DOT}[a-z0-9_%+\-]+)*{_AT}[a-z0-9\-]+(?:{_DOT}[a-z0-9\-]+)+")
_DOMAIN = re.compile(rf"(?i) ?{_AT}[a-z0-9\-]+{_DOT}[a-z0-9\-]")
#: An address has at most 64 characters before the sign and 255 behind it; spelt-out dots and signs make it longer.
EMAIL_WINDOW, EMAIL_NEAR = 600, 60
_NUMBERS = re.compile(
    r"(?=[\d+(])(?<![\d])(?<!\d[.\-/,])(?<![A-Za-z]-)"
    r"(?:\+\d{1,3}[ .\-]?(?:\(0\))?\(?\d{2,4}\)?[ .\-]\d{3,4}[ .\-]?\d{3,4}|1[ .\-]\(?\d{3}\)?[ .\-]\d{3}[ .\-]\d{4}|\+\d{10,13}"
    r"|\(\d{3,5}\) ?\d{3}[ .\-]?\d{3,4}|\d{3}[.\-/ ]\d{3}[.\- ]\d{4}|0\d{2}[ .\-]\d{4}[ .\-]\d{4}|0\d{4}[ .\-]\d{6}|0\d{3}[ .\-]\d{3}[ .\-]\d{4}"
    r"|\d{3}[.\- ]\d{2}[.\- ]\d{4}|\d{4}[ .\-]\d{6}|\d{4}[ .\-]\d{3}[ .\-]\d{3}|\d{2} \d{4}-\d{4}|\d{5}[.\-]\d{5}|\d{3}[.\- ]\d{4}|\d{6,12})"
    r"(?!\d)(?![.\-/]\d)(?!\w)"
)
_ADDRESS_HEAD = re.compile(rf"(?:(?:P\.? ?O\.? ?Box|p\.o\. box|P\.O\. BOX|PO BOX) \d+|(?<![\w.,\-/])\d{{1,5}}[A-Za-z]?,? (?:[{_UP}][\w'’\-]*\s){{1,3}}(?:{STREET}|{STREET.upper()})\b\.?)")
_BOX = re.compile(r"(?i)p\.? ?o\.? ?box $")
_BREAK = r"(?:,\s{0,3}|\s{0,2}\r?\n\s{0,2})"
_APT = re.compile(rf"{_BREAK}(?:Apt|Flat|Unit|Suite|Apartment|Floor|APT|FLAT|UNIT|SUITE)\.? ?#?\w+|{_BREAK}#\d+")
_CITY = re.compile(rf"{_BREAK}[{_UP}][\w'’\-]*(?: [{_UP}][\w'’\-]*){{0,2}}")
_CODE = re.compile(rf"(?:{_BREAK}| )[A-Z]{{2}},? \d{{4,5}}(?:-\d{{4}})?\b|(?:{_BREAK}| )\d{{4,5}}\b")
_NAME_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")


def digits(s: str) -> str:
    return re.sub(r"\D", "", s)


def tidy(s: str) -> str:
    return re.sub(r"[\W_]+", "", s.lower())


def shape(s: str) -> str:
    return re.sub(r"\d", "9", s)


class Lexica:
    """Given names, small words with the share of notes they stand in, contexts that names stand behind (all as hashes), and cities as text."""

    def __init__(self, given: np.ndarray, cities: frozenset[str], small: np.ndarray, share: np.ndarray, cues: np.ndarray | None = None):
        self.given, self.cities, self.small, self.share, self.cues = given, cities, small, share, np.zeros(0, np.uint64) if cues is None else cues
        # of a small word the log of the notes out of 6,000 that hold it
        self.is_given, self.is_cue, self.log_notes = Hashed(given), Hashed(self.cues), Hashed(small, np.log1p(6000 * np.asarray(share)))


_IS_TITLE = Hashed(word_hashes(TITLES))


@dataclass
class Spans:
    """Proposals of one model on a page: where they stand, their context keys and features without the context rates."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    keys: np.ndarray  # proposals x contexts
    plain: np.ndarray  # proposals x features
    extra: object = None


def small_words(page: Page, given: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """doc and hash of the distinct words in small letters of every text, without those of mail addresses and beside a given name in small letters."""
    w = np.flatnonzero(page.type == WORD)
    s, e, h = page.start[w], page.end[w], page.low[w]
    plain = page.kind[s] == SMALL
    named = plain & member(given, h)
    beside = (s[1:] - e[:-1] <= 2) & (page.doc[w][1:] == page.doc[w][:-1])
    near = named.copy()
    near[1:] |= named[:-1] & beside
    near[:-1] |= named[1:] & beside
    before, behind, then = page.char(s - 1), page.char(e), page.char(e + 1)
    joined = among(before, "@._+-") | among(behind, "@_") | ((behind == ord(".")) & (page.kind[np.minimum(e + 1, len(page.kind) - 1)] == SMALL) & (then > 0))
    keep = plain & ~near & ~joined
    doc, h = page.doc[w][keep], h[keep]
    _, first = np.unique(mix(doc, h), return_index=True)
    return doc[first], h[first]


class Words:
    """The words of a page and how they stand to one another."""

    def __init__(self, page: Page, lexica: Lexica):
        self.page = page
        w = self.token = np.flatnonzero(page.type == WORD)
        s, e = self.start, self.end = page.start[w], page.end[w]
        self.doc, self.low = page.doc[w], page.low[w]
        n, kind = len(w), page.kind
        before, behind = page.char(s - 1), page.char(e)
        inside = lambda at: kind[np.clip(at, 0, len(kind) - 1)]
        first = s == page.begin[self.doc]
        bad = among(before, "'’@.°%") | (inside(s - 1) >= DIGIT) & (inside(s - 1) != SPACE)
        bad |= (before == 32) & (inside(s - 2) == DIGIT) & (s - 2 >= page.begin[self.doc])
        self.valid = (first | ~bad) & (behind != ord("@")) & ((inside(e) < DIGIT) | (inside(e) == SPACE))
        self.capital = kind[s] == CAPITAL
        self.size = e - s
        self.title = _IS_TITLE.has(self.low)
        self.given = lexica.is_given.has(self.low)
        self.counts = lexica.log_notes.get(self.low)
        capitals = np.concatenate([[0], np.cumsum(kind == CAPITAL)])
        letters = np.concatenate([[0], np.cumsum((kind == CAPITAL) | (kind == SMALL))])
        self.upper = (capitals[e] - capitals[s]) == (letters[e] - letters[s])
        self.parted = (letters[e] - letters[s]) < self.size
        # joined[i]: word i and word i + 1 can stand in one name
        gap = s[1:] - e[:-1]
        c0, c1, c2 = (page.char(e[:-1] + k) for k in range(3))
        one = self.size[:-1] == 1
        sp, cm, ht, dt = (ord(c) for c in " ,^.")
        ok = (gap == 1) & ((c0 == sp) | (c0 == cm) | (c0 == ht) | (one & (c0 == dt)))
        ok |= (gap == 2) & (((c0 == cm) & (c1 == sp)) | ((c0 == sp) & (c1 == ht)) | ((c0 == ht) & (c1 == sp)) | (one & (c0 == dt) & ((c1 == sp) | (c1 == cm))))
        ok |= (gap == 3) & (c2 == sp) & (((c0 == sp) & (c1 == ht)) | (one & (c0 == dt) & (c1 == cm)))
        same = self.doc[1:] == self.doc[:-1] if n else np.zeros(0, bool)
        self.joined = np.concatenate([ok & same & self.valid[1:] & self.valid[:-1], [False]]) if n else np.zeros(0, bool)
        self.comma = (page.char(e) == cm) & self.joined
        self.cue_keys = self._cue_keys()
        self.cue = lexica.is_cue.has(self.cue_keys)

    def _cue_keys(self) -> np.ndarray:
        p, t = self.page, self.token
        line = self.page.char(self.start - 1) == ord("\n")  # what stands in the line before is no label
        return mix("cue", p.around(t - 2, self.doc, p.low), p.around(t - 1, self.doc, p.low), line)

    def after_keys(self, token: np.ndarray, end: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """What follows in the same line."""
        return mix("after", self.page.around(token + 1, doc), self.page.char(end) == ord(" "))

    def late_comma(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether a comma stands behind the second or a later word inside a proposal; in one name it can only stand behind the first."""
        return np.any([self.comma[np.minimum(i + k, j)] & (i + k < j) for k in range(1, MOST_WORDS - 1)], axis=0)

    def seen(self) -> np.ndarray:
        """How often each word stands capitalised in its text."""
        if not len(self.token):
            return np.zeros(0)
        _, inverse = np.unique(mix(self.doc, self.low), return_inverse=True)
        return np.bincount(inverse, self.capital)[inverse]


def context_keys(page: Page, model: str, first: np.ndarray, last: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Keys of what stands before token ``first`` and behind token ``last``."""
    b1, b2, b3 = (page.around(first - k, doc) for k in (1, 2, 3))
    a1, a2 = page.around(last + 1, doc), page.around(last + 2, doc)
    base = mix(model)[0]
    near = (mix(base, 1, b1), mix(base, 2, b2, b1), mix(base, 3, b3, b2), mix(base, 4, a1), mix(base, 5, a1, a2), mix(base, 6, b1, a1))
    return np.stack(near, axis=1) if len(first) else np.zeros((0, 6), np.uint64)


_WORD_KEY = mix("word")[0]


def name_proposals(page: Page, words: Words) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """first word, last word and end of every proposal, by model: up to MOST_WORDS words that can stand in one name.

    All of them are capitalised, or they start behind a cue or hold a given name.
    """
    n = len(words.token)
    out: dict[str, list] = {"name": [], LOWER: []}
    fine = words.valid & ~words.title
    run, caps, named = fine.copy(), words.capital.copy(), words.given.copy()
    for size in range(1, MOST_WORDS + 1):
        m = n - size + 1
        if m <= 0:
            break
        if size > 1:
            k = size - 1
            run = run[:m] & words.joined[k - 1 : k - 1 + m] & fine[k:]
            caps, named = caps[:m] & words.capital[k:], named[:m] | words.given[k:]
        i = np.flatnonzero(run & (caps | named | words.cue[:m]))
        j = i + size - 1
        lone = words.size[j] == 1
        end = words.end[j] + lone
        keep = ~lone | ((size > 1) & (page.char(words.end[j]) == ord(".")))
        keep &= ~among(page.char(words.start[i] - 1), "[_*") & ~among(page.char(end), "]_")
        cap = caps[i]
        for model, part in (("name", keep & cap), (LOWER, keep & ~cap)):
            out[model].append((i[part], j[part], end[part]))
    return {k: tuple(np.concatenate(x) for x in zip(*v, strict=True)) if v else (np.zeros(0, np.int64),) * 3 for k, v in out.items()}


def repeats(words: Words, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether a word stands twice in a proposal."""
    out = np.zeros(len(i), bool)
    for a in range(MOST_WORDS - 1):
        for b in range(a + 1, MOST_WORDS):
            out |= (i + b <= j) & (words.low[np.minimum(i + a, j)] == words.low[np.minimum(i + b, j)])
    return out


def name_features(page: Page, words: Words, model: str, i: np.ndarray, j: np.ndarray, end: np.ndarray, seen: np.ndarray) -> Spans:
    doc, s = words.doc[i], words.start[i]
    token = context_keys(page, model, words.token[i], words.token[j], doc)
    n = j - i + 1
    at = [np.minimum(i + k, j) for k in range(MOST_WORDS)]  # the last word again where there are fewer
    spread = lambda x, how: how(np.stack([x[a] for a in at]), axis=0)
    total = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.float64)])[j + 1] - np.concatenate([[0], np.cumsum(x, dtype=np.float64)])[i]
    left_ok = np.concatenate([[False], words.joined[:-1]])[i] if len(words.joined) else np.zeros(0, bool)
    right_ok = words.joined[j]
    li, ri = np.maximum(i - 1, 0), np.minimum(j + 1, max(len(words.token) - 1, 0))
    beside = lambda x, ok, k: np.where(ok, x[k], 0).astype(np.float32)
    prev, nxt = page.char(s - 1), page.char(end)
    begins = s == page.begin[doc]
    inner = [page.char(words.end[np.minimum(i + k, j)]) for k in range(MOST_WORDS - 1)]
    between = lambda chars: np.any([among(c, chars) & (i + k < j) for k, c in enumerate(inner)], axis=0)
    hat = between("^") | np.any([among(page.char(words.end[np.minimum(i + k, j)] + 1), "^") & (i + k < j) for k in range(MOST_WORDS - 1)], axis=0)
    plain = [
        n, left_ok & words.capital[li], right_ok & words.capital[ri], begins | among(prev, "\n"), among(prev, " "), among(prev, "/(\"'"), among(nxt, "'’"), among(nxt, ".,;"), among(nxt, "\r\n"),
        hat, between(","), spread(words.upper, np.all), spread(words.size, np.min) == 1, spread(words.parted, np.any),
        words.given[i], words.given[j], total(words.given), spread(words.counts, np.max), spread(words.counts, np.min), total(words.counts) / n,
        spread(words.size, np.max), spread(words.size, np.min), beside(words.given, left_ok, li), beside(words.counts, left_ok, li), beside(words.title, left_ok, li), beside(words.size, left_ok, li),
        beside(words.given, right_ok, ri), beside(words.counts, right_ok, ri), beside(words.title, right_ok, ri), beside(words.size, right_ok, ri),
        np.minimum(9, spread(seen, np.min)), np.minimum(9, spread(seen, np.max)), total(words.capital) / n, words.cue[i], repeats(words, i, j), words.late_comma(i, j),
    ]
    own = [mix(_WORD_KEY, words.low[a]) for a in at]
    edge = [mix(_WORD_KEY, np.where(ok, words.low[k], np.uint64(0))) for ok, k in ((left_ok, li), (right_ok, ri))]
    keys = np.concatenate([token, np.stack([*own, *edge], axis=1)], axis=1) if len(i) else np.zeros((0, 6 + MOST_WORDS + 2), np.uint64)
    return Spans(s, end, doc, keys, np.stack([np.asarray(x, np.float32) for x in plain], axis=1) if len(i) else np.zeros((0, len(plain)), np.float32), (i, j))


def _bracketed(text: str, s: int, e: int) -> bool:
    return s > 0 and text[s - 1] in "[_*" or e < len(text) and text[e] in "]_"


def _spanned(page: Page, model: str, found: list[tuple[int, int]], plain: list[list[float]], width: int, formats: list[str], extra: object = None) -> Spans:
    """Spans found by patterns, with the keys of their context and format."""
    if not found:
        return Spans(*(np.zeros(0, np.int64) for _ in range(3)), np.zeros((0, 7), np.uint64), np.zeros((0, width), np.float32), extra)
    s, e = np.array(found, np.int64).T
    doc = np.searchsorted(page.begin, s, side="right") - 1
    first = np.searchsorted(page.end, s, side="right")  # the first token that ends behind the start
    last = np.searchsorted(page.start, e, side="left") - 1
    keys = context_keys(page, model, first, last, doc)
    form = np.array([crc32(f.encode("utf-8", "replace")) for f in formats], np.uint64)
    return Spans(s, e, doc, np.concatenate([keys, mix(mix(model)[0], 7, form)[:, None]], axis=1), np.array(plain, np.float32), extra)


def number_places(page: Page) -> list[tuple[int, int]]:
    """Numbers of a telling length, left to right, without stand-ins and placeholders."""
    digit = page.kind == DIGIT
    ahead = np.concatenate([[0], np.cumsum(digit)])
    n, cp = len(page.cp), page.cp
    opens = np.flatnonzero((digit & ~np.concatenate([[False], digit[:-1]])) | (cp == ord("+")) | (cp == ord("(")))
    opens = opens[ahead[np.minimum(opens + 24, n)] - ahead[opens] >= 6]
    out, reach = [], 0
    for at in opens.tolist():
        if at >= reach and (m := _NUMBERS.match(page.text, at)):
            reach = m.end()
            if len(set(digits(m[0]))) > 1 and not _bracketed(page.text, at, reach):
                out.append((at, reach))
    return out


def number_spans(page: Page, places: list[tuple[int, int]], kind: str) -> Spans:
    plain, formats = [], []
    for s, e in places:
        t = page.text[s:e]
        d, prev = digits(t), page.text[s - 1] if s else "\n"
        formats.append(shape(t))
        plain.append([len(d), len(t) - len(d), t[0] == "+", "(" in t, "." in t, "-" in t, "/" in t, " " in t, d[0] == "0", d[:2] in ("00", "01", "02", "03", "07"), d[0] == "9", d[0] == "1", prev == "#", prev == "=", prev == "/", len(d) == 9, len(d) == 10])
    return _spanned(page, kind, places, plain, 17, formats)


def email_spans(page: Page) -> Spans:
    cp, text = page.cp, page.text
    a = np.flatnonzero((cp[:-1] == ord("a")) | (cp[:-1] == ord("A")))
    a = a[among(cp[a + 1], "tT") & among(page.char(a - 1), " ([") & among(page.char(a + 2), " )]")] - 1
    anchors = np.sort(np.concatenate([np.flatnonzero(cp == ord("@")), a]))
    found, plain, formats, reach = [], [], [], 0
    for at in anchors.tolist():
        if at < reach or not _DOMAIN.match(text, at):
            continue
        doc = bisect.bisect_right(page.begin, at) - 1
        floor, hi = max(int(page.begin[doc]), at - EMAIL_WINDOW, reach), min(int(page.begin[doc + 1]) - 1, at + EMAIL_WINDOW)
        for back in (EMAIL_NEAR, EMAIL_WINDOW):
            lo = max(floor, at - back)
            m = next((m for m in _EMAIL.finditer(text, lo, hi) if m.end() > at), None)
            if m and m.start() > at:
                m = None
            if lo == floor or (m and m.start() > lo + 8):
                break  # a wider window finds no longer one
        if m:
            t, reach = m[0], m.end()
            low = t.lower()
            tail = re.split(r"[^a-z0-9\-]+", low)[-1]
            found.append(m.span())
            formats.append(tail)
            plain.append(["@" in t, " at " in low, "(" in t or "[" in t, t.count("."), len(t), len(tail), tail.isalpha(), any(c.isdigit() for c in t), t.count(" ")])
    return _spanned(page, "email", found, plain, 9, formats)


def address_spans(page: Page, lexica: Lexica) -> Spans:
    """Every head of an address with none, some and all of the parts behind it; extra: number of the head and parts that would still follow."""
    text, n = page.text, len(page.cp)
    w = np.flatnonzero(page.type != WORD)
    s, e = page.start[w], page.end[w]
    digit = page.kind[s] == DIGIT
    s, e = s[digit], e[digit]
    letter = (page.kind[np.minimum(e, n - 1)] == SMALL) | (page.kind[np.minimum(e, n - 1)] == CAPITAL)
    e = e + letter
    e = e + (page.char(e) == ord(","))
    house = (e - s <= 7) & (page.char(e) == 32) & (page.kind[np.minimum(e + 1, n - 1)] == CAPITAL)
    box = among(page.char(s - 2), "xX") & among(page.char(s - 4), "bB") & (page.char(s - 1) == 32)
    heads, found, plain, formats, reach = [], [], [], [], 0
    for at, boxed in zip(s[house | box].tolist(), box[house | box].tolist(), strict=True):
        if boxed:
            back = _BOX.search(text, max(0, at - 12), at)
            at = back.start() if back else at
        m = _ADDRESS_HEAD.match(text, at) if at >= reach else None
        if not m:
            continue
        end, parts = m.end(), "h"
        ends = [(end, parts)]
        for rx, sign in ((_APT, "a"), (_CITY, "c"), (_CODE, "z")):
            if x := rx.match(text, end):
                end, parts = x.end(), parts + sign
                ends.append((end, parts))
        reach = m.end()
        bare = m.end() - (text[m.end() - 1] == ".")
        for k, (stop, p) in enumerate(ends):
            stop = bare if k == 0 and len(ends) == 1 else stop
            t, room = text[at:stop], len(ends) - 1 - k
            city = re.split(r",|\n", re.sub(rf"{_CODE.pattern}$", "", t) if p.endswith("z") else t)[-1].strip().lower() if "c" in p else ""
            follows = _CITY.match(text, stop)
            then = re.sub(r"^[,\s]+", "", follows[0]).lower() if follows else ""
            heads.append((at, room))
            found.append((at, stop))
            formats.append(p + re.split(r"\s", m[0].rstrip("."))[-1].lower())
            plain.append([len(p), room, "a" in p, "c" in p, "z" in p, city in lexica.cities, bool(then) and then in lexica.cities, bool(_CODE.match(text, stop)), bool(_APT.match(text, stop)), t[0] in "Pp", "\n" in t, t.isupper(), len(t), "box" in t.lower()])
    return _spanned(page, "address", found, plain, 14, formats, heads)


class Proposals:
    """Everything proposed on the texts of one page."""

    def __init__(self, texts: list[str], lexica: Lexica):
        page = self.page = Page(texts)
        words = self.words = Words(page, lexica)
        seen = words.seen()
        self.spans: dict[str, Spans] = {model: name_features(page, words, model, *found, seen) for model, found in name_proposals(page, words).items()}
        places = number_places(page)
        for kind in ("phone", "id"):
            self.spans[kind] = number_spans(page, places, kind)
        self.spans["email"] = email_spans(page)
        self.spans["address"] = address_spans(page, lexica)


class Context:
    """Facts seen per context key, by fold; rates are smoothed towards a prior."""

    def __init__(self, keys: np.ndarray, y: np.ndarray, fold: np.ndarray):
        self.keys, at = np.unique(keys, return_inverse=True)
        self.n = np.stack([np.bincount(at, fold == f, len(self.keys)) for f in range(FOLDS)], axis=1)
        self.pos = np.stack([np.bincount(at, y * (fold == f), len(self.keys)) for f in range(FOLDS)], axis=1)

    def table(self) -> Hashed:
        """Rates for the executors; keys seen once or twice tell nothing and go."""
        n = self.n.sum(1)
        keep = n >= 3
        return Hashed(self.keys[keep], rate(self.pos.sum(1), n)[keep])

    def without(self, keys: np.ndarray, fold: np.ndarray) -> np.ndarray:
        """Rates for fitted notes: less what their own fold says."""
        if not len(self.keys):
            return np.full(keys.shape, rate(0, 0), np.float32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        own = np.broadcast_to(fold[:, None], keys.shape)
        n, pos = self.n.sum(1)[at] - self.n[at, own], self.pos.sum(1)[at] - self.pos[at, own]
        return np.where(self.keys[at] == keys, rate(pos, n), rate(0, 0)).astype(np.float32)


def rate(pos, n, prior: float = 0.3, weight: float = 3.0):
    return (pos + prior * weight) / (n + weight)


def features(model: str, spans: Spans, rates: np.ndarray) -> np.ndarray:
    if model in ("name", LOWER):
        own = rates[:, 6 : 6 + MOST_WORDS]
        rates = np.concatenate([rates[:, :6], own.max(1, keepdims=True), own.min(1, keepdims=True), own.mean(1, keepdims=True), rates[:, 6 + MOST_WORDS :]], axis=1) if len(rates) else np.zeros((0, 11), np.float32)
    return np.concatenate([rates, spans.plain], axis=1).astype(np.float32)


def choose(found: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int]]:
    """The accepted proposals that do not overlap: most certain first, the longer one among the about equally certain."""
    starts: list[int] = []
    taken: list[tuple[str, int, int]] = []
    for kind, s, e, _ in sorted(found, key=lambda f: (-round(f[3], 1), -(f[2] - f[1]), f[1], f[0])):
        k = bisect.bisect_right(starts, s)
        if (k and taken[k - 1][2] > s) or (k < len(starts) and starts[k] < e):
            continue
        starts.insert(k, s)
        taken.insert(k, (kind, s, e))
    return taken


def join_names(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Neighbouring names with a blank or hyphen between them become one where it has more words than any proposal."""
    out: list[tuple[str, int, int]] = []
    for kind, s, e in taken:
        if out and kind == out[-1][0] == "name" and text[out[-1][2] : s] in (" ", "-") and len(_NAME_WORD.findall(text, out[-1][1], e)) > MOST_WORDS:
            out[-1] = (kind, out[-1][1], e)
        else:
            out.append((kind, s, e))
    return out


def paged(texts: list[str | None]) -> Iterator[list[int]]:
    """Indexes of the texts that have characters, in groups of about PAGE_CHARS."""
    group, size = [], 0
    for i, t in enumerate(texts):
        if t:
            if group and size + len(t) > PAGE_CHARS:
                yield group
                group, size = [], 0
            group.append(i)
            size += len(t)
    if group:
        yield group


class Detector:
    """What the executors need: lexica, context rates, one set of trees and one threshold per kind (two for names)."""

    def __init__(self, lexica: Lexica, table: Hashed, trees: dict[str, boosting.Trees], thresholds: dict[str, float]):
        self.lexica, self.table, self.trees, self.thresholds = lexica, table, trees, thresholds

    def spans(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        for group in paged(texts):
            made = Proposals([texts[i] for i in group], self.lexica)
            found: dict[int, list] = defaultdict(list)
            for model, spans in made.spans.items():
                shown = "name" if model == LOWER else model
                if len(spans.start):
                    rows, p = self.trees[model].reaching(features(model, spans, self.table.get(spans.keys.ravel(), rate(0, 0)).reshape(spans.keys.shape)), self.thresholds[model])
                    for d, s, e, v in zip(spans.doc[rows].tolist(), spans.start[rows].tolist(), spans.end[rows].tolist(), p.tolist(), strict=True):
                        found[d].append((shown, s, e, v))
            for d, f in found.items():
                at = int(made.page.begin[d])
                taken = join_names(made.page.text, choose(f))
                out[group[d]] = [(k, s - at, e - at) for k, s, e in taken]
        return out


# ---- fitting


@dataclass
class Facts:
    """What the personas say of the sampled notes."""

    words: list[set[str]]
    phone: list[set[str]]
    ids: list[set[str]]
    email: list[set[str]]
    address: list[set[str]]

    @classmethod
    def of(cls, rows: list[dict]) -> Facts:
        text = lambda r, c: str(r.get(c) or "")
        number = lambda r, *cs: {digits(text(r, c))[-10:] for c in cs} - {""}
        names = lambda r: {w.lower() for w in _NAME_WORD.findall(text(r, "name"))}
        return cls([names(r) for r in rows], [number(r, "phone") for r in rows], [number(r, "unit_no", "ssn") for r in rows], [{tidy(text(r, "email"))} - {""} for r in rows], [{tidy(text(r, "address"))} - {""} for r in rows])


def lexica_of_rows(rows: list[dict]) -> Lexica:
    """The lexica of sampled rows alone, where no corpus is at hand."""
    given, cities = set(), set()
    for r in rows:
        for c in ("name", "physician_name"):
            w = str(r.get(c) or "").split()
            if len(w) > 1:
                given.add(w[0].lower())
        a = re.split(r",\s*|\n", str(r.get("address") or ""))
        if len(a) > 1:
            cities.add(a[1].strip().lower())
    given = word_hashes(given)
    count: Counter = Counter()
    for group in paged([r["note"] for r in rows]):
        count.update(small_words(Page([rows[i]["note"] for i in group], raw=False), given)[1].tolist())
    hashes = sorted(h for h, n in count.items() if n >= max(2, SMALL_SHARE * len(rows)))
    return Lexica(given, frozenset(cities), np.array(hashes, np.uint64), np.array([count[h] / max(1, len(rows)) for h in hashes]))


def _pairs(docs, hashes) -> np.ndarray:
    return mix(np.asarray(docs, np.int64), np.asarray(hashes, np.uint64))


class NameLabels:
    """Labels of name proposals from facts: the personas of the sampled notes, learnt cues and words that are written with a capital only."""

    def __init__(self, rows: list[dict], facts: Facts, pages: list[tuple[int, Words]], lexica: Lexica):
        present = [bool(ws) and any(w in r["note"].lower() for w in ws) for r, ws in zip(rows, facts.words, strict=True)]
        self.known_note = np.array(present, bool)
        own_d, own_w, family, places = [], [], set(), set(lexica.cities)
        for i, (r, ws) in enumerate(zip(rows, facts.words, strict=True)):
            doctor = {w.lower() for w in _NAME_WORD.findall(str(r.get("physician_name") or ""))}
            for side in (_NAME_WORD.findall(str(r.get("name") or "")), _NAME_WORD.findall(str(r.get("physician_name") or ""))):
                family.update(w.lower() for w in side[1:] if len(w) > 1)
            places.update(w.lower() for w in _NAME_WORD.findall(str(r.get("address") or "")))
            if present[i]:
                for w in ws | doctor:
                    own_d.append(i)
                    own_w.append(w)
        hashed = {w: h for w in set(own_w) for h in word_hashes([w])[:1]}
        at = [k for k, w in enumerate(own_w) if w in hashed]
        self.own = np.unique(_pairs([own_d[k] for k in at], [hashed[own_w[k]] for k in at])) if at else np.zeros(0, np.uint64)
        self.surname = np.setdiff1d(word_hashes(family), lexica.given)
        # strange words: never in small letters, in few notes
        pairs = [w.low[w.capital][np.unique(_pairs(w.doc[w.capital], w.low[w.capital]), return_index=True)[1]] for _, w in pages if w.capital.any()]
        words, n = np.unique(np.concatenate(pairs), return_counts=True) if pairs else (np.zeros(0, np.uint64), np.zeros(0))
        self.capital_words = np.setdiff1d(words, word_hashes(w for p in places for w in p.split()))
        self.strange_words = np.intersect1d(self.capital_words, words[n <= max(2, 0.012 * len(rows))])
        self._contexts(pages)

    def strange(self, w: Words, often: bool = False) -> np.ndarray:
        """Words never in small letters; of those in few notes nothing else is known, those ``often`` seen are as good behind a cue."""
        return (w.size > 4) & (w.counts == 0) & member(self.capital_words if often else self.strange_words, w.low)

    def _contexts(self, pages: list[tuple[int, Words]]) -> None:
        """Cues that names stand behind, and what never follows a name of the facts."""
        before, behind, fact, likely = [], [], [], []
        for first, w in pages:
            known = member(self.own, _pairs(w.doc + first, w.low))
            left = np.concatenate([[False], w.joined[:-1] & w.capital[:-1] & ~w.title[:-1]]) if len(w.token) else np.zeros(0, bool)
            right = w.joined & np.concatenate([w.capital[1:], [False]]) if len(w.token) else np.zeros(0, bool)
            here = w.capital & w.valid & ~w.title & self.known_note[w.doc + first]
            begun = known | np.concatenate([(w.joined[:-1] & known[1:]), [False]]) if len(w.token) else known
            likely = known | w.given | member(self.surname, w.low) | self.strange(w, often=True)
            likely |= (w.size == 1) & np.concatenate([w.joined[:-1] & likely[1:], [False]]) if len(w.token) else likely
            before.append((w.cue_keys[here & ~left], begun[here & ~left], likely[here & ~left]))
            behind.append((w.after_keys(w.token, w.end, w.doc)[here & ~right], known[here & ~right]))
        fold = lambda parts: [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)]
        keys, fact, likely = fold(before)
        keys, at = np.unique(keys, return_inverse=True)
        n, k, m = np.bincount(at, minlength=len(keys)), np.bincount(at, fact, len(keys)), np.bincount(at, likely, len(keys))
        self.cues = keys[(n >= SEEN) & (k >= CUE_FACTS * n) & (m >= CUE * n)]
        keys, fact = fold(behind)[:2]
        keys, at = np.unique(keys, return_inverse=True)
        n, k = np.bincount(at, minlength=len(keys)), np.bincount(at, fact, len(keys))
        self.not_person = keys[(n >= SEEN) & (k <= NEVER * n)]

    def __call__(self, first: int, w: Words, i: np.ndarray, j: np.ndarray, end: np.ndarray) -> np.ndarray:
        """1, 0 or -1 (unknown) for the proposals of a page whose first note is number ``first``."""
        doc = w.doc + first
        strange, pair = self.strange(w), _pairs(doc, w.low)
        own, surname = member(self.own, pair), member(self.surname, w.low)
        # persons named in full beside a given name belong to the note
        a, b = (w.given[:-1] & strange[1:] & ~w.given[1:], w.given[1:] & strange[:-1] & ~w.given[:-1]) if len(w.token) else (np.zeros(0, bool),) * 2
        pairs = w.joined[:-1] & w.capital[:-1] & w.capital[1:] if len(w.token) else np.zeros(0, bool)
        here = self.known_note[doc] if len(doc) else np.zeros(0, bool)
        named = np.unique(np.concatenate([pair[1:][pairs & a], pair[:-1][pairs & b]])) if len(w.token) else np.zeros(0, np.uint64)
        own = (own | member(named, pair)) & here
        full = np.unique(np.concatenate([pair[:-1][pairs & w.given[:-1] & (w.size[1:] >= 5)], pair[1:][pairs & w.given[1:] & (w.size[:-1] >= 5)]])) if len(w.token) else np.zeros(0, np.uint64)
        in_full = member(full, pair)
        known = own | w.given | surname | (w.size == 1) | strange
        behind = member(self.cues, w.cue_keys)
        after = np.concatenate([[False], (w.joined & (w.given | (w.size == 1)) & behind)[:-1]]) if len(w.token) else behind
        vouched = (behind | after) & self.strange(w, often=True)
        known |= vouched
        running = lambda x: np.concatenate([[0], np.cumsum(x)])
        count = lambda x: running(x)[j + 1] - running(x)[i]
        n = j - i + 1
        cue, lowered = behind[i], count(w.capital) < n
        one, note = n == 1, self.known_note[doc[i]]
        li, ri = np.maximum(i - 1, 0), np.minimum(j + 1, len(w.token) - 1)
        left = (i > 0) & w.joined[li] & (lowered | w.capital[li]) & ~w.title[li] & known[li] & ((w.size[li] > 1) | (w.page.char(w.end[li]) == ord("."))) & (n < 3)
        right = w.joined[j] & (lowered | w.capital[ri]) & ~w.title[ri] & known[ri] & (w.size[ri] > 1) & (n < 3) & (w.page.char(end) != ord("."))
        again = lambda k: (w.low[k] != w.low[i]) & (w.low[k] != w.low[j])
        # a list of names: behind two words a comma ends the name, and before a name it belongs to one word only
        second = np.concatenate([[False], (w.joined & w.capital & ~w.comma)[:-1]])[li] if len(w.token) else left
        left, right = left & again(li) & ~(w.comma[li] & second), right & again(ri) & ~(w.comma[j] & (n > 1))
        rules = [
            ((n > 1) & repeats(w, i, j), 0),
            (member(self.not_person, w.after_keys(w.token[j], end, w.doc[i])) & ~cue & ~own[j], 0),
            (w.late_comma(i, j), 0),
            (lowered & cue & ~note, -1),
            (lowered & one & ~cue & own[i], -1),
            (lowered & one & ~cue, 0),
            (count(known) < n, 0),
            # a given name alone is somebody else's word unless the patient bears it; of a strange word nothing is known
            (one & ~cue & ~own[i] & w.given[i] & in_full[i], -1),
            (one & ~cue & ~own[i] & ~w.given[i] & ~surname[i], -1),
            (one & ~cue & ~own[i], 0),
            ((n > 1) & (count(w.given | surname | own | vouched) == 0), -1),
            (count(w.size == 1) == n, 0),
            (left | right, 0),  # longer spans of known words are the whole name
        ]
        y = np.ones(len(i), np.int64)
        open_ = np.ones(len(i), bool)
        for condition, value in rules:
            y[open_ & condition] = value
            open_ &= ~condition
        y[(y == 1) & ~note] = -1
        return y




def never(keys: np.ndarray, matched: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Proposals with a context that has hardly ever gone with a fact."""
    out = np.zeros(len(matched), bool)
    for c in range(3):
        distinct, at = np.unique(keys[:, c], return_inverse=True)
        n, k = np.bincount(at, among, len(distinct)), np.bincount(at, matched & among, len(distinct))
        out |= ((n >= SEEN) & (k <= NEVER * n))[at]
    return out


def fact_labels(kind: str, rows: list[dict], facts: Facts, doc: np.ndarray, spans: list[tuple[str, object]], keys: np.ndarray) -> np.ndarray:
    """1, 0 or -1 for proposals of numbers, mail and addresses (text and, for addresses, head and room)."""
    y = np.full(len(doc), -1)
    if kind == "address":
        heads: dict[tuple, list[int]] = defaultdict(list)
        for k, (_, head) in enumerate(spans):
            heads[head].append(k)
        for ks in heads.values():
            full = max(ks, key=lambda k: len(spans[k][0]))
            for a in facts.address[doc[full]]:
                fits = [k for k in ks if a.startswith(tidy(spans[k][0]))]
                best = max(fits, key=lambda k: len(spans[k][0]), default=None)
                if best is not None and (best == full or tidy(spans[best][0]) == a):
                    for k in ks:
                        y[k] = int(k == best)
    else:
        mine = {"phone": facts.phone, "id": facts.ids, "email": facts.email}[kind]
        other = {"phone": facts.ids, "id": facts.phone, "email": None}[kind]
        for k, (d, (t, _)) in enumerate(zip(doc.tolist(), spans, strict=True)):
            own = tidy(re.sub(rf"(?i){_DOT}", ".", re.sub(rf"(?i){_AT}", "@", t))) if kind == "email" else digits(t)[-10:]
            if own in mine[d]:
                y[k] = 1
            elif other is not None and own in other[d]:
                y[k] = 0
    known = np.array([bool(r.get("name")) for r in rows], bool)
    among = known[doc] if len(doc) else np.zeros(0, bool)
    y[(y < 0) & never(keys, y == 1, among)] = 0
    return y


def fit_rows(rows: list[dict], lexica: Lexica | None = None) -> Detector:
    """Fits on sampled notes: dicts with note and, where known, name, physician_name, phone, unit_no, ssn, email, address."""
    rows = sorted(rows, key=lambda r: (r["note"], str(r.get("name"))))
    lexica = lexica or lexica_of_rows(rows)
    facts = Facts.of(rows)
    groups = list(paged([r["note"] for r in rows]))
    texts = [[rows[i]["note"] for i in g] for g in groups]
    label = NameLabels(rows, facts, [(g[0], Words(Page(t), lexica)) for g, t in zip(groups, texts, strict=True)], lexica)
    lexica = Lexica(lexica.given, lexica.cities, lexica.small, lexica.share, label.cues)
    parts: dict[str, list[tuple]] = {m: [] for m in MODELS}
    for g, t in zip(groups, texts, strict=True):
        made = Proposals(t, lexica)
        for model, spans in made.spans.items():
            if not len(spans.start):
                continue
            if model in ("name", LOWER):
                y = label(g[0], made.words, *spans.extra, spans.end)
                keep = y >= 0
                parts[model].append((spans.doc[keep] + g[0], Spans(spans.start[keep], spans.end[keep], spans.doc[keep], spans.keys[keep], spans.plain[keep], spans.extra[1][keep] - spans.extra[0][keep] + 1), y[keep]))
            else:
                shown = [(made.page.text[s:e], spans.extra and (g[0], spans.extra[k][0])) for k, (s, e) in enumerate(zip(spans.start.tolist(), spans.end.tolist(), strict=True))]
                parts[model].append((spans.doc + g[0], spans, shown))
    contexts, labelled = [], {}
    for model, found in parts.items():
        if not found:
            continue
        doc = np.concatenate([f[0] for f in found])
        keys, plain = np.concatenate([f[1].keys for f in found]), np.concatenate([f[1].plain for f in found])
        if model in ("name", LOWER):
            y, size = np.concatenate([f[2] for f in found]), np.concatenate([f[1].extra for f in found])
        else:
            y, size = fact_labels(model, rows, facts, doc, [x for f in found for x in f[2]], keys), None
        keep = y >= 0
        doc, keys, plain, y = doc[keep], keys[keep], plain[keep], y[keep]
        labelled[model] = (doc, keys, plain, y)
        fold = doc % FOLDS
        for c in range(keys.shape[1]):
            if size is None or c < 6:
                contexts.append((keys[:, c], y, fold))
            elif model == "name" and c < 6 + MOST_WORDS:
                own = c - 6 < size[keep]
                contexts.append((keys[own, c], y[own], fold[own]))
    context = Context(*(np.concatenate(x) for x in zip(*contexts, strict=True))) if contexts else Context(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    trees, thresholds = {}, {}
    for model in MODELS:
        doc, keys, plain, y = labelled.get(model, (np.zeros(0, np.int64),) * 4)
        if not len(y):
            thresholds[model], trees[model] = 0.5, boosting.nothing()
            continue
        if len(y) > MOST_ROWS:
            # whole notes by a hash that knows nothing of the fold, so that every fold keeps its share
            drawn = {d for d in set(doc.tolist()) if crc32(rows[d]["note"].encode("utf-8", "replace")) * len(y) < MOST_ROWS * 2**32}
            own = np.isin(doc, list(drawn))
            doc, keys, plain, y = doc[own], keys[own], plain[own], y[own]
        x = features(model, Spans(doc, doc, doc, keys, plain), context.without(keys, doc % FOLDS))
        held = doc % FOLDS == 0
        if held.any() and not held.all():
            # some rows again as if nothing around them had been seen before, for notes with other labels
            blind = ~held & (doc % MASKED == 1)
            unseen = x[blind].copy()
            unseen[:, :6] = rate(0, 0)
            trees[model] = boosting.fit(np.concatenate([x[~held], unseen]), np.concatenate([y[~held], y[blind]]))
            thresholds[model] = boosting.calibrated_threshold(trees[model].probability(x[held]), y[held], slack=0.0, beta=BETA)
        else:
            warnings.warn(f"too few notes with a labelled {model} to hold any out: threshold 0.5", stacklevel=2)
            trees[model], thresholds[model] = boosting.fit(x, y), 0.5
    return Detector(lexica, context.table(), trees, thresholds)


# ---- Spark


def corpus_lexica(notes: DataFrame, personas: DataFrame | None, note: str = "note") -> Lexica:
    """Given names and cities of all personas, and the share of all notes in which a word stands in small letters."""
    given, cities = np.zeros(0, np.uint64), frozenset()
    if personas is not None:
        people = personas.filter(~F.coalesce(F.col("random_name"), F.lit(False)))
        names = F.array(*(F.when(F.size(F.split(F.trim(c), r"\s+")) > 1, F.lower(F.split(F.trim(c), r"\s+")[0])) for c in ("name", "physician_name")))
        place = F.lower(F.trim(F.get(F.split("address", r",\s*|\n"), F.lit(1))))
        tagged = people.select(F.explode(F.concat(F.transform(names, lambda w: F.struct(F.lit("n").alias("kind"), w.alias("word"))), F.array(F.struct(F.lit("c").alias("kind"), place.alias("word"))))).alias("x"))
        counted = tagged.select("x.*").filter("word IS NOT NULL AND word <> ''").groupBy("kind", "word").agg(F.count(F.lit(1)).alias("n"))
        least = people.count() * LEXICON_SHARE
        found = counted.filter(F.col("n") >= least).collect()  # a share of the rows each: at most 3 / LEXICON_SHARE
        given, cities = word_hashes(r.word for r in found if r.kind == "n"), frozenset(r.word for r in found if r.kind == "c")
    spark = ship(notes.sparkSession)
    known = spark.sparkContext.broadcast(given)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for group in paged(texts):
                hashes, n = np.unique(small_words(Page([texts[i] for i in group], raw=False), known.value)[1], return_counts=True)
                for h, k in zip(hashes.astype(np.int64).tolist(), n.tolist(), strict=True):
                    total[h] = total.get(h, 0) + k
            if len(total) > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], names=["word", "n"])
                total = {}
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    texts = notes.filter(F.length(note) > 0).select(note)
    rows = texts.count()
    words = texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= rows * SMALL_SHARE)
    found = sorted((int(np.int64(r.word).astype(np.uint64)), r.n) for r in words.collect())  # a share of the notes each: at most words a note / SMALL_SHARE
    return Lexica(given, cities, np.array([h for h, _ in found], np.uint64), np.array([n / max(1, rows) for _, n in found]))


def sample_rows(notes: DataFrame, personas: DataFrame | None, note: str = "note", subject: str = "subject_id", most: int = SAMPLE_NOTES) -> list[dict]:
    """At most ``most`` identified notes of moderate length with what the personas say of their subjects."""
    tidied = lambda c: F.regexp_replace(F.lower(F.col(c)), r"[^\p{L}\p{Nd}]", "")
    base = notes.filter(F.col(note).isNotNull() & (F.length(note) > 20) & (F.length(note) <= SAMPLE_CHARS) & ~F.contains(F.col(note), F.lit("___"))).select(F.col(note).alias("note"), tidied(subject).alias("who"), F.xxhash64(note).alias("h"))
    # one hash per text: the same notes on every run; those under a cut that leaves about twice as many as are asked for
    texts = base.agg(F.approx_count_distinct("h", 0.02).alias("n")).first().n or 0
    cut = min(2**63 - 1, int(2.2 * most / max(1, texts) * 2**64) - 2**63)
    picked = stable(base.filter(F.col("h") <= F.lit(cut).cast("long")).groupBy("h", "note").agg(F.min("who").alias("who")))
    fields = ("name", "physician_name", "phone", "unit_no", "ssn", "email", "address")
    if personas is None:
        return [{"note": r.note} for r in picked.orderBy("h", "note").limit(most).collect()]
    known = personas.filter(F.col("name").isNotNull() & ~F.coalesce(F.col("random_name"), F.lit(False))).select(tidied(subject).alias("who"), F.struct(*fields).alias("p"))
    asked = picked.select("who").distinct()
    # at most one subject per picked note is asked for, so this side is bounded
    known = known.join(F.broadcast(asked), "who", "left_semi").groupBy("who").agg(F.min("p").alias("p"))
    rows = picked.join(F.broadcast(known), "who", "left").orderBy(F.col("p").isNull(), "h", "note").limit(most).collect()
    return [{"note": r.note} | (r.p.asDict() if r.p is not None else {}) for r in rows]


def fit_detector(notes: DataFrame, personas: DataFrame | None, note: str = "note", subject: str = "subject_id", most: int = SAMPLE_NOTES) -> Detector:
    return fit_rows(sample_rows(notes, personas, note, subject, most), corpus_lexica(notes, personas, note))


def _mapped(df: DataFrame, note: str, keep: list[str], detector: Detector, schema: str, make) -> DataFrame:
    spark = ship(df.sparkSession)
    shared = spark.sparkContext.broadcast(detector)  # bounded by the sample it was fitted on and the lexica's shares
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = batch.column(n).to_pylist()
                yield make(batch, texts, d.spans(texts))

    return df.select(*keep, note).mapInArrow(run, schema)


def find_spans(df: DataFrame, note: str, keep: list[str], detector: Detector) -> DataFrame:
    """``keep``, kind, start_at, end_at, surface of every span; one narrow pass, no shuffle."""
    kinds = dict(df.dtypes)
    n = len(keep)

    def make(batch: pa.RecordBatch, texts: list, spans: list) -> pa.RecordBatch:
        rows = [(i, k, s, e, texts[i][s:e]) for i, found in enumerate(spans) for k, s, e in found]
        kept = [batch.column(j).take(pa.array([r[0] for r in rows], pa.int64())) for j in range(n)]
        return pa.RecordBatch.from_arrays([*kept, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int32()), pa.array([r[4] for r in rows], pa.string())], names=[*keep, "kind", "start_at", "end_at", "surface"])

    return _mapped(df.filter(F.col(note).isNotNull()), note, keep, detector, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", kind string, start_at int, end_at int, surface string", make)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, s, e in spans:
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def redacted(df: DataFrame, note: str, keep: list[str], detector: Detector) -> DataFrame:
    """``keep``, the redacted text and the number of spans replaced, one row per input row."""
    kinds = dict(df.dtypes)
    n = len(keep)

    def make(batch: pa.RecordBatch, texts: list, spans: list) -> pa.RecordBatch:
        out = [None if t is None else redact(t, f) for t, f in zip(texts, spans, strict=True)]
        return pa.RecordBatch.from_arrays([*(batch.column(j) for j in range(n)), pa.array(out, pa.string()), pa.array([len(f) for f in spans], pa.int32())], names=[*keep, "redacted", "n_spans"])

    return _mapped(df, note, keep, detector, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", redacted string, n_spans int", make)
