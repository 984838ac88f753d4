"""One consistent form for text that looks alike in print (problem 9).

Steps per text: compatibility normalization of width, blanks and ligatures,
deletion of ignorable characters, then for every word a Viterbi search through
the lattice of its look-alike letters under character bigram scores of each
script, with a price on changing script inside a word. The lattice of a word
depends only on the visual classes of its letters, so words that look alike
always get the same form, and words that differ in a class never do.

Defined results: NULL stays NULL, an empty text stays empty, a text of only
invisible characters becomes empty. Case, accents and digits are kept.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakgauge.session import ship, stable

# Letters of the three scripts that print alike, Latin first.
LOOKALIKE_CLASSES = (
    "aа", "cс", "dԁ", "eе", "hһ", "iі", "jј", "lӏ", "oоο", "pр", "qԛ", "sѕ", "vν", "wԝ", "xх", "yу",
    "AАΑ", "BВΒ", "CС", "EЕΕ", "HНΗ", "IІΙӀ", "JЈ", "KКΚ", "MМΜ", "NΝ", "OОΟ", "PРΡ", "SЅ", "TТΤ", "XХΧ", "YУΥҮ", "ZΖ",
)
# Visible format characters, which stay; ignorable characters outside category Cf, which go.
VISIBLE_FORMAT = set(range(0x600, 0x606)) | {0x6DD, 0x70F, 0x8E2}
IGNORABLE_OTHER = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0} | set(range(0xFE00, 0xFE10)) | set(range(0x180B, 0x180E)) | set(range(0xE0100, 0xE01F0))
# Compatibility decompositions that leave the look of a character as it is.
SAME_LOOK_TAGS = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")

SWITCH_PRICE = 14.0
MEMO_LIMIT = 400_000


def _letters() -> str:
    """Letters of the basic plane as ranges of a character class, which is searched faster than a category."""
    ranges, start = [], None
    for o in range(0x10001):
        inside = o < 0x10000 and chr(o).isalnum() and not chr(o).isdecimal()
        if inside and start is None:
            start = o
        elif not inside and start is not None:
            ranges.append(f"\\u{start:04x}-\\u{o - 1:04x}")
            start = None
    return "".join(ranges)


# a word is letters and marks on them; characters beyond the basic plane have no look-alikes here and part words
_CLASS = _letters()
WORD = re.compile(f"[{_CLASS}]+(?:[̀-ͯ]+[{_CLASS}]*)*")
_WORDS, _ASCII_WORDS = re.compile(f"({WORD.pattern})"), re.compile("([A-Za-z]+)")


def script_of(ch: str) -> str:
    """``L``, ``C`` or ``G`` for Latin, Cyrillic and Greek letters, ``?`` for the rest."""
    o = ord(ch)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "L"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "G"
    if 0x400 <= o < 0x530:
        return "C"
    return "?"


CLASS_OF = {ch: cls for cls in LOOKALIKE_CLASSES for ch in cls}
_SHARED = re.compile("[" + "".join(CLASS_OF) + "]")


class _Plain(dict):
    """Translation of single code points: width, blanks, ligatures, ignorable characters."""

    def __missing__(self, o: int) -> str:
        ch = chr(o)
        cat = unicodedata.category(ch)
        tag = unicodedata.decomposition(ch).split(" ")[0]
        if o in IGNORABLE_OTHER or (cat == "Cf" and o not in VISIBLE_FORMAT):
            out = ""
        elif cat == "Zs" or ch == "\t":
            out = " "
        elif ch in "  \x85":
            out = "\n"
        elif ch in "‐‑":
            out = "-"
        elif tag in SAME_LOOK_TAGS:
            out = unicodedata.normalize("NFKD", ch)
            if any(unicodedata.category(c) == "Zs" for c in out):
                out = ch  # spacing accents stay what they are
        else:
            out = unicodedata.normalize("NFD", ch)
        self[o] = out
        return out


_PLAIN = _Plain()


@functools.cache
def _special() -> re.Pattern:
    """Characters that change otherwise than by canonical decomposition; whole planes without letters of the given texts are looked up one by one."""
    odd = [o for o in (*range(0x80, 0xD800), *range(0xE000, 0x20000)) if _PLAIN[o] != unicodedata.normalize("NFD", chr(o))]
    ranges, start = [], None
    for k, o in enumerate(odd):
        start = o if start is None else start
        if k + 1 == len(odd) or odd[k + 1] != o + 1:
            ranges.append(f"{re.escape(chr(start))}-{re.escape(chr(o))}")
            start = None
    return re.compile("[" + "".join(ranges) + "\t\U00020000-\U0010ffff]")


def plain_text(text: str) -> str:
    """Width, blanks, ligatures and ignorable characters made plain, marks apart from their letters."""
    if text.isascii():
        return text.replace("\t", " ") if "\t" in text else text
    return unicodedata.normalize("NFD", _special().sub(lambda m: _PLAIN[ord(m[0])], text))


class Model:
    """Bigram log probabilities by script; ``counts`` maps (script, left, right) to a number."""

    def __init__(self, counts: dict[tuple[str, str, str], int]):
        left: Counter = Counter()
        for (s, a, _), n in counts.items():
            left[s, a] += n
        self.counts, self.left = counts, left
        self.total = Counter()
        for (s, a, _), n in counts.items():
            self.total[s] += n

    def score(self, script: str, a: str, b: str) -> float:
        n = self.counts.get((script, a, b), 0)
        return math.log((n + 0.02) / (self.left.get((script, a), 0) + 2.0))

    def prior(self, script: str) -> float:
        return math.log((self.total.get(script, 0) + 1) / (sum(self.total.values()) + 3))


def search(letters: str, model: Model) -> str:
    """Best letter sequence of the lattice of ``letters`` (no combining marks)."""
    states: list[tuple[float, str, str]] = []  # score, script, letters so far
    for k, ch in enumerate(letters):
        options = [(c, script_of(c)) for c in CLASS_OF.get(ch, ch)]
        new = []
        for c, s in options:
            if not k:
                new.append((model.prior(s) + model.score(s, "^", c), s, c))
                continue
            best = None
            for score, s0, path in states:
                x = score + (model.score(s, path[-1], c) if s == s0 or "?" in (s, s0) else model.score(s, "^", c) - SWITCH_PRICE)
                if best is None or x > best[0]:
                    best = (x, s, path + c)
            new.append(best)
        states = new
    return max(((score + model.score(s, path[-1], "$"), path) for score, s, path in states), key=lambda x: x[0])[1]


class _Resolved(dict):
    """Words and their consistent form, each resolved when it is first asked for; up to a fixed number is kept."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, w: str) -> str:
        if not _SHARED.search(w):
            out = w
        else:
            base = [c for c in w if not unicodedata.combining(c)]
            found = iter(search("".join(base), self.model))
            out = "".join(c if unicodedata.combining(c) else next(found) for c in w)
        if len(self) >= MEMO_LIMIT:
            self.clear()
        self[w] = out
        return out


class Normalizer:
    """Applies one model."""

    def __init__(self, model: Model):
        self.words = _Resolved(model)

    def __call__(self, text: str | None) -> str | None:
        if text is None:
            return None
        text = plain_text(text)
        if "\r" in text:
            text = text.replace("\r\n", "\n")
        parts = (_ASCII_WORDS if text.isascii() else _WORDS).split(text)  # every second part is a word
        parts[1::2] = map(self.words.__getitem__, parts[1::2])
        text = "".join(parts)
        return text if text.isascii() else unicodedata.normalize("NFC", text)


def word_bigrams(word: str) -> tuple[str, list[tuple[str, str]]] | None:
    """Script and bigrams of a word written in one script, else None."""
    base = [c for c in word if not unicodedata.combining(c)]
    scripts = {script_of(c) for c in base}
    if len(scripts) != 1 or "?" in scripts:
        return None
    return scripts.pop(), list(zip(["^", *base], [*base, "$"], strict=True))


def fit(df: DataFrame, text: str) -> Model:
    """Bigram model over every text; the driver gets one count per bigram of letters, a number bounded by the alphabets."""
    ship(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words = Counter(), Counter()

        def flush() -> None:
            for w, n in words.items():
                if got := word_bigrams(w):
                    for a, b in got[1]:
                        total[got[0], a, b] += n
            words.clear()

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    words.update((_ASCII_WORDS if t.isascii() else WORD).findall(plain_text(t)))
            if len(words) > MEMO_LIMIT:
                flush()
        flush()
        keys = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[j] for k in keys], pa.string()) for j in range(3)] + [pa.array([total[k] for k in keys], pa.int64())], names=["script", "a", "b", "n"]
        )

    rows = df.select(F.col(text)).mapInArrow(count, "script string, a string, b string, n long").groupBy("script", "a", "b").agg(F.sum("n").alias("n")).collect()
    return Model({(r.script, r.a, r.b): r.n for r in rows})


def consistent_text(df: DataFrame, id_col: str, text: str, model: Model | None = None, keys_only: bool = False) -> DataFrame:
    """``id_col`` with the consistent form of ``text``; with ``keys_only`` two digests (form, stored text) instead of texts."""
    model = model or fit(df, text)
    ship(df.sparkSession)
    counts = model.counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = Normalizer(Model(counts))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            forms = [apply(t) for t in texts]
            if keys_only:
                digest = lambda ts: pa.array([None if t is None else hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() for t in ts], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), digest(forms), digest(texts)], names=[id_col, "form_key", "raw_key"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms, pa.string())], names=[id_col, "form"])

    kind = dict(df.dtypes)[id_col]
    out = f"`{id_col}` {kind}, " + ("form_key binary, raw_key binary" if keys_only else "form string")
    return df.select(id_col, text).mapInArrow(run, out)


def lookalike_pairs(df: DataFrame, id_col: str, text: str, model: Model | None = None) -> DataFrame:
    """Pairs (a_id < b_id) of rows with one consistent form and different stored texts.

    Only classes holding two different stored texts reach the join, so plain
    copies alone never meet each other.
    """
    # two digests a row are kept, so each text is normalized once
    keys = stable(consistent_text(df.filter(F.col(text).isNotNull() & F.col(id_col).isNotNull()), id_col, text, model, keys_only=True))
    mixed = keys.groupBy("form_key").agg(F.min("raw_key").alias("lo"), F.max("raw_key").alias("hi")).filter("lo <> hi").select("form_key")
    rows = stable(keys.join(mixed, "form_key", "left_semi").select(F.col(id_col).alias("id"), "form_key", "raw_key").distinct())
    # different writings meet first, then each writing's rows the rows of the other: copies of one writing never meet
    written = stable(rows.select("form_key", "raw_key").distinct())
    x, y = written.alias("x"), written.alias("y")
    facing = x.join(y, (F.col("x.form_key") == F.col("y.form_key")) & (F.col("x.raw_key") < F.col("y.raw_key"))).select(F.col("x.form_key").alias("form_key"), F.col("x.raw_key").alias("raw_key"), F.col("y.raw_key").alias("other"))
    a = rows.join(facing, ["form_key", "raw_key"]).select(F.col("id").alias("a"), "form_key", F.col("other").alias("raw_key"))
    b = rows.select(F.col("id").alias("b"), "form_key", "raw_key")
    return a.join(b, ["form_key", "raw_key"]).select(F.least("a", "b").alias("a_id"), F.greatest("a", "b").alias("b_id")).filter("a_id < b_id").distinct()


def lookalike_classes(df: DataFrame, id_col: str, text: str, model: Model | None = None) -> DataFrame:
    """Every row with a text: id, form_key (its class), n_rows and n_writings of the class; grows with the rows, not with their pairs."""
    keys = stable(consistent_text(df.filter(F.col(text).isNotNull()), id_col, text, model, keys_only=True))
    sizes = keys.groupBy("form_key", "raw_key").agg(F.count(F.lit(1)).alias("n")).groupBy("form_key").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_writings"))
    return keys.join(sizes, "form_key").select(id_col, F.lower(F.hex("form_key")).alias("form_key"), "n_rows", "n_writings")
