"""Splitting oversized texts at natural boundaries (problem 1).

Atomic segments (sentences, cut down to word runs where one is too long) are
merged agglomeratively: all adjacent pairs stand in a heap by the strength of
the boundary between them, the weakest is merged first while the merged size
plus the overlap fits the limit. What remains apart is cut at the strongest
boundaries: sections, then paragraphs, lines, sentences, words.

Defined results: a text of at most ``limit`` code points (an empty one too) is
one piece; a NULL text gives no piece; pieces less their overlaps join to the
exact stored text; every row of the input is cut on its own, repeated rows too.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakgauge.session import ship

# Strength of the boundary before an atom.
HARD, WORD, SENTENCE, LINE, PARAGRAPH, SECTION = range(6)

_END = re.compile(r"(?P<para>\n[^\S\n]*\n\s*)|(?P<line>\n\s*)|(?P<sent>(?<=[.!?;。！？])(?<!\bDr\.)(?<!\bMr\.)(?<!\bMs\.)(?<!\bMx\.)(?<!\bMrs\.)(?<!\bSt\.)(?<!\bNo\.)(?<!\bno\.)(?<!\bref\.)(?<!\be\.g\.)(?<!\bi\.e\.)[\"'”’)\]]*[^\S\n]+(?=[^\s]))")
_HEADING = re.compile(r"(?:-{3,}|#{1,6} |[A-Z][A-Z0-9 /&-]{2,60}:|[A-Z][\w /&-]{2,60}:[ \t]*(?:\n|$))")


def _shorten(text: str, start: int, end: int, most: int) -> Iterator[tuple[int, int]]:
    """Cuts one atom into runs of at most ``most``, behind blanks where there are any in the last half."""
    while end - start > most:
        cut = max(text.rfind(c, start + most // 2, start + most) for c in " \n\t,;") + 1
        kind = WORD if cut > start else HARD
        cut = cut if cut > start else start + most
        yield cut, kind
        start = cut


def atoms(text: str, most: int) -> tuple[list[int], list[int]]:
    """Start offsets of the atomic segments and the strength of the boundary before each."""
    starts, strength = [0], [SECTION]
    for m in _END.finditer(text):
        at = m.end()
        if at >= len(text) or at == starts[-1]:
            continue
        kind = PARAGRAPH if m["para"] is not None else LINE if m["line"] is not None else SENTENCE
        if kind >= LINE and _HEADING.match(text, at):
            kind = SECTION
        starts.append(at)
        strength.append(kind)
    out_s, out_k = [], []
    for i, s in enumerate(starts):
        out_s.append(s)
        out_k.append(strength[i])
        for cut, kind in _shorten(text, s, starts[i + 1] if i + 1 < len(starts) else len(text), most):
            out_s.append(cut)
            out_k.append(kind)
    return out_s, out_k


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, begin) of each piece: its own text is [start, end), it begins at ``begin`` <= start inside the piece before."""
    n = len(text)
    if n <= limit:
        return [(0, n, 0)]
    starts, strength = atoms(text, limit - overlap)
    k = len(starts)
    end = [*starts[1:], n]
    right, left, alive = [*range(1, k), -1], [-1, *range(k - 1)], [True] * k
    heap = [(strength[i], end[i] - starts[i - 1], i) for i in range(1, k)]
    heapq.heapify(heap)
    while heap:
        _, size, i = heapq.heappop(heap)
        if not alive[i]:
            continue
        p = left[i]
        now = end[i] - starts[p]
        if now != size:  # one of the two has grown since
            heapq.heappush(heap, (strength[i], now, i))
            continue
        if now + (overlap if starts[p] else 0) > limit:
            continue  # sizes only grow: this boundary stays a cut
        end[p], alive[i], right[p] = end[i], False, right[i]
        if right[i] >= 0:
            left[right[i]] = p
    out, before = [], 0
    for i in range(k):
        if not alive[i]:
            continue
        s, begin = starts[i], starts[i]
        if s and overlap:
            low = max(s - overlap, before)
            words = [m.end() for m in re.finditer(r"\s+", text[low:s])]
            fits = [low + w for w in words if low + w < s]
            begin = low if low == before or text[low - 1].isspace() or not fits else fits[0]
        out.append((s, end[i], begin))
        before = s
    return out


def split_oversized(df: DataFrame, text: str, keep: list[str], limit: int = 2000, overlap: int = 200) -> DataFrame:
    """Pieces of every non-NULL text: ``keep``, piece_no (from 1), start_at, end_at, overlap_chars, piece.

    Texts within the limit never leave the JVM; there is no shuffle.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be under half the limit")
    ship(df.sparkSession)
    base = df.filter(F.col(text).isNotNull()).select(*keep, F.col(text).alias("__text"))
    small = base.filter(F.length("__text") <= limit).select(
        *keep, F.lit(1).alias("piece_no"), F.lit(0).alias("start_at"), F.length("__text").alias("end_at"), F.lit(0).alias("overlap_chars"), F.col("__text").alias("piece")
    )
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cols = [], [[] for _ in range(5)]
            for i, t in enumerate(batch.column(n_keep).to_pylist()):
                for no, (s, e, b) in enumerate(cut(t, limit, overlap), 1):
                    rows.append(i)
                    for c, v in zip(cols, (no, s, e, s - b, t[b:e]), strict=True):
                        c.append(v)
            kept = [batch.column(j).take(pa.array(rows, pa.int64())) for j in range(n_keep)]
            made = [pa.array(c, pa.int32()) for c in cols[:4]] + [pa.array(cols[4], pa.string())]
            yield pa.RecordBatch.from_arrays(kept + made, names=[*keep, "piece_no", "start_at", "end_at", "overlap_chars", "piece"])

    large = base.filter(F.length("__text") > limit)
    return small.unionByName(large.mapInArrow(run, small.schema))
