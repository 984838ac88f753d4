"""Same or near-same records across splits (problem 6).

The normalised evaluation passages are sharded and an Aho-Corasick automaton is
built over each shard; it scans every distinct normalised training text that
can match in the shard. The patterns of a passage are the whole passage and,
in names and addresses, its runs: all words but one together with the first or
the last half of that one. One letter inserted, missing or replaced leaves at
least one such run intact. As a changed letter can move a word in the sorted
passage, the text to scan is written once whole and once for every word put
behind and before the others. The intervals of a passage that are matched in
any training text are merged into its coverage; whether one single training
text is the same or one letter away is then checked exactly.

A text is sent once to every shard it can match in. Shard keys hold the other
words and the outer letters of the halved word, so a first name in a third of
all rows spreads over the surnames beside it; equal texts are made one before
anything is sent.

Defined results: rows without split, type or form are on no side; an empty side
gives no match; words are never joined or split, but a word of one letter may
be the inserted or missing letter. The coverage is the share of a passage's
letters and digits inside merged intervals: 1 for an exact match, 0 where no run
of it stands in any training text whose other word has about the same length; runs
of several training texts add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakgauge.llm.forms import kind_of, with_form
from leakgauge.session import ship, stable

EDGE = 3
#: Patterns or texts that one shard's task should hold.
SHARD_ROWS = 1_000_000
MATCH_SCHEMA = "pii_type string, form string, exact boolean, near boolean, intervals array<struct<s:int,e:int>>"
#: Ways a text can match: whole; a word of one letter left out; first half, last half of one word.
WHOLE, LESS, HEAD, TAIL = range(4)


def split_side(split: Column) -> Column:
    """The split in lower case without outer blanks, non-breaking ones too."""
    return F.lower(F.regexp_replace(split, r"(?U)^\s+|\s+$", ""))


def one_letter_apart(a: str, b: str) -> bool:
    """Whether one letter is inserted, missing or replaced between the two; another digit never is."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    most, p = min(len(a), len(b)), 0
    while p < most and a[p] == b[p]:
        p += 1
    s = 0
    while s < most - p and a[-1 - s] == b[-1 - s]:
        s += 1
    left_a, left_b = a[p : len(a) - s], b[p : len(b) - s]
    return len(left_a) <= 1 and len(left_b) <= 1 and all(c.isalpha() for c in left_a + left_b)


def comparable(evaluated: str, trained: str) -> bool:
    """Whether the lengths allow one letter to be inserted, missing or replaced; a word of digits alone can only lack one."""
    more = len(evaluated) - len(trained)
    return more == 1 or (-1 <= more <= 0 and any(c.isalpha() for c in trained))


def _sent(records: DataFrame, near_types: list[str], train: bool) -> DataFrame:
    """shard key, pii_type, form and codes (word number * 4 + way) of every way a record can match; built-in expressions, row by row."""
    words = F.split("form", " ")
    # a hash runs on from word to word, so it is the same wherever the other words are parted
    key = lambda before, behind, way, edge: F.xxhash64(F.col("pii_type"), before, behind, F.lit(way), edge)
    entry = lambda k, way, h: F.struct(h.alias("key"), (k * 4 + way).cast("int").alias("code"))
    none = F.array().cast("array<struct<key:bigint,code:int>>")

    def of_word(w: Column, k: Column) -> Column:
        n = F.length(w)
        others = F.slice(words, F.lit(1), k), F.slice(words, k + 2, F.size(words))
        if train:
            # the evaluation word has one letter less, as many or one more; a word of digits has no letter to lose or replace
            sizes = lambda *steps: F.array(*(F.greatest(n + d, F.lit(1)) for d in steps))
            evals = F.when(w.rlike(r"\p{L}"), sizes(-1, 0, 1)).otherwise(sizes(1))
        else:
            evals = F.array(n)
        reach = lambda half: F.array_distinct(F.transform(evals, lambda x: F.least(half(x).cast("int"), F.lit(EDGE), n)))
        heads = F.transform(reach(lambda x: F.floor(x / 2)), lambda h: entry(k, HEAD, key(*others, HEAD, F.concat(h.cast("string"), F.substring(w, F.lit(1), h)))))
        tails = F.transform(reach(lambda x: F.ceil(x / 2)), lambda h: entry(k, TAIL, key(*others, TAIL, F.concat(h.cast("string"), F.right(w, h)))))
        # a text less a word of one letter may be a whole text of the other side
        lone = F.when((n == 1) & (F.size(words) > 1) & w.rlike(r"\p{L}"), F.array(entry(k, LESS, key(*others, WHOLE, F.lit(""))))).otherwise(none)
        return F.concat(heads, tails, lone)

    whole = F.array(entry(F.lit(0), WHOLE, key(words, F.array().cast("array<string>"), WHOLE, F.lit(""))))
    near = F.when(F.col("pii_type").isin(near_types), F.flatten(F.transform(words, of_word))).otherwise(none)
    return records.select("pii_type", "form", F.concat(whole, near).alias("ways"))


def _shards(sent: DataFrame, shards: int) -> DataFrame:
    """One row per record and shard: shard, pii_type, form, codes."""
    placed = F.transform("ways", lambda x: F.struct(F.pmod(x["key"], F.lit(shards)).cast("int").alias("shard"), x["code"].alias("code")))
    rows = sent.select("pii_type", "form", placed.alias("ways")).select("pii_type", "form", "ways", F.explode(F.array_distinct(F.transform("ways", lambda x: x["shard"]))).alias("shard"))
    return rows.select("shard", "pii_type", "form", F.array_distinct(F.transform(F.filter("ways", lambda x: x["shard"] == F.col("shard")), lambda x: x["code"])).alias("codes"))


def _words(form: str) -> tuple[list[str], list[int]]:
    """The words of a form and where each begins."""
    words, starts, at = form.split(" "), [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    return words, starts


def _without(form: str, start: int, word: str) -> str:
    return form[: start - 1] + form[start + len(word) :] if start else form[len(word) + 1 :]


def patterns_of(form: str, codes: list[int]) -> list[tuple[str, int, int]]:
    """(pattern, way, word number) of an evaluation passage."""
    words, starts = _words(form)
    out = []
    for code in codes:
        k, way = code >> 2, code & 3
        w = words[k]
        half = len(w) // 2
        if way == WHOLE:
            out.append((f"\x04{form}\x04", way, k))
            continue
        others = _without(form, starts[k], w)
        out.append((f"\x04{others}\x04" if way == LESS else f"\x02{others}\x02{w[:half]}" if way == HEAD else f"{w[half:]}\x03{others}\x01", way, k))
    return out


def text_of(form: str, codes: list[int]) -> tuple[str, list[tuple[int, int, int]]]:
    """A training text as it is scanned, and (end, way, word number) of its renderings in order."""
    words, starts = _words(form)
    parts, ends, at = [], [], 0
    for code in codes:
        k, way = code >> 2, code & 3
        w = words[k]
        others = "" if way == WHOLE else _without(form, starts[k], w)
        part = f"\x04{form}\x04" if way == WHOLE else f"\x04{others}\x04" if way == LESS else f"\x02{others}\x02{w}\x05" if way == HEAD else f"{w}\x03{others}\x01"
        parts.append(part)
        at += len(part)
        ends.append((at, way, k))
    return "".join(parts), ends


def intervals_of(form: str, way: int, k: int) -> list[tuple[int, int]]:
    """The stretches of an evaluation passage that a match of its pattern covers."""
    words, starts = _words(form)
    s, n, half = starts[k], len(words[k]), len(words[k]) // 2
    gap = {WHOLE: None, LESS: (s, s + n), HEAD: (s + half, s + n), TAIL: (s, s + half)}[way]
    if gap is None:
        return [(0, len(form))]
    return [(a, b) for a, b in ((0, gap[0]), (gap[1], len(form))) if a < b]


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open intervals."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(intervals):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def scan_shard(evals: list[tuple[str, str, list[int]]], trains: list[tuple[str, str, list[int]]]) -> dict[tuple[str, str], tuple[bool, bool, list[tuple[int, int]]]]:
    """(exact, near, merged intervals) per matched (type, form); evals and trains: (type, form, codes)."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    owners: dict[str, list[tuple[str, str, int, int]]] = {}
    for kind, form, codes in evals:
        for pattern, way, k in patterns_of(form, codes):
            owners.setdefault(pattern, []).append((kind, form, way, k))
    found: dict[tuple[str, str], list] = {}
    if not owners:
        return {}
    for pattern, own in owners.items():
        automaton.add_word(pattern, own)
    automaton.make_automaton()
    for kind, text, codes in trains:
        scanned, ends = text_of(text, codes)
        words, at = text.split(" "), 0
        for end, own in automaton.iter(scanned):
            while ends[at][0] <= end:
                at += 1
            way, k = ends[at][1:]
            for kind_e, form, way_e, k_e in own:
                if kind_e != kind or way == way_e == LESS or (way_e > LESS and way != way_e):
                    continue  # each less a letter of its own: the halves see to those
                exact = way == way_e == WHOLE
                near = not exact and way_e <= LESS
                if way_e > LESS:
                    one = form.split(" ")[k_e]
                    if not comparable(one, words[k]):
                        continue
                    near = one_letter_apart(one, words[k])
                got = found.setdefault((kind, form), [False, False, set()])
                got[0] |= exact
                got[1] |= near
                got[2].add((way_e, k_e))
    return {key: (exact, near, merged([x for way, k in seen for x in intervals_of(key[1], way, k)])) for key, (exact, near, seen) in found.items()}


def matched_forms(evals: DataFrame, trains: DataFrame, near_types: list[str]) -> DataFrame:
    """Evaluation forms with a match: pii_type, form, exact, near, coverage. Both inputs hold distinct (pii_type, form)."""
    ship(evals.sparkSession)
    # an upper bound of the ways, read off the number of words: nothing is sent to be counted
    ways = lambda df, each: df.agg(F.sum(1 + each * F.size(F.split("form", " "))).alias("n")).first().n or 0
    shards = max(1, -(-int(ways(evals, 3) + ways(trains, 4)) // SHARD_ROWS))
    sides = [_shards(_sent(df, near_types, train), shards) for df, train in ((evals, False), (trains, True))]
    # both sides may come from one frame; other names keep their columns apart in the cogroup
    sides[1] = sides[1].toDF("shard", "t_type", "t_form", "t_codes")

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = lambda t: zip(*(t.column(j).to_pylist() for j in (1, 2, 3)), strict=True)
        found = scan_shard(list(rows(left)), rows(right)) if left.num_rows and right.num_rows else {}
        keys = list(found)
        spans = pa.array([[{"s": a, "e": b} for a, b in found[k][2]] for k in keys], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))
        return pa.table({"pii_type": pa.array([k[0] for k in keys], pa.string()), "form": pa.array([k[1] for k in keys], pa.string()), "exact": pa.array([found[k][0] for k in keys], pa.bool_()), "near": pa.array([found[k][1] for k in keys], pa.bool_()), "intervals": spans})

    found = sides[0].groupBy("shard").cogroup(sides[1].groupBy("shard")).applyInArrow(scan, MATCH_SCHEMA)
    # what the shards found of a passage is merged: at most a few intervals per word
    both = found.groupBy("pii_type", "form").agg(F.max("exact").alias("exact"), F.max("near").alias("near"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("intervals")))).alias("intervals"))
    return both.select("pii_type", "form", "exact", (F.col("near") & ~F.col("exact")).alias("near"), covered_share("form", "intervals").alias("coverage"))


def covered_share(form: str, intervals: str) -> Column:
    """Share of a form's letters and digits inside the union of sorted half-open intervals."""
    inside = lambda s, e: F.length(F.translate(F.substring(F.col(form), s + 1, e - s), " ", ""))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    step = lambda acc, x: F.struct((acc["n"] + F.when(x["e"] > acc["reach"], inside(F.greatest(x["s"], acc["reach"]), x["e"])).otherwise(0)).alias("n"), F.greatest(acc["reach"], x["e"]).alias("reach"))
    return F.aggregate(F.col(intervals), start, step)["n"] / F.length(F.translate(F.col(form), " ", ""))


def eval_overlaps(df: DataFrame, id_col: str, value: str, pii_type: str, split: str, keep: list[str] = (), eval_splits: tuple[str, ...] = ("val", "test"), train_split: str = "train", near_types: tuple[str, ...] = ("name-patient", "name-attending", "address")) -> DataFrame:
    """Every evaluation row with a form: id, split (tidied), pii_type, exact, near, coverage, and ``keep``.

    exact and near are false where no training row is the same or one letter away.
    """
    t = F.col(pii_type)
    sided = df.withColumn("__side", split_side(F.col(split))).filter(t.isNotNull())
    on_eval, on_train = F.col("__side").isin(*eval_splits), F.col("__side") == train_split
    formed = lambda rows: with_form(rows, F.col(value), kind_of(F.col(value), t), "__form")
    # one scan gives the distinct texts of both sides
    both = stable(formed(sided.filter(on_eval | on_train)).select(t.alias("pii_type"), F.col("__form").alias("form"), on_train.alias("train")).distinct())
    side = lambda train: both.filter(F.col("train") == train).select("pii_type", "form")
    found = matched_forms(side(False), side(True), list(near_types))
    rows = formed(sided.filter(on_eval)).select(F.col(id_col), F.col("__side").alias("split"), t.alias("pii_type"), *[F.col(c) for c in keep], F.col("__form").alias("form"))
    out = rows.join(found, ["pii_type", "form"], "left")
    return out.select(id_col, "split", "pii_type", *keep, F.coalesce("exact", F.lit(False)).alias("exact"), F.coalesce("near", F.lit(False)).alias("near"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def overlap_report(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows, exact and near overlaps and the mean coverage per group, pre-aggregated map-side."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("exact").cast("long")).alias("n_exact"), F.sum((F.coalesce("near", F.lit(False))).cast("long")).alias("n_near"), F.round(F.avg("coverage"), 6).alias("mean_coverage")
    )
