"""Training-data operators: brute force, round trips and the edge cases each docstring states."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakgauge.llm import boosting, copies, groupsplit, lookalike, mixing, overlap, packing, personal, pieces, terms, tokens
from leakgauge.llm.page import Hashed, Page, member, word_hashes

VOCABULARY = tokens.DEFAULT_VOCABULARY


# ---- problem 1


def sample_text(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    out = []
    while sum(map(len, out)) < n:
        out.append(rnd.choice(["One sentence here. ", "Dr. Smith came e.g. late! ", "\n\nHISTORY:\n", "\n", "x" * rnd.choice([3, 2500]) + " ", "Ещё одно предложение. ", "\r\n"]))
    return "".join(out)


@pytest.mark.parametrize("seed", range(8))
def test_pieces_round_trip(seed):
    text = sample_text(seed, 9000)
    got = pieces.cut(text, 2000, 200)
    assert "".join(text[s:e] for s, e, _ in got) == text
    assert all(e - b <= 2000 and 0 <= s - b <= 200 for s, e, b in got)
    assert got[0][2] == 0 and all(b >= before[0] for before, (_, _, b) in zip(got, got[1:], strict=False))


def test_pieces_cut_at_the_strongest_boundary():
    part = "A sentence of some length stands here. " * 30
    text = part + "\n\nHOSPITAL COURSE:\n" + part
    assert [s for s, _, _ in pieces.cut(text, 2000, 200)] == [0, text.index("HOSPITAL")]


def test_pieces_edges(spark):
    rows = [("a", None, 1), ("b", "", 2), ("c", "y" * 2000, 3), ("d", "z" * 5001, 4), ("d", "z" * 5001, 4), ("e", "\U0001f600" * 2000, 5)]
    df = spark.createDataFrame(rows, "note_id string, note string, piece_no int").withColumnRenamed("piece_no", "extra")
    got = pieces.split_oversized(df, "note", ["note_id", "extra"]).collect()
    assert Counter(r.note_id for r in got) == {"b": 1, "c": 1, "d": 6, "e": 1}  # repeated rows are each cut
    assert max(len(r.piece) for r in got) <= 2000
    assert pieces.split_oversized(df.limit(0), "note", ["note_id"]).count() == 0
    with pytest.raises(ValueError):
        pieces.split_oversized(df, "note", ["note_id"], 100, 60)


# ---- problem 2

FIRST = ["Ulrika", "Cormac", "Venetia", "Will", "Grace", "Oswin"]
LAST = ["Herhosberhid", "Dusfugfunfor", "Kitmimkezess", "Lamgohfapims", "Patizafutert", "Volpobsofass", "Rinvaklumiza", "Zezetofutrin"]


def make_notes(n: int, seed: int) -> list[tuple[dict, set]]:
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        f, s, doc = rnd.choice(FIRST), rnd.choice(LAST), rnd.choice(["Monfavkut", "Telpivlom", "Wonkitfap"])
        mrn, ssn, phone = (str(rnd.randrange(10**9, 10**10)), f"{rnd.randrange(900, 999)}-{rnd.randrange(10, 99)}-{rnd.randrange(1000, 9999)}", f"0{rnd.randrange(10, 99)}-{rnd.randrange(100, 999)}-{rnd.randrange(1000, 9999)}")
        mail, address = f"{f.lower()}.{s.lower()}{rnd.randrange(99)}@mail.farrowdale.example", f"{rnd.randrange(1, 9999)} Saffron {rnd.choice(['Lane', 'Court'])}, Castlewray, QX {rnd.randrange(10000, 99999)}"
        filler = ["Lot 717-20-27 of oxalprin was used.", "Accession 4408700887 was filed with the sample.", "The Torvald sign was absent.", "Grace period for the form ends soon.", "Seen again in May, will return in April.", "MRN 9999999999 is a stand-in."]
        body = [f"{f}'s chart was reviewed.", f"Contact {mail}.", f"ring before noon, {phone}.", f"SSN {ssn}.", f"Lives at {address}.", f"Discussed with Dr. {doc}.", f"Mrs. {s} slept well."]
        rnd.shuffle(body)
        text = f"Name: {f} {s}\nMRN: {mrn}\nAttending: Dr. {doc}\n\n" + " ".join(x for b in body for x in (b, rnd.choice(filler)))
        truth = {("name", f"{f} {s}"), ("name", f), ("name", s), ("name", doc), ("id", mrn), ("id", ssn), ("phone", phone), ("email", mail), ("address", address)}
        out.append(({"note": text, "name": f"{f} {s}", "physician_name": f"Ada {doc}", "phone": phone, "unit_no": mrn, "ssn": ssn, "email": mail, "address": address.replace(", ", "\n")}, truth))
    return out


@pytest.fixture(scope="module")
def detector():
    return personal.fit_rows([r for r, _ in make_notes(500, 1)])


def test_detector_on_held_out_notes(detector):
    notes = make_notes(120, 2)
    hits = got = want = 0
    for (row, truth), spans in zip(notes, detector.spans([r["note"] for r, _ in notes]), strict=True):
        found = {(k, row["note"][s:e]) for k, s, e in spans}
        hits += len(found & truth)
        got += len(found)
        want += len(truth)
    assert hits / got > 0.97 and hits / want > 0.95


def lower_headers(n: int, seed: int) -> list[tuple[dict, str]]:
    """Notes of which every fifth has the name of its header in lower case, with that name as it stands."""
    out = []
    for i, (row, _) in enumerate(make_notes(n, seed)):
        label = ["Name: ", "PATIENT: ", "Patient Name: "][i % 3]
        name = row["name"].lower() if i % 5 == 0 else row["name"]
        out.append((row | {"note": row["note"].replace(f"Name: {row['name']}", label + name, 1)}, name))
    return out


def test_names_in_lower_case():
    d = personal.fit_rows([r for r, _ in lower_headers(400, 4)])
    notes = [(r["note"], name) for r, name in lower_headers(150, 5) if name.islower()]
    got = [("name", t.index(name), t.index(name) + len(name)) in spans for (t, name), spans in zip(notes, d.spans([t for t, _ in notes]), strict=True)]
    assert len(got) == 30 and sum(got) >= 29
    assert "ulrika o'birk-holt" in proposed("seen: ulrika o'birk-holt, well") and "birk, ulrika" in proposed("for birk, ulrika (MRN") and "birk^ulrika" in proposed("x birk^ulrika")
    assert proposed("plain words only, no name here") == set() and "Will birk" in proposed("Will birk came")


def lexica(*given: str) -> personal.Lexica:
    return personal.Lexica(word_hashes(given), frozenset(), np.zeros(0, np.uint64), np.zeros(0))


def proposed(text: str, given: tuple[str, ...] = ("ulrika", "will")) -> set[str]:
    made = personal.Proposals([text], lexica(*given))
    return {text[a:b] for m in ("name", personal.LOWER) for a, b in zip(made.spans[m].start, made.spans[m].end, strict=True)}


def test_every_capitalised_word_is_proposed():
    text = "Romhev's chart. The O'Birk-Holt sign; Dr. A. Elm, Mary (Ana R. Oak) 12 Lead x@y.z [Name] ___Anna Fir ... J.K. Ash"
    got = proposed(text)
    assert {"Romhev", "The", "O'Birk-Holt", "A. Elm", "Elm, Mary", "Ana", "Ana R.", "Ana R. Oak", "Ash"} <= got
    assert not got & {"Lead", "Name", "Dr", "R", "A."} and not any("Dr" in g for g in got)
    assert proposed("ULRIKA BIRK'S and Birk’s") == {"ULRIKA", "ULRIKA BIRK", "BIRK", "Birk"}


def test_neighbouring_accepted_parts_of_a_long_name_become_one():
    text = "Ana Maria Luisa de Souza Prado e Silva came, Bob Elm Oak Ash"
    at = lambda w: ("name", text.index(w), text.index(w) + len(w))
    assert personal.join_names(text, [at("Ana Maria Luisa de"), at("Souza Prado e"), at("Silva")]) == [at("Ana Maria Luisa de Souza Prado e Silva")]
    assert personal.join_names(text, [at("Bob"), at("Elm Oak Ash")]) == [at("Bob"), at("Elm Oak Ash")]  # four words were a proposal


def test_choice_against_brute_force():
    rnd = random.Random(7)
    for _ in range(50):
        found = [(rnd.choice("ab"), s, s + rnd.randrange(1, 9), rnd.random()) for s in (rnd.randrange(60) for _ in range(40))]
        taken = []
        for k, s, e, _ in sorted(found, key=lambda f: (-round(f[3], 1), -(f[2] - f[1]), f[1], f[0])):
            if all(e <= a or s >= b for _, a, b in taken):
                taken.append((k, s, e))
        assert personal.choose(found) == sorted(taken, key=lambda t: t[1])


def test_cues_the_fit_has_not_seen(detector):
    """The labels come from facts, so contexts that no note of the fit holds rest on format and words alone."""
    hits = want = 0
    for row, truth in make_notes(150, 9):
        text = row["note"]
        for a, b in (("Name: ", "Pt = "), ("MRN: ", "Chart id "), ("Attending: Dr. ", "Under "), ("ring before noon, ", "voicemail "), ("SSN ", "tax file "), ("Contact ", "write via "), ("Lives at ", "staying in "), ("Discussed with", "Cc"), ("Mrs. ", "Madam ")):
            text = text.replace(a, b)
        found = {(k, text[s:e]) for k, s, e in detector.spans([text])[0]}
        hits += len(found & truth)
        want += len(truth)
    assert hits / want > 0.7


def test_pages_match_patterns():
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(["Ana ", "o'Birk", "-", "’s ", "Ünal", "12", "a_b", "@", ".", "\n", "文字 ", "\U00010400x ", "É", "'S "]) for _ in range(rnd.randrange(30))) for _ in range(200)]
    page = Page(texts)
    for d, t in enumerate(texts):
        here = [(s - page.begin[d], e - page.begin[d]) for s, e in zip(page.start[page.doc == d], page.end[page.doc == d], strict=True)]
        assert "".join(t[a:b] for a, b in here) == re.sub(r"\s", "", t) and all(a < b for a, b in here)
    words = ["ana", "ünal", "o'birk", "anaa"]
    page = Page(["Ana ANA ünal", "x O'BIRK"])
    assert member(word_hashes(words), page.low).tolist() == [True, True, True, False, True]
    table = Hashed(np.arange(1, 5000, dtype=np.uint64), np.arange(1, 5000))
    assert table.get(np.array([1, 4999, 5000], np.uint64), -1).tolist() == [1, 4999, -1] and not Hashed(np.zeros(0, np.uint64)).has(np.array([7], np.uint64)).any()


def test_detector_edges(spark, detector):
    rows = [("a", None), ("b", ""), ("c", "Contact [PHONE] or ___, MRN: 0000000000."), ("d", "MRN: 5005912237. " + "nothing else is said. " * 1500), ("d", "MRN: 5005912237.")]
    df = spark.createDataFrame(rows, "note_id string, note string").withColumn("kind", F.lit(1))
    found = personal.find_spans(df, "note", ["note_id"], detector).collect()
    assert {(r.note_id, r.kind, r.surface) for r in found} == {("d", "id", "5005912237")} and len(found) == 2
    out = {(r.note_id, r.redacted) for r in personal.redacted(df, "note", ["note_id"], detector).collect()}
    assert ("a", None) in out and ("b", "") in out and ("d", "MRN: [ID].") in out
    assert personal.find_spans(df.limit(0), "note", ["note_id"], detector).count() == 0
    assert personal.fit_detector(df.limit(0).withColumn("subject_id", F.lit("s")), None).spans(["Ana Elm"]) == [[]]
    nobody = personal.fit_rows([])
    assert nobody.spans(["Name: Ulrika Herhosberhid", None]) == [[], []]


def test_thresholds_are_calibrated_whatever_the_number_of_proposals(monkeypatch):
    rows, fits, helds = [r for r, _ in make_notes(150, 3)], [], []
    fit, calibrate = boosting.fit, boosting.calibrated_threshold
    monkeypatch.setattr(personal.boosting, "fit", lambda x, y: fits.append(len(y)) or fit(x, y))
    monkeypatch.setattr(personal.boosting, "calibrated_threshold", lambda p, y, **kw: helds.append(len(y)) or calibrate(p, y, **kw))
    personal.fit_rows(rows)
    names, whole = fits[0] + helds[0], len(fits)
    for part in (1.5, 2.5, 3.5, 5.5):  # a third step was one with the folds
        fits.clear()
        helds.clear()
        monkeypatch.setattr(personal, "MOST_ROWS", int(names / part))
        personal.fit_rows(rows)
        assert len(fits) == whole and min(fits) > 0 and abs((fits[0] + helds[0]) * part / names - 1) < 0.35
        assert 0.5 < fits[0] / (fits[0] + helds[0]) < 0.85 and min(helds) > 0
    with pytest.warns(UserWarning, match="threshold 0.5"):
        assert personal.fit_rows(rows[:1]).thresholds["name"] == 0.5


def test_sample_is_bounded_and_keeps_every_text_once(spark):
    rows = [(f"note number {i} of some length, with words", f"S {i % 7}") for i in range(900)] + [("one text that holds a third of all rows", "S 1")] * 450
    notes = spark.createDataFrame(rows, "note string, subject_id string")
    personas = spark.createDataFrame([(f"s{i}", f"Ana Elm{i}", None, None, 7, None, None, None, False) for i in range(7)], "subject_id string, name string, physician_name string, phone string, unit_no long, ssn string, email string, address string, random_name boolean")
    got = personal.sample_rows(notes, personas, most=100)
    assert len(got) == 100 and len({r["note"] for r in got}) == 100 and all(r["name"].startswith("Ana Elm") for r in got)
    assert len(personal.sample_rows(notes, None, most=5000)) == 901


def test_early_exit_changes_no_result():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 5)).astype(np.float32)
    t = boosting.fit(x, (x[:, 0] + x[:, 1] > 1.3).astype(int))
    for threshold in (0.05, 0.5, 0.9):
        rows, p = t.reaching(x, threshold)
        assert rows.tolist() == np.flatnonzero(t.probability(x) >= threshold).tolist() and np.allclose(p, t.probability(x)[rows])
    assert len(boosting.nothing().reaching(x, 0.5)[0]) == 0


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(int)
    t = boosting.fit(x[:3000], y[:3000])
    assert (((t.probability(x[3000:]) > 0.5) == y[3000:]).mean()) > 0.97
    assert boosting.fit(x[:5], np.ones(5)).probability(x[:2]).min() > 0.9 and len(t.probability(x[:0])) == 0
    assert 0.2 < boosting.calibrated_threshold(np.array([0.9, 0.8, 0.2, 0.1]), np.array([1, 1, 0, 0])) < 0.8


# ---- problem 3


def test_components_against_union_find(spark):
    rnd = random.Random(4)
    edges = {(f"n{rnd.randrange(120)}", f"n{rnd.randrange(120)}") for _ in range(90)} | {(f"c{i}", f"c{i + 1}") for i in range(25)}
    parent: dict[str, str] = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = {n: min(m for m in parent if find(m) == find(n)) for n in parent if any(n in e and e[0] != e[1] for e in edges)}
    df = spark.createDataFrame(sorted(edges), "a string, b string")
    assert {r.node: r.label for r in groupsplit.components(df).collect()} == want


def notes_of_persons(spark):
    rows = [
        ("n1", "S-1", "MRN: 123-456-7890."), ("n2", "s1 ", "none"), ("n3", "S2", "Unit No: 1234567890"), ("n4", "S3", "medical record number 1234 567 890"), ("n5", "S4", "MRN 0000000000"), ("n6", "S5", "Unit No. 1111111111"),
        ("n7", None, "MRN: 1234567890"), ("n8", None, None), ("n8", None, None), ("n9", "", ""), ("n10", "S6", "Accession 1234567890"),
    ]
    return spark.createDataFrame(rows, "note_id string, subject_id string, note string")


def test_same_person(spark):
    df = notes_of_persons(spark)
    got = {tuple(r) for r in groupsplit.same_person_pairs(df, "note_id", "subject_id", "note").collect()}
    ids = ["S-1", "s1 ", "S2", "S3"]
    assert got == {(a, b) for a in ids for b in ids if a < b}
    assert groupsplit.same_person_pairs(df.limit(0), "note_id", "subject_id", "note").count() == 0


def test_split_keeps_persons_together_and_meets_shares(spark):
    df = notes_of_persons(spark)
    shares = spark.createDataFrame([("train", 0.5), ("val", 0.5), ("none", None)], "split string, share double")
    out = groupsplit.split_groups(df, shares, "note_id", "subject_id", "note", F.lit("x")).collect()
    assert len(out) == df.count() and len({r.split for r in out if r.note_id in ("n1", "n2", "n3", "n4", "n7")}) == 1 and None not in {r.split for r in out} and "none" not in {r.split for r in out}
    rnd = random.Random(1)
    big = spark.createDataFrame([(f"n{i}", f"S{rnd.randrange(400) if i % 3 else 0}", "a" if i % 4 else "b") for i in range(4000)], "note_id string, subject_id string, note string")
    aims = spark.createDataFrame([("train", 0.8), ("val", 0.1), ("test", 0.1)], "split string, share double")
    got = groupsplit.split_groups(big, aims, "note_id", "subject_id", "note", F.col("note"), ["subject_id"]).collect()
    n, per = Counter(r.split for r in got), defaultdict(set)
    for r in got:
        per[r.subject_id].add(r.split)
    assert all(len(v) == 1 for v in per.values()) and abs(n["train"] / 4000 - 0.8) < 0.01 and abs(n["val"] / 4000 - 0.1) < 0.01
    assert abs(sum(r.split == "val" and r.label == "b" for r in got) / 1000 - 0.1) < 0.03
    assert groupsplit.split_groups(big.limit(0), aims, "note_id", "subject_id", "note", F.col("note")).count() == 0


def test_more_than_a_thousand_splits(spark):
    n = 1001
    df = spark.createDataFrame([(f"n{i}", f"S{i}", "a") for i in range(3 * n)], "note_id string, subject_id string, note string")
    aims = spark.createDataFrame([(f"part{i}", 1.0 / n) for i in range(n)], "split string, share double")
    got = groupsplit.split_groups(df, aims, "note_id", "subject_id", "note", F.lit("x")).groupBy("split").count().collect()
    assert len(got) > 0.9 * n and sum(r["count"] for r in got) == 3 * n


def test_classes_of_persons(spark):
    df = notes_of_persons(spark)
    pairs = {tuple(r) for r in groupsplit.same_person_pairs(df, "note_id", "subject_id", "note").collect()}
    classes = groupsplit.same_person_classes(df, "note_id", "subject_id", "note").collect()
    assert {(a.subject, b.subject) for a in classes for b in classes if a.person == b.person and a.subject < b.subject} == pairs
    assert all(r.n_subjects == sum(x.person == r.person for x in classes) for r in classes)


# ---- problem 4


def brute_form(v, t):
    if v is None or re.fullmatch(r"(?s)\s*\[.*\]\s*", v):
        return None
    kind = {"unit_no": "number", "phone": "number", "email": "email"}.get(t, "words") if t else "email" if "@" in v else "number" if not re.search(r"[^\W\d_]", v) else "words"
    words = re.findall(r"[^\W_]+", v.lower())
    form = re.sub(r"\D", "", v) if kind == "number" else "".join(words) if kind == "email" else " ".join(sorted(words))
    return (t, kind, form) if form else None


VALUES = ["Ada Birk", "birk, ADA", "Ada_Birk", "AdaBirk", "12 Elm Row, Quenby", "Quenby - 12 Elm Row", "123-456", "123 456", "[NAME]", "___", " ", "", None, "a.b@c.example", "<A.B@c.example>", "Ada  Birk\t", "é É", "É é"]


def test_copies_against_brute_force(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(VALUES), rnd.choice(["name-patient", "unit_no", None])) for i in range(160)] + [(1000 + i, "Hot Value", "name-patient") for i in range(60)] + [(5000, "Ada Birk", "email"), (5000, "Ada Birk", "email")]
    df = spark.createDataFrame(rows, "row_id long, value string, pii_type string").withColumn("form", F.lit("clash"))
    classes = defaultdict(list)
    for i, v, t in rows:
        if brute_form(v, t):
            classes[brute_form(v, t)].append(i)
    want = {(a, b) for ids in classes.values() if 2 <= len(ids) <= 20 for a in ids for b in ids if a < b}
    got = [tuple(r) for r in copies.copy_pairs(df, "row_id", "value", "pii_type").collect()]
    assert set(got) == want and len(got) == len(want)
    counts = {(r.pii_type, r.form): r.n_rows for r in copies.identifiers(df, "value", "pii_type").collect()}
    assert counts[("name-patient", "hot value")] == 60 and sum(counts.values()) == sum(map(len, classes.values()))
    assert copies.identifiers(df.limit(0), "value", "pii_type").count() == 0 and copies.copy_pairs(df.limit(0), "row_id", "value").count() == 0


# ---- problem 5


def test_terms_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["Ada Birk", "ada ADA_b12", "", None, "...", "ß é", f"u{i}"]), rnd.choice([None, -1, 0, 2, 5])) for i in range(400)]
    occ, held = Counter(), Counter()
    for v, w in rows:
        if v is not None:
            t = re.findall(r"[^\W_]+", v.lower())
            for x in t:
                occ[x] += max(w if w is not None else 1, 1)
            held.update(set(t))
    df = spark.createDataFrame(rows, "value string, count long")
    for heavy in (0, 3, 512):
        got = {r.term: (r.occurrences, r.n_rows) for r in terms.term_counts(df, "value", "count", heavy=heavy, detect_part=1.0).collect()}
        assert got == {k: (occ[k], held[k]) for k in occ}
    n = sum(v is not None for v, _ in rows)
    marks = {r.term: r.mark for r in terms.marked_terms(df, "value", "count").collect()}
    assert marks == {k: "common" if held[k] > 0.01 * n else "rare" if occ[k] < 3 else None for k in occ}
    assert terms.marked_terms(df.limit(0), "value", "count").count() == 0


# ---- problem 6


def edit_one(a: list[str], b: list[str]) -> bool:
    ca, cb = Counter(a), Counter(b)
    x, y = list((ca - cb).elements()), list((cb - ca).elements())
    if len(x) + len(y) == 1:
        return len((x + y)[0]) == 1 and (x + y)[0].isalpha()
    if len(x) != 1 or len(y) != 1:
        return False
    x, y = x[0], y[0]
    letters = "abcdefghijklmnopqrstuvwxyz"
    near = {x[:i] + x[i + 1 :] for i in range(len(x)) if x[i].isalpha()} | {x[:i] + c + x[i:] for i in range(len(x) + 1) for c in letters} | {x[:i] + c + x[i + 1 :] for i in range(len(x)) if x[i].isalpha() for c in letters}
    return y in near - {""}


def test_overlap_against_brute_force(spark):
    rnd = random.Random(6)
    names = ["Ilse Lemdek", "Ilse Lemdeks", "Lemdek Ilse", "lse Lemdek", "Ilse Lemdxk", "Ada B Birk", "Ada Birk", "Ada BB Birk", "Bo Li", "B Li", "Bo Lia", "C D", "E D", "12 Elm Row", "13 Elm Row", "12 Elms Row", "12 Elm2 Row", "Zoe", "Zo", None, "___", "Anna Anna", "Anna Ana", "x1 y", "x y"]
    rows = [(i, rnd.choice(["name-patient", "address", "unit_no", None]), rnd.choice(["train", " TRAIN", "val", "Test ", None, "other"]), rnd.choice(names)) for i in range(260)]
    tidy = lambda s: s.strip().lower() if s else None
    train = {brute_form(v, t) for _, t, s, v in rows if t and tidy(s) == "train"} - {None}
    want = {}
    for i, t, s, v in rows:
        f = brute_form(v, t) if t else None
        if f and tidy(s) in ("val", "test"):
            near = t != "unit_no" and any(k[0] == t and edit_one(f[2].split(), k[2].split()) for k in train)
            want[i] = (f in train, f not in train and near)
    df = spark.createDataFrame(rows, "row_id long, pii_type string, split string, value string").withColumn("words", F.lit(0))
    got = {r.row_id: (r.exact, r.near) for r in overlap.eval_overlaps(df, "row_id", "value", "pii_type", "split").collect()}
    assert got == want
    assert overlap.eval_overlaps(df.filter("split = 'val'"), "row_id", "value", "pii_type", "split").filter("exact OR near").count() == 0
    assert overlap.eval_overlaps(df.limit(0), "row_id", "value", "pii_type", "split").count() == 0


def test_a_letter_beside_a_number_both_ways(spark):
    words = ["1", "12", "123", "1234", "12345678"]
    pairs = [(w, w[:k] + "b" + w[k:]) for w in words for k in range(len(w) + 1)]
    rows, near = [], set()
    for i, (a, b) in enumerate(pairs):
        for way, (x, y) in enumerate([(a, b), (b, a)]):
            rows += [(4 * i + 2 * way, f"{x} Oak{chr(97 + i)}{way} Street", "address", "val"), (4 * i + 2 * way + 1, f"{y} Oak{chr(97 + i)}{way} Street", "address", "train")]
            near.add(4 * i + 2 * way)
    rows += [(9000, "12 Elm Row", "address", "val"), (9001, "13 Elm Row", "address", "train"), (9002, "123 Elm Row", "address", "train"), (9003, "1b Elm Row", "address", "train")]
    df = spark.createDataFrame(rows, "row_id long, value string, pii_type string, split string")
    got = overlap.eval_overlaps(df, "row_id", "value", "pii_type", "split").collect()
    assert {r.row_id for r in got if r.near} == near and not any(r.exact for r in got)


def test_coverage(spark):
    assert overlap.merged([(2, 6), (0, 4), (8, 9)]) == [(0, 6), (8, 9)]
    assert overlap.one_letter_apart("abcd", "abxd") and not overlap.one_letter_apart("abc", "ab1") and not overlap.one_letter_apart("a", "abc") and not overlap.one_letter_apart("ab", "ab")
    # runs of two training texts cover a passage that neither comes near; a run of one covers half of a word less
    rows = [(1, "Anna Bell Carl", "val"), (2, "Bell Anna Cabc", "train"), (3, "Anna Xxrl Bell", "train"), (4, "Dora Elm Finch", "val"), (5, "Dora Elm Fixxx", "train"), (10, "Dora Elm Finchley", "train"), (6, "Gus Hay", "test"), (7, "Ina Hay", "train"), (8, "Joe Key", "val"), (9, "key joe", "train")]
    df = spark.createDataFrame(rows, "row_id long, value string, split string").withColumn("pii_type", F.lit("name-patient"))
    got = {r.row_id: (r.exact, r.near, round(r.coverage, 3)) for r in overlap.eval_overlaps(df, "row_id", "value", "pii_type", "split").collect()}
    assert got == {1: (False, False, 1.0), 4: (False, False, round(9 / 12, 3)), 6: (False, False, 0.0), 8: (True, False, 1.0)}


def test_one_shard_or_many(spark, monkeypatch):
    rnd = random.Random(3)
    names = [f"{rnd.choice(['Ana', 'Bo', 'Cy'])} {''.join(rnd.choice('abc') for _ in range(rnd.randrange(1, 6)))}" for _ in range(300)]
    df = spark.createDataFrame([(i, n, rnd.choice(["train", "val"])) for i, n in enumerate(names)], "row_id long, value string, split string").withColumn("pii_type", F.lit("name-patient"))
    rows = lambda: sorted(map(tuple, overlap.eval_overlaps(df, "row_id", "value", "pii_type", "split").collect()))
    one = rows()
    monkeypatch.setattr(overlap, "SHARD_ROWS", 50)
    assert rows() == one and any(r[4] for r in one)


# ---- problem 7


def test_bucket_bounds_are_optimal():
    rnd = random.Random(8)
    hist = {rnd.randrange(1, 60): rnd.randrange(1, 9) for _ in range(9)}
    sizes = sorted(hist)
    cost = lambda bounds: sum(n * (min(b for b in bounds if b >= s) - s) for s, n in hist.items())
    from itertools import combinations

    best = min(cost([*c, sizes[-1]]) for k in range(3) for c in combinations(sizes[:-1], k))
    assert cost(packing.bucket_bounds(hist, 3)) == best
    assert packing.bucket_bounds({}, 3) == [] and packing.bucket_bounds({5: 2}, 3) == [5]


@pytest.mark.parametrize("buckets", [1, 4, 192])
def test_packing_places_everything(spark, buckets):
    rnd = random.Random(9)
    rows = [(i, rnd.choice([0, 1, 7, 100, 101, 250, rnd.randrange(1, 260)])) for i in range(900)] + [(1000, None), (7, 55), (7, 55)]
    df = spark.createDataFrame(rows, "doc_id long, n long")
    got = packing.pack(df, "doc_id", "n", 100, buckets).collect()
    assert sum(r.n_tokens for r in got) == sum(n or 0 for _, n in rows)
    fill, slots = Counter(), set()
    for r in got:
        if r.n_tokens:
            fill[r.container] += r.n_tokens
            assert (r.container, r.slot) not in slots and r.n_tokens <= 100
            slots.add((r.container, r.slot))
        else:
            assert r.container is None
    assert max(fill.values()) <= 100 and set(fill) == set(range(len(fill)))
    if buckets == 192:
        assert sum(fill.values()) / (100 * len(fill)) > 0.9
    uncut = {i: n for i, n in rows if n and n <= 100}
    assert all(r.piece == 0 for r in got if r.doc_id in uncut and r.doc_id != 7)
    assert packing.pack(df.limit(0), "doc_id", "n", 100).count() == 0
    # step 1 alone: the batches of one bucket each, and no more unused by both steps
    alone = packing.pack(df, "doc_id", "n", 100, buckets, waste=1.0).collect()
    assert {r.step for r in alone if r.n_tokens} == {1} and sum(r.n_tokens for r in alone) == sum(r.n_tokens for r in got)
    assert len(fill) <= len({r.container for r in alone if r.n_tokens})
    report = {r.step: r for r in packing.fill_report(packing.pack(df, "doc_id", "n", 100, buckets), 100).collect()}
    assert report[None].containers == len(fill) and report[None].n_tokens == sum(fill.values()) == sum(r.n_tokens for k, r in report.items() if k)


def test_batches_of_a_bucket_stay_together():
    rows = packing.plan_batches({50: 5, 30: 7, 99: 3, 60: 4}, 100, 0.1)
    assert rows == [(30, 0, 6, 0, 3, 0, 1), (50, 0, 4, 2, 2, 0, 1), (99, 0, 3, 4, 1, 0, 1)]
    both = packing.plan({50: 5, 30: 7, 99: 3, 60: 4}, 100, 0.1)
    assert both[:3] == rows and {r[0]: r[2] for r in both} == {50: 5, 30: 7, 99: 3, 60: 4} and {r[6] for r in both[3:]} == {2}


def test_text_sizes(spark):
    import tiktoken  # noqa: F401

    texts = ["", None, "Hello world. " * 10, "длинный текст", "a" * 1000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("n_tokens", F.lit(-1))
    got = {r.doc_id: r.n_tokens for r in tokens.token_sizes(df, "text", ["doc_id"]).collect()}
    assert got == {i: len(tokens.encoder(VOCABULARY).encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}


def test_long_texts_have_the_tokens_of_the_whole(monkeypatch):
    rnd = random.Random(8)
    made = lambda signs, n: "".join(rnd.choice(signs) for _ in range(n))
    texts = [made(["word", " ", "  ", "\n", ".", "don't", " 12", "é", "_"], 60_000), "x" * 111_909, made("abcdefgh", 200_000), made(["a", "\u00a0", "\t"], 150_000), "plain words here " * 15_000]
    whole = [len(tokens.encoder(VOCABULARY).encode_ordinary(t)) for t in texts]
    assert [tokens.count_tokens(t) for t in texts] == whole
    monkeypatch.setattr(tokens, "STRETCH", 100)
    assert [tokens.count_tokens(t) for t in texts] == whole


# ---- problem 8


def test_rates():
    r = {x.source: x.rate for x in mixing.rates({"a": 1000, "b": 100, "c": 1}, {"a": (0.5, 1), "b": (0.3, 4), "c": (0.1, 2), "gone": (0.1, 3), "zero": (0.0, 2)})}
    assert r["c"] == 2 and r["gone"] == 0 and r["zero"] == 0 and r["a"] <= 1 and r["b"] <= 4
    used = {"a": 1000 * r["a"], "b": 100 * r["b"]}
    assert abs(used["a"] / used["b"] - 5 / 3) < 0.6 or r["b"] == 4
    exact = {x.source: x.rate for x in mixing.rates({"a": 500, "b": 500}, {"a": (0.75, 1), "b": (0.25, 1)})}
    assert exact == {"a": 1.0, "b": pytest.approx(1 / 3)}
    assert mixing.rates({}, {}) == []


def test_mix_reaches_shares(spark):
    rows = [(i, "word " * (5 + i % 7), "a" if i % 5 else "b") for i in range(3000)] + [(9001, None, "a"), (9002, "x", None), (9003, "x", "other"), (9004, "", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("uses", F.lit(0))
    aims = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 3), ("absent", 0.0, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mix(df, aims, "doc_id", "text", "source")
    got = {r.source: r for r in report.collect()}
    assert abs(got["a"].reached_share - 0.6) < 0.02 and abs(got["b"].reached_share - 0.4) < 0.02 and got["absent"].tokens_used == 0
    assert chosen.agg(F.max("uses")).first()[0] <= 3 and chosen.filter("source NOT IN ('a', 'b')").count() == 0
    again = mixing.mix(df.repartition(7), aims, "doc_id", "text", "source")[0]
    assert sorted(map(tuple, chosen.collect())) == sorted(map(tuple, again.collect()))
    assert mixing.mix(df.limit(0), aims, "doc_id", "text", "source")[0].count() == 0


def test_mix_with_more_than_a_thousand_targets(spark):
    n = 1001
    df = spark.createDataFrame([(i, "word " * 6, f"s{i % (2 * n)}") for i in range(4 * n)], "doc_id long, text string, source string")
    aims = spark.createDataFrame([(f"s{i}", 1.0 / n, 2) for i in range(n)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mix(df, aims, "doc_id", "text", "source")
    assert {r.source for r in chosen.select("source").distinct().collect()} == {f"s{i}" for i in range(n)} and report.filter("tokens_used > 0").count() == n


# ---- problem 9


@pytest.fixture(scope="module")
def model(spark):
    words = "the patient was admitted with pain and no fever пациент поступил с жалобами на слабость нос сон они Ende über été"
    df = spark.createDataFrame([(i, words) for i in range(5)], "doc_id long, text string")
    return lookalike.fit(df, "text")


SAME = [("patient", "раtіеnt"), ("a b", "a\xa0b"), ("fever", "ｆｅｖｅｒ"), ("pain", "pa​in"), ("été", "été"), ("fine", "ﬁne"), ("нос", "нoc"), ("µg", "μg"), ("a-b", "a‑b"), ("é", "е́"), ("ok", "o­k")]
DIFFERENT = [("ete", "été"), ("Pain", "pain"), ("m2", "m²"), ("10", "1O"), ("a b", "ab"), ("a  b", "a b"), ("½", "1/2"), ("l", "1"), ("\n", " "), ("нос", "носы")]


def test_look_alikes(model):
    form = lookalike.Normalizer(model)
    assert [form(a) == form(b) for a, b in SAME] == [True] * len(SAME)
    assert [form(a) != form(b) for a, b in DIFFERENT] == [True] * len(DIFFERENT)
    assert form("рatіеnt") == "patient" and form("пoстyпил") == "поступил" and form(None) is None and form("") == "" and form("​") == ""
    for a, b in SAME:
        assert form(form(b)) == form(b)


def test_pairs(spark, model):
    rows = [(1, "pain"), (2, "pa​in"), (3, "pain"), (4, "Pain"), (5, None), (6, ""), (7, "​"), (8, "раin"), (8, "раin"), (None, "pain")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("form_key", F.lit(1))
    got = sorted(tuple(r) for r in lookalike.lookalike_pairs(df, "doc_id", "text", model).collect())
    assert got == [(1, 2), (1, 8), (2, 3), (2, 8), (3, 8), (6, 7)]
    assert lookalike.lookalike_pairs(df.limit(0), "doc_id", "text").count() == 0
    long = spark.createDataFrame([(1, "pain " * 50000), (2, "раin " * 50000)], "doc_id long, text string")
    assert lookalike.lookalike_pairs(long, "doc_id", "text", model).count() == 1
    many = spark.createDataFrame([(i, "pain") for i in range(3000)] + [(9000, "раin"), (9001, "p\u0430in")], "doc_id long, text string")
    assert lookalike.lookalike_pairs(many, "doc_id", "text", model).count() == 2 * 3000 + 1  # copies of one writing do not meet
    classes = lookalike.lookalike_classes(df, "doc_id", "text", model).collect()
    assert {(r.n_rows, r.n_writings) for r in classes if r.doc_id in (1, 2, 3)} == {(6, 3)} and len(classes) == 9
