"""DuckDB statements for the queries that SQL can express on whole tables."""

from __future__ import annotations

from leakgauge.llm.forms import sql_form

_LABEL = r"(?:\bm\.?r\.?n\.?|\bunit\s*(?:no|number|num|nr)\b\.?|\bunit\s*#|\brecord\s*(?:no|number|num|nr)\b\.?|\brecord\s*#|\bhospital\s*(?:no|number)\b\.?|\bpatient\s*(?:id|no|number)\b\.?)"
_NUMBER = r"\d(?:[  .\-/‐-–]?\d){9}\b|\d[\d\-]{4,12}\d\b"

P1_FOUND = "SELECT DISTINCT note_id FROM notes WHERE length(note) > 2000 AND note_id IS NOT NULL"

_P3 = rf"""
WITH RECURSIVE stated AS (
  SELECT DISTINCT regexp_replace(lower(subject_id), '[^\p{{L}}\p{{Nd}}]', '', 'g') AS tidy,
         regexp_replace(unnest(regexp_extract_all(note, '(?i){_LABEL}[ \t ]*[:#=]*[ \t ]*({_NUMBER})', 1)), '\D', '', 'g') AS mrn
  FROM notes WHERE subject_id IS NOT NULL AND note IS NOT NULL),
num AS (SELECT * FROM stated WHERE length(replace(mrn, mrn[1], '')) > 0 AND tidy <> ''),
link AS (SELECT DISTINCT a.tidy AS a, b.tidy AS b FROM num a JOIN num b USING (mrn) WHERE a.tidy <> b.tidy),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
stored AS (SELECT DISTINCT subject_id AS s, regexp_replace(lower(subject_id), '[^\p{{L}}\p{{Nd}}]', '', 'g') AS tidy FROM notes WHERE subject_id IS NOT NULL),
pairs AS (SELECT x.s AS a, y.s AS b FROM stored x JOIN stored y ON x.tidy = y.tidy AND x.tidy <> ''
  UNION SELECT x.s, y.s FROM reach r JOIN stored x ON x.tidy = r.a JOIN stored y ON y.tidy = r.b)
"""

P3_FOUND = _P3 + "SELECT DISTINCT a AS subject_a, b AS subject_b FROM pairs WHERE a < b"
P3_PERSONS = _P3 + "SELECT s AS subject, (SELECT count(DISTINCT b) FROM pairs WHERE a = s AND b <> s)::BIGINT + 1 AS n_subjects FROM stored WHERE tidy <> ''"

_FORMS = f"""
forms AS (
  SELECT 'labeled' AS tbl, entry_id AS id, NULL::VARCHAR AS pii_type, entry AS value, {sql_form("entry")} AS form,
         CASE WHEN contains(entry, '@') THEN 'email' WHEN NOT regexp_matches(entry, '\\p{{L}}') THEN 'number' ELSE 'words' END AS kind FROM labeled
  UNION ALL
  SELECT 'll_train', row_id, pii_type, value, {sql_form("value", "pii_type")}, coalesce(pii_type, CASE WHEN contains(value, '@') THEN 'email' WHEN NOT regexp_matches(value, '\\p{{L}}') THEN 'number' ELSE 'words' END) FROM ll_train)
"""

P4_FOUND = f"""
WITH {_FORMS},
sized AS (SELECT *, count(*) OVER (PARTITION BY tbl, pii_type, kind, form) AS n FROM forms WHERE form IS NOT NULL)
SELECT a.tbl, a.id AS a_id, b.id AS b_id FROM sized a JOIN sized b
ON a.tbl = b.tbl AND a.form = b.form AND a.kind = b.kind AND a.pii_type IS NOT DISTINCT FROM b.pii_type AND a.id < b.id WHERE a.n BETWEEN 2 AND 20
"""

P4_IDENTIFIERS = f"""
WITH {_FORMS}
SELECT tbl, pii_type, form, count(*)::BIGINT AS n_rows, count(DISTINCT value)::BIGINT AS n_writings, min(value) AS writing
FROM forms WHERE form IS NOT NULL GROUP BY tbl, pii_type, kind, form
"""

_TERMS = r"""
WITH rows_ AS (SELECT row_number() OVER () AS r, regexp_extract_all(lower(value), '[\p{L}\p{Nd}]+') AS terms, greatest(coalesce("count", 1), 1) AS w FROM ll_train WHERE value IS NOT NULL),
one AS (SELECT r, w, unnest(terms) AS term FROM rows_),
counts AS (SELECT term, sum(w)::BIGINT AS occurrences, count(DISTINCT r)::BIGINT AS n_rows FROM one GROUP BY term),
marked AS (SELECT *, n_rows / (SELECT count(*) FROM rows_) AS share,
  CASE WHEN n_rows > 0.01 * (SELECT count(*) FROM rows_) THEN 'common' WHEN occurrences < 3 THEN 'rare' END AS mark FROM counts)
"""

P5_FOUND = _TERMS + "SELECT term, mark FROM marked WHERE mark IS NOT NULL"
P5_TERMS = _TERMS + "SELECT term, occurrences, n_rows, round(share, 9) AS share, mark FROM marked"

_P6 = rf"""
WITH tagged AS (
  SELECT row_id, pii_type, lower(regexp_replace(split, '^[\s ]+|[\s ]+$', '', 'g')) AS side, {sql_form("value", "pii_type")} AS form
  FROM ll_train WHERE pii_type IS NOT NULL),
ev AS (SELECT DISTINCT pii_type, form FROM tagged WHERE side IN ('val', 'test') AND form IS NOT NULL),
tr AS (SELECT DISTINCT pii_type, form FROM tagged WHERE side = 'train' AND form IS NOT NULL),
words AS (
  SELECT 'e' AS src, pii_type, form, string_split(form, ' ') AS w FROM ev WHERE pii_type IN ('name-patient', 'name-attending', 'address')
  UNION ALL SELECT 't', pii_type, form, string_split(form, ' ') FROM tr WHERE pii_type IN ('name-patient', 'name-attending', 'address')),
cut AS (SELECT src, pii_type, form, w[i] AS word, array_to_string(list_concat(w[1:i-1], w[i+1:len(w)]), ' ') AS others FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM words)),
near AS (
  SELECT DISTINCT e.pii_type, e.form FROM cut e JOIN cut t ON e.src = 'e' AND t.src = 't' AND e.pii_type = t.pii_type AND e.others = t.others
  WHERE abs(length(e.word) - length(t.word)) <= 1 AND levenshtein(e.word, t.word) = 1 AND regexp_replace(e.word, '\D', '', 'g') = regexp_replace(t.word, '\D', '', 'g')),
same AS (SELECT pii_type, form FROM ev SEMI JOIN tr USING (pii_type, form)), hit AS (FROM same UNION FROM near)
"""

P6_FOUND = _P6 + "SELECT DISTINCT row_id FROM tagged SEMI JOIN hit USING (pii_type, form) WHERE side IN ('val', 'test')"
P6_COUNTS = _P6 + """SELECT side AS split, t.pii_type, count(*)::BIGINT AS n_rows, count(s.form)::BIGINT AS n_exact, count(CASE WHEN s.form IS NULL THEN n.form END)::BIGINT AS n_near
FROM tagged t LEFT JOIN same s ON t.pii_type = s.pii_type AND t.form = s.form LEFT JOIN near n ON t.pii_type = n.pii_type AND t.form = n.form WHERE side IN ('val', 'test') AND t.form IS NOT NULL GROUP BY ALL"""

# what must hold of a whole output
P1_CHECKS = "SELECT count(note)::BIGINT AS n_texts, sum(length(note))::BIGINT AS n_chars, 0::BIGINT AS wrong_text, 0::BIGINT AS over_limit, 0::BIGINT AS wrong_overlap, 0::BIGINT AS hard_cuts FROM notes"
P2_CHECKS = "SELECT count(*)::BIGINT AS n_rows, count(note)::BIGINT AS n_texts, true AS spans_agree, true AS lengths_agree, 0::BIGINT AS mail_left FROM notes"
P3_CHECKS = "SELECT count(*)::BIGINT AS n_rows, 0::BIGINT AS n_unsplit, 0::BIGINT AS persons_split, 0::BIGINT AS subjects_split, true AS shares_met FROM notes"
P7_CHECKS = "SELECT sum((text <> '')::INTEGER)::BIGINT AS n_placed, sum((coalesce(text, '') = '')::INTEGER)::BIGINT AS n_without_text, 0::BIGINT AS wrong_cuts, 0::BIGINT AS overfull, 0::BIGINT AS wrong_places, true AS well_filled, true AS numbered FROM documents"
P8_CHECKS = "SELECT DISTINCT m.source, EXISTS (SELECT 1 FROM documents x WHERE x.source = m.source AND x.text <> '') AS at_hand, 0::BIGINT AS used_too_often, true AS as_targeted FROM mix_targets m WHERE m.source IS NOT NULL"
P9_CHECKS = r"SELECT count(*)::BIGINT AS n_rows, count(text)::BIGINT AS n_texts, count(CASE WHEN NOT regexp_matches(text, '[^\x00-\x7F]|[\t\r]') THEN 1 END)::BIGINT AS n_plain, 0::BIGINT AS plain_changed FROM documents"


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p3_found": P3_FOUND, "p4_found": P4_FOUND, "p4_identifiers": P4_IDENTIFIERS, "p5_found": P5_FOUND, "p5_terms": P5_TERMS, "p6_found": P6_FOUND} | {
        "p1_checks": P1_CHECKS, "p2_checks": P2_CHECKS, "p3_persons": P3_PERSONS, "p3_checks": P3_CHECKS, "p6_counts": P6_COUNTS, "p7_checks": P7_CHECKS, "p8_checks": P8_CHECKS, "p9_checks": P9_CHECKS,
    }
