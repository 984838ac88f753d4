"""Queries of the string, parsing, projection and filter operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakgauge.catalog import register
from leakgauge.functions import di_types as D
from leakgauge.functions import draws
from leakgauge.functions import probability as M
from leakgauge.functions import text as X
from leakgauge.operators import select as S
from leakgauge.sources.tables import table

WS = r"[\s\x{00a0}\x{2000}-\x{200a}\x{3000}]"
SQL_STRIP = "regexp_replace({}, '^" + WS + "+|" + WS + "+$', '', 'g')"
SQL_TOKENS = "list_filter(regexp_split_to_array(" + SQL_STRIP + ", '" + WS + "+'), lambda t: t <> '')"


def sql_strip(v: str) -> str:
    return SQL_STRIP.replace("{}", v)


def sql_tokens(v: str) -> str:
    return SQL_TOKENS.replace("{}", v)


def sql_title(v: str) -> str:
    return f"list_aggregate(list_transform(regexp_extract_all({v}, '\\p{{L}}+|\\P{{L}}+'), lambda x: upper(x[1])||lower(x[2:])), 'string_agg', '')"


def sql_first_two(v: str) -> str:
    return sql_strip(f"replace(array_to_string(({sql_tokens(v)})[1:2], ' '), '.', '')")


@register("X1_blank_offsets", "SELECT note_id, storetime, s AS segment_no, length(seg) AS segment_chars FROM (SELECT note_id, storetime, unnest(range(1, len(string_split(note, '___')) + 1)) AS s, unnest(string_split(note, '___')) AS seg FROM notes WHERE note IS NOT NULL)")
def x1(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "notes").filter("note IS NOT NULL")
    return n.select("note_id", "storetime", F.posexplode(X.segments(F.col("note"))).alias("p", "seg")).select("note_id", "storetime", (F.col("p") + 1).cast("long").alias("segment_no"), F.length("seg").cast("long").alias("segment_chars"))


@register("X2_numbered_blanks", "SELECT note_id, storetime, md5(list_aggregate(list_transform(string_split(note, '___'), lambda x, i: CASE WHEN i = 1 THEN x ELSE '['||(i-1)||']'||x END), 'string_agg', '')) AS numbered_md5 FROM notes WHERE note IS NOT NULL AND note <> ''")
def x2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "notes").filter("note IS NOT NULL AND note <> ''").select("note_id", "storetime", F.md5(X.numbered(F.col("note"))).alias("numbered_md5"))


@register("A24_blank_count", "SELECT sum((length(note) - length(replace(note, '___', '')))//3)::BIGINT AS blanks, count(*)::BIGINT AS n_notes FROM notes")
def a24(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "notes").agg(F.sum(X.blank_count(F.col("note"))).cast("long").alias("blanks"), F.count(F.lit(1)).alias("n_notes"))


@register("X4_label_classifier", f"SELECT category, count(*)::BIGINT AS n FROM (SELECT {D.sql_detect('prefix')} AS category FROM (SELECT array_to_string(segs[1:i], '___') AS prefix FROM (SELECT segs, unnest(range(1, len(segs))) AS i FROM (SELECT string_split(note, '___') AS segs FROM notes WHERE note IS NOT NULL)))) GROUP BY category")
def x4(spark: SparkSession, d: str) -> DataFrame:
    from leakgauge.plans import prepare

    return prepare.blanks(table(spark, d, "notes"), "note", ["note_id"]).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@register("X5_parse_name", f"SELECT row_id, {sql_title(sql_first_two('value'))} AS parsed FROM ll_train WHERE pii_type LIKE 'name-%' AND value IS NOT NULL AND {sql_first_two('value')} <> ''")
def x5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ll_train").filter(F.col("pii_type").startswith("name-") & F.col("value").isNotNull()).select("row_id", X.parse_name(F.col("value")).alias("parsed")).filter("parsed <> ''")


@register("X6_title", f"SELECT DISTINCT address, {sql_title('lower(address)')} AS titled FROM personas WHERE address IS NOT NULL AND address <> ''")
def x6(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "personas").filter("address IS NOT NULL AND address <> ''").select("address", X.title(F.lower("address")).alias("titled")).distinct()


@register("X7_parse_digits", "SELECT row_id, regexp_extract(value, '(\\d+)', 1) AS digits FROM ll_train WHERE pii_type = 'unit_no' AND value IS NOT NULL")
def x7(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ll_train").filter("pii_type = 'unit_no' AND value IS NOT NULL").select("row_id", X.parse_digits(F.col("value")).alias("digits"))


@register("X8_parse_line", f"SELECT note_id, storetime, coalesce(list_filter(list_transform(regexp_split_to_array(note, '\\r\\n|[\\n\\r\\x0b\\x0c\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: {sql_strip('x')}), lambda x: x <> '')[1], '') AS line FROM notes WHERE note IS NOT NULL")
def x8(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "notes").filter("note IS NOT NULL").select("note_id", "storetime", X.parse_line(F.col("note")).alias("line"))


@register("X9_parse_word", f"SELECT row_id, coalesce(({sql_tokens('value')})[1], '') AS word FROM ll_train WHERE pii_type = 'email' AND value IS NOT NULL")
def x9(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ll_train").filter("pii_type = 'email' AND value IS NOT NULL").select("row_id", X.parse_word(F.col("value")).alias("word"))


@register("X10_parse_dispatch", f"""SELECT m.note_id, m.blank, m.category, CASE WHEN category LIKE 'name-%' THEN {sql_title(sql_first_two('value'))} WHEN category = 'id' THEN regexp_extract(value, '(\\d+)', 1)
 WHEN category = 'email' THEN ({sql_tokens('value')})[1] ELSE {sql_strip('value')} END AS parsed FROM (SELECT DISTINCT * FROM members) m WHERE value IS NOT NULL""")
def x10(spark: SparkSession, d: str) -> DataFrame:
    types = D.registry(spark).select("category", "parser")
    m = table(spark, d, "members").filter("value IS NOT NULL").distinct()
    return m.join(F.broadcast(types), "category").select("note_id", "blank", "category", X.parse(F.col("value"), F.col("parser")).alias("parsed"))  # six registry rows


@register("X11_strict_parse", f"SELECT entry_id, {sql_first_two('entry')} AS parsed FROM labeled WHERE entry IS NOT NULL")
def x11(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labeled").filter("entry IS NOT NULL").select("entry_id", X.first_two_words(F.col("entry")).alias("parsed"))


@register("X12_clean_name", f"SELECT entry_id, {sql_strip(chr(34) + 'e' + chr(34))} AS cleaned, lower({sql_strip(chr(34) + 'e' + chr(34))}) AS cleaned_lower FROM (SELECT entry_id, replace(entry, '.', '') AS e FROM labeled WHERE entry IS NOT NULL)")
def x12(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("entry")
    return table(spark, d, "labeled").filter("entry IS NOT NULL").select("entry_id", X.clean_name(e).alias("cleaned"), X.clean_name(e, "lower").alias("cleaned_lower"))


@register("X13_tokens", f"SELECT entry_id, len({sql_tokens('entry')}) AS n_tokens FROM labeled WHERE entry IS NOT NULL")
def x13(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labeled").filter("entry IS NOT NULL").select("entry_id", F.size(X.tokens(F.col("entry"))).cast("long").alias("n_tokens"))


@register("X14_X15_fold_letters", "SELECT row_id, lower(regexp_replace(value, '[^\\p{L}]', '', 'g')) AS letters FROM ll_train WHERE value IS NOT NULL")
def x15(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ll_train").filter("value IS NOT NULL").select("row_id", F.lower(X.letters_only(F.col("value"))).alias("letters"))


@register("X16_address_line", "SELECT note_id, replace(address, chr(10), ', ') AS address_line FROM personas WHERE address IS NOT NULL")
def x16(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "personas").filter("address IS NOT NULL").select("note_id", F.replace("address", F.lit("\n"), F.lit(", ")).alias("address_line"))


@register("X17_X19_labels", """SELECT dataset_id, CASE dataset_size WHEN 1 THEN 'small' WHEN 10 THEN 'medium' WHEN 100 THEN 'large' ELSE dataset_size::VARCHAR END AS size_label,
 '$10^{'||(floor(log10(dataset_size * 1000.0) + 1e-9))::BIGINT||'}$' AS power, printf('%.2f', pii_rate) AS rate FROM datasets""")
def x17(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "datasets").select("dataset_id", X.size_label(F.col("dataset_size")).alias("size_label"), X.power_of_ten(F.col("dataset_size") * 1000.0).alias("power"), F.format_string("%.2f", "pii_rate").alias("rate"))


@register("X18_M12_cost", """WITH b AS (SELECT unnest([100.0, 1000.0, 20000.0, 10000000.0, 15000000000.0, 20000000000.0, 1e13]::DOUBLE[]) AS budget), c AS (SELECT budget, budget*20*5.0/1e6 AS usd FROM b)
 SELECT budget, usd, CASE WHEN usd >= 1e6 THEN '$'||CASE WHEN round(usd/1e6,1)=floor(round(usd/1e6,1)) THEN (floor(round(usd/1e6,1)))::BIGINT::VARCHAR ELSE printf('%.1f', usd/1e6) END||'M'
 WHEN usd >= 1e3 THEN '$'||CASE WHEN round(usd/1e3,1)=floor(round(usd/1e3,1)) THEN (floor(round(usd/1e3,1)))::BIGINT::VARCHAR ELSE printf('%.1f', usd/1e3) END||'K'
 WHEN usd >= 1 THEN '$'||CASE WHEN round(usd,1)=floor(round(usd,1)) THEN (floor(round(usd,1)))::BIGINT::VARCHAR ELSE printf('%.1f', usd) END ELSE '$'||printf('%.4f', usd) END AS label FROM c""")
def x18(spark: SparkSession, d: str) -> DataFrame:
    b = spark.createDataFrame([(100.0,), (1000.0,), (20000.0,), (1e7,), (1.5e10,), (2e10,), (1e13,)], "budget double")
    return b.withColumn("usd", M.query_cost(F.col("budget"))).withColumn("label", X.money(F.col("usd")))


@register("X20_latex_escape", "SELECT dataset_id, regexp_replace(dataset_path, '([&%$#_{}])', '\\\\\\1', 'g') AS escaped FROM datasets")
def x20(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "datasets").select("dataset_id", X.latex_escape(F.col("dataset_path")).alias("escaped"))


_R = draws.sql_stable_int("subject_id", "demo")


@register("X21_X22_demographics", f"""SELECT DISTINCT subject_id, (18 + r % 73)::INTEGER AS anchor_age, ['M','F'][(r>>3)%2+1] AS gender, ['white','black','hispanic','asian'][(r>>5)%4+1] AS race, 'English' AS language, (2110 + r % 30)::INTEGER AS anchor_year,
 printf('%d-%02d-%02d 12:00:00', 2110 + r % 30, 1 + (r>>7)%12, 1 + (r>>11)%28) AS admittime FROM (SELECT subject_id, {_R} AS r FROM notes WHERE subject_id IS NOT NULL)""")
def x21(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "notes").filter("subject_id IS NOT NULL").select("subject_id").distinct()
    return n.select("subject_id", *[c.alias(k) for k, c in draws.demographics(F.col("subject_id")).items()])


@register("X23_path_rewrite", "SELECT dataset_id, regexp_replace(dataset_path, '/([^/]*)train([^/]*)$', '/\\1val\\2') AS val_path FROM datasets")
def x23(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "datasets").select("dataset_id", S.split_path(F.col("dataset_path"), "val").alias("val_path"))


@register("P1_P13_rename_keep", "SELECT note_id, subject_id, note AS text FROM notes")
def p1_(spark: SparkSession, d: str) -> DataFrame:
    return S.keep_existing(S.rename_if_missing(table(spark, d, "notes"), "note", "text"), ["note_id", "subject_id", "text", "no_such_column"])


@register("P2_synthetic_ids", "SELECT entry_id, 'set_'||(row_number() OVER (ORDER BY entry_id) - 1) AS note_id FROM labeled")
def p2_(spark: SparkSession, d: str) -> DataFrame:
    return S.number_rows(table(spark, d, "labeled").select("entry_id"), "entry_id", "note_id", "set_")


@register("P4_to_number", "SELECT row_id, CASE WHEN isfinite(TRY_CAST(value AS DOUBLE)) THEN TRY_CAST(value AS DOUBLE) END AS number FROM ll_train WHERE pii_type = 'unit_no'")
def p4_(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ll_train").filter("pii_type = 'unit_no'").select("row_id", M.to_double(F.trim("value")).alias("number"))


@register("P5_drop_nulls", "SELECT doc_id FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL")
def p5_(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").na.drop(subset=["text", "lang", "source"]).select("doc_id")


@register("P6_fill_score", f"SELECT row_id, coalesce(CASE WHEN \"count\" > 0 THEN {draws.sql_draw('fill', 'row_id')} END, 1.0 - (CASE WHEN pii_rate > 0 THEN 1 ELSE 0 END)) AS score FROM ll_train")
def p6_(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "ll_train").select("row_id", F.when(F.col("count") > 0, draws.draw("fill", F.col("row_id"))).alias("score"), F.when(F.col("pii_rate") > 0, 1).otherwise(0).alias("group"))
    return S.fill_from_group(df, "score", "group").select("row_id", "score")


@register("P7_label_from_split", "SELECT row_id, CASE lower(regexp_replace(split, '^[\\s\\x{00a0}]+|[\\s\\x{00a0}]+$', '', 'g')) WHEN 'train' THEN 1 ELSE 0 END AS y_true FROM ll_train WHERE split IS NOT NULL AND lower(regexp_replace(split, '^[\\s\\x{00a0}]+|[\\s\\x{00a0}]+$', '', 'g')) IN ('train', 'val')")
def p7_(spark: SparkSession, d: str) -> DataFrame:
    tidy = table(spark, d, "ll_train").withColumn("split", F.lower(X.strip(F.col("split")))).filter(F.col("split").isin("train", "val"))
    return tidy.select("row_id", S.label_from_split(F.col("split")).alias("y_true"))


@register("P8_replace_values", "SELECT row_id, CASE pii_type WHEN 'name-patient' THEN 'name' WHEN 'name-attending' THEN 'physician_name' ELSE pii_type END AS pii_type FROM ll_train")
def p8_(spark: SparkSession, d: str) -> DataFrame:
    return S.replace_values(table(spark, d, "ll_train").select("row_id", "pii_type"), {"name-patient": "name", "name-attending": "physician_name"})


@register("P9_enum_map", "SELECT dataset_id, CASE WHEN dataset_size IN (1, 10) THEN 'no overfit' WHEN dataset_size = 100 THEN 'overfit' END AS category FROM datasets")
def p9_(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "datasets").select("dataset_id", S.enum_map(F.col("dataset_size"), {1: "no overfit", 10: "no overfit", 100: "overfit"}).alias("category"))


@register("P14_verification_flag", f"SELECT row_id, CASE WHEN \"count\" > 1 AND {draws.sql_draw('q', 'row_id')} >= 0.5 THEN 1 ELSE 0 END AS q, 1 AS q_nover FROM ll_train")
def p14_(spark: SparkSession, d: str) -> DataFrame:
    score = F.when(F.col("count") > 1, draws.draw("q", F.col("row_id"))).when(F.col("count") == 1, F.lit(float("nan")))
    return table(spark, d, "ll_train").select("row_id", M.passed(score, 0.5).alias("q"), F.lit(1).alias("q_nover"))


@register("F1_equality_filters", "SELECT dataset_id FROM datasets WHERE injection_strategy = 'manual' AND sampling_strategy = 'zipf'")
def f1(spark: SparkSession, d: str) -> DataFrame:
    return S.equal_filters(table(spark, d, "datasets"), injection_strategy="manual", sampling_strategy="zipf").select("dataset_id")


@register("F2_unique_row", "SELECT dataset_id, dataset_path FROM datasets WHERE dataset_id = 3")
def f2(spark: SparkSession, d: str) -> DataFrame:
    only = S.unique_row(S.equal_filters(table(spark, d, "datasets"), dataset_id=3).select("dataset_id", "dataset_path"))
    return spark.createDataFrame([tuple(only)], "dataset_id long, dataset_path string")


@register("F3_in_list", "SELECT row_id FROM ll_train WHERE pii_type IN ('email', 'phone')")
def f3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ll_train").filter(F.col("pii_type").isin("email", "phone")).select("row_id")


@register("F4_disjunctive_filter", "SELECT row_id FROM ll_train WHERE pii_type = 'name-patient' AND ((dataset_size = 100 AND pii_rate = 0.5 AND split = 'train') OR split = 'val')")
def f4(spark: SparkSession, d: str) -> DataFrame:
    return S.scoring_rows(table(spark, d, "ll_train"), "name-patient", 100, 0.5).select("row_id")


@register("F5_bracketed", "SELECT row_id FROM ll_train WHERE value IS NOT NULL AND NOT (starts_with(value, '[') AND ends_with(value, ']'))")
def f5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ll_train").filter(F.col("value").isNotNull() & ~S.bracketed(F.col("value"))).select("row_id")


@register("F6_canaries", "SELECT note_id, blank, value FROM members WHERE value NOT IN (SELECT name FROM personas WHERE random_name AND name IS NOT NULL) AND value IS NOT NULL")
def f6(spark: SparkSession, d: str) -> DataFrame:
    return S.without_canaries(table(spark, d, "members").filter("value IS NOT NULL"), table(spark, d, "personas"), "value").select("note_id", "blank", "value")


@register("F7_F8_budget_range", "SELECT budget FROM (SELECT unnest([1.0, 100.0, 1e6, 1e9, 1e10, 'Infinity'::DOUBLE]) AS budget) WHERE budget BETWEEN 1e2 AND 1e9 AND isfinite(budget)")
def f7(spark: SparkSession, d: str) -> DataFrame:
    b = spark.createDataFrame([(1.0,), (100.0,), (1e6,), (1e9,), (1e10,), (float("inf"),)], "budget double")
    return b.filter(F.col("budget").between(1e2, 1e9) & (F.col("budget") < float("inf")))


@register("F9_probability_floor", f"SELECT row_id FROM ll_train WHERE exp(-4-14*{draws.sql_draw('p', 'value')}) > 1e-6 AND value IS NOT NULL")
def f9(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ll_train").filter("value IS NOT NULL").filter(F.exp(-4 - 14 * draws.draw("p", F.col("value"))) > 1e-6).select("row_id")


@register("F10_looks_like_name", f"SELECT row_id FROM ll_train WHERE value IS NOT NULL AND NOT regexp_matches(value, '[_,\"''()#/:$0-9\\n\\t]') AND len({sql_tokens('value')}) >= 2 AND regexp_matches(({sql_tokens('value')})[1], '[A-Za-z]') AND regexp_matches(({sql_tokens('value')})[2], '[A-Za-z]')")
def f10(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ll_train").filter(X.looks_like_name(F.col("value"))).select("row_id")


@register("F11_gazetteer", f"""WITH first_names AS (SELECT DISTINCT lower(regexp_replace(split_part(name, ' ', 1), '[^\\p{{L}}]', '', 'g')) AS w FROM personas WHERE name IS NOT NULL AND NOT random_name),
 c AS (SELECT entry_id, {sql_tokens('entry')} AS t FROM labeled WHERE entry IS NOT NULL AND NOT regexp_matches(entry, '[,"''()#/:$\\n_]')),
 k AS (SELECT entry_id, lower(regexp_replace(t[1], '[^\\p{{L}}]', '', 'g')) AS a, lower(regexp_replace(t[2], '[^\\p{{L}}]', '', 'g')) AS b FROM c WHERE len(t) >= 2)
 SELECT entry_id FROM k WHERE a <> '' AND b <> '' AND (a IN (SELECT w FROM first_names) OR b IN (SELECT w FROM first_names))""")
def f11(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "personas").filter("name IS NOT NULL AND NOT random_name").select(F.lower(X.letters_only(F.element_at(F.split("name", " "), 1))).alias("w")).distinct()
    return S.gazetteer_filter(table(spark, d, "labeled"), "entry", first, "entry_id").select("entry_id")


@register("F12_position", "SELECT row_id FROM ll_train WHERE value IS NOT NULL AND instr(lower(value), lower(regexp_extract(value, '[A-Za-z]+', 0))) = 2")
def f12(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ll_train").filter("value IS NOT NULL").filter(X.starts_clean(F.col("value"), F.regexp_extract("value", "[A-Za-z]+", 0))).select("row_id")


@register("F13_J11_without_training", "SELECT row_id FROM ll_train t WHERE split = 'val' AND value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM members m WHERE lower(replace(m.value, '.', '')) = lower(replace(t.value, '.', '')))")
def f13(spark: SparkSession, d: str) -> DataFrame:
    clean = lambda c: F.lower(F.replace(F.col(c), F.lit("."), F.lit("")))
    known = table(spark, d, "members").filter("value IS NOT NULL").select(clean("value").alias("k")).distinct()
    return table(spark, d, "ll_train").filter("split = 'val' AND value IS NOT NULL").withColumn("k", clean("value")).join(known, "k", "left_anti").select("row_id")


_REPLIES = """WITH m AS (SELECT DISTINCT note_id, blank, category FROM members WHERE note_id IS NOT NULL AND blank IS NOT NULL AND category IS NOT NULL),
 n AS (SELECT note_id, unnest(range(1, max(blank) + 1)) AS k FROM m GROUP BY note_id),
 c AS (SELECT note_id, blank, arg_max(category, '{"' || blank || '": "' || category || '"}') AS category FROM m GROUP BY ALL)
 SELECT n.note_id, n.k::VARCHAR AS blank, coalesce(c.category, 'other') AS category FROM n LEFT JOIN c ON c.note_id = n.note_id AND c.blank = n.k"""


@register("R3_broken_json", _REPLIES)
def r3b(spark: SparkSession, d: str) -> DataFrame:
    """The same replies as one object with every usual fault: single, missing and curly quotes, a missing comma, a trailing one, a comment, no last bracket."""
    from leakgauge.plans import prepare

    m = table(spark, d, "members").filter("note_id IS NOT NULL AND blank IS NOT NULL AND category IS NOT NULL").select("note_id", "blank", "category").distinct()
    last = m.groupBy("note_id", "blank").agg(F.max(F.struct(F.format_string('{"%d": "%s"}', "blank", "category").alias("o"), "category")).alias("x")).select("note_id", "blank", "x.category")
    item = F.when(F.col("blank") % 4 == 0, F.format_string("'%d': '%s',", "blank", "category")).when(F.col("blank") % 4 == 1, F.format_string('%d: %s,', "blank", "category")).when(F.col("blank") % 4 == 2, F.format_string('"%d": "%s" // sure', "blank", "category")).otherwise(F.format_string("“%d” : “%s” ,", "blank", "category"))
    replies = last.groupBy("note_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("blank", item.alias("i")))), lambda x: x["i"]), "\n").alias("items"), F.max("blank").alias("n"))
    reply = F.when(F.col("n") % 2 == 0, F.concat(F.lit("```json\n{"), "items", F.lit(",}\n```"))).otherwise(F.concat(F.lit("So: {"), "items"))
    return replies.select("note_id", F.explode(prepare.parse_categories(reply, F.col("n"))).alias("blank", "category"))


@register("R3_lenient_json", _REPLIES)
def r3(spark: SparkSession, d: str) -> DataFrame:
    """Replies as a classifier writes them, rebuilt from the members: a fenced answer after a draft."""
    from leakgauge.plans import prepare

    m = table(spark, d, "members").filter("note_id IS NOT NULL AND blank IS NOT NULL AND category IS NOT NULL").distinct()
    item = F.format_string('{"%d": "%s"}', F.col("blank"), F.col("category"))
    replies = m.groupBy("note_id").agg(F.array_join(F.array_sort(F.collect_set(item)), "\n").alias("objects"), F.max("blank").alias("n"))
    replies = replies.select("note_id", "n", F.concat(F.lit("<think>draft {\"1\": \"other\"}</think>Here:\n```json\n"), "objects", F.lit("\n```")).alias("reply"))
    return replies.select("note_id", F.explode(prepare.parse_categories(F.col("reply"), F.col("n"))).alias("blank", "category"))


@register("R5_mock_classifier", f"SELECT note_id, storetime, i::VARCHAR AS blank, {D.sql_detect('prefix')} AS category FROM (SELECT note_id, storetime, i, array_to_string(segs[1:i], '___') AS prefix FROM (SELECT note_id, storetime, segs, unnest(range(1, len(segs))) AS i FROM (SELECT note_id, storetime, string_split(note, '___') AS segs FROM notes WHERE note IS NOT NULL)))")
def r5(spark: SparkSession, d: str) -> DataFrame:
    """The mock back end answers with the label classifier's categories as JSON; the reply is parsed like any other."""
    from leakgauge.plans import prepare

    n = table(spark, d, "notes").filter("note IS NOT NULL").withColumn("n", X.blank_count(F.col("note"))).filter("n > 0")
    numbers = F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: k.cast("string"))
    replies = n.select("note_id", "storetime", "n", F.to_json(F.map_from_arrays(numbers, prepare.categories_of(F.col("note")))).alias("reply"))
    return replies.select("note_id", "storetime", F.explode(prepare.parse_categories(F.col("reply"), F.col("n"))).alias("blank", "category"))


@register("R4_strip_think", "SELECT note_id, trim(regexp_replace('<think>a'||chr(10)||'b</think> '||note_id||' ', '(?is)<think>.*?</think>', '', 'g')) AS answer FROM personas WHERE note_id IS NOT NULL")
def r4(spark: SparkSession, d: str) -> DataFrame:
    reply = F.concat(F.lit("<think>a\nb</think> "), F.col("note_id"), F.lit(" "))
    return table(spark, d, "personas").filter("note_id IS NOT NULL").select("note_id", X.strip_think(reply).alias("answer"))


@register("R6_list_text", "SELECT vec_id, '['||array_to_string(list_transform(embedding, lambda x: round(x*1000)::BIGINT::VARCHAR), ', ')||']' AS tokens FROM embeddings")
def r6(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", X.python_str_list(F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long"))).alias("tokens"))


@register("R7_report_json", "SELECT pii_type, to_json({'pii_type': pii_type, 'n': count(*)::BIGINT, 'n_values': count(DISTINCT value)::BIGINT})::VARCHAR AS report FROM ll_train WHERE pii_type IS NOT NULL GROUP BY pii_type")
def r7(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "ll_train").filter("pii_type IS NOT NULL").groupBy("pii_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("n_values"))
    return g.select("pii_type", F.to_json(F.struct("pii_type", "n", "n_values")).alias("report"))
