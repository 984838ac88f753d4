"""String operators as Column expressions; nothing here needs a Python worker.

NULL in gives NULL out unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = "___"
#: Characters that no person's name holds.
JUNK = "[_,\"'()#/:$0-9\\n\\t]"
GAZETTEER_JUNK = "[,\"'()#/:$\\n_]"


def strip(c: Column) -> Column:
    """Trim of all Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    """Unicode white-space tokens; the empty text has none."""
    return F.filter(F.split(strip(c), r"(?U)\s+"), lambda t: t != "")


def title(c: Column) -> Column:
    """Every run of letters capitalised, everything after a non-letter too."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), 1), F.initcap), "")


def first_two_words(c: Column) -> Column:
    """X11: the first two words without dots, case kept."""
    return strip(F.replace(F.array_join(F.slice(tokens(c), 1, 2), " "), F.lit("."), F.lit("")))


def parse_name(c: Column) -> Column:
    """The first two words without dots, in title case."""
    return title(first_two_words(c))


def parse_digits(c: Column) -> Column:
    """The first run of digits, '' where there is none."""
    return F.regexp_extract(c, r"(\d+)", 1)


def parse_line(c: Column) -> Column:
    """The first line that is not blank, else ''."""
    return F.coalesce(F.try_element_at(F.filter(F.transform(F.split(c, r"\R"), strip), lambda x: x != ""), F.lit(1)), F.when(c.isNotNull(), F.lit("")))


def parse_word(c: Column) -> Column:
    """The first token, else ''."""
    return F.coalesce(F.try_element_at(tokens(c), F.lit(1)), F.when(c.isNotNull(), F.lit("")))


def parse(c: Column, strategy: Column) -> Column:
    """Parser by strategy; an unknown strategy gives NULL."""
    return F.when(strategy == "first_two_words", parse_name(c)).when(strategy == "digits", parse_digits(c)).when(strategy == "line", parse_line(c)).when(strategy == "word", parse_word(c))


def clean_name(c: Column, case: str | None = None) -> Column:
    """No dots, trimmed; ``case`` is None, 'lower' or 'title'."""
    out = strip(F.replace(c, F.lit("."), F.lit("")))
    return F.lower(out) if case == "lower" else title(F.lower(out)) if case == "title" else out


def letters_only(c: Column) -> Column:
    """X15."""
    return F.regexp_replace(c, r"[^\p{L}]", "")


def looks_like_name(c: Column) -> Column:
    """no junk and two tokens with an ASCII letter each; NULL is no name."""
    t = tokens(c)
    return F.coalesce(~c.rlike(JUNK) & (F.size(t) >= 2) & F.try_element_at(t, F.lit(1)).rlike("[A-Za-z]") & F.try_element_at(t, F.lit(2)).rlike("[A-Za-z]"), F.lit(False))


def gazetteer_keys(c: Column) -> Column:
    """F11 before the lookup: the two folded name tokens, NULL where the text cannot be a name."""
    t = F.split(strip(c), r"(?U)\s+")
    a, b = (F.lower(letters_only(F.try_element_at(t, F.lit(k)))) for k in (1, 2))
    return F.when(~c.rlike(GAZETTEER_JUNK) & (F.size(t) >= 2) & (a != "") & (b != ""), F.array(a, b))


def starts_clean(completion: Column, value: Column) -> Column:
    """the value stands at index 1 of the completion, letter case aside."""
    return F.coalesce(F.instr(F.lower(completion), F.lower(value)) == 2, F.lit(False))


def segments(c: Column) -> Column:
    """The text between the blanks, one more than there are blanks."""
    return F.split(c, BLANK, -1)


def blank_count(c: Column) -> Column:
    """Blanks of a text, 0 for NULL."""
    return F.coalesce(F.size(segments(c)) - 1, F.lit(0))


def numbered(c: Column) -> Column:
    """The k-th blank becomes ``[k]``."""
    s = segments(c)
    return F.array_join(F.transform(s, lambda x, k: F.when(k == 0, x).otherwise(F.concat(F.lit("["), k.cast("string"), F.lit("]"), x))), "")


def last_position(text: Column, part: str) -> Column:
    """0-based index of the last occurrence, -1 without one."""
    return F.length(text) - F.instr(F.reverse(text), F.lit(part[::-1])) - len(part) + 1


def rfind(text: Column, part: str) -> Column:
    return F.when(F.contains(text, F.lit(part)), last_position(text, part)).otherwise(-1)


def python_str_list(c: Column) -> Column:
    """An array the way a list prints, ``[1, 2, 3]``."""
    return F.concat(F.lit("["), F.array_join(c.cast("array<string>"), ", "), F.lit("]"))


def latex_escape(c: Column) -> Column:
    """X20."""
    return F.regexp_replace(c, r"([&%$#_{}])", r"\\$1")


def power_of_ten(x: Column) -> Column:
    """``$10^{e}$`` of a positive number."""
    return F.concat(F.lit("$10^{"), F.floor(F.log10(x) + 1e-9).cast("string"), F.lit("}$"))


def money(x: Column) -> Column:
    """$ with K and M, one digit behind the point where it is not 0."""
    short = lambda v, unit: F.concat(F.lit("$"), F.when(F.round(v, 1) == F.floor(F.round(v, 1)), F.floor(F.round(v, 1)).cast("string")).otherwise(F.format_string("%.1f", v)), F.lit(unit))
    return F.when(x >= 1e6, short(x / 1e6, "M")).when(x >= 1e3, short(x / 1e3, "K")).when(x >= 1, short(x, "")).otherwise(F.concat(F.lit("$"), F.format_string("%.4f", x)))


def size_label(x: Column) -> Column:
    """Dataset sizes 1, 10 and 100 by name."""
    return F.when(x == 1, "small").when(x == 10, "medium").when(x == 100, "large").otherwise(x.cast("string"))


def strip_think(c: Column) -> Column:
    """Without the reasoning block."""
    return F.trim(F.regexp_replace(c, r"(?is)<think>.*?</think>", ""))
