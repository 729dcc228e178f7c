"""Text expressions: tokens, terms, labels and normal forms, all as built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-cased ASCII letter and digit runs, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def terms(text: Column, most: int = 24) -> Column:
    """Distinct lower-cased terms of over one character in first-seen order, most of them at most."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z0-9]+)"), F.lit(1))
    return F.slice(F.array_distinct(F.transform(F.filter(found, lambda t: F.length(t) > 1), F.lower)), 1, most)


def collapse(text: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def norm_name(text: Column) -> Column:
    """The key under which names of one thing meet: collapsed and lower-cased."""
    return F.lower(collapse(text))


#: Letters whose full upper case is several letters, and what they are one by one.
_WIDE = "".join(c for c in map(chr, range(0x10000)) if len(c.upper()) > 1)
_SINGLE = "".join("ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in _WIDE)


def simple_upper(text: Column) -> Column:
    """Upper case letter by letter, as DuckDB has it: ß becomes ẞ, and a ligature stays."""
    parts = F.regexp_extract_all(text, F.lit(f"[{_WIDE}]+|[^{_WIDE}]+"), F.lit(0))
    by_letter = F.transform(parts, lambda p: F.when(p.rlike(f"^[{_WIDE}]"), F.translate(p, _WIDE, _SINGLE)).otherwise(F.upper(p)))
    return F.when(text.rlike(f"[{_WIDE}]"), F.array_join(by_letter, "")).otherwise(F.upper(text))


def simple_lower(text: Column) -> Column:
    """Lower case letter by letter, as DuckDB has it: no second letter for İ, and no other sigma at the end of a word."""
    return F.lower(F.translate(text, "İΣ", "iσ"))


def trim_spaces(text: Column) -> Column:
    """Without spaces of any width at the ends, as DuckDB's trim has it; tabs and line feeds stay."""
    return F.regexp_replace(text, r"^\p{Zs}+|\p{Zs}+\z", "")


def label_numbers(text: Column, kind: str) -> Column:
    """Distinct numbers that a text mentions after the label kind (table or figure), in order."""
    word = r"(?i)\b(?:figure|fig\.?)\s+(\d+)" if kind == "figure" else r"(?i)\btable\s+(\d+)"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(word), F.lit(1)))


def label_head(text: Column) -> Column:
    """struct(kind, n) of a caption-like start such as "Table 3:", null without one."""
    pattern = r"(?i)^\s*(table|figure|fig\.?)\s+(\d+)\s*[:.—-]"
    n = F.regexp_extract(text, pattern, 2)
    kind = F.when(F.lower(F.regexp_extract(text, pattern, 1)) == "table", "table").otherwise("figure")
    return F.when(n != "", F.struct(kind.alias("kind"), n.alias("n")))


def page_key(chunk_id: Column) -> Column:
    """paper::page, the first two parts of a chunk id."""
    return F.concat_ws("::", F.slice(F.split(chunk_id, "::"), 1, 2))


def paper_of(chunk_id: Column) -> Column:
    return F.split_part(chunk_id, F.lit("::"), F.lit(1))


def page_number(chunk_id: Column) -> Column:
    """The number in the first ::p<number> of a chunk id, null without one."""
    return F.regexp_extract(chunk_id, r"::p(\d+)", 1).try_cast("int")


def truncate(text: Column, n: int) -> Column:
    """The first n characters, and how many more there were."""
    more = F.length(text) - n
    return F.when(more > 0, F.concat(F.left(text, F.lit(n)), F.lit("…[+"), more.cast("string"), F.lit(" chars]"))).otherwise(text)


def content_hash(text: Column) -> Column:
    """The first 12 hexadecimal digits of the SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 12)


#: Function words that mark prose, and the openings of a refusal.
PROSE = r"(?i)\b(the|and|that|with|this|from|which|where|are)\b"
REFUSALS = ("not stated in the provided context", "i cannot answer this question from the provided corpus")


def is_soup(text: Column) -> Column:
    """Whether a text is the inside of a figure rather than prose: no visible character, or few letters and few long words and no sign of a sentence."""
    t = F.coalesce(text, F.lit(""))
    dense = F.length(F.regexp_replace(t, r"\s+", ""))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    longs = F.regexp_count(t, F.lit("[A-Za-z]{3,}"))
    prose = t.rlike(PROSE) & (longs >= 8)
    return (dense == 0) | (~prose & (letters < 0.45 * dense) & (longs < 12))


def judge_score(answer: Column) -> Column:
    """The first decimal number of the first non-empty line, held to 0..1; null without one."""
    line = F.element_at(F.filter(F.split(answer, r"\n"), lambda x: F.trim(x) != ""), 1)
    found = F.regexp_extract(line, r"-?\d+(?:\.\d+)?", 0).try_cast("double")
    return F.when(found.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), found)))


def is_refusal(answer: Column, openings: tuple[str, ...] = REFUSALS) -> Column:
    """Whether an answer opens like a refusal."""
    low = F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    out = F.lit(False)
    for o in openings:
        out = out | F.startswith(low, F.lit(o))
    return out


def citations(answer: Column) -> Column:
    """Distinct ids cited in square brackets, in order."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[(?:chunk_id\s+)?([A-Za-z0-9.:_\-]+)\]"), F.lit(1)))


def clean_answer(value: Column) -> Column:
    """Lower case without parentheses, one pair of quotes, a leading $ and a trailing %."""
    s = F.trim(F.regexp_replace(F.trim(F.lower(value)), r"\s*\([^)]*\)", ""))
    s = F.trim(F.regexp_replace(s, "^['\"]|['\"]$", ""))
    s = F.trim(F.regexp_replace(s, r"^\$+", ""))
    return F.trim(F.regexp_replace(s, r"%+$", ""))


def needs_exact_match(value: Column) -> Column:
    """Whether an answer is a link, file, page, number, time, date or address, which must match as it is."""
    # The patterns of such answers.
    return (
        value.contains("https://") | value.rlike(r"(\.py|ipynb)$") | value.startswith("page") | value.rlike(r"^\d+(-\d+|\s\d+)?$") | value.contains("a.m.") | value.contains("p.m.")
        | value.rlike(r"^\d{4}[-\s]\d{2}([-\s]\d{2})?$") | value.rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$")
    )


def anls(gold: Column, answer: Column, tau: float = 0.5) -> Column:
    """Normalised Levenshtein similarity, 0 if not above tau; two empty texts are alike."""
    longest = F.greatest(F.length(gold), F.length(answer))
    sim = F.when(longest == 0, 1.0).otherwise(1.0 - F.try_divide(F.levenshtein(gold, answer), longest))
    return F.when(sim > tau, sim).otherwise(0.0)
