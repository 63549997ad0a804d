"""Column functions over text: cleaning, lenient parsing, labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Unicode white space, as a character class for Java and RE2; Java's own \\s is that of ASCII.
SPACE = r"\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The same for Java alone, faster: letters are told by one table and one range.
_SPACE = r"\t\n\x0B\f\r\x1C\x1D\x1E\x1F \x{85}\x{A0}[\x{100}-\x{FFFF}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]"
#: White space other than single blanks and line feeds.
_ODD_SPACE = r"[\t\x0B\f\r\x1C\x1D\x1E\x1F\x{85}\x{A0}[\x{100}-\x{FFFF}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]]|  "
#: Its characters.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it is named: lambdas have no common subexpressions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def where_held(c: Column, sign: str, use: Callable[[Column], Column]) -> Column:
    """`use` of a text that holds a sign, the text itself without it: looking for a sign costs a small part of a pattern."""
    return bound(c, lambda x: F.when(x.contains(sign), use(x)).otherwise(x))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def clean_transcript(c: Column) -> Column:
    """Line ends to LF, blanks squeezed, indentation and runs of empty lines gone."""
    c = F.regexp_replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), "\r", "\n")
    c = F.replace(F.replace(c, F.lit(" "), F.lit(" ")), F.lit("​"), F.lit(""))
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n[ \t]+", "\n")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def plain_punctuation(c: Column) -> Column:
    return F.replace(F.translate(c, "’‘“”–—−", "''\"\"---"), F.lit("…"), F.lit("..."))


def speaker_labels(c: Column) -> Column:
    return F.regexp_replace(c, r"(?im)^(\s*Operator)\s*[-–—]\s+", "$1: ")


def count_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"[^{_SPACE}]+")).cast("long")


def squeeze(c: Column) -> Column:
    """All white space to single blanks, none at the ends."""
    return F.trim(bound(F.coalesce(c, F.lit("")), lambda x: F.when(x.rlike(f"\n|{_ODD_SPACE}"), F.regexp_replace(x, f"[{_SPACE}]+", " ")).otherwise(x)))


def strip_all(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def clean_text(c: Column) -> Column:
    """Terminal colours off, odd blanks plain, addresses apart from what they are glued to, blanks and empty lines squeezed."""
    c = where_held(F.coalesce(c, F.lit("")), "\x1b", lambda x: F.regexp_replace(x, r"\x1b\[[0-9;]*m", ""))
    c = F.replace(F.replace(c, F.lit("\u00a0"), F.lit(" ")), F.lit("\u200b"), F.lit(""))
    c = where_held(c, "@", lambda x: F.regexp_replace(x, rf"([A-Za-z\)])({EMAIL})", "$1 $2"))
    c = where_held(F.replace(c, F.lit("\t"), F.lit(" ")), "  ", lambda x: F.regexp_replace(x, " {2,}", " "))
    c = where_held(F.replace(c, F.lit("\n "), F.lit("\n")), "\n\n\n", lambda x: F.regexp_replace(x, r"\n{3,}", "\n\n"))
    return strip_all(c)


def filing_text(c: Column) -> Column:
    """Text of a filing's page: blanks squeezed, none at the ends of lines, empty lines in a row as one."""
    c = F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\u00a0"), F.lit(" ")), r"[ \t\r\f\x0B]+", " ")
    return strip_all(F.regexp_replace(F.regexp_replace(c, r" *\n *", "\n"), r"\n{3,}", "\n\n"))


def lines(c: Column) -> Column:
    """Lines of a text, each squeezed, empty ones too."""
    return bound(c, lambda x: F.when(x.rlike(_ODD_SPACE), F.transform(F.split(x, LINE_END), squeeze)).otherwise(F.transform(F.split(x, "\n"), lambda y: F.trim(y))))


def paragraphs(c: Column) -> Column:
    """Lines up to an empty one, joined by blanks; an array without empty paragraphs."""
    groups = F.split(F.array_join(lines(F.coalesce(c, F.lit(""))), "\n"), r"\n{2,}")
    return F.filter(F.transform(groups, lambda g: clean_text(F.replace(strip_all(g), F.lit("\n"), F.lit(" ")))), lambda g: g != "")


def headline(c: Column) -> Column:
    """Of the first 80 lines the first that tells of results, else the first; null without lines."""
    # A line that tells of results holds one of two words, whatever their case: only such lines are lower-cased.
    told = lambda x, low: ((low.contains("reports") | low.contains("announces")) & (low.contains("results") | low.contains("earnings"))) | (low.contains("financial results") & (F.length(x) < 220))
    tells = lambda x: x.rlike("(?i)results|earnings") & bound(F.lower(x), lambda low: told(x, low))
    return bound(F.filter(lines(c), lambda x: x != ""), lambda own: F.coalesce(F.get(F.filter(F.slice(own, 1, 80), tells), F.lit(0)), F.get(own, F.lit(0))))


def size_estimate(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    chars = F.length(text).cast("long")
    return F.struct(chars.alias("characters"), count_words(text).alias("words"), F.greatest(F.lit(1), F.floor(chars / 4)).cast("long").alias("rough_tokens_estimate"))


def is_html(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike("(?i)<(?:html|body|/?table|p)")


def quarter_code(c: Column) -> Column:
    """Q1 to Q4 from 1, Q1, FIRST and so on, whatever the case; null for anything else."""
    own = F.upper(F.trim(c.cast("string")))
    out = F.lit(None).cast("string")
    for k, word in enumerate(("FIRST", "SECOND", "THIRD", "FOURTH"), 1):
        out = F.when(own.isin(str(k), f"Q{k}", word), f"Q{k}").otherwise(out)
    return out


def quarter_word(code: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ("first", "second", "third", "fourth"))), F.substring(code, 2, 1).cast("int"))


def date_range(first: Column, last: Column) -> Column:
    """ok, or what is wrong with two ISO dates of which either may be missing."""
    bad = lambda c: c.isNotNull() & ~F.coalesce(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), F.lit(False))
    return F.when(bad(first), "from_date_not_a_date").when(bad(last), "to_date_not_a_date").when(first > last, "from_date_after_to_date").otherwise("ok")


def lenient_int(c: Column) -> Column:
    """`Q1` is 1, `FY2025` is 2025; what is no whole number is null."""
    s = F.trim(F.replace(F.replace(F.upper(c), F.lit("FY"), F.lit("")), F.lit("Q"), F.lit("")))
    return F.when(s.rlike(r"^[+-]?[0-9]{1,9}$"), s.cast("int"))


def lenient_date(c: Column) -> Column:
    s = F.substring(c, 1, 10)
    return F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(s, "yyyy-MM-dd"))


def first_filled(*columns: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


def holds(text: Column, low: Column, pattern: str, words: list[str]) -> Column:
    """Whether an ASCII pattern that ignores case is found, asked only of texts that hold one of `words`, without which it cannot
    be; `low` is the text lower-cased. Looking for plain words costs a small part of what a pattern of many branches does."""
    some = F.contains(low, F.lit(words[0]))
    for w in words[1:]:
        some = some | F.contains(low, F.lit(w))
    return some & text.rlike(pattern)


def holds_any(text: Column, phrases: list[str]) -> Column:
    """Whether a text holds one of some phrases, without those that hold another: much cheaper than a pattern of as many branches."""
    least = [p for p in dict.fromkeys(phrases) if not any(q != p and q in p for q in phrases)]
    found = F.contains(text, F.lit(least[0]))
    for p in least[1:]:
        found = found | F.contains(text, F.lit(p))
    return found


def first_hit(text: Column, pattern: str) -> Column:
    """Code points before the first match, null without one. (regexp_instr would count UTF-16 units.)"""
    pieces = F.split(text, pattern, 2)
    return F.when(F.size(pieces) > 1, F.length(pieces[0]))


def hits(text: Column, pattern: str) -> Column:
    """Code points before each match."""
    sizes = F.arrays_zip(F.transform(F.split(text, pattern), F.length).alias("gap"), F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length).alias("hit"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("at"))
    return F.aggregate(
        F.filter(sizes, lambda x: x["hit"].isNotNull()),
        start,
        lambda s, x: F.struct((s["end"] + x["gap"] + x["hit"]).alias("end"), F.concat(s["at"], F.array(s["end"] + x["gap"])).alias("at")),
    )["at"]
