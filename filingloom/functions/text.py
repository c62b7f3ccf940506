"""Text expressions. Each takes a column (or its name) and returns a column."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from filingloom.functions.vectors import let

# Every Unicode space under (?U); the four separators complete Java's definition.
SPACE = r"\s\x1c-\x1f"

# The same characters one by one.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The filing layout and markup that results depend on.
PERIOD = rf"(?U)CONFORMED PERIOD OF REPORT:[{SPACE}]+(\d{{4}})"
SECTION_START = rf"(?iU)Item[{SPACE}]+1A\.?[{SPACE}]+Risk[{SPACE}]+Factors"
SECTION = (
    rf"(?isU)Item[{SPACE}]+1A\.?[{SPACE}]+Risk[{SPACE}]+Factors"
    rf"(.*?)(?=Item[{SPACE}]+(?:1B|2)\.?|\z)"
)
HTML_TAG = r"<[^<]+?>"
DECIMAL_ENTITY = r"&#\d+;"
NBSP = r"(?i)&nbsp;"
CONTRACTIONS = ["cannot", "gimme", "gonna", "gotta", "lemme", "wanna"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decode(c: Column | str) -> Column:
    """Drop undecodable bytes, then use ``\\n`` for every line end."""
    c = _col(c)
    valid = F.when(F.is_valid_utf8(c), c).otherwise(
        F.regexp_replace(F.make_valid_utf8(c), "�", "")
    )
    return F.regexp_replace(valid, r"\r\n?", "\n")


def strip(c: Column | str) -> Column:
    """Trim all white space; only the ends of the text are looked at."""
    return F.trim(_col(c), F.lit(SPACES))


def squeeze(c: Column | str) -> Column:
    """Runs of blanks become one blank; the ends are trimmed."""
    return strip(F.regexp_replace(_col(c), " {2,}", " "))


def clean_markup(c: Column | str) -> Column:
    """Tags and decimal entities out, ``&nbsp;`` to a blank, blank lines to one."""
    c = F.regexp_replace(_col(c), HTML_TAG, "")
    c = F.regexp_replace(c, DECIMAL_ENTITY, "")
    c = squeeze(F.regexp_replace(c, NBSP, " "))
    return F.regexp_replace(c, rf"(?U)\n[{SPACE}]*\n", "\n\n")


def risk_section(c: Column | str, pick: str = "first") -> Column:
    """Text of Item 1A: the first match, or the longest one (skips contents pages)."""
    c = _col(c)
    if pick == "first":
        return F.regexp_extract(c, SECTION, 1)
    if pick != "longest":
        raise ValueError("pick must be 'first' or 'longest'")
    found = F.regexp_extract_all(c, F.lit(SECTION), 1)
    sized = F.transform(found, lambda s, i: F.struct(F.length(s), -i, s.alias("text")))
    return F.coalesce(F.array_max(sized)["text"], F.lit(""))


def has_risk_section(c: Column | str) -> Column:
    return _col(c).rlike(SECTION_START)


def report_year(c: Column | str) -> Column:
    return F.regexp_extract(_col(c), PERIOD, 1).try_cast("int")


def words(c: Column | str) -> Column:
    """White-space separated words."""
    return F.filter(F.split(_col(c), rf"(?U)[{SPACE}]+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def letters_only(c: Column | str) -> Column:
    """Lowercase, then delete every character but ASCII letters and white space."""
    return F.regexp_replace(F.lower(_col(c)), rf"(?U)[^a-z{SPACE}]+", "")


def _pieces(c: Column | str) -> Column:
    return F.split(letters_only(c), rf"(?U)[{SPACE}]+")


def raw_tokens(c: Column | str) -> Column:
    """Words left after ``letters_only``; fixed contractions fall apart into
    pieces that are too short to be kept, so they are dropped here."""
    return F.filter(_pieces(c), lambda w: (w != "") & ~w.isin(CONTRACTIONS))


def text_tokens(c: Column | str, stop: Iterable[str], min_len: int = 4) -> Column:
    """``keep_tokens`` of ``raw_tokens``, all tests in one look at each word."""
    return keep_tokens(_pieces(c), [*stop, *CONTRACTIONS], max(1, min_len))


def keep_tokens(tokens: Column | str, stop: Iterable[str], min_len: int = 4) -> Column:
    """Long enough and not a stop word. The literal list becomes a hash set."""
    stop = sorted(set(stop))
    if not stop:
        return F.filter(_col(tokens), lambda w: F.length(w) >= min_len)
    return F.filter(_col(tokens), lambda w: (F.length(w) >= min_len) & ~w.isin(stop))


def excerpt(c: Column | str, size: int = 200) -> Column:
    return F.concat(F.substring(_col(c), 1, size), F.lit("..."))


def term_runs(tokens: Column | str) -> Column:
    """Tokens of one document as ``array<struct<token, cnt>>``, inside the row.

    Sorting puts equal tokens side by side, so each run is one distinct token
    and no shuffle on the document key is needed.
    """

    def run_starts(ordered: Column) -> Column:
        marked = F.transform(
            ordered,
            lambda w, i: F.when(
                (i == 0) | (F.get(ordered, i - 1) != w),
                F.struct(w.alias("token"), i.alias("at")),
            ),
        )
        return F.filter(marked, lambda s: s.isNotNull())

    def run_lengths(ordered: Column, starts: Column) -> Column:
        return F.transform(
            starts,
            lambda s, k: F.struct(
                s["token"].alias("token"),
                (
                    F.coalesce(F.get(starts, k + 1)["at"], F.size(ordered)) - s["at"]
                ).alias("cnt"),
            ),
        )

    return let(
        F.sort_array(_col(tokens)),
        lambda ordered: let(
            run_starts(ordered), lambda starts: run_lengths(ordered, starts)
        ),
    )


def marked_tokens(tokens: Column | str) -> Column:
    """Tokens of one document as ``array<struct<token, first>>``; ``first`` is 1 at
    one occurrence of each distinct token and 0 at its repeats."""
    return let(
        F.sort_array(_col(tokens)),
        lambda ordered: F.transform(
            ordered,
            lambda w, i: F.struct(
                w.alias("token"),
                F.when((i > 0) & (F.get(ordered, i - 1) == w), 0).otherwise(1).alias("first"),
            ),
        ),
    )
