"""Text edits by code points: splices, years, casing, dates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_YEAR = r"(?<!\p{Nd})(?:1[0-9]{3}|20[0-9]{2})(?!\p{Nd})"
#: Dutch month names, short forms and short weekdays (from Sunday); fixed values.
MONTHS = ["januari", "februari", "maart", "april", "mei", "juni", "juli", "augustus", "september", "oktober", "november", "december"]
SHORT_MONTHS = ["jan", "feb", "mrt", "apr", "mei", "jun", "jul", "aug", "sep", "okt", "nov", "dec"]
WEEKDAYS = ["zo", "ma", "di", "wo", "do", "vr", "za"]
LONG_WEEKDAYS = ["zondag", "maandag", "dinsdag", "woensdag", "donderdag", "vrijdag", "zaterdag"]
SPELLINGS = {"sept": 9, "maa": 3, "mar": 3}
#: Day-precision date formats in order; fixed values.
DATE_PROFILES = ["numeric_slash_long", "numeric_dash_long", "numeric_dot_long", "textual_full", "textual_abbr_dot", "textual_hyphen", "weekday_textual", "numeric_slash_short"]


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value worked out once however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def spliced(text: Column, begin: Column, end: Column, replacement: Column) -> Column:
    """The text with [begin, end) replaced."""
    return F.concat(text.substr(F.lit(1), begin.cast("int")), replacement, text.substr(end.cast("int") + 1, F.length(text)))


def offsets_valid(text: Column, begin: Column, end: Column, expected: Column) -> Column:
    inside = (begin >= 0) & (end >= begin) & (end <= F.length(text))
    return inside & (text.substr(begin.cast("int") + 1, (end - begin).cast("int")) == expected)


def replaced_all(text: Column, edits: Column) -> Column:
    """The text with every edit struct(begin, end, replacement) applied; an error if edits overlap.

    All offsets refer to the given text.
    """
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(acc: Column, e: Column) -> Column:
        clash = F.raise_error(F.lit("overlapping replacements")).cast("string")
        gap = F.when(e["begin"] < acc["at"], clash).otherwise(text.substr((acc["at"] + 1).cast("int"), (e["begin"] - acc["at"]).cast("int")))
        return F.struct(e["end"].cast("long").alias("at"), F.concat(acc["parts"], F.array(gap, e["replacement"])).alias("parts"))

    return F.aggregate(F.array_sort(edits), start, add, lambda acc: F.concat(F.array_join(acc["parts"], ""), text.substr((acc["at"] + 1).cast("int"), F.length(text))))


def years(text: Column) -> Column:
    """Years 1000 to 2099 in a text, not next to other digits."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({_YEAR})"), F.lit(1)), lambda y: y.cast("int"))


def year_gaps(text: Column) -> Column:
    """The texts before, between and after the years of a text."""
    return F.split(text, _YEAR, -1)


def years_shifted(text: Column, delta: Column) -> Column:
    """Every year moved by ``delta``, written with four digits."""
    return _rewritten(year_gaps(text), years(text), delta)


def _rewritten(gaps: Column, found: Column, delta: Column) -> Column:
    moved = F.transform(found, lambda y: F.lpad((y + delta).cast("string"), 4, "0"))
    return F.array_join(F.zip_with(gaps, moved, lambda gap, year: F.concat(gap, F.coalesce(year, F.lit("")))), "")


def years_written(gaps: Column, found: Column, delta: Column) -> Column:
    """A text of ``year_gaps`` and ``years`` with every year moved by ``delta``; the usual one of two years without functions of lists."""
    year = lambda i: F.lpad((F.get(found, F.lit(i)) + delta).cast("string"), 4, "0")
    gap = lambda i: F.get(gaps, F.lit(i))
    return F.when(F.size(found) == 2, F.concat(gap(0), year(0), gap(1), year(1), gap(2))).otherwise(_rewritten(gaps, found, delta))


def years_moved(text: Column, first: Column) -> Column:
    """The text's years moved so that the first becomes each of the array ``first``; the text is searched once."""
    known = F.struct(year_gaps(text).alias("gaps"), years(text).alias("years"))
    return once(known, lambda k: F.transform(first, lambda y: _rewritten(k["gaps"], k["years"], y - F.get(k["years"], F.lit(0)))))


def recased(value: Column, mode: str) -> Column:
    """full: each run of letters capitalised; first_only: the first letter alone; lower; upper. Others leave it as it is."""
    if mode == "lower":
        return F.lower(value)
    if mode == "upper":
        return F.upper(value)
    if mode == "full":
        runs = F.split(value, r"(?<=\p{L})(?=\P{L})|(?<=\P{L})(?=\p{L})")
        return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))), "")
    if mode == "first_only":
        low = F.lower(value)
        before = F.length(F.regexp_extract(low, r"(?s)^(\P{L}*)", 1))
        return F.concat(low.substr(F.lit(1), before), F.upper(low.substr(before + 1, F.lit(1))), low.substr(before + 2, F.length(low)))
    return value


def _from(values: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def date_rendered(date: Column, profile: str) -> Column:
    """A date in one of DATE_PROFILES."""
    day, month, year = F.dayofmonth(date).cast("string"), F.month(date), F.year(date).cast("string")
    full, short = _from(MONTHS, month - 1), _from(SHORT_MONTHS, month - 1)
    d2, m2, y2 = F.lpad(day, 2, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad((F.year(date) % 100).cast("string"), 2, "0")
    return {
        "numeric_slash_long": F.concat_ws("/", d2, m2, year),
        "numeric_dash_long": F.concat_ws("-", d2, m2, year),
        "numeric_dot_long": F.concat_ws(".", day, month.cast("string"), year),
        "textual_full": F.concat_ws(" ", day, full, year),
        "textual_abbr_dot": F.concat_ws(" ", day, F.concat(short, F.lit(".")), year),
        "textual_hyphen": F.concat_ws("-", day, short, year),
        "weekday_textual": F.concat_ws(" ", _from(WEEKDAYS, F.dayofweek(date) - 1), day, full, year),
        "numeric_slash_short": F.concat_ws("/", day, month.cast("string"), y2),
    }[profile]


def date_parsed(text: Column) -> Column:
    """The calendar date that a text writes with day, month and year; null for anything else, relative dates among it.

    One pattern over the whole text: an optional weekday, then day, month and year in numbers or with the month's name (long,
    short or SPELLINGS, any of them with a dot), an ordinal ending after the day, an apostrophe before a short year; or year,
    month and day. Two-digit years above 50 are of the last century.
    """
    names = {n: i + 1 for group in (MONTHS, SHORT_MONTHS) for i, n in enumerate(group)} | SPELLINGS
    month = "|".join(sorted(names, key=lambda n: (-len(n), n)))
    week = "|".join([*LONG_WEEKDAYS, *WEEKDAYS])
    gap = r"(?: ?[-/.] ?| )"
    form = rf"^(?:(?:{week})[.,]? )?(?:op )?(?:([0-9]{{1,2}})(?:e|ste|de)?{gap}((?:{month})\.?|[0-9]{{1,2}}){gap}('?[0-9]{{2}}|[0-9]{{4}})|([0-9]{{4}})-([0-9]{{2}})-([0-9]{{2}}))$"
    low = F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")
    numbers = F.create_map(*[F.lit(x) for n, i in names.items() for x in (n, i)])

    def date(parts: Column) -> Column:
        part = lambda i: F.nullif(F.get(parts, F.lit(i - 1)), F.lit(""))
        name = F.regexp_replace(part(2), r"\.$", "")
        number = F.coalesce(F.try_element_at(numbers, name), name.try_cast("int"), part(5).try_cast("int"))
        short = F.regexp_replace(part(3), "'", "")
        y = short.try_cast("int")
        whole = F.coalesce(F.when(F.length(short) == 2, F.when(y > 50, y + 1900).otherwise(y + 2000)).otherwise(y), part(4).try_cast("int"))
        written = F.concat_ws("-", F.lpad(whole.cast("string"), 4, "0"), F.lpad(number.cast("string"), 2, "0"), F.lpad(F.coalesce(part(1), part(6)), 2, "0"))
        return F.when(whole.isNotNull() & number.isNotNull(), F.try_to_date(written, "yyyy-MM-dd"))

    # one search: a text that fits is replaced by its six parts, with a mark after each; others stay in one piece
    marked = F.split(F.regexp_replace(low, form, "".join(f"${i}\u0001" for i in range(1, 7))), "\u0001", -1)
    fits = (F.size(marked) == 7) & ~F.contains(low, F.lit("\u0001"))
    return once(F.when(fits, marked), lambda parts: F.when(parts.isNotNull(), date(parts)))


def device(value: Column) -> Column:
    """Accelerators are ``gpu``, blanks ``cpu``; other names stay, in lower case."""
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(low.isin("cuda", "gpu", "mps", "metal", "rocm", "xpu"), "gpu").when(low == "", "cpu").otherwise(low)
