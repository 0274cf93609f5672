"""Names: parsing into parts against name lists, and writing parts in other forms."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .texts import once

#: Orders of parts that can be switched on and off, casing modes and forms; fixed values, in their fixed order.
PATTERNS = ["first_last", "last_first", "first_only", "last_only", "last_comma_first", "initial_last", "last_initial", "last_comma_initial", "first_middle_initial_last"]
CASINGS = ["full", "first_only", "lower", "upper"]
FORMS = ["same", "full_name", "first_only", "initials_only", "first_initials", "title_dr"]
#: A parsed name; ``written`` are its parts in the order of the text, each with its sort: first, last, initial or comma.
PARTS = "title string, first_name string, last_name string, pattern string, first_initial string, written array<struct<sort:string,text:string>>"
_INITIAL = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]\.?")


@dataclass(frozen=True)
class Lookups:
    """Name lists; titles are tried longest first."""

    prefixes: list[str]
    first_names: list[str]
    surnames: list[str]
    interfixes: list[str]
    interfix_surnames: list[str]


class NameParser:
    """Reads a name in the first enabled pattern whose parts are all of their sort."""

    def __init__(self, lookups: Lookups, patterns: list[str] | None = None):
        self.on = set(PATTERNS if patterns is None else patterns)
        self.first = {n.lower(): n for n in lookups.first_names}
        self.last = {n.lower() for n in lookups.surnames}
        self.inner = {n.lower() for n in lookups.interfixes}
        self.after = self.last | {n.lower() for n in lookups.interfix_surnames}
        self.titles = sorted((p.strip() for p in lookups.prefixes if p.strip()), key=len, reverse=True)

    def surname(self, text: str) -> bool:
        """Whether a text is a listed surname, or a listed interfix with a name that may follow one."""
        low = " ".join(text.lower().split())
        return low in self.last or any(low.startswith(f"{i} ") and low.removeprefix(f"{i} ") in self.after for i in self.inner)

    def title(self, text: str) -> tuple[str, str]:
        """All leading titles and the rest; a title never takes the whole text."""
        taken: list[str] = []
        while True:
            for t in self.titles:
                rest = text[len(t) :]
                if text[: len(t)].lower() == t.lower() and rest.strip() and (rest[0] == " " or t.endswith(".")):
                    taken.append(text[: len(t)])
                    text = rest.strip()
                    break
            else:
                return " ".join(taken), text

    def readings(self, text: str) -> Iterator[tuple[str, list[tuple[str, str]]]]:
        """(pattern, parts as (sort, text) in written order), in order of preference."""
        words = text.split()
        if "," in text:
            left, right = (x.strip() for x in text.split(",", 1))
            yield "last_comma_first", [("last", left), ("comma", ","), ("first", right)]
            yield "last_comma_initial", [("last", left), ("comma", ","), ("initial", right)]
        if known := next((n for n in range(len(words), 0, -1) if " ".join(words[:n]).lower() in self.first), 0):
            first, rest = ("first", " ".join(words[:known])), words[known:]
            if rest:
                yield "first_last", [first, ("last", " ".join(rest))]
                yield "first_middle_initial_last", [first, ("initial", rest[0]), ("last", " ".join(rest[1:]))]
            else:
                yield "first_only", [first]
        yield "initial_last", [("initial", words[0]), ("last", " ".join(words[1:]))]
        yield "last_initial", [("last", " ".join(words[:-1])), ("initial", words[-1])]
        yield "last_only", [("last", text)]
        for n in range(1, len(words)):
            yield "last_first", [("last", " ".join(words[:n])), ("first", " ".join(words[n:]))]

    def holds(self, sort: str, text: str) -> bool:
        if sort == "first":
            return text.lower() in self.first
        return self.surname(text) if sort == "last" else sort == "comma" or bool(_INITIAL.fullmatch(text))

    def parse(self, text: str | None) -> tuple | None:
        """Values of PARTS, or None. ``first_name`` is written as in the list."""
        title, body = self.title(" ".join((text or "").split()))
        for pattern, written in self.readings(body) if body else ():
            if pattern in self.on and all(self.holds(*part) for part in written):
                have = dict(written)
                return title, self.first.get(have.get("first", "").lower(), ""), have.get("last", ""), pattern, have.get("initial", "")[:1].upper(), [{"sort": s, "text": t} for s, t in written]
        return None


_PARTS = pa.struct([("title", pa.string()), ("first_name", pa.string()), ("last_name", pa.string()), ("pattern", pa.string()), ("first_initial", pa.string()), ("written", pa.list_(pa.struct([("sort", pa.string()), ("text", pa.string())])))])
#: Names whose readings a task remembers.
REMEMBERED = 100_000


def _reader(lookups: Lookups, patterns: list[str] | None) -> Callable[[pa.Array], pa.Array]:
    """A function from texts to their parts, which reads each different text of an array once."""
    parse, fields = lru_cache(REMEMBERED)(NameParser(lookups, patterns).parse), [f.name for f in _PARTS]

    def read(texts: pa.Array) -> pa.Array:
        coded = texts.cast(pa.string()).dictionary_encode(null_encoding="encode")
        found = [dict(zip(fields, parse(t) or (None,) * len(fields), strict=True)) for t in coded.dictionary.to_pylist()]
        return pa.array(found, _PARTS).take(coded.indices)

    return read


def parsed_name(text: Column, lookups: Lookups, patterns: list[str] | None = None) -> Column:
    """The parts of a name as a struct; its fields are null where no pattern fits."""

    @F.arrow_udf(PARTS)
    def apply(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        read = _reader(lookups, patterns)
        for batch in texts:
            yield read(batch)

    # not deterministic only so that a filter on the result does not run it once more
    return apply.asNondeterministic()(text)


def parsed_names(texts: Column, lookups: Lookups, patterns: list[str] | None = None) -> Column:
    """``parsed_name`` of every text of an array; no array where there is none."""

    @F.arrow_udf(f"array<struct<{', '.join(p.replace(' ', ':', 1) for p in PARTS.split(', '))}>>")
    def apply(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        read = _reader(lookups, patterns)
        for batch in lists:
            yield pa.ListArray.from_arrays(batch.offsets, read(batch.values), mask=batch.is_null() if batch.null_count else None)

    return apply.asNondeterministic()(texts)


def casing(model: Column) -> Column:
    """upper or lower if all letters of ``model`` are; otherwise, and without letters, as_is."""
    letters = F.regexp_replace(model, r"\P{L}+", "")
    return F.when(F.upper(letters) == F.lower(letters), "as_is").when(letters == F.upper(letters), "upper").when(letters == F.lower(letters), "lower").otherwise("as_is")


def in_casing(value: Column, case: Column) -> Column:
    return F.when(case == "upper", F.upper(value)).when(case == "lower", F.lower(value)).otherwise(value)


def shaped(written: Column) -> Column:
    """The written parts with what their casing and dots are, found once for all names written in their place."""
    model = lambda w: F.when(w["sort"] == "initial", F.substring(w["text"], 1, 1)).otherwise(w["text"])
    return F.transform(written, lambda w: F.struct(w["sort"].alias("sort"), w["text"].alias("text"), casing(model(w)).alias("case"), F.when(w["text"].endswith("."), ".").otherwise("").alias("dot")))


def composed(parts: Column, first: Column, last: Column, shape: Column | None = None) -> Column:
    """A name with the title, order and casing of the parsed one; an initial is that of ``first``, or stays if that is empty.

    The initial between a first name and a surname is a middle one and stays. ``shape`` is ``shaped`` of the parts, if it is known.
    """
    middle = parts["pattern"] == "first_middle_initial_last"

    def letter(w: Column) -> Column:
        source = F.when(middle | (first == ""), w["text"]).otherwise(first)
        return F.concat(in_casing(F.upper(F.substring(F.trim(source), 1, 1)), w["case"]), w["dot"])

    def write(w: Column) -> Column:
        return F.when(w["sort"] == "first", in_casing(first, w["case"])).when(w["sort"] == "last", in_casing(last, w["case"])).when(w["sort"] == "initial", letter(w)).otherwise(w["text"])

    whole = F.concat(F.array(parts["title"]), F.transform(shaped(parts["written"]) if shape is None else shape, write))
    return F.replace(F.array_join(F.filter(whole, lambda x: x != ""), " "), F.lit(" ,"), F.lit(","))


def rendered(parts: Column, form: str, title: str = "dr.") -> Column:
    """The name in one of FORMS; null where a part that the form needs is missing, and for other forms."""
    first, last = F.trim(parts["first_name"]), F.trim(parts["last_name"])
    initial = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lit("."))
    both = F.when((first != "") & (last != ""), F.concat(first, F.lit(" "), last))
    forms = {
        "same": composed(parts, parts["first_name"], parts["last_name"]),
        "full_name": both,
        "first_only": F.nullif(first, F.lit("")),
        "initials_only": F.when(both.isNotNull(), F.concat(initial(first), initial(last))),
        "first_initials": F.when(both.isNotNull(), F.concat(first, F.lit(" "), initial(last))),
        "title_dr": F.concat(F.lit(f"{title} "), F.coalesce(both, F.nullif(F.concat(first, last), F.lit("")))),
    }
    return forms.get(form, F.lit(None).cast("string"))


def listed(values: list[str]) -> Column:
    """A list of texts as one constant."""
    return F.split(F.lit("\u001f".join(values)), "\u001f")


def distinct(values: list[str]) -> list[str]:
    """The first of each group of names that are equal in small letters."""
    return list({v.lower(): v for v in reversed(values)}.values())[::-1]


def place(values: list[str], name: Column) -> Column:
    """The place of a name among ``distinct`` values, from 1 on, ignoring case; 0 if it is not there."""
    return F.coalesce(F.array_position(listed([v.lower() for v in distinct(values)]), F.lower(name)), F.lit(0))


def place_apart(size: int, number: Column, at: Column) -> Column:
    """The place, from 0 on, that a number picks of ``size`` values but the one at ``at`` (from 1 on; 0: none is left out)."""
    among = F.greatest(F.lit(size) - F.when(at > 0, 1).otherwise(0), F.lit(1))
    return once(F.pmod(number, among), lambda i: F.least(i + F.when((at > 0) & (i >= at - 1), 1).otherwise(0), F.lit(size - 1)).cast("int"))


def drawn_apart(values: list[str], number: Column, at: Column) -> Column:
    """The value that a number picks from all but the one at ``at``: one draw, and equal chances for all others.

    The value at ``at`` itself only if there is no other.
    """
    kept = distinct(values)
    return F.get(listed(kept), place_apart(len(kept), number, at))


#: What stands for a drawn first name or initial, and for a drawn surname, in a name's template.
_FIRST, _LAST = "\u0001", "\u0002"


def template(parts: Column, lookups: Lookups, shape: Column) -> Column:
    """What all other names of a target share: struct(form, firsts, lasts, both, first_at, last_at, again).

    ``form`` is the name with marks where names are drawn, ``firsts`` (first names or initials) and ``lasts`` the lists to draw from
    in its casing, null if none is written; ``first_at`` and ``last_at`` the places that are left out of a draw, 0 for none;
    with ``both`` the surname is left out only where the first name at ``again`` is drawn again.
    """
    case = lambda sort: F.get(F.transform(F.filter(shape, lambda w: w["sort"] == sort), lambda w: w["case"]), F.lit(0))
    middle = parts["pattern"] == "first_middle_initial_last"
    first, last, initial = case("first"), case("last"), F.when(~middle, case("initial"))

    def cased(values: list[str], by: Column) -> Column:
        return F.when(by == "upper", listed([v.upper() for v in values])).when(by == "lower", listed([v.lower() for v in values])).when(by.isNotNull(), listed(values))

    names, surnames = distinct(lookups.first_names), distinct(lookups.surnames)
    letters = [v.strip()[:1].upper() for v in names]
    first_at = F.when(first.isNotNull() & last.isNull(), place(lookups.first_names, parts["first_name"])).otherwise(0)
    known_first = F.when(first.isNotNull() & last.isNotNull(), place(lookups.first_names, parts["first_name"])).otherwise(0)
    return F.struct(
        composed(parts, F.lit(_FIRST), F.lit(_LAST), shape).alias("form"),
        F.coalesce(cased(names, first), cased(letters, initial)).alias("firsts"),
        cased(surnames, last).alias("lasts"),
        (first.isNotNull() & last.isNotNull()).alias("both"),
        first_at.alias("first_at"),
        place(lookups.surnames, parts["last_name"]).alias("last_at"),
        known_first.alias("again"),
    )


def other_name(shared: Column, sizes: tuple[int, int], draw: Callable[[str], Column]) -> Column:
    """A listed name written like the parsed one but not equal to it, unless the lists hold no other.

    ``shared`` is the target's ``template``, ``sizes`` are those of the lists; ``draw`` gives a number for ``f`` or ``l``. Only a first
    name: it is new. A surname alone or with an initial: it is new. Both: the surname is new where the first name is drawn
    again. What is not written is not drawn.
    """

    def written(at: Column) -> Column:
        left_out = F.when(shared["both"] & (at + 1 != shared["again"]), 0).otherwise(shared["last_at"])
        some = F.when(shared["firsts"].isNotNull(), F.replace(shared["form"], F.lit(_FIRST), F.get(shared["firsts"], at))).otherwise(shared["form"])
        surname = F.get(shared["lasts"], place_apart(sizes[1], draw("l"), left_out))
        return F.when(shared["lasts"].isNotNull(), F.replace(some, F.lit(_LAST), surname)).otherwise(some)

    return once(F.when(shared["firsts"].isNotNull(), place_apart(sizes[0], draw("f"), shared["first_at"])), written)
