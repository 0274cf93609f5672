"""One-factor-at-a-time variants of names, dates and ages, each a text with its target span."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions.labels import category_key, label_key, role_of
from ..functions.names import CASINGS, FORMS, PATTERNS, Lookups, parsed_name, parsed_names
from ..functions.texts import DATE_PROFILES, date_parsed, date_rendered, once, recased, year_gaps, years, years_moved

#: Ways of writing an age, with %s for the number.
AGE_FORMS = ["%s jaar", "%s j.", "%s jr.", "%s-jarige", "%s jaar oud", "%sj"]
#: Documents of a part of ``together``.
DOCUMENTS = 20_000
_OPTION = "array<struct<dimension:string,value:string,replacement:string>>"


@dataclass(frozen=True)
class Plan:
    """What to vary; labels match as parts of normalised labels."""

    name_labels: list[str] = field(default_factory=lambda: ["Name:Patient", "Name:Caregiver"])
    date_labels: list[str] = field(default_factory=lambda: ["Date", "Age_Birthdate"])
    casings: list[str] = field(default_factory=lambda: list(CASINGS))
    forms: list[str] = field(default_factory=lambda: list(FORMS))
    date_profiles: list[str] = field(default_factory=lambda: list(DATE_PROFILES))
    year_min: int = 1980
    year_max: int = 2050
    year_step: int = 1
    trials: int = 25
    seed: int = 42
    title: str = "dr."
    patterns: list[str] = field(default_factory=lambda: list(PATTERNS))


def drawn(*parts: Column) -> Column:
    """A draw below 2**32 that depends only on the given values, not on order or partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def _options(dimension: str, values: list[tuple[Column, Column]]) -> Column:
    rows = [F.struct(F.lit(dimension).alias("dimension"), v.alias("value"), r.alias("replacement")) for v, r in values]
    return F.array(*rows).cast(_OPTION) if rows else F.array().cast(_OPTION)


def _new(options: Column, original: Column) -> Column:
    """Options whose replacement is filled and neither the original nor an earlier option's."""

    def fresh(known: Column) -> Column:
        written = F.transform(known, lambda o: F.coalesce(o["replacement"], F.lit("")))
        return F.filter(known, lambda o, i: (F.coalesce(o["replacement"], F.lit("")) != "") & (o["replacement"] != original) & (F.array_position(written, o["replacement"]) == i + 1))

    return once(options, fresh)


def name_options(plan: Plan, lookups: Lookups, wanted: Callable[[str], bool]) -> Column:
    """All changes of a name target: casings and forms share what they have seen, other names have their own.

    ``shape``, ``shared`` and ``seeded`` are columns of the target.
    """
    parts, base, shape = F.col("parts"), F.col("base_text"), F.col("shape")
    none = F.array().cast(_OPTION)
    tried = none
    if wanted("capitalization") or wanted("format"):
        same = names.composed(parts, parts["first_name"], parts["last_name"], shape)
        tried = once(same, lambda name: _options("capitalization", [(F.lit(m), recased(name, m)) for m in plan.casings]))
        tried = F.concat(tried, _options("format", [(F.lit(f), names.rendered(parts, f, plan.title)) for f in plan.forms]))

    sizes = len(names.distinct(lookups.first_names)), len(names.distinct(lookups.surnames))

    def other(trial: Column) -> Column:
        draw = lambda kind: drawn(F.concat(F.col("seeded"), trial, F.lit(f":{kind}")))
        found = names.other_name(F.col("shared"), sizes, draw)
        return F.struct(F.lit("name_source").alias("dimension"), F.concat(F.lit("other_"), trial).alias("value"), found.alias("replacement"))

    trials = F.array(*[F.lit(str(t)) for t in range(plan.trials)]).cast("array<string>")
    others = F.transform(trials, other) if plan.trials > 0 and wanted("name_source") else none
    return F.concat(_new(tried, base), _new(others, base))


def candidates(notes: DataFrame, plan: Plan, lookups: Lookups) -> DataFrame:
    """Spans inside their texts with a label of the plan: row, document_id, text, place, begin, end, label, base_text, is_name, parts."""
    numbered = notes.withColumn("row", F.monotonically_increasing_id())  # before the spans are taken apart
    spans = numbered.select("row", "document_id", "text", F.posexplode("spans").alias("place", "s"))
    base = F.col("text").substr((F.col("s.begin") + 1).cast("int"), (F.col("s.end") - F.col("s.begin")).cast("int"))
    spans = spans.where("s.begin >= 0 and s.end > s.begin and s.end <= length(text)")
    spans = spans.select("row", "document_id", "text", "place", "s.begin", "s.end", "s.label", base.alias("base_text"))
    key = label_key(F.col("label"))

    def among(labels: list[str]) -> Column:
        return F.exists(F.array(*[label_key(F.lit(x)) for x in labels]), lambda a: F.contains(key, a)) if labels else F.lit(False)

    spans = spans.withColumn("is_name", among(plan.name_labels)).where(F.col("is_name") | among(plan.date_labels))
    return spans.withColumn("parts", parsed_name(F.when(F.col("is_name"), F.col("base_text")), lookups, plan.patterns))


def unread(notes: DataFrame, plan: Plan, lookups: Lookups) -> DataFrame:
    """Name spans that no pattern reads."""
    return candidates(notes, plan, lookups).where(F.col("is_name") & F.col("parts.pattern").isNull())


def together(notes: DataFrame) -> DataFrame:
    """Notes dealt out by document, with ``single``: no other note has its document_id.

    What is grouped by document later needs no other shuffle, and parts are small enough for tables of their variants.
    """
    parts = max(int(notes.sparkSession.conf.get("spark.sql.shuffle.partitions")), notes.count() // DOCUMENTS)
    own = Window.partitionBy("document_id")
    return notes.repartition(parts, "document_id").withColumn("single", F.count("*").over(own) == 1)


def targets(notes: DataFrame, plan: Plan, lookups: Lookups) -> DataFrame:
    """One row for each usable target: document_id, text, begin, end, label, base_text, kind, role, parts, span_index, date, alone.

    Spans out of the text are skipped; name spans that no pattern reads are skipped and take no index. A span counts as a
    name before it counts as a date. ``alone``: no other target of its document is of its kind, as far as ``single`` of
    ``together`` tells; false without that.
    """
    text = F.col("text")

    def among(key: Column, labels: list[str]) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(key, label_key(F.lit(x))) for x in labels], F.lit(False))

    def cut(s: Column) -> Column:
        base = text.substr((s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int"))
        key = label_key(s["label"])
        return F.struct(s["begin"].alias("begin"), s["end"].alias("end"), s["label"].alias("label"), base.alias("base_text"), among(key, plan.name_labels).alias("is_name"), among(key, plan.date_labels).alias("is_date"))

    inside = F.filter("spans", lambda s: (s["begin"] >= 0) & (s["end"] > s["begin"]) & (s["end"] <= F.length(text)))
    cuts = F.filter(F.transform(inside, cut), lambda s: s["is_name"] | s["is_date"])
    single = F.col("single") if "single" in notes.columns else F.lit(False)
    rows = notes.select("document_id", "text", single.alias("single"), cuts.alias("cuts"))
    rows = rows.withColumn("read", parsed_names(F.transform("cuts", lambda s: F.when(s["is_name"], s["base_text"])), lookups, plan.patterns))
    read = F.zip_with("cuts", "read", lambda s, parts: F.struct(s.alias("s"), parts.alias("parts"), F.when(~s["is_name"], date_parsed(s["base_text"])).alias("date")))
    kind = lambda t: F.when(t["s"]["is_name"], "name").when(t["date"].isNotNull(), "date").otherwise("age")
    usable = F.filter(read, lambda t: ~t["s"]["is_name"] | t["parts"]["pattern"].isNotNull())
    rows = rows.select("document_id", "text", "single", F.transform(usable, lambda t: F.struct(t.alias("t"), kind(t).alias("kind"))).alias("found"))
    # posexplode() would have Spark infer a filter that works out what it takes apart once more
    rows = rows.select("document_id", "text", "single", F.transform("found", lambda t: t["kind"]).alias("kinds"), F.posexplode_outer("found").alias("span_index", "x")).where("x is not null")
    s, kind_of = F.col("x.t.s"), F.col("x.kind")
    role = F.when(kind_of == "name", F.coalesce(role_of(s["label"]), F.lit("name"))).otherwise(kind_of)
    alone = F.col("single") & (F.size(F.filter("kinds", lambda k: k == kind_of)) == 1)
    return rows.select("document_id", "text", s["begin"].alias("begin"), s["end"].alias("end"), s["label"].alias("label"), s["base_text"].alias("base_text"), kind_of.alias("kind"), role.alias("role"), F.col("x.t.parts").alias("parts"), "span_index", F.col("x.t.date").alias("date"), alone.alias("alone"))


#: The dimension whose replacements are written only when its variants are rows of their own; fixed name.
SHIFT = "date_value_shift"


def with_options(rows: DataFrame, plan: Plan, lookups: Lookups, only: list[str] | None = None) -> DataFrame:
    """Targets with ``options``: all changes as array<struct<dimension, value, replacement>>, the unchanged baseline first.

    ``only``: the dimensions asked for, and no others. The options of a text's only year are without their replacement, which
    is the year between ``before_year`` and ``after_year``.
    """
    wanted = lambda dimension: only is None or dimension in only
    base, kind = F.col("base_text"), F.col("kind")
    none = F.array().cast(_OPTION)
    rows = rows.withColumn("shape", names.shaped(F.col("parts.written"))).withColumn("shared", names.template(F.col("parts"), lookups, F.col("shape")))
    rows = rows.withColumn("seeded", F.concat_ws(":", F.lit(str(plan.seed)), "document_id", F.col("span_index").cast("string"), F.lit("")))
    named = none
    if any(wanted(d) for d in ("capitalization", "format", "name_source")):
        named = F.when(kind == "name", name_options(plan, lookups, wanted))
    gaps = F.when(kind == "date", year_gaps(base)) if wanted(SHIFT) else F.lit(None).cast("array<string>")
    rows = rows.withColumn("own_first", F.coalesce(F.get(years(base), F.lit(0)) == plan.year_min, F.lit(False)) if wanted(SHIFT) else F.lit(False))
    rows = rows.withColumn("gaps", gaps).withColumn("before_year", F.get("gaps", F.lit(0))).withColumn("after_year", F.get("gaps", F.lit(1)))
    values = range(plan.year_min, plan.year_max + 1, max(1, plan.year_step))
    grid = F.array(*[F.lit(y) for y in values]).cast("array<int>")
    one = _options(SHIFT, [(F.lit(str(y)), F.lit(None).cast("string")) for y in values])
    several = F.zip_with(grid, years_moved(base, grid), lambda y, text: F.struct(F.lit(SHIFT).alias("dimension"), y.cast("string").alias("value"), text.alias("replacement")))
    shifts = F.when(F.size("gaps") == 2, one).when(F.size("gaps") > 2, several).otherwise(none) if wanted(SHIFT) else none
    formats = _options("date_format", [(F.lit(p), date_rendered(F.col("date"), p)) for p in plan.date_profiles]) if wanted("date_format") else none
    number = F.regexp_extract(base, "[0-9]+", 0)
    ages = _options("age_format", [(F.lit(f"age_{i}"), F.when(number != "", F.format_string(a, number))) for i, a in enumerate(AGE_FORMS)]) if wanted("age_format") else none
    written = F.when(kind == "date", formats).when(kind == "age", ages).otherwise(none)
    start = _options("baseline", [(F.lit("original"), base)]) if wanted("baseline") else none
    return rows.withColumn("options", F.concat(start, shifts, _new(written, F.trim(base)), F.coalesce(named, none)))


def varied(notes: DataFrame, plan: Plan, lookups: Lookups, only: list[str] | None = None) -> DataFrame:
    """``variants`` with their parts as columns, and what scoring takes from them.

    Beside those: ``category``, ``key`` (the label's normalised keys), ``alone`` of ``targets`` and ``leads``: the first variant
    of its target in its dimension.
    """
    rows = with_options(targets(notes, plan, lookups), plan, lookups, only)
    text, year = F.col("text"), F.lpad("o.value", 4, "0")
    rows = rows.select(
        "document_id", "begin", "label", "base_text", "kind", "role", "span_index", "alone", "own_first", "before_year", "after_year", "options",
        text.substr(F.lit(1), F.col("begin").cast("int")).alias("before"), text.substr(F.col("end").cast("int") + 1, F.length(text)).alias("after"),
        F.concat(F.concat_ws("::", "document_id", F.col("span_index").cast("string")), F.lit("")).alias("entity"), category_key(F.col("label")).alias("category"), label_key(F.col("label")).alias("key"),
    )
    # what follows has no functions of lists, so that Spark compiles it into one loop; posexplode() would have Spark infer a filter
    # that works out all options once more
    rows = rows.withColumn("dimensions", F.transform("options", lambda o: o["dimension"]))
    rows = rows.select("*", F.posexplode_outer("options").alias("at", "o")).where("o is not null")
    dimension = F.col("o.dimension")
    new = F.when(F.col("o.replacement").isNull() & (dimension == SHIFT), F.concat("before_year", year, "after_year")).otherwise(F.col("o.replacement"))
    # the text's own year is no variant, so that the next one leads where it comes first
    leads = F.coalesce(F.get("dimensions", F.col("at") - F.when(F.col("own_first") & (dimension == SHIFT), 2).otherwise(1)) != dimension, F.lit(True))
    rows = rows.select("document_id", "begin", "label", "base_text", "kind", "role", "span_index", "alone", "before", "after", "entity", "category", "key", leads.alias("leads"), dimension.alias("dimension"), F.col("o.value").alias("dimension_value"), new.alias("replacement"))
    rows = rows.where((F.col("dimension") != SHIFT) | (F.col("replacement") != F.col("base_text")))
    identity = F.concat("entity", F.lit("::"), "dimension", F.lit("::"), "dimension_value")
    return rows.select("*", identity.alias("variant_id"), F.concat("before", "replacement", "after").alias("text"), (F.col("begin") + F.length("replacement")).alias("end"))


def variants(notes: DataFrame, plan: Plan, lookups: Lookups) -> DataFrame:
    """variant_id, document_id, text and target struct, one row for each variant of each target of ``notes``."""
    target = F.struct("begin", "end", "label", F.col("replacement").alias("text"), "role", "kind", "span_index", "dimension", "dimension_value", "base_text")
    return varied(notes, plan, lookups).select("variant_id", "document_id", "text", target.alias("target"))
