"""Labels: normalised keys, categories, roles and matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Categories that are not core personal data; fixed values.
NOT_CORE = ["additional_info", "formatting", "medical_info", "time", "title"]
#: Fields of a span that may hold a label, in order; fixed values.
LABEL_FIELDS = ["label", "Category", "category", "type", "entity_label", "group", "SubType", "subtype", "subcategory"]


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor an empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def label_key(label: Column) -> Column:
    """Lower case without anything but ASCII letters and digits."""
    return F.regexp_replace(F.lower(label), "[^a-z0-9]+", "")


def category_key(label: Column) -> Column:
    return label_key(F.split_part(label, F.lit(":"), F.lit(1)))


def category_of(label: Column) -> Column:
    return F.split_part(label, F.lit(":"), F.lit(1))


def subtype_of(label: Column) -> Column:
    """What follows the first colon; null without one."""
    return F.when(F.instr(label, ":") > 0, label.substr(F.instr(label, ":") + 1, F.length(label)))


def role_of(label: Column) -> Column:
    key = label_key(label)
    return F.when(key == "namepatient", "patient").when(key == "namecaregiver", "caregiver")


def span_keys(fields: dict[str, Column]) -> Column:
    """All normalised label keys of a span whose label fields are given, among them category:subtype combined."""
    category = first_filled(fields["Category"], fields["category"])
    subtype = first_filled(fields["SubType"], fields["subtype"], fields["type"])
    combined = F.when(category.isNotNull() & subtype.isNotNull(), label_key(F.concat(category, F.lit(":"), subtype)))
    keys = F.array(*[label_key(fields[f]) for f in LABEL_FIELDS], combined)
    return F.array_distinct(F.filter(keys, lambda k: k.isNotNull() & (k != "")))


def matches(keys: Column, aliases: list[str]) -> Column:
    """Whether any alias, normalised, is part of any key."""
    wanted = F.array_distinct(F.transform(F.array(*[F.lit(a) for a in aliases]), label_key)) if aliases else F.array().cast("array<string>")
    return F.exists(keys, lambda k: F.exists(wanted, lambda a: F.contains(k, a)))


def core_category(category: Column) -> Column:
    """A trimmed category; blank ones are ``uncategorized``, a null one is ``None``."""
    return F.coalesce(F.nullif(F.trim(F.coalesce(category, F.lit("None"))), F.lit("")), F.lit("uncategorized"))


def is_core(category: Column) -> Column:
    return ~F.lower(category).isin(NOT_CORE)


def canonical_label(fields: dict[str, Column]) -> Column:
    category, subtype = first_filled(fields["Category"], fields["category"]), first_filled(fields["SubType"], fields["subtype"])
    both = F.when(category.isNotNull() & subtype.isNotNull(), F.concat(category, F.lit(":"), subtype))
    return F.coalesce(first_filled(fields["label"]), both, category, F.lit(""))


def label_value(fields: dict[str, Column]) -> Column:
    """The first filled of a span's label, category and type; empty without any."""
    return F.coalesce(first_filled(*[fields[f] for f in ("label", "Category", "category", "type")]), F.lit(""))
