"""Battery input: documents with explicit metadata, made from another source's lines and read back.

Source rows have fields of any name, so they stay VARIANT: metadata objects are overlaid as maps of VARIANT and written
without their keys being named.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import RETIRED
from .documents import filled, lines, part

_MAP = "map<string,variant>"
#: Keys of metadata that post-processing takes as they are, where they are not null; fixed values.
PLAIN = ["document_creation_date", "date_shift_days", "known_values"]
#: Where metadata may come from; fixed values.
SOURCES = ["none", "from_input"]


@dataclass(frozen=True)
class Adapter:
    """Which fields of the source hold what; the defaults are fixed values."""

    text_field: str = "raw_text"
    id_field: str = "id"
    metadata_field: str | None = None
    metadata_fields: dict[str, str] = field(default_factory=dict)


def _person(first: Column, last: Column, initials: Column) -> Column:
    """A map of the parts that are there; null without any."""
    parts = [("given_name", F.trim(first)), ("family_name", F.trim(last)), ("initials", initials)]
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in parts]), lambda e: e["value"].isNotNull())
    return F.when(F.size(entries) > 0, F.map_from_entries(entries))


def as_variant(value: Column) -> Column:
    """A text as VARIANT; a null as the null that JSON has."""
    return F.variant_get(F.to_variant_object(F.array(value)), "$[0]", "variant")


def present(entries: list[tuple[str, Column, Column]]) -> Column:
    """map<string,variant> of those (key, there, value) that are there."""
    some = F.array(*[F.when(there, F.struct(F.lit(k).alias("key"), x.alias("value"))) for k, there, x in entries])
    return F.map_from_entries(F.filter(some, lambda e: e.isNotNull()))


def built(v: Column, fields: dict[str, str]) -> Column:
    """map<string,variant> of the metadata that the named source fields give."""
    get = lambda name: filled(v, fields.get(name))
    patient = _person(get("patient_first"), get("patient_last"), get("patient_initials"))
    caregiver = _person(get("caregiver_first"), get("caregiver_last"), F.lit(None).cast("string"))
    date = get("doc_date")
    return present(
        [
            ("patient", patient.isNotNull(), F.to_variant_object(patient)),
            ("caregivers", caregiver.isNotNull(), F.to_variant_object(F.array(caregiver))),
            ("document_creation_date", date.isNotNull(), as_variant(date)),
        ]
    )


def checked(metadata: Column) -> Column:
    """A map of metadata as it is; retired keys are an error."""
    clash = F.arrays_overlap(F.map_keys(metadata), F.array(*[F.lit(k) for k in RETIRED]))
    return F.when(clash, F.raise_error(F.lit("retired metadata key")).cast(_MAP)).otherwise(metadata)


def objects(v: Column) -> Column:
    """An object as a map; empty for anything else."""
    return F.coalesce(F.try_variant_get(v, "$", _MAP), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>")))


def adapted(rows: DataFrame, how: Adapter) -> DataFrame:
    """doc_id, text, metadata (map<string,variant>, null if empty), spans (VARIANT, null if empty) of source rows (ord, v).

    The id is the first filled one of the named field, doc_id and document_id, else empty. A missing text is empty, a null one stays
    null. Explicit metadata lies under what the fields give: a key that both have is the fields'.
    """
    v = F.col("v")
    text = F.when(part(v, how.text_field).isNull(), "").otherwise(part(v, how.text_field, "string"))
    named = F.coalesce(*[filled(v, n) for n in (how.id_field, "doc_id", "document_id")], F.lit(""))
    under = objects(part(v, how.metadata_field) if how.metadata_field else F.lit(None).cast("variant"))
    fields = built(v, how.metadata_fields)
    whole = checked(F.map_concat(F.map_filter(under, lambda k, _: ~F.array_contains(F.map_keys(fields), k)), fields))
    spans = part(v, "spans")
    some = F.size(F.coalesce(F.try_variant_get(spans, "$", "array<variant>"), F.array().cast("array<variant>"))) > 0
    return rows.select("ord", named.alias("doc_id"), text.alias("text"), F.when(F.size(whole) > 0, whole).alias("metadata"), F.when(some, spans).alias("spans"))


def adapt(spark: SparkSession, source: str | list[str], out: str, how: Adapter) -> DataFrame:
    """Write ``source`` as battery input and return the rows as written; absent metadata and spans have no key."""
    rows = adapted(lines(spark, source), how)
    always = F.lit(True)
    filled_in = [("metadata", F.col("metadata").isNotNull(), F.to_variant_object("metadata")), ("spans", F.col("spans").isNotNull(), F.col("spans"))]
    keys = present([("doc_id", always, as_variant(F.col("doc_id"))), ("text", always, as_variant(F.col("text"))), *filled_in])
    rows.select(F.to_json(keys).alias("value")).write.mode("overwrite").text(out)
    return read_input(spark, out)


def read_input(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """ord, doc_id, text, metadata (VARIANT), spans (VARIANT) of battery input; an id is doc_id, id or document_id, else empty."""
    v = F.col("v")
    named = F.coalesce(*[filled(v, n) for n in ("doc_id", "id", "document_id")], F.lit(""))
    text = F.when(part(v, "text").isNull(), "").otherwise(part(v, "text", "string"))
    return lines(spark, path).select("ord", named.alias("doc_id"), text.alias("text"), part(v, "metadata").alias("metadata"), part(v, "spans").alias("spans"))


def resolved(metadata: Column, source: str = "none") -> Column:
    """The metadata to use, as a map: none at all, or the explicit one of the input; never from annotations."""
    if source not in SOURCES:
        raise ValueError(f"unknown metadata source: {source!r} (supported: {SOURCES})")
    return checked(objects(metadata if source == "from_input" else F.lit(None).cast("variant")))


def postprocessed(metadata: Column) -> Column:
    """What post-processing takes of a map of metadata: a filled patient, caregivers that are objects, and PLAIN keys not null."""
    is_object = lambda x: F.schema_of_variant(x).startswith("OBJECT")
    null = lambda x: F.coalesce(F.is_variant_null(x), F.lit(True))

    def kept(key: Column, x: Column) -> Column:
        patient = (key == "patient") & is_object(x) & (F.size(objects(x)) > 0)
        listed = F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array().cast("array<variant>"))
        return F.when(key == "patient", patient).when(key == "caregivers", F.size(listed) > 0).otherwise(key.isin(PLAIN) & ~null(x))

    def shaped(key: Column, x: Column) -> Column:
        listed = F.filter(F.try_variant_get(x, "$", "array<variant>"), is_object)
        return F.when(key == "caregivers", F.to_variant_object(listed)).otherwise(x)

    return F.transform_values(F.map_filter(metadata, kept), shaped)
