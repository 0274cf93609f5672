"""Span edits, metadata, resuming, timings and tables for figures."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import device

RETIRED = ["patient_name", "caregiver_names"]


def span_edits(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(document_id, begin, end, op, old, new) that turn predictions into gold; equal boundaries on one side are an error."""
    key = ["document_id", "begin", "end"]
    both = gold.select(*key, F.col("label").alias("new"), F.lit(1).alias("g")).unionByName(pred.select(*key, F.col("label").alias("old"), F.lit(1).alias("p")), allowMissingColumns=True)
    sides = both.groupBy(*key).agg(F.max("old").alias("old"), F.max("new").alias("new"), F.count("g").alias("g"), F.count("p").alias("p"))
    clash = F.raise_error(F.lit("duplicate span boundary")).cast("string")
    op = F.when((F.col("g") > 1) | (F.col("p") > 1), clash).when(F.col("p") == 0, "Addition").when(F.col("g") == 0, "Deletion").when(F.coalesce("old", F.lit("")) != F.coalesce("new", F.lit("")), "Edit")
    return sides.withColumn("op", op).where("op is not null").select(*key, "op", "old", "new")


def full_names(given: Column, family: Column, aliases: Column) -> Column:
    """Aliases, then "given family", trimmed, without blanks and repetitions, in order."""
    whole = F.concat_ws(" ", F.nullif(given, F.lit("")), F.nullif(family, F.lit("")))
    names = F.concat(F.coalesce(aliases, F.array().cast("array<string>")), F.array(whole))
    return F.array_distinct(F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n.isNotNull() & (n != "")))


def metadata(patient_first: Column, patient_last: Column, caregiver_first: Column, caregiver_last: Column, date: Column) -> Column:
    """struct(patient, caregivers, document_creation_date) from source columns; blank parts are null."""

    def person(first: Column, last: Column) -> Column:
        given, family = F.nullif(F.trim(first), F.lit("")), F.nullif(F.trim(last), F.lit(""))
        return F.when(given.isNotNull() | family.isNotNull(), F.struct(given.alias("given_name"), family.alias("family_name")))

    caregiver = person(caregiver_first, caregiver_last)
    return F.struct(person(patient_first, patient_last).alias("patient"), F.when(caregiver.isNotNull(), F.array(caregiver)).alias("caregivers"), F.nullif(date.cast("string"), F.lit("")).alias("document_creation_date"))


def checked_keys(keys: list[str]) -> list[str]:
    """Metadata keys; retired ones are an error."""
    if found := sorted(set(keys) & set(RETIRED)):
        raise ValueError(f"retired metadata key: {found}")
    return keys


def injected(docs: DataFrame) -> DataFrame:
    """(document_id, begin, end, label) of literal names that no span covers; ``docs`` has text, spans, patient, caregivers.

    patient and caregivers are arrays of names. Names of one character are passed over; what is added also blocks later
    names, so order matters and one document is worked on at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc in batch.itertuples():
                taken = [(s["begin"], s["end"]) for s in ([] if doc.spans is None else doc.spans)]
                text = doc.text or ""
                for label, names in (("Name:Patient", doc.patient), ("Name:Caregiver", doc.caregivers)):
                    for name in [] if names is None else names:
                        at = text.find(name) if len(name) > 1 else -1
                        while at >= 0:
                            if all(at + len(name) <= b or e <= at for b, e in taken):
                                taken.append((at, at + len(name)))
                                rows.append((doc.document_id, at, at + len(name), label))
                            at = text.find(name, at + len(name))
            yield pd.DataFrame(rows, columns=["document_id", "begin", "end", "label"])

    return docs.select("document_id", "text", "spans", "patient", "caregivers").mapInPandas(run, "document_id string, begin long, end long, label string")


def remaining(docs: DataFrame, done: DataFrame, key: str = "document_id") -> DataFrame:
    """Documents that a resumed run still has to do."""
    return docs.join(done.select(key), key, "left_anti")


def backfilled(docs: DataFrame, done: DataFrame, key: str = "document_id") -> DataFrame:
    """Every document with its spans; an empty array where there are none yet."""
    empty = F.array().cast(done.schema["spans"].dataType)
    return docs.select(key).join(done.select(key, "spans"), key, "left").withColumn("spans", F.coalesce("spans", empty))


def recorded(entries: DataFrame, measured: DataFrame) -> DataFrame:
    """Timings (model, device, seconds, source, ord) with new measurements (model, device, seconds) put in.

    The first measured entry of the same model and normalised device takes the new seconds; without one the measurement is
    appended. Other entries, manual ones above all, stay as they are.
    """
    new = measured.select("model", device(F.col("device")).alias("bucket"), F.round("seconds", 2).alias("new_seconds"))
    auto = F.col("source").eqNullSafe("measured")
    old = entries.withColumn("bucket", device(F.col("device")))
    nth = F.row_number().over(Window.partitionBy("model", "bucket", auto).orderBy("ord"))
    old = old.withColumn("hit", auto & (nth == 1))
    joined = old.join(new, ["model", "bucket"], "left")
    fresh = F.col("hit") & F.col("new_seconds").isNotNull()
    kept = joined.select("model", F.when(fresh, F.col("bucket")).otherwise(F.col("device")).alias("device"), F.when(fresh, F.col("new_seconds")).otherwise(F.col("seconds")).alias("seconds"), "source")
    added = new.join(old.where("hit").select("model", "bucket"), ["model", "bucket"], "left_anti").select("model", F.col("bucket").alias("device"), F.col("new_seconds").alias("seconds"), F.lit("measured").alias("source"))
    return kept.unionByName(added)


def denominators(rows: DataFrame, key: str, size: str) -> DataFrame:
    """The largest ``size`` of each key over all systems: what a heatmap's row is a share of."""
    return rows.groupBy(key).agg(F.max(size).alias("denominator"))


def pivoted(rows: DataFrame, key: str, value: str, systems: list[str]) -> DataFrame:
    """One column of ``value`` for each system; null where a system has no such row."""
    return rows.groupBy(key).pivot("system", systems).agg(F.max(value))
