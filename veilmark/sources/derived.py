"""Annotated documents derived from the given tables, which hold no annotations themselves.

Gold and predicted spans lie on a grid of 40 characters over each document; notes are written from orders. The same rules
are stated in SQL beside the queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.texts import DATE_PROFILES, date_rendered

SPAN = "struct<begin:bigint,end:bigint,label:string>"
_LABEL = "CASE i % 4 WHEN 0 THEN 'Name:Patient' WHEN 1 THEN 'Name:Caregiver' WHEN 2 THEN 'Date' ELSE 'Age_Birthdate' END"
_SLOTS = "CASE WHEN length(text) >= 40 THEN sequence(0L, bigint(length(text) div 40) - 1) ELSE array() END"
_B, _W = "(i * 40 + (i * 7 + doc_id) % 13)", "(4 + i % 9)"
#: How each system misses and mislabels.
SYSTEMS = {"alpha": (7, 6), "beta": (5, 4)}

FIRST_NAMES = ["Anna", "Bram", "Clara", "Dirk", "Elise", "Femke", "Gijs", "Hanne", "Ivo", "Jana", "Koen", "Lies"]
SURNAMES = ["Aerts", "Bakker", "Claes", "Dekker", "Evers", "Franssen", "Goossens", "Hermans", "Janssens", "Maes", "Peeters"]
PREFIXES = ["dr.", "mevr.", "dhr."]
INTERFIXES = ["van", "van den", "de"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; one of fewer parts than the session has cores is dealt out, since deriving spans is most of the work."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def gold_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, text, lang, spans, has_nested, subannotations; source ``src4`` has no gold, ``src5`` legacy subannotations."""

    def sub(b: str, e: str) -> str:
        second = "CASE WHEN i % 10 = 9 THEN '' WHEN i % 3 = 0 THEN 'family' WHEN i % 3 = 1 THEN 'formatting' ELSE ' Title ' END"
        return f"array(named_struct('begin', {b}, 'end', {b} + 2, 'category', 'given'), named_struct('begin', {b} + 2, 'end', {e}, 'category', {second}))"

    def span(b: str, e: str, label: str) -> str:
        return f"named_struct('begin', {b}, 'end', {e}, 'label', {label}, 'subannotations', {sub(b, e)})"

    plain, extra = span(_B, f"{_B} + {_W}", _LABEL), span(f"{_B} + 2", f"{_B} + {_W} + 6", "'Date'")
    arrays = f"concat(CASE WHEN i % 5 <> 3 THEN array({plain}) ELSE array() END, CASE WHEN i % 5 <> 3 AND i % 17 = 0 THEN array({plain}) ELSE array() END, CASE WHEN i % 11 = 4 THEN array({extra}) ELSE array() END)"
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL AND source <> 'src4'")
    docs = docs.select(F.col("doc_id").cast("string").alias("document_id"), "text", "lang", "source", F.expr(f"flatten(transform({_SLOTS}, i -> {arrays}))").alias("spans"))
    flat = F.flatten(F.transform("spans", lambda s: s["subannotations"]))
    return docs.select("document_id", "text", "lang", "spans", (F.col("source") != "src5").alias("has_nested"), flat.alias("subannotations"))


def predictions(spark: SparkSession, sf_dir: str, system: str = "alpha") -> DataFrame:
    """document_id, spans of a system; source ``src3`` has no predictions."""
    missed, wrong = SYSTEMS[system]

    def span(b: str, e: str, label: str) -> str:
        return f"named_struct('begin', {b}, 'end', {e}, 'label', {label})"

    main = span(_B, f"{_B} + {_W} + CASE WHEN i % 5 = 1 THEN 1 ELSE 0 END", f"CASE WHEN i % {wrong} = {wrong} - 1 THEN 'Name:Other' ELSE {_LABEL} END")
    arrays = f"concat(CASE WHEN i % {missed} <> 2 THEN array({main}) ELSE array() END, CASE WHEN i % 19 = 3 THEN array({span(f'{_B} + 1', f'{_B} + 1', chr(39) + 'Date' + chr(39))}) ELSE array() END, CASE WHEN i % 13 = 6 THEN array({span(f'{_B} + {_W} - 1', f'{_B} + {_W} + 9', chr(39) + 'ID:Patient' + chr(39))}) ELSE array() END)"
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL AND source <> 'src3'")
    return docs.select(F.col("doc_id").cast("string").alias("document_id"), F.expr(f"flatten(transform({_SLOTS}, i -> {arrays}))").alias("spans"))


def _pick(values: list[str], index) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, scope, text and spans (a name, a date, an age) of a short note for each order."""
    orders = table(spark, sf_dir, "orders")
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    first, last = _pick(FIRST_NAMES, customer % len(FIRST_NAMES)), _pick(SURNAMES, F.floor(customer / len(FIRST_NAMES)) % len(SURNAMES))
    form = key % 7
    name = (
        F.when(form == 0, F.concat_ws(" ", first, last))
        .when(form == 1, F.concat_ws(" ", last, first))
        .when(form == 2, first)
        .when(form == 3, last)
        .when(form == 4, F.concat_ws(", ", last, first))
        .when(form == 5, F.concat(F.substring(first, 1, 1), F.lit(". "), last))
        .otherwise(F.concat_ws(" ", F.lit("dr."), first, last))
    )
    name = F.when(key % 4 == 1, F.upper(name)).when(key % 4 == 2, F.lower(name)).otherwise(name)
    label = F.when(key % 3 == 0, "Name:Patient").when(key % 3 == 1, "Name:Caregiver").otherwise("Name:Other")
    written = F.coalesce(*[F.when(key % 8 == i, date_rendered(F.col("o_orderdate"), p)) for i, p in enumerate(DATE_PROFILES)])
    age = F.concat((customer % 90 + 1).cast("string"), F.lit(" jr"))
    rows = orders.select(key.cast("string").alias("document_id"), F.col("o_orderpriority").alias("scope"), name.alias("name"), label.alias("label"), written.alias("date"), age.alias("age"))
    text = F.concat(F.lit("Seen: "), F.col("name"), F.lit(" on "), F.col("date"), F.lit(". Age "), F.col("age"), F.lit("."))
    at_date = F.length("name") + 10
    at_age = at_date + F.length("date") + 6

    def span(begin, value: str, label) -> Column:
        return F.struct(begin.cast("long").alias("begin"), (begin + F.length(value)).cast("long").alias("end"), label.alias("label"))

    spans = F.array(span(F.lit(6), "name", F.col("label")), span(at_date, "date", F.lit("Date")), span(at_age, "age", F.lit("Age_Birthdate")))
    return rows.select("document_id", "scope", text.alias("text"), spans.alias("spans"))
