"""Readers and writers of JSON Lines documents with their loose schema, by way of VARIANT.

Whether a key is present matters here (a null is not a missing key), and so does letter case, so lines are parsed as
VARIANT and projected. A malformed line is an error; blank lines are passed over. Later rows of an id win.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import LABEL_FIELDS, canonical_label, first_filled, matches, span_keys
from ..operators.order import ordinals
from ..operators.scoring import last_rows

_SUB = "array<struct<begin:bigint,end:bigint,category:string>>"


def lines(spark: SparkSession, path: str | list[str], torn: bool = False) -> DataFrame:
    """(ord, v): a VARIANT for each line that is not blank; ``ord`` sorts in reading order: paths as given, files by name, lines.

    Lines that are not JSON are an error, or passed over with ``torn``: what is left of a write that was cut off.
    """
    parse = F.try_parse_json if torn else F.parse_json
    parts = []
    for i, one in enumerate([path] if isinstance(path, str) else path):
        text = spark.read.text(one).select("value", "_metadata.file_path", "_metadata.file_block_start").where("trim(value) <> ''")
        piece = F.struct(F.lit(i).alias("source"), F.col("file_path").alias("file"), F.col("file_block_start").alias("block"))
        parts.append(text.select(F.struct(piece.alias("piece"), F.monotonically_increasing_id().alias("at")).alias("ord"), parse("value").alias("v")))
    return reduce(DataFrame.unionAll, parts)


def numbered(rows: DataFrame, name: str = "number") -> DataFrame:
    """Rows of ``lines`` with their place from 0 on over all files, found from counts by file and block."""
    flat = rows.select("*", F.col("ord.piece").alias("_of"), F.col("ord.at").alias("_at"))
    return ordinals(flat, "_of", "_at", name).drop("_of", "_at")


def field(path: str, kind: str = "string", of: str = "v") -> Column:
    return F.try_variant_get(F.col(of) if isinstance(of, str) else of, f"$.{path}", kind)


def has_key(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant").isNotNull()


def part(v: Column, name: str, kind: str = "variant") -> Column:
    """A field by its name, whatever characters that has."""
    quoted = name.replace("\\", "\\\\").replace("'", "\\'")
    return F.try_variant_get(v, f"$['{quoted}']", kind)


def filled(v: Column, name: str | None) -> Column:
    """A field as text; null where it is absent, null, empty, zero or false."""
    if not name:
        return F.lit(None).cast("string")
    text = part(v, name, "string")
    number = part(v, name, "double")
    is_text = F.schema_of_variant(part(v, name)) == "STRING"
    return F.when((text != "") & (is_text | ~F.coalesce(number == 0, F.lit(False))) & (is_text | (text != "false")), text)


def identity(*names: str, default: Column | None = None) -> Column:
    """The first of the fields that is filled, as text; ``default`` or ``None`` without any."""
    return F.coalesce(*[filled(F.col("v"), n) for n in names], F.lit("None") if default is None else default)


def _whole(name: str, v: Column) -> Column:
    """An offset as a whole number; anything else is an error."""
    value = F.coalesce(F.try_variant_get(v, f"$.{name}", "bigint"), F.floor(F.try_variant_get(v, f"$.{name}", "double")).cast("bigint"))
    return F.coalesce(value, F.raise_error(F.lit(f"span without a valid {name}")).cast("bigint"))


def read_gold(spark: SparkSession, path: str | list[str], first: int = 0, ordinal: bool = False) -> DataFrame:
    """document_id, text, spans, has_nested, subannotations as scoring takes them; of the ``first`` documents read, or all.

    With ``ordinal`` a document without an id is doc_<n>, n its place in reading order from 0 on, and ``id`` counts as an id.
    """
    rows = lines(spark, path)
    if ordinal:
        rows = numbered(rows)
    names = ("document_id", "doc_id", "id") if ordinal else ("document_id", "doc_id")
    named = identity(*names, default=F.concat(F.lit("doc_"), F.col("number").cast("string")) if ordinal else None)
    spans = F.coalesce(F.try_variant_get("v", "$.spans", "array<variant>"), F.array().cast("array<variant>"))

    def subs(v: Column) -> Column:
        found = F.coalesce(F.try_variant_get(v, "$.subannotations", "array<variant>"), F.array().cast("array<variant>"))

        def one(a: Column) -> Column:
            category = F.when(has_key(a, "category"), F.coalesce(F.try_variant_get(a, "$.category", "string"), F.lit("None"))).otherwise("uncategorized")
            return F.struct(_whole("begin", a).alias("begin"), _whole("end", a).alias("end"), category.alias("category"))

        return F.transform(found, one)

    def span(v: Column) -> Column:
        label = F.coalesce(F.try_variant_get(v, "$.label", "string"), F.raise_error(F.lit("span without a label")).cast("string"))
        return F.struct(_whole("begin", v).alias("begin"), _whole("end", v).alias("end"), label.alias("label"), subs(v).alias("subannotations"))

    text = F.when(has_key(F.col("v"), "text"), F.coalesce(field("text"), F.lit("None"))).otherwise("")
    docs = rows.select(
        "ord",
        named.alias("document_id"),
        text.alias("text"),
        F.transform(spans, span).alias("spans"),
        F.exists(spans, lambda s: has_key(s, "subannotations")).alias("has_nested"),
        subs(F.col("v")).alias("subannotations"),
    )
    last = last_rows(docs, "document_id", "ord")
    return (last.orderBy("ord").limit(first) if first > 0 else last).drop("ord")


def span_objects(v: Column) -> Column:
    """The objects in a row's list of spans as array<variant>; what is no list, and what is no object in it, counts as nothing."""
    listed = F.coalesce(F.try_variant_get(v, "$.spans", "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(listed, lambda s: F.coalesce(F.schema_of_variant(s).startswith("OBJECT"), F.lit(False)))


def _offset(s: Column, *names: str) -> Column:
    """An offset under the first of the names that is present, as a whole number; null if it is none, -1 without any."""
    out = F.lit(-1).cast("bigint")
    for name in reversed(names):
        whole = F.coalesce(F.try_variant_get(s, f"$.{name}", "bigint"), F.try_variant_get(s, f"$.{name}", "double").cast("bigint"))
        out = F.when(has_key(s, name), whole).otherwise(out)
    return out


def read_target_spans(spark: SparkSession, path: str | list[str], labels: list[str]) -> DataFrame:
    """(document_id, place, begin, end, label, text) of the spans whose labels match, cut out of their texts.

    Offsets are ``begin`` or ``start``, and ``end``; spans with offsets that are no numbers, are empty or lie outside the text are passed
    over, and so is what is no object. ``place`` counts a document's objects; ``label`` is the canonical one.
    """
    rows = numbered(lines(spark, path))
    named = identity("document_id", "doc_id", "id", default=F.concat(F.lit("doc_"), F.col("number").cast("string")))
    text = F.coalesce(field("text"), F.lit(""))
    spans = rows.select(named.alias("document_id"), text.alias("whole"), F.posexplode(span_objects(F.col("v"))).alias("place", "s"))
    fields = {f: F.try_variant_get("s", f"$.{f}", "string") for f in LABEL_FIELDS}
    found = spans.where(matches(span_keys(fields), labels)).select("document_id", "place", "whole", _offset(F.col("s"), "begin", "start").alias("begin"), _offset(F.col("s"), "end").alias("end"), canonical_label(fields).alias("label"))
    found = found.where("begin >= 0 and end > begin and end <= length(whole)")
    return found.select("document_id", "place", "begin", "end", "label", F.substring("whole", F.col("begin").cast("int") + 1, (F.col("end") - F.col("begin")).cast("int")).alias("text"))


def read_predictions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """document_id, spans."""
    return read_gold(spark, path).select("document_id", F.transform("spans", lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"), s["label"].alias("label"))).alias("spans"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, text) from lines, a JSON list of rows, or a JSON object of texts or of objects with a text.

    Files whose names say that they hold lines are never read whole.
    """
    if path.endswith((".jsonl", ".jsonl.gz", ".ndjson")):
        return _with_text(lines(spark, path))
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    kind = whole.select(F.schema_of_variant("v")).first()
    if kind and kind[0] and kind[0].startswith("ARRAY"):
        rows = whole.select(F.explode(F.variant_get("v", "$", "array<variant>")).alias("v"))
    elif kind and kind[0] and kind[0].startswith("OBJECT") and not has_document(whole):
        entries = whole.select(F.explode(F.variant_get("v", "$", "map<string,variant>")).alias("id", "v"))
        return entries.select(F.col("id").alias("document_id"), F.coalesce(first_filled(field("text"), field("plain_text")), F.when(F.schema_of_variant("v") == "STRING", F.try_variant_get("v", "$", "string")), F.lit("")).alias("text"))
    else:
        rows = lines(spark, path)
    return _with_text(rows)


def _with_text(rows: DataFrame) -> DataFrame:
    return rows.select(identity("document_id", "doc_id", "id").alias("document_id"), F.coalesce(first_filled(field("text"), field("plain_text")), F.lit("")).alias("text"))


def has_document(whole: DataFrame) -> bool:
    return whole.where(has_key(F.col("v"), "document_id") | has_key(F.col("v"), "doc_id")).count() > 0


def read_finished(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, spans) of a resume log; torn lines are passed over, later ones win."""
    kind = "array<struct<begin:bigint,end:bigint,label:string>>"
    found = lines(spark, path, torn=True).where("v is not null")
    found = found.select("ord", field("doc_id").alias("document_id"), F.coalesce(F.try_variant_get("v", "$.entities", kind), F.array().cast(kind)).alias("spans"))
    return last_rows(found.where("document_id is not null"), "document_id", "ord").drop("ord")


def with_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (document_id, text, plain_text) with the first filled text of their own, else the one from ``texts``, else empty."""
    found = rows.join(texts.select("document_id", F.col("text").alias("_text")), "document_id", "left")
    return found.withColumn("text", F.coalesce(first_filled(F.col("text"), F.col("plain_text"), F.col("_text")), F.lit(""))).drop("_text", "plain_text")


def write_entities(found: DataFrame, path: str) -> None:
    """document_id, spans as lines with doc_id, num_entities and entities; the committer makes the write atomic."""
    found.select(F.col("document_id").alias("doc_id"), F.size("spans").alias("num_entities"), F.col("spans").alias("entities")).write.json(path)


def write_table(rows: DataFrame, path: str, mode: str = "error") -> None:
    """A CSV with a header."""
    rows.write.mode(mode).option("header", True).csv(path)


def write_lines(rows: DataFrame, path: str) -> None:
    """Rows as JSON Lines with all their fields, nested ones too: variants, predictions; the committer makes the write atomic."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)
