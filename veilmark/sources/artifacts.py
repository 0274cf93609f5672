"""Score artifacts as tables: N files, each a JSON object, scanned as VARIANT and numbered in the order given."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the detail tables; fixed values.
DETAILS = {
    "recall_by_gold_label": "gold_label string, matched_core_pii_chars bigint, total_core_pii_chars bigint, core_pii_recall double",
    "recall_by_subannotation_category": "subannotation_category string, matched_core_pii_chars bigint, total_core_pii_chars bigint, core_pii_recall double",
    "non_pii_redaction_by_predicted_label": "prediction_label string, non_pii_redacted_chars bigint",
    "label_confusion_chars": "gold_label string, prediction_label string, chars bigint",
    "exact_label_confusion": "gold_label string, prediction_label string, spans bigint",
}
#: Numbers that an artifact must have to be compared; fixed values.
NUMBERS = ["core_pii_recall", "exact_f1", "non_pii_redaction_rate"]


def read_artifacts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """number, name, seconds, device, method_type, NUMBERS and v, one row for each file.

    An artifact without a name is System <n>. Files that are no JSON object with the NUMBERS are an error.
    """
    files = [spark.read.text(p, wholetext=True).select(F.lit(i).alias("number"), F.parse_json("value").alias("v")) for i, p in enumerate(paths)]
    run = lambda key, kind="string": F.try_variant_get("v", f"$.run.{key}", kind)

    def number(key: str) -> Column:
        return F.coalesce(F.try_variant_get("v", f"$.{key}", "double"), F.raise_error(F.lit(f"score artifact without {key}")).cast("double"))

    name = F.coalesce(F.nullif(run("name"), F.lit("")), F.concat(F.lit("System "), (F.col("number") + 1).cast("string")))
    return reduce(DataFrame.unionAll, files).select("number", name.alias("name"), run("seconds", "double").alias("seconds"), run("device").alias("device"), run("method_type").alias("method_type"), *[number(n).alias(n) for n in NUMBERS], "v")


def detail(artifacts: DataFrame, table: str) -> DataFrame:
    """(number, name, and the columns of one of DETAILS): a row for each entry; a table that is absent has none."""
    kind = f"array<struct<{', '.join(':'.join(c.split()) for c in DETAILS[table].split(', '))}>>"
    rows = artifacts.select("number", "name", F.explode(F.variant_get("v", f"$.details.{table}", kind)).alias("d"))
    return rows.select("number", "name", "d.*")
