"""Places in a total order without a task that holds it: counts for each part, offsets from them, joined back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle


def same(columns: list[str]) -> Column:
    """Columns equal their namesakes with an underscore, nulls included."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns], F.lit(True))


def placed(rows: DataFrame, family: list[str], by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_part`` and ``_rank`` (from 1 on in their family), and (family, _part, _rows): how many of a family each part has.

    ``by`` begins with the family. Rows are range partitioned and sorted by it and written once, so that each row's number
    inside its part stays what it was.
    """
    number = F.monotonically_increasing_id()
    held = settle(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_number", number).withColumn("_part", F.shiftright("_number", 33)))
    ends = held.groupBy(*family, "_part").agg(F.count("*").alias("_rows"), F.min("_number").alias("_first"))
    before = F.sum("_rows").over(Window.partitionBy(*family).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    ends = settle(ends.withColumn("_before", F.coalesce(before, F.lit(0))))
    at = ends.select(*[F.col(f).alias(f"_{f}") for f in family], F.col("_part").alias("_of"), "_first", "_before")
    ranked = held.join(at, same(family) & (F.col("_part") == F.col("_of")))
    return ranked.select(*rows.columns, "_part", (F.col("_number") - F.col("_first") + F.col("_before") + 1).alias("_rank")), ends.select(*family, "_part", "_rows")


def ordinals(rows: DataFrame, piece: str, at: str, name: str) -> DataFrame:
    """Rows with ``name``: their place from 0 on, pieces in order of ``piece``, inside a piece by ``at``, which counts up by one.

    One counting pass gives each piece's rows; there is a row for each piece of a file in the table of offsets.
    """
    counts = rows.groupBy(piece).agg(F.count("*").alias("_rows"), F.min(at).alias("_first"))
    before = F.sum("_rows").over(Window.orderBy(piece).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col(piece).alias("_piece"), "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    found = rows.join(offsets, F.col(piece) == F.col("_piece"))
    return found.withColumn(name, F.col("_before") + F.col(at) - F.col("_first")).drop("_piece", "_first", "_before")
