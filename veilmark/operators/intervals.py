"""Interval algebra on half-open [begin, end) spans by one sorted sweep for each key, without joins or positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coalesced(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping and touching spans of a key merged into (keys, begin, end); empty and inverted spans vanish."""
    ahead = Window.partitionBy(*keys).orderBy("begin", "end")
    reach = F.max("end").over(ahead.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.where("end > begin").select(*keys, "begin", "end", F.when(F.col("begin") <= reach, 0).otherwise(1).alias("opens"))
    numbered = marked.withColumn("island", F.sum("opens").over(ahead.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("island")


def swept(spans: DataFrame, keys: list[str], sides: list[str]) -> DataFrame:
    """Segments (keys, size, one depth for each side) between the boundaries of a key's spans.

    ``spans`` has keys, side, begin and end. One shuffle and one sort by key; spans may overlap within a side.
    """
    edges = F.explode(F.array(F.struct(F.col("begin").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("step"))))
    events = spans.where("end > begin").select(*keys, "side", edges.alias("e")).select(*keys, "side", "e.at", "e.step")
    order = Window.partitionBy(*keys).orderBy("at")
    upto = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    depth = [F.sum(F.when(F.col("side") == s, F.col("step")).otherwise(0)).over(upto).alias(s) for s in sides]
    return events.select(*keys, (F.lead("at").over(order) - F.col("at")).alias("size"), *depth).where("size > 0")


def measure(*conditions: Column) -> Column:
    """Total size of the segments where all conditions hold; 0 if there are none."""
    held = conditions[0]
    for c in conditions[1:]:
        held = held & c
    return F.coalesce(F.sum(F.when(held, F.col("size")).otherwise(0)), F.lit(0)).cast("long")


def inside(side: str) -> Column:
    return F.col(side) > 0


def side(spans: DataFrame, name: str, keys: list[str]) -> DataFrame:
    return spans.select(*keys, F.lit(name).alias("side"), F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"))
