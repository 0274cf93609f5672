"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root) for every linked node, root being the smallest node of its component.

    Every step is a minimum per node (combined before the shuffle) and an equi-join that Spark may split when one
    node has very many links; the table only ever holds as many rows as there are links. Self-links and repeated
    links are ignored; an empty table gives an empty result.
    """
    big, small = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    star = settle(links.where(F.col(a) != F.col(b)).select(big, small).distinct())
    before = None
    while True:
        now = star.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or not now[0]:
            return star.select(F.col("u").alias("node"), F.col("v").alias("root")).union(star.select("v", "v").distinct())
        before = now
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = settle(moved.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).union(least).distinct())
