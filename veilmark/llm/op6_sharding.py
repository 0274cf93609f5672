"""Sharding through fixed virtual slots and a versioned slot-to-shard map.

A record's slot depends on its id alone and never changes. Shards own slots; to balance bytes, or to add a shard, only
the map is edited, and every edit makes a new version.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, shared_folder, table

SLOTS = 4096
#: Each slot's rows are numbered in so many parts, so that no task has to hold a whole slot.
PARTS = 16


def slot_of(doc_id: Column, text_crc32: Column, size: Column, slots: int = SLOTS) -> Column:
    """The fixed virtual slot of a record: by id and text, so that null and repeated ids are spread like others."""
    return F.pmod(F.xxhash64(doc_id, text_crc32, size), F.lit(slots)).cast("int")


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 0: (version, slot, shard), equal runs of slots for each shard."""
    return spark.range(slots).select(F.lit(0).alias("version"), F.col("id").cast("int").alias("slot"), F.expr(f"int(id * {shards} div {slots})").alias("shard"))


def _released(weighed: DataFrame, target: Column) -> Column:
    """Whether a slot leaves its shard: largest slots stay first, as far as they fit into the target."""
    return F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot").rowsBetween(Window.unboundedPreceding, 0)) > target


def rebalanced(current: DataFrame, slot_bytes: DataFrame, shards: int) -> DataFrame:
    """The next version of a map, near equal in bytes: shards over their share release slots, smallest first, and each
    released slot, largest first, goes to the shard with the fewest bytes. Slots without records stay where they are.

    All work here is on one row for each slot, whatever the number of records.
    """
    weighed = current.join(slot_bytes.select("slot", "bytes"), "slot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    total = F.sum("bytes").over(Window.partitionBy())
    weighed = weighed.withColumn("target", total / shards)
    weighed = weighed.withColumn("moves", _released(weighed, F.col("target")) & (F.col("bytes") > 0))
    kept = F.collect_list(F.when(~F.col("moves"), F.struct("shard", "bytes")))
    loose = F.array_sort(F.collect_list(F.when(F.col("moves"), F.struct((-F.col("bytes")).alias("minus"), "slot"))))
    one = weighed.groupBy().agg(kept.alias("kept"), loose.alias("loose"))
    loads = F.aggregate(
        "kept",
        F.array_repeat(F.lit(0).cast("long"), shards),
        lambda acc, k: F.transform(acc, lambda load, i: load + F.when(i == k["shard"], k["bytes"]).otherwise(0)),
    )

    def place(acc: Column, x: Column) -> Column:
        to = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        put = F.transform(acc["loads"], lambda load, i: load - F.when(i == to, x["minus"]).otherwise(0))
        return F.struct(put.alias("loads"), F.array_append(acc["moved"], F.struct(x["slot"].alias("slot"), to.alias("to"))).alias("moved"))

    start = F.struct(F.col("loads").alias("loads"), F.array().cast("array<struct<slot:int,to:int>>").alias("moved"))
    moved = one.select("loose", loads.alias("loads")).select(F.explode(F.aggregate("loose", start, place, lambda acc: acc["moved"])).alias("m")).select("m.*")
    return current.join(moved, "slot", "left").select((F.col("version") + 1).alias("version"), "slot", F.coalesce("to", "shard").alias("shard"))


def grown(current: DataFrame, slot_bytes: DataFrame, shards: int) -> DataFrame:
    """The next version with shard ``shards`` added: each shard keeps its share of bytes and releases slots to the new one only."""
    weighed = current.join(slot_bytes.select("slot", "bytes"), "slot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    target = F.sum("bytes").over(Window.partitionBy("shard")) * shards / (shards + 1)
    weighed = weighed.withColumn("target", target)
    shard = F.when(_released(weighed, F.col("target")) & (F.col("bytes") > 0), F.lit(shards)).otherwise(F.col("shard"))
    return weighed.select((F.col("version") + 1).alias("version"), "slot", shard.alias("shard"))


def store_map(current: DataFrame, path: str) -> None:
    """Add a version to a stored map; earlier versions stay readable."""
    current.write.mode("append").partitionBy("version").parquet(path)


def stored_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of a stored map; the latest by default."""
    maps = spark.read.parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == version).select("version", "slot", "shard").coalesce(1)


def shard_documents(docs: DataFrame, shards: int = 40, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, version: a row for each input row.

    The law is ``bytes``: shards are near equal in bytes, as far as single slots allow. size is the UTF-8 length of the
    text plus 16; a null text has no bytes and the checksum of an empty one. slot is the row's place in its shard,
    gapless from 0, by virtual slot, part, id (null first), checksum and size; equal rows are in any order. Rows that
    are equal in id and text share a virtual slot, so very many of them weigh one shard down; null and repeated ids with other
    texts do not. Repeated rows each get a place of their own; other columns are left out; an empty table gives an empty result.

    The map is kept at ``path``, in the shared folder by default: version 0 if there is none yet, then a version rebalanced by
    the bytes of ``docs``, which the rows are placed by as it is read back.
    """
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}"
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    sized = settle(sized.withColumn("virtual_slot", slot_of(F.col("doc_id"), F.col("text_crc32"), F.col("size"), slots)).withColumn("part", F.pmod(F.xxhash64("text_crc32", "doc_id"), F.lit(PARTS)).cast("int")))
    counts = settle(sized.groupBy("virtual_slot", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    per_slot = counts.groupBy(F.col("virtual_slot").alias("slot")).agg(F.sum("bytes").alias("bytes"))
    try:
        current = stored_map(spark, path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        store_map(first_map(spark, shards, slots), path)
        current = stored_map(spark, path)
    store_map(settle(rebalanced(current, per_slot, shards)), path)
    final = stored_map(spark, path)
    places = counts.join(final.withColumnRenamed("slot", "virtual_slot"), "virtual_slot")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1))
    places = places.select("virtual_slot", "part", "shard", "version", F.coalesce(before, F.lit(0)).alias("before"))
    order = Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size")
    numbered = sized.withColumn("place", F.row_number().over(order) - 1)
    # at most slots * PARTS rows, whatever the input
    placed = numbered.join(F.broadcast(places), ["virtual_slot", "part"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "version"
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and place of every document."""
    return shard_documents(table(spark, sf_dir, "documents"))
