"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` once to the cluster's shared checkpoint folder and read it from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again, so that Spark knows its size.

    A join with it is broadcast only if its files are below ``spark.sql.autoBroadcastJoinThreshold``; otherwise both sides
    are shuffled.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """This application's part of the folder that the session names in spark.checkpoint.dir.

    Only a local session may do without that setting; it gets a temporary folder.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n; a null counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def joined_hash(parts: Column) -> Column:
    """Lowercase hex SHA-256 of an array of strings joined by commas."""
    return F.sha2(F.concat_ws(",", parts), 256)


#: Elements that ``running`` takes at a time.
BLOCK = 256


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def blocks(items: Column, size: int = BLOCK) -> Column:
    """An array cut into arrays of ``size`` elements; one empty array if there are none."""

    def cut(whole: Column) -> Column:
        last = F.floor((F.greatest(F.size(whole), F.lit(1)) - 1) / size).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(whole, i * size + 1, size))

    return let(items, cut)


def running(items: Column, start: Column, empty: Column, state: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column]) -> Column:
    """What ``out(state before, item)`` gives for each item, states following from ``state(state before, item)``.

    ``empty`` is an empty array of the output's type. Items are taken in blocks, since adding to an array copies it.
    """

    def block(outer: Column, some: Column) -> Column:
        step = lambda acc, x: F.struct(state(acc["at"], x).alias("at"), F.array_append(acc["out"], out(acc["at"], x)).alias("out"))
        done = lambda acc: F.struct(acc["at"].alias("at"), F.array_append(outer["out"], acc["out"]).alias("out"))
        return F.aggregate(some, F.struct(outer["at"].alias("at"), empty.alias("out")), step, done)

    whole = F.struct(start.alias("at"), F.slice(F.array(empty), 1, 0).alias("out"))
    return F.aggregate(blocks(items), whole, block, lambda acc: F.flatten(acc["out"]))


def below(counts: DataFrame, group: str, h: str, most: int) -> Column:
    """Whether the 64-bit hash ``h`` lies where about ``most`` of its group's rows do; ``counts`` has (group, n), few rows."""
    bound = F.lit(None).cast("long")
    for value, n in counts.collect():
        share = min(1.0, most / max(1, n))
        bound = F.when(F.col(group).eqNullSafe(F.lit(value)), F.lit(min(int(share * 2**64) - 2**63, 2**63 - 1))).otherwise(bound)
    return F.col(h) <= bound


def smallest_hashes(df: DataFrame, group: str, h: str, most: int) -> DataFrame:
    """The rows among the ``most`` smallest hashes ``h`` of their ``group``; ``h`` is distinct and even over 64 bits.

    Each group's count gives a bound under which twice as many rows are expected as are asked for, so the ranking sees
    a bounded number of rows however large the input. ``group`` takes few values: the driver gets a count for each.
    """
    few = df.where(below(df.groupBy(group).agg(F.count("*").alias("n")), group, h, 2 * most + 100))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(h))
    return few.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """Rows (text, label): at most ``per_class`` whole distinct texts of each label, those of smallest hash.

    The choice depends on the texts alone, so it is the same however the tables are partitioned, and copies and repeated
    rows count once. Rows without an id, text or label are left out.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").distinct()
    texts = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("h"))
    chosen = smallest_hashes(texts.join(known, "doc_id").select("label", "h").distinct(), "label", "h", per_class)
    found = docs.where("text is not null").select("text", F.xxhash64("text").alias("h"))
    # at most 2 * per_class rows by construction
    return found.join(F.broadcast(chosen), "h").groupBy("label", "h").agg(F.min("text").alias("text")).select("text", "label")
