"""An append log of finished documents with batches that count once, and what a resumed run asks of it.

Each batch is written under its own number, then a commit row for it, last of all: a batch that was cut off has no commit and
is not read, and one that is written again replaces what was there. So replayed batches, killed runs and lost executors
leave the rows of one run. Later batches win.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ROWS = "doc_id string, num_entities bigint, entities array<struct<begin:bigint,end:bigint,label:string>>, batch bigint"


def _there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines under ``path``; no rows if there is nothing yet."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def record(found: DataFrame, log: str | None, batch: int) -> None:
    """Write (document_id, spans) as one batch of the log; nothing without a log."""
    if not log:
        return
    rows = found.select(F.col("document_id").alias("doc_id"), F.size("spans").cast("bigint").alias("num_entities"), F.col("spans").alias("entities"))
    rows.write.mode("overwrite").json(f"{log}/rows/batch={batch}")
    found.sparkSession.createDataFrame([(batch,)], "number bigint").coalesce(1).write.mode("overwrite").json(f"{log}/commits/batch={batch}")


def committed(spark: SparkSession, log: str) -> DataFrame:
    """(batch): the batches that were written to their end."""
    return _there(spark, f"{log}/commits", "number bigint").where("number is not null").select(F.col("number").alias("batch")).distinct()


def finished(spark: SparkSession, log: str | None) -> DataFrame:
    """(document_id, spans) of all committed batches; a document of several batches as the last has it. Nothing without a log."""
    if not log:
        return spark.createDataFrame([], ROWS).select(F.col("doc_id").alias("document_id"), F.col("entities").alias("spans"))
    rows = _there(spark, f"{log}/rows", ROWS).join(committed(spark, log), "batch").where("doc_id is not null")
    return rows.groupBy(F.col("doc_id").alias("document_id")).agg(F.max_by("entities", "batch").alias("spans"))


def has(documents: DataFrame, log: str | None) -> DataFrame:
    """Documents (document_id, ...) that the log already has."""
    return documents.join(finished(documents.sparkSession, log).select("document_id"), "document_id", "left_semi")


def todo(documents: DataFrame, log: str | None) -> DataFrame:
    """Documents that are still to be done."""
    return documents.join(finished(documents.sparkSession, log).select("document_id"), "document_id", "left_anti")


def n_done(spark: SparkSession, log: str | None) -> int:
    return finished(spark, log).count()


def in_order(documents: DataFrame, found: DataFrame, order: str) -> DataFrame:
    """(order, document_id, spans): every document once, in the order of the input, with an empty array where there are no spans."""
    empty = F.array().cast(found.schema["spans"].dataType)
    joined = documents.select(order, "document_id").join(found.select("document_id", "spans"), "document_id", "left")
    return joined.select(order, "document_id", F.coalesce("spans", empty).alias("spans")).orderBy(order)


def resume(documents: DataFrame, log: str, predict: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Do what is left and log it as the next batch; (document_id, spans) of all documents done so far.

    ``predict`` turns documents into (document_id, spans) and is not called if nothing is left.
    """
    spark = documents.sparkSession
    left = todo(documents, log)
    if not left.isEmpty():
        last = committed(spark, log).agg(F.max("batch")).first()[0]
        record(predict(left), log, 0 if last is None else last + 1)
    return finished(spark, log)


def follow(documents: DataFrame, log: str, checkpoint: str, predict: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Log a stream of documents batch by batch; ``checkpoint`` and the batch's number make every batch count once."""

    def write(rows: DataFrame, batch: int) -> None:
        record(predict(rows), log, batch)

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
