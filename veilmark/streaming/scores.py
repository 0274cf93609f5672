"""Running scores: prediction files that arrive are scored once each, and sums of documents make the score at any time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import scoring

PREDICTIONS = "document_id string, spans array<struct<begin:bigint,end:bigint,label:string>>"


def start(spark: SparkSession, gold: DataFrame, arriving: str, measured: str, checkpoint: str) -> StreamingQuery:
    """Score each new JSON file of predictions against ``gold`` and add its documents' measures to ``measured``.

    A batch that is run again overwrites its own folder, so a document is never counted twice for one arrival.
    """
    incoming = spark.readStream.schema(PREDICTIONS).json(arriving)

    def add(batch: DataFrame, number: int) -> None:
        flat = scoring.flattened(gold.join(batch.select("document_id"), "document_id", "left_semi"), batch)
        scoring.document_measures(flat).write.mode("overwrite").parquet(f"{measured}/batch={number}")

    return incoming.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def so_far(spark: SparkSession, measured: str) -> DataFrame:
    """core_pii_recall and non_pii_redaction_rate over everything measured; the latest batch of a document counts."""
    rows = scoring.last_rows(spark.read.parquet(measured), "document_id", "batch")
    sums = rows.agg(*[F.sum(c).alias(c) for c in ("core_total", "core_matched", "non_pii_characters", "non_pii_redacted_chars")])
    return sums.select(
        "*",
        scoring.ratio(F.col("core_matched"), F.col("core_total"), 1.0).alias("core_pii_recall"),
        scoring.ratio(F.col("non_pii_redacted_chars"), F.col("non_pii_characters"), 0.0).alias("non_pii_redaction_rate"),
    )
