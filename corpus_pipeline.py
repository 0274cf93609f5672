"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Every stage keeps the columns of ``documents`` (the last one returns digests), hands other columns on, and takes null ids and
texts, repeated rows and empty tables. Decisions are made on ids, hashes and spans and stored; texts meet them in one join,
which Spark broadcasts only if the stored table is small.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.common import crc_mod, shared_folder, stored, table
from veilmark.llm.op2_pii import redact_documents
from veilmark.llm.op3_decontaminate import contamination
from veilmark.llm.op4_sentencepiece import encode_documents, model_bytes
from veilmark.llm.op7_language import learn, predictor
from veilmark.llm.op9_simhash import near_duplicates


def _key() -> Column:
    """Identifies a row by its id (null last) and text, so that null and repeated ids are told apart."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("h"))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc, key): all columns of a row as one struct, so that no helper column can clash with theirs."""
    return docs.select(F.struct(*docs.columns).alias("doc"), _key().alias("key"))


def _unkeyed(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ``lang`` set to the language that their texts are parsed as; ``und`` goes.

    ``und`` are null texts and texts without a letter. A low score alone rejects nothing: it mostly marks clean documents in
    more than one language. Without a column lang nothing can be learnt, and it is an error. Repeated rows stay.
    """
    # Spark would move the filter on a deterministic prediction below it and parse every text twice, in two workers
    predict = predictor(learn(docs.where(crc_mod("doc_id", 5) != 0))).asNondeterministic()
    said = docs.select(F.struct(*docs.columns).alias("doc"), predict(F.col("text"))["lang_pred"].alias("said")).where("said != 'und'")
    return said.select(*[F.col("said" if c == "lang" else f"doc.`{c}`").alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id (null last; then by hash of the text).

    Of repeated rows one stays. Null and empty texts have one fingerprint, so one of them stays too.
    """
    found = near_duplicates(docs.select(_key().alias("doc_id"), "text"))
    counts = found.groupBy(F.col("doc_id").alias("key")).agg(F.max(F.col("doc_id") != F.col("component_id")).alias("later"), F.count("*").alias("n"))
    judged = stored(counts.where("later or n > 1"))
    rows = _keyed(docs)
    single = rows.join(judged.select("key"), "key", "left_anti")
    repeated = rows.join(judged.where("not later").select("key"), "key", "left_semi").dropDuplicates(["key"])
    return _unkeyed(single.select("doc").union(repeated.select("doc")), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up less than a twentieth; repeated rows are judged alike."""
    found = contamination(docs.select(_key().alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    gone = stored(found.where("contaminated").select(F.col("doc_id").alias("key")).distinct())
    return _unkeyed(_keyed(docs).join(gone, "key", "left_anti"), docs)


def remove_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind; repeated rows are treated alike."""
    return redact_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with token counts and digests of its ids and decoded text, a row for each row; other columns are left out."""
    return encode_documents(docs, model_bytes())


STAGES = [("language_id", language), ("simhash_near_dedup", near_dedup), ("benchmark_decontamination", decontaminate), ("pii", remove_pii), ("sentencepiece", encode)]

#: Language identification and near-duplicate components are not expressible in SQL; see the brute-force test.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage but the last is written to the shared folder and read from there."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
