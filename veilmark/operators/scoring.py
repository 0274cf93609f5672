"""Scores of predicted spans against gold spans: exact, by character, core data, over-redaction, and detail tables.

Gold documents have document_id, text, spans (array of struct begin, end, label, subannotations), has_nested and
subannotations (document level, used only where has_nested is false); predictions have document_id and spans.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import core_category, is_core
from ..session import settle
from .intervals import inside, measure, side, swept


class Flat(NamedTuple):
    """The exploded form that all measures start from."""

    docs: DataFrame  # document_id, size
    gold: DataFrame  # document_id, begin, end, label
    pred: DataFrame  # the same; only of documents in docs
    core: DataFrame  # document_id, label, category, begin, end


def last_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """For each key the row that came last by ``order``."""
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def resolved_id(*ids: str) -> Column:
    """The first id that is neither null, empty nor zero, as text; ``None`` if there is none."""
    texts = [F.col(i).cast("string") for i in ids]
    return F.coalesce(*[F.when((t != "") & (t != "0"), t) for t in texts], F.lit("None"))


def flattened(gold: DataFrame, pred: DataFrame) -> Flat:
    """Predictions of documents that are not in gold are left out; documents without predictions keep no spans there."""
    pred = pred.join(gold.select("document_id"), "document_id", "left_semi")
    spans = gold.select("document_id", "has_nested", F.explode("spans").alias("s")).select("document_id", "has_nested", "s.*")
    found = pred.select("document_id", F.explode("spans").alias("s")).select("document_id", "s.begin", "s.end", "s.label")
    nested = spans.where("has_nested").select("document_id", F.coalesce("label", F.lit("Unassigned")).alias("label"), F.explode("subannotations").alias("a"))
    legacy = gold.where("not has_nested").select("document_id", F.lit("Unassigned").alias("label"), F.explode("subannotations").alias("a"))
    core = nested.unionByName(legacy).select("document_id", "label", core_category(F.col("a.category")).alias("category"), "a.begin", "a.end")
    own = spans.select("document_id", "begin", "end", "label")
    texts = gold.select("document_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["end"])), F.lit(0)).alias("reach"))
    ends = pred.select("document_id", F.coalesce(F.array_max(F.transform("spans", lambda s: s["end"])), F.lit(0)).alias("pred_reach"))
    sized = texts.join(ends, "document_id", "left")
    size = F.when(F.col("size") > 0, F.col("size")).otherwise(F.greatest(F.lit(0), "reach", F.coalesce("pred_reach", F.lit(0)))).cast("long")
    return Flat(sized.select("document_id", size.alias("size")), own, found, core.where(is_core(F.col("category"))))


def kept(flat: Flat) -> Flat:
    """The same as one narrow table, written once: what takes several measures starts from it, not from the documents."""
    none = F.lit(None).cast("string")
    sides = [
        flat.docs.select("document_id", F.lit("d").alias("side"), F.lit(0).cast("bigint").alias("begin"), F.col("size").alias("end"), none.alias("label"), none.alias("category")),
        flat.gold.select("document_id", F.lit("g").alias("side"), "begin", "end", "label", none.alias("category")),
        flat.pred.select("document_id", F.lit("p").alias("side"), "begin", "end", "label", none.alias("category")),
        flat.core.select("document_id", F.lit("c").alias("side"), "begin", "end", "label", "category"),
    ]
    whole = settle(reduce(DataFrame.unionByName, sides))
    one = lambda side: whole.where(F.col("side") == side)
    spans = ["document_id", "begin", "end", "label"]
    return Flat(one("d").select("document_id", F.col("end").alias("size")), one("g").select(*spans), one("p").select(*spans), one("c").select("document_id", "label", "category", "begin", "end"))


def ratio(a: Column, b: Column, empty: float) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty))


def exact_scores(flat: Flat) -> DataFrame:
    """documents, exact_true_positive, exact_gold, exact_pred, exact_precision, exact_recall, exact_f1 (spans as sets)."""
    key = ["document_id", "begin", "end", "label"]
    both = side_flags(flat, key).groupBy(*key).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    sums = both.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(n) for x, n in ((F.col("g") * F.col("p"), "exact_true_positive"), (F.col("g"), "exact_gold"), (F.col("p"), "exact_pred"))])
    docs = flat.docs.agg(F.count("*").alias("documents"))
    tp, g, p = F.col("exact_true_positive"), F.col("exact_gold"), F.col("exact_pred")
    scored = docs.join(sums, how="cross").select("documents", "exact_true_positive", "exact_gold", "exact_pred", ratio(tp, p, 1.0).alias("exact_precision"), ratio(tp, g, 1.0).alias("exact_recall"))  # one row by one row
    pr = F.col("exact_precision") + F.col("exact_recall")
    return scored.withColumn("exact_f1", F.when(pr > 0, 2 * F.col("exact_precision") * F.col("exact_recall") / pr).otherwise(0.0))


def side_flags(flat: Flat, key: list[str]) -> DataFrame:
    gold = flat.gold.select(*key, F.lit(1).cast("long").alias("g"), F.lit(0).cast("long").alias("p"))
    return gold.unionByName(flat.pred.select(*key, F.lit(0).cast("long").alias("g"), F.lit(1).cast("long").alias("p")))


def char_scores(flat: Flat) -> DataFrame:
    """gold_chars, predicted_chars, matched_chars by label, summed, and the precision and recall."""
    keys = ["document_id", "label"]
    seg = swept(side(flat.gold, "g", keys).union(side(flat.pred, "p", keys)), keys, ["g", "p"])
    sums = seg.agg(measure(inside("g")).alias("gold_chars"), measure(inside("p")).alias("predicted_chars"), measure(inside("g"), inside("p")).alias("matched_chars"))
    m = F.col("matched_chars")
    return sums.select("*", ratio(m, F.col("predicted_chars"), 1.0).alias("character_precision"), ratio(m, F.col("gold_chars"), 1.0).alias("character_recall"))


def document_measures(flat: Flat) -> DataFrame:
    """document_id, core_total, core_matched, non_pii_characters, non_pii_redacted_chars; documents without any span too."""
    keys = ["document_id"]
    extent = flat.docs.select("document_id", F.lit("d").alias("side"), F.lit(0).cast("long").alias("begin"), F.col("size").alias("end"))
    parts = [side(flat.gold, "g", keys), side(flat.pred, "p", keys), side(flat.core, "c", keys), extent]
    seg = swept(reduce(DataFrame.unionByName, parts), keys, ["g", "p", "c", "d"])
    clear = inside("d") & (F.col("g") == 0)
    return seg.groupBy("document_id").agg(
        measure(inside("c")).alias("core_total"),
        measure(inside("c"), inside("p")).alias("core_matched"),
        measure(clear).alias("non_pii_characters"),
        measure(clear, inside("p")).alias("non_pii_redacted_chars"),
    )


def core_and_redaction(flat: Flat) -> DataFrame:
    """One row: core_pii_recall and non_pii_redaction_rate with the sums they come from."""
    names = ["core_total", "core_matched", "non_pii_characters", "non_pii_redacted_chars"]
    sums = document_measures(flat).agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in names])
    return sums.select(
        "*",
        ratio(F.col("core_matched"), F.col("core_total"), 1.0).alias("core_pii_recall"),
        ratio(F.col("non_pii_redacted_chars"), F.col("non_pii_characters"), 0.0).alias("non_pii_redaction_rate"),
    )


def score_summary(flat: Flat) -> DataFrame:
    """All headline numbers in one row, from spans that are written once."""
    return summed(kept(flat))


def summed(flat: Flat) -> DataFrame:
    """All headline numbers in one row, of spans that are written already."""
    chars = char_scores(flat).select("character_precision", "character_recall")
    rest = core_and_redaction(flat).select("core_pii_recall", "non_pii_redacted_chars", "non_pii_characters", "non_pii_redaction_rate")
    return exact_scores(flat).drop("exact_gold", "exact_pred").join(chars, how="cross").join(rest, how="cross")  # one row each


def core_recall_by(flat: Flat, column: str, name: str) -> DataFrame:
    """Recall of core data by gold label or category: (name, matched_core_pii_chars, total_core_pii_chars, core_pii_recall)."""
    keys = ["document_id", column]
    wanted = flat.core.select(*keys).distinct()
    against = flat.pred.select("document_id", "begin", "end").join(wanted, "document_id")
    seg = swept(side(flat.core, "c", keys).union(side(against, "p", keys)), keys, ["c", "p"])
    total, matched = measure(inside("c")), measure(inside("c"), inside("p"))
    found = seg.groupBy(column).agg(matched.alias("matched_core_pii_chars"), total.alias("total_core_pii_chars"))
    rows = flat.core.select(column).distinct().join(found, column, "left").na.fill(0)
    m, t = F.col("matched_core_pii_chars"), F.col("total_core_pii_chars")
    return rows.select(F.col(column).alias(name), m, t, F.when(t > 0, m / t).alias("core_pii_recall"))


def redaction_by_label(flat: Flat) -> DataFrame:
    """(prediction_label, non_pii_redacted_chars), labels without any such character too."""
    keys = ["document_id", "label"]
    wanted = flat.pred.select(*keys).distinct()
    gold = flat.gold.select("document_id", "begin", "end").join(wanted, "document_id")
    extent = flat.docs.select("document_id", F.lit(0).cast("long").alias("begin"), F.col("size").alias("end")).join(wanted, "document_id")
    seg = swept(side(flat.pred, "p", keys).union(side(gold, "g", keys)).union(side(extent, "d", keys)), keys, ["p", "g", "d"])
    found = seg.groupBy("label").agg(measure(inside("p"), inside("d"), F.col("g") == 0).alias("non_pii_redacted_chars"))
    return flat.pred.select("label").distinct().join(found, "label", "left").na.fill(0).withColumnRenamed("label", "prediction_label").select("prediction_label", "non_pii_redacted_chars")


def label_confusion_chars(flat: Flat) -> DataFrame:
    """(gold_label, prediction_label, chars) for every pair of labels that overlap."""
    keys = ["document_id", "gold_label", "prediction_label"]
    gold, pred = flat.gold.withColumnRenamed("label", "gold_label"), flat.pred.withColumnRenamed("label", "prediction_label")
    a = gold.join(pred.select("document_id", "prediction_label").distinct(), "document_id")
    b = pred.join(gold.select("document_id", "gold_label").distinct(), "document_id")
    seg = swept(side(a, "g", keys).union(side(b, "p", keys)), keys, ["g", "p"])
    return seg.groupBy("gold_label", "prediction_label").agg(measure(inside("g"), inside("p")).alias("chars")).where("chars > 0")


def exact_label_confusion(flat: Flat) -> DataFrame:
    """(gold_label, prediction_label, spans) of equal boundaries, counted with repetitions."""
    key = ["document_id", "begin", "end"]
    g = flat.gold.groupBy(*key, F.col("label").alias("gold_label")).agg(F.count("*").alias("n"))
    p = flat.pred.groupBy(*key, F.col("label").alias("prediction_label")).agg(F.count("*").alias("m"))
    return g.join(p, key).groupBy("gold_label", "prediction_label").agg(F.sum(F.col("n") * F.col("m")).alias("spans"))


def in_report_order(rows: DataFrame, size: str, *names: str) -> DataFrame:
    """Largest first, then by name: one name ignores case, a pair of names is compared as it is."""
    return rows.orderBy(F.desc(size), *([F.lower(names[0])] if len(names) == 1 else names))
