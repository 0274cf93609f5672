"""Quality rules: counts with fixed thresholds, and a calibrated logistic regression on hashed word and character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import labelled_sample, table

#: Fixed thresholds of the rules, and of the calibrated probability.
MIN_WORDS, MAX_REPEATED_PERCENT, MIN_PROBABILITY = 10, 20, 0.5
#: The bounded sample that is fitted on: whole documents of each class.
SAMPLE_DOCS = 1000
#: Hashed features of each family: words, pairs of words, character trigrams (of UTF-8 bytes).
DIM = 1 << 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 48:
            if len(self) > 200_000:
                self.clear()
            self[word] = value
        return value


def features(raw: bytes, hashes: np.ndarray) -> list[np.ndarray]:
    """Feature indices of each family for a text and the hashes of its words."""
    chars = np.frombuffer(raw, np.uint8).astype(np.uint32)
    trigrams = ((chars[:-2] << 16 | chars[1:-1] << 8 | chars[2:]) * np.uint32(2654435761)) >> np.uint32(16)
    pairs = (hashes[:-1] * _MIX + hashes[1:]) * _MIX
    return [(hashes >> np.uint64(48)).astype(np.int64), (pairs >> np.uint64(48)).astype(np.int64) + DIM, trigrams.astype(np.int64) + 2 * DIM]


def logit(weights: np.ndarray, bias: float, raw: bytes, hashes: np.ndarray) -> float:
    """bias plus each family's mean weight."""
    return bias + float(sum(weights[f].mean() for f in features(raw, hashes) if len(f)))


def vector(text: str, cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature indices of a whole text and their shares of their families; at most 3 * DIM, however long the text."""
    raw = text.encode("utf-8", "surrogatepass")
    index, value = [np.empty(0, np.int64)], [np.empty(0)]
    for family in features(raw, np.array([cache[w] for w in raw.split()], np.uint64)):
        if len(family):
            ids, n = np.unique(family, return_counts=True)
            index.append(ids)
            value.append(n / len(family))
    return np.concatenate(index), np.concatenate(value)


def train(found: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, share_good: float, epochs: int = 120) -> tuple[np.ndarray, float]:
    """Weights and bias with the calibration folded in: Platt scaling on every fourth row, weighted to the real shares."""
    if not len(found) or len(set(labels.tolist())) < 2:  # nothing to tell apart: the known share decides
        p = min(max(share_good, 0.01), 0.99)
        return np.zeros(3 * DIM, np.float32), float(np.log(p / (1 - p)))
    index, value = (np.concatenate([v[i] for v in found]) for i in (0, 1))
    row = np.repeat(np.arange(len(found)), [len(v[0]) for v in found])
    held = np.arange(len(found)) % 4 == 3
    good = labels == 1
    if len(set(labels[held].tolist())) < 2:
        held = np.ones(len(found), bool)
    fit = ~held if not held.all() else held
    balance = np.where(good, 0.5 / max(1, (good & fit).sum()), 0.5 / max(1, (~good & fit).sum())) * fit
    w, bias, seen = np.zeros(3 * DIM), 0.0, np.full(3 * DIM, 1e-8)
    for _ in range(epochs):  # AdaGrad on the whole sample
        z = np.bincount(row, w[index] * value, len(found)) + bias
        error = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - good)
        slope = np.bincount(index, error[row] * value, 3 * DIM) + 1e-6 * w
        seen += slope * slope
        w -= 0.7 * slope / np.sqrt(seen)
        bias -= 0.5 * error.sum()
    z = (np.bincount(row, w[index] * value, len(found)) + bias)[held]
    y = good[held]
    weight = np.where(y, share_good / max(1, y.sum()), (1 - share_good) / max(1, (~y).sum()))
    target = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's method on two parameters
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g, h = weight * (p - target), weight * p * (1 - p) + 1e-9
        hess = np.array([[(h * z * z).sum() + 1e-6, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        da, db = np.linalg.solve(hess, [(g * z).sum(), g.sum()])
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    a = max(a, 0.05)
    return (a * w).astype(np.float32), float(a * bias + b)


def vectors(text: Column) -> Column:
    """struct(index, value) of each whole text."""

    @F.pandas_udf("index array<int>, value array<float>")
    def apply(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache = WordHashes()
        for batch in texts:
            yield pd.DataFrame([vector(t, cache) for t in batch], columns=["index", "value"])

    return apply(text)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE_DOCS) -> tuple[np.ndarray, float]:
    """Fit in one task on the feature vectors of the bounded sample; the driver gets the weights, whose number is fixed."""
    shares = labels.where(F.col(label).isin(0, 1)).agg(F.avg(F.col(label))).first()[0]
    share = 0.5 if shares is None else float(shares)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"h": [], "index": [], "value": [], "label": []}), *batches]).sort_values(["h", "label"], kind="stable")
        w, bias = train([(np.asarray(i, np.int64), np.asarray(v, float)) for i, v in zip(rows["index"], rows["value"], strict=True)], rows["label"].to_numpy(int), share)
        yield pd.DataFrame({"w": [w.tobytes()], "bias": [bias]})

    sample = labelled_sample(docs, labels, label, per_class)
    made = sample.select(F.xxhash64("text").alias("h"), "label", vectors(F.col("text")).alias("v")).select("h", "label", "v.index", "v.value")
    found = made.repartition(1).mapInPandas(run, "w binary, bias double").first()
    if found is None:
        return train([], np.empty(0, int), share)
    return np.frombuffer(found["w"], np.float32), found["bias"]


def repeated_words(words: list[bytes], hashes: np.ndarray) -> int:
    """Words inside five-word windows found twice or more; windows of equal hashes are compared word by word."""
    n = len(words)
    if n <= 5:
        return 0
    grams = hashes[: n - 4].copy()
    for j in range(1, 5):
        grams = grams * _MIX + hashes[j : n - 4 + j]
    order = np.argsort(grams)
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return 0
    at = np.unique(np.concatenate((order[1:][same], order[:-1][same]))).tolist()
    found: dict[tuple, list[int]] = {}
    for i in at:
        found.setdefault(tuple(words[i : i + 5]), []).append(i)
    marks = np.zeros(n + 1, np.int64)
    for places in found.values():
        if len(places) > 1:
            np.add.at(marks, places, 1)
            np.add.at(marks, np.array(places) + 5, -1)
    return int((np.cumsum(marks) > 0).sum())


def judge(weights, bias: float):
    """A column function: struct of a text's counts, verdict of the rules, probability and final verdict."""
    columns = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"

    @F.pandas_udf(columns)
    def apply(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache, w = WordHashes(), weights.value
        for batch in texts:
            rows = []
            for text in batch:
                text = text or ""
                raw = text.encode("utf-8", "surrogatepass")
                words = raw.split()
                hashes = np.array(list(map(cache.__getitem__, words)), np.uint64)
                n = len(words)
                seen, dups = set(), 0
                for line in raw.split(b"\n"):
                    if line in seen:
                        dups += 1
                    elif line.strip():
                        seen.add(line)
                repeated = repeated_words(words, hashes)
                failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED_PERCENT * n
                p = float(1 / (1 + np.exp(-np.clip(logit(w, bias, raw, hashes), -30, 30))))
                word_chars = len(text) - (len(raw) - len(raw.translate(None, b" \t\n\x0b\x0c\r")))
                symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
                rows.append((n, word_chars, symbols, dups, repeated, failed, p, not failed and p >= MIN_PROBABILITY))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in columns.split(", ")])

    return apply


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id with counts, base_failed, probability and kept, a row for each input row (doc_id, text).

    Words are runs without ASCII white space; a duplicate line has a word and equals an earlier line; repeated words lie
    in five-word windows found twice or more. Null and empty texts have no words and fail the rules. Other columns and
    order do not matter; without usable labels the share of good labels (or one half) is everyone's probability.
    """
    spark = docs.sparkSession
    weights, bias = fit(docs, labels)
    return docs.select("doc_id", judge(spark.sparkContext.broadcast(weights), bias)(F.col("text")).alias("r")).select("doc_id", "r.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every document."""
    return judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
