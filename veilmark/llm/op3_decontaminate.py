"""Benchmark decontamination by winnowing.

Of every 6 consecutive 8-gram hashes the smallest is kept, on both sides, so each shared run of 13 words shares a kept
hash. A fixed-size bitmap of the benchmark's kept hashes lets a document task pass over almost everything; around what
is left, hits are extended to the 13-word windows that hold them, which are joined exactly with the benchmark's windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined_hash, settle, table

WINDOW = 13
GRAM = 8
#: Bits of the bitmap, as a power of two; its size does not depend on the benchmark's.
FILTER_BITS = 25
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters A-Z lower-cased, and all characters beyond ASCII, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


def kept_grams(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that winnowing keeps so that each ``window`` words hold one.

    Windows of 8 words or fewer are grams themselves and all kept.
    """
    k = min(GRAM, window)
    n, w = len(hashes) - k + 1, window - k + 1
    if n < w:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    rolled = np.zeros(n, np.uint64)
    for j in range(k):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    rolled ^= rolled >> np.uint64(29)
    rolled = rolled * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(window)
    rolled ^= rolled >> np.uint64(32)
    if w == 1:
        return np.arange(n), rolled
    ends = np.arange(w - 1, n)
    at = ends - np.lib.stride_tricks.sliding_window_view(rolled, w)[:, ::-1].argmin(axis=1)
    at = at[np.concatenate(([True], at[1:] != at[:-1]))]
    return at, rolled[at]


def window_key(words: list[bytes], start: int, length: int) -> bytes:
    return blake2b(b" ".join(words[start : start + length]), digest_size=16).digest()


def _item_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every window of an item with the kept hashes inside it, so that one pass serves the bitmap and the join."""
    cache = WordHashes()
    for batch in batches:
        rows = []
        for item, text in zip(batch["item_id"], batch["text"], strict=True):
            words = words_of(text)
            length = min(WINDOW, len(words))
            if length:
                _, kept = kept_grams(np.array([cache[w] for w in words], np.uint64), length)
                bits = (kept & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
                keys = list(dict.fromkeys(window_key(words, s, length) for s in range(len(words) - length + 1)))
                rows += [(item, length, key, bits if i == 0 else bits[:0]) for i, key in enumerate(keys)]
        yield pd.DataFrame(rows, columns=["item_id", "length", "key", "bits"])


def _scanner(lengths: list[int], bitmap) -> Callable:
    @F.pandas_udf("n_words long, hits array<struct<start:int,length:int,key:binary>>")
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache, known = WordHashes(), bitmap.value
        for batch in texts:
            counts, found = [], []
            for text in batch:
                words = words_of(text)
                hashes = np.array(list(map(cache.__getitem__, words)), np.uint64)
                hits = []
                for length in lengths:
                    at, kept = kept_grams(hashes, length)
                    index = (kept & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
                    at = at[(known[index >> 3] >> (index & 7)) & 1 == 1]
                    if len(at):
                        reach = np.arange(length - min(GRAM, length), -1, -1)
                        starts = np.unique((at[:, None] - reach).ravel())
                        starts = starts[(starts >= 0) & (starts <= len(words) - length)]
                        hits += [(s, length, window_key(words, s, length)) for s in starts.tolist()]
                counts.append(len(words))
                found.append(hits)
            yield pd.DataFrame({"n_words": counts, "hits": found})

    return scan


def _bitmap(items: DataFrame) -> np.ndarray:
    """The benchmark's kept hashes as a bitmap of fixed size; what reaches the driver has at most 2**FILTER_BITS / 32 rows."""
    bit = items.select(F.explode("bits").alias("bit"))
    ints = bit.groupBy(F.expr("bit div 32").alias("at")).agg(F.expr("bit_or(shiftleft(1L, int(bit % 32)))").alias("bits"))
    rows = ints.toPandas()
    out = np.zeros((1 << FILTER_BITS) // 32, np.uint32)
    out[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).astype(np.uint32)
    return out.view(np.uint8)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text) against ``benchmark`` (item_id, text).

    doc_id, n_words, n_hit (words inside an occurrence of a benchmark window), items (sorted array of the ids, as
    strings, of items with an occurring window), contaminated (n_hit > 0 and at least a twentieth of the words).
    Null and empty texts have no words and no windows; items without words are passed over; null item ids are left out
    of ``items`` but their windows still hit. Repeated rows each get a result, other columns are ignored, and an empty
    benchmark leaves every document clean.
    """
    spark = docs.sparkSession
    items = settle(benchmark.select("item_id", "text").mapInPandas(_item_windows, f"item_id {benchmark.schema['item_id'].dataType.simpleString()}, length int, key binary, bits array<long>"))
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())  # at most 13
    scan = _scanner(lengths, spark.sparkContext.broadcast(_bitmap(items)))
    scanned = settle(docs.select("doc_id", scan(F.col("text")).alias("r")).select(F.monotonically_increasing_id().alias("row"), "doc_id", "r.n_words", "r.hits"))
    hits = scanned.where(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select("row", "h.*")
    windows = items.select("length", "key").distinct()
    real = hits.join(windows, ["length", "key"])
    spans = F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("length")).alias("stop"))))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["to"], s["stop"]).alias("to"), (a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(a["to"], s["start"]))).alias("n")),
        lambda a: a["n"],
    )
    n_hit = real.groupBy("row").agg(spans.alias("spans")).select("row", covered.alias("n_hit"))
    held = hits.select("row", "length", "key").distinct().join(items.select("length", "key", F.col("item_id").cast("string").alias("item")), ["length", "key"])
    held = held.select("row", "item").distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    result = scanned.select("row", "doc_id", "n_words").join(n_hit.join(held, "row"), "row", "left")
    result = result.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return result.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), joined_hash(F.col("items")).alias("items_sha256"), "contaminated")
