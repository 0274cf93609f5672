"""Hard-negative mining by exact integer scores.

Anchors and candidates are packed into blocks; every anchor block meets every candidate block as one pair of tiles, whose
scores come from Strassen's recursion on int64 (seven products of halves instead of eight, odd sides padded with zeros).
Two passes: the first keeps a heap of each anchor's best positives, the second, for each positive, a heap of the best
negatives inside its window. Heaps of tiles are merged in the task, heaps of tasks by a partial and a final top-k of Spark.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, table

#: Rows of an anchor block and of a candidate block; candidate blocks that share one copy of an anchor block.
ANCHOR_ROWS, ROWS, SHARE = 512, 2048, 8
#: Sides from which on tiles are multiplied directly.
DIRECT = 16
_BLOCK = "block string, size int, width int, kind string, ids binary, labels binary, vectors binary"


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` for int64. Additions wrap around, so the product is exact wherever it fits into 64 bits itself."""
    if min(*a.shape, b.shape[1]) <= DIRECT:
        return a @ b
    m, k, n = *a.shape, b.shape[1]
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l] = p1 + p4 - p5 + p7
    out[:i, l:] = p3 + p5
    out[i:, :l] = p2 + p4
    out[i:, l:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label, vector (array<bigint>, floor(256 * x)) of the rows that take part."""
    known = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull()
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    parts = F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("bigint"))
    return rows.where(known & whole).select(F.col("vec_id").cast("bigint").alias("vec_id"), moved.cast("bigint").alias("label"), parts.alias("vector"))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` rows, made where the rows are; inside a block rows follow their ids."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), size):
                some = batch.iloc[at : at + size].sort_values("vec_id", kind="stable")
                width = max(map(len, some["vector"]), default=0)
                vectors = np.zeros((len(some), width), np.int64)
                for i, v in enumerate(some["vector"]):
                    vectors[i, : len(v)] = v
                ids, labels = some["vec_id"].to_numpy(np.int64), some["label"].to_numpy(np.int64)
                kind = next(k for k in ("int16", "int32", "int64") if k == "int64" or not vectors.size or max(-vectors.min(), vectors.max()) < np.iinfo(k).max)
                yield pd.DataFrame([(uuid.uuid4().hex, len(some), width, kind, ids.tobytes(), labels.tobytes(), vectors.astype(kind).tobytes())], columns=["block", "size", "width", "kind", "ids", "labels", "vectors"])

    return rows.mapInPandas(pack, _BLOCK)


def _opened(row: dict, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (np.frombuffer(row[f"{side}_{c}"], np.int64) for c in ("ids", "labels"))
    return ids, labels, np.frombuffer(row[f"{side}_vectors"], row[f"{side}_kind"]).astype(np.int64).reshape(row[f"{side}_size"], row[f"{side}_width"])


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores of all rows of ``a`` against all of ``b``; shorter vectors count as padded with zeros."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    if width and len(a) and len(b) and np.linalg.norm(a.astype(float), axis=1).max() * np.linalg.norm(b.astype(float), axis=1).max() >= 2.0**62:
        raise OverflowError("scores do not fit into 64 bits")
    return strassen(a, np.ascontiguousarray(b.T))


def met(anchors: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pairs of blocks (a_..., c_...): every anchor block with every candidate block, as an equi-join.

    Candidate blocks name the anchor blocks they want; copies of an anchor block are numbered, so no task gets one block's
    whole partners.
    """
    # names only, one for each ANCHOR_ROWS anchors
    names = anchors.select("block").agg(F.sort_array(F.collect_list("block")).alias("names"))
    copies = candidates.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / SHARE)).cast("int").alias("copies"))
    a = anchors.crossJoin(F.broadcast(copies)).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))  # one row by blocks
    c = candidates.crossJoin(F.broadcast(names)).crossJoin(F.broadcast(copies))  # one row by blocks
    c = c.withColumn("wanted", F.explode("names")).withColumn("copy", F.pmod(F.xxhash64("block"), F.col("copies")).cast("int"))
    a = a.select("copy", F.col("block").alias("wanted"), *[F.col(x).alias(f"a_{x}") for x in anchors.columns])
    return c.select("copy", "wanted", *[F.col(x).alias(f"c_{x}") for x in candidates.columns if x != "block"]).join(a, ["copy", "wanted"]).drop("copy", "wanted")


def top(rows: DataFrame, keys: list[str], order: list[Column], most: int, rank: str) -> DataFrame:
    """The first ``most`` rows of each key; Spark cuts each partition down before it shuffles."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= most)


def _merged(held: dict, key: tuple, found: np.ndarray, most: int) -> None:
    """Merge rows (score, id) into a heap of the ``most`` best, highest score first, then smallest id."""
    both = np.concatenate([held[key], found]) if key in held else found
    held[key] = both[np.lexsort((both[:, 1], -both[:, 0]))[:most]]


def positives(pairs: DataFrame, most: int) -> DataFrame:
    """(anchor, anchor_id, positive_id, positive_score): each anchor's best other rows of its label."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def rows() -> pd.DataFrame:
            out = [(*key, int(i), int(s)) for key, heap in held.items() for s, i in heap]
            held.clear()
            return pd.DataFrame(out, columns=["anchor", "anchor_id", "positive_id", "positive_score"])

        for batch in batches:
            for row in batch.to_dict("records"):
                a_ids, a_labels, a = _opened(row, "a")
                c_ids, c_labels, c = _opened(row, "c")
                scores = _scores(a, c)
                for i, anchor in enumerate(a_ids):
                    like = np.flatnonzero((c_labels == a_labels[i]) & (c_ids != anchor))
                    found = np.column_stack([scores[i, like], c_ids[like]])
                    _merged(held, (f"{row['a_block']}:{i}", int(anchor)), found, most)
                if len(held) > 100 * ANCHOR_ROWS:
                    yield rows()
        yield rows()

    heaps = pairs.mapInPandas(run, "anchor string, anchor_id bigint, positive_id bigint, positive_score bigint")
    return top(heaps, ["anchor"], [F.desc("positive_score"), F.asc("positive_id")], most, "place")


def negatives(pairs: DataFrame, most: int, low: int, high: int) -> DataFrame:
    """Of pairs with ``a_windows`` (anchor, place, positive_score): the best rows of other labels in each window."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def rows() -> pd.DataFrame:
            out = [(*key, int(i), int(s)) for key, heap in held.items() for s, i in heap]
            held.clear()
            return pd.DataFrame(out, columns=["anchor", "place", "negative_id", "negative_score"])

        for batch in batches:
            for row in batch.to_dict("records"):
                _, a_labels, a = _opened(row, "a")
                c_ids, c_labels, c = _opened(row, "c")
                windows: dict[int, list] = {}
                for w in row["a_windows"]:
                    windows.setdefault(int(w["anchor"].rpartition(":")[2]), []).append((w["anchor"], int(w["place"]), int(w["positive_score"])))
                scores = _scores(a, c)
                for i, asked in windows.items():
                    unlike = np.flatnonzero(c_labels != a_labels[i])
                    # ids ascend in a block, so a stable sort breaks ties by them
                    down = unlike[np.argsort(-scores[i, unlike], kind="stable")]
                    falling = -scores[i, down]
                    for anchor, place, positive in asked:
                        least, greatest = -(-low * positive // 100), high * positive // 100
                        first, last = np.searchsorted(falling, -greatest, "left"), np.searchsorted(falling, -least, "right")
                        some = down[first : max(first, min(last, first + most))]
                        if len(some):
                            _merged(held, (anchor, place), np.column_stack([scores[i, some], c_ids[some]]), most)
                if len(held) > 500 * ANCHOR_ROWS:
                    yield rows()
        yield rows()

    heaps = pairs.mapInPandas(run, "anchor string, place int, negative_id bigint, negative_score bigint")
    return top(heaps, ["anchor", "place"], [F.desc("negative_score"), F.asc("negative_id")], most, "rank")


def hard_negatives(rows: DataFrame, anchor: Column, vector: str = "embedding", n_positive: int = 5, n_negative: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Negatives lie between ``low`` and ``high`` percent of the positive's score. Rows with a null vec_id, label or vector, or a
    component that is null or not finite, take no part; a vector shorter than its partner counts as padded with zeros, an
    empty one scores 0. Equal anchor rows are one anchor; other repeated rows are rows of their own and fill ranks as such,
    but no row with the anchor's own vec_id is its positive. A score that might not fit into 64 bits is an error. Other
    columns are left out. Empty tables, anchors without positives and positives with an empty window give no rows. The work
    is the stated anchors against all rows, in tiles; a task holds two blocks and its heaps.
    """
    known = usable(rows, vector)
    asked = settle(known.where(anchor).distinct())
    anchors = settle(packed(asked.repartition(max(1, -(-asked.count() // ANCHOR_ROWS))), ANCHOR_ROWS))
    candidates = settle(packed(known, ROWS))
    found = settle(positives(met(anchors, candidates), n_positive))
    windows = found.groupBy(F.substring_index("anchor", ":", 1).alias("block")).agg(F.collect_list(F.struct("anchor", "place", "positive_score")).alias("windows"))
    mined = negatives(met(anchors.join(windows, "block"), candidates), n_negative, low, high)
    return mined.join(found, ["anchor", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten negatives for each of five positives of every row whose vec_id is divisible by 100, against all rows."""
    return hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), F.col("vec_id") % 100 == 0)
