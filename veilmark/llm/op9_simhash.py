"""SimHash near-duplicates: 64-bit fingerprints, candidates by pigeonring chains, exact Hamming check, components.

A pair within ``RADIUS`` differing bits, cut into 13 ring segments, has by the pigeonring principle a start segment from
which every chain of l consecutive segments differs in at most l * RADIUS / 13 bits. Hence the first three segments of
that chain are equal, the first six hold at most one difference and the first nine at most two. Each fingerprint is indexed
under its 13 starts x 3 choices of five equal segments among the first six (24 or 25 bits). Where many fingerprints share
such a key, the chain is followed to nine segments: 6 choices of seven equal ones (34 or 35 bits). What meets there must
pass the chain condition at six, nine, twelve and thirteen segments, one after the other; the last is the Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table
from .components import connected_components

RADIUS = 4
SHINGLE = 4
#: Ring segments, low bits first.
WIDTHS = [5] * 12 + [4]
SHIFTS = [sum(WIDTHS[:i]) for i in range(13)]
#: Members up to which a key's fingerprints are searched in one task; others take the longer chain first.
BUCKET = 1024


def fingerprint_of(text: str | None) -> int:
    """The SimHash of one text as a signed 64-bit integer; 0 if it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        spans = zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
        hashes = [digest(joined[s:e], 42) for s, e in spans]
    bits = np.zeros(64, np.int64)
    packed = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    for i in range(0, len(packed), 1 << 14):
        bits += np.unpackbits(packed[i : i + (1 << 14)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: Column) -> Column:
    """The SimHash of a text column as a signed 64-bit integer."""

    @F.pandas_udf("long")
    def apply(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint_of(t) for t in batch], dtype="int64")

    return apply(text)


def _chain(start: int, n: int) -> int:
    """The bits of ``n`` consecutive segments from ``start`` on."""
    return sum(((1 << WIDTHS[i % 13]) - 1) << SHIFTS[i % 13] for i in range(start, start + n))


#: For each start, the chains that are tested beyond those that a key makes equal, and their budgets.
CHAINS = [[(np.uint64(_chain(start, n)), RADIUS * n // 13) for n in (6, 9, 12, 13)] for start in range(13)]


def chained(some: np.ndarray, at: np.uint64, start: int) -> np.ndarray:
    """Places in ``some`` that pass the chain condition from ``start`` with ``at``; each longer chain sees the survivors only."""
    places, x = np.arange(len(some)), some ^ at
    for mask, budget in CHAINS[start]:
        passed = np.bitwise_count(x & mask) <= budget
        places, x = places[passed], x[passed]
    return places


def forest(bucket: np.ndarray, start: int) -> Iterator[tuple[int, int]]:
    """Links that connect a bucket's fingerprints as all of its chained pairs would: a spanning forest, found by search."""
    rest = bucket
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = chained(rest, at, start)
            if len(near):
                for other in rest[near]:
                    yield int(at), int(other)
                front.extend(rest[near])
                rest = np.delete(rest, near)


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out: list[np.ndarray] = []
        arrays = [np.asarray(x, np.int64).view(np.uint64) for x in batch["members"]]
        starts = batch["start"].to_numpy()
        two = np.array([len(x) == 2 for x in arrays], bool)
        for start in np.unique(starts[two]):
            pairs = np.stack([arrays[i] for i in np.flatnonzero(two & (starts == start))])
            out.append(pairs[chained(pairs[:, 0] ^ pairs[:, 1], np.uint64(0), start)])
        if more := [p for i in np.flatnonzero(~two) for p in forest(arrays[i], starts[i])]:
            out.append(np.array(more, np.uint64))
        if out:
            found = np.concatenate(out).view(np.int64)
            yield pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})


#: (start, skipped segment of the first six), and for each the pairs of skipped segments of the first nine: the chain holds
#: two differences at most, and the first six segments one.
SHORT = [(start, skipped) for start in range(13) for skipped in (3, 4, 5)]
LONG = [[(skipped, x) for x in (6, 7, 8)] + [(6, 7), (6, 8), (7, 8)] for _, skipped in SHORT]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _short_keys() -> list[Column]:
    """The 39 index keys of a fingerprint column ``fp``: five segments in one number, led by the number of the key."""
    keys = []
    for number, (start, skipped) in enumerate(SHORT):
        key = F.lit(number).cast("long")
        for step in range(6):
            if step != skipped:
                at = (start + step) % 13
                key = F.shiftleft(key, 5).bitwiseOR(F.shiftrightunsigned("fp", SHIFTS[at]).bitwiseAND(F.lit((1 << WIDTHS[at]) - 1)))
        keys.append(key)
    return keys


def _long_masks() -> Column:
    """For each short key the bits that its 6 longer keys hold equal: seven of the nine segments."""
    masks = [[sum(_chain(start + step, 1) for step in range(9) if step not in pair) for pair in LONG[i]] for i, (start, _) in enumerate(SHORT)]
    return F.array(*[F.array(*[F.lit(_signed(m)) for m in some]) for some in masks])


def _met(keyed: DataFrame, by: list[str], start: Column, bucket: int) -> tuple[DataFrame, DataFrame]:
    """(start, members) of every key (columns ``by``) with up to ``bucket`` members ``fp``, and the rows of the other keys.

    Keys of two need one aggregation; the others up to ``bucket`` are gathered. ``start`` follows from the key.
    """
    counts = settle(keyed.groupBy(*by).agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    twos = counts.where("n = 2").select(start.alias("start"), F.array("a", "b").alias("members"))
    some = counts.where(F.col("n").between(3, bucket)).select(*by)
    gathered = keyed.join(some, by).groupBy(*by).agg(F.collect_list("fp").alias("members")).select(start.alias("start"), "members")
    return twos.union(gathered), keyed.join(counts.where(F.col("n") > bucket).select(*by), by)


def close_links(fingerprints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that have the same components as all pairs within RADIUS bits.

    Keys with more than ``bucket`` members take the longer chain. Fingerprints that even crowd a longer key agree in 34
    bits; they are linked to the smallest fingerprint that shares a point within RADIUS / 2 bits of both: two fingerprints
    share such a point exactly if they are within RADIUS bits, so no link is lost there either, and the work stays in
    proportion to the members.
    """
    keyed = fingerprints.select("fp", F.explode(F.array(*_short_keys())).alias("key"))
    number = F.shiftright("key", 25).cast("int")
    short, crowded = _met(keyed, ["key"], F.floor(number / 3).cast("int"), bucket)
    crowded = settle(crowded)
    links = short.mapInPandas(_links, "a long, b long")
    if not crowded.isEmpty():
        longer = crowded.select("fp", number.alias("number"), F.posexplode(F.get(_long_masks(), number)).alias("pair", "mask"))
        longer = longer.select("fp", (F.col("number") * 6 + F.col("pair")).alias("number"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        long, dense = _met(longer, ["number", "key"], F.floor(F.col("number") / 18).cast("int"), bucket)
        dense = settle(dense.select("fp").distinct())
        flips = [0] + [1 << i for i in range(64)] + [(1 << i) | (1 << j) for i in range(64) for j in range(i)]
        flips = F.explode(F.array(*[F.lit(_signed(x)) for x in flips]))
        near = dense.select("fp", flips.alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
        first = near.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("point", "a")
        shared = near.join(first, "point").where("fp != a").select("a", F.col("fp").alias("b"))
        links = links.union(long.mapInPandas(_links, "a long, b long")).union(shared)
    return links.distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, fp, component_id, root), one for each input row.

    Texts are cut into words at ASCII white space after lower-casing A-Z; null, empty and wordless texts have
    fingerprint 0 and link like any other. Equal fingerprints are merged before any pair is looked at.
    component_id is the smallest doc_id of the component: nulls are passed over, and it is null only if all ids of
    the component are. Repeated rows each keep their row. Other columns are ignored.
    """
    prints = settle(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text)).alias("fp")))
    classes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = settle(connected_components(close_links(classes.select("fp")))).withColumnRenamed("node", "fp")
    linked = roots.join(classes, "fp")
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("smallest"))
    linked = roots.join(smallest, "root").select("fp", "root", "smallest")
    named = classes.join(linked, "fp", "left").select(
        "fp", F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("smallest")).alias("component_id"), F.coalesce("root", "fp").alias("root")
    )
    # settled, so that both sides of the last join are dealt anew and Spark may split a fingerprint with very many copies
    return prints.join(settle(named), "fp").select("doc_id", "fp", "component_id", "root")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
