"""Prefix trie of conversations with totals over subtrees, rolled up by bands of depths.

A node is the sequence of the first turns of some conversation; its id is a chained hash. Subtree totals never send a node to
all its ancestors: nodes go to those in their own band of HEIGHT depths only, and the roots of bands then form a trie of
their own, HEIGHT times less deep, whose totals are found in the same way and handed down. So a node is copied at most
HEIGHT times for each of log(depth) levels, and the number of rounds is twice that logarithm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import running, settle, table

#: Depths in a band.
HEIGHT = 8
_NONE = hashlib.sha256(b"").hexdigest()


def _root() -> Column:
    return F.expr("X''")


def _digest(*parts: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def chats(turns: DataFrame) -> DataFrame:
    """conv_id, turns: array of struct(key, n) in order, key a hash of role and text, n the text's code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = _digest(F.length(role).cast("string"), F.lit(":"), role, text)
    lines = turns.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct("turn", role.alias("role"), key.alias("key"), F.length(text).cast("bigint").alias("n")).alias("t"))
    return lines.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["key"].alias("key"), t["n"].alias("n"))).alias("turns"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of conversation c - c % 100; h is crc32(c) % 6."""
    h = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")
    heads = own.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 5).alias("head"))
    both = own.withColumn("base", F.expr("conv_id - conv_id % 100")).withColumn("h", h).join(heads, "base", "left")
    kept = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return both.select("conv_id", F.when(F.col("head").isNull(), kept).otherwise(F.concat(F.slice("head", F.lit(1), F.col("h")), kept)).alias("turns"))


def ends(leaves: DataFrame) -> DataFrame:
    """leaf, ends_sha256 of rows (leaf, conv_id): ids are sorted and joined in pieces by range, and pieces hashed as a stream.

    However many conversations end at one node, no task sorts them all or holds them: the last step reads pieces in order.
    """

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            leaf, ids = batch["leaf"].to_numpy(), batch["conv_id"].tolist()
            begins = [i for i in range(len(ids)) if not i or leaf[i] != leaf[i - 1]]
            rows = [(leaf[a], ids[a], ",".join(map(str, ids[a:b]))) for a, b in zip(begins, [*begins[1:], len(ids)], strict=True)]
            yield pd.DataFrame(rows, columns=["leaf", "first", "ids"])

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for batch in batches:
            done = []
            for leaf, ids in zip(batch["leaf"], batch["ids"], strict=True):
                if state is not None and leaf == at:
                    state.update(b",")
                else:
                    if state is not None:
                        done.append((at, state.hexdigest()))
                    at, state = leaf, hashlib.sha256()
                state.update(ids.encode())
            yield pd.DataFrame(done, columns=["leaf", "ends_sha256"])
        if state is not None:
            yield pd.DataFrame([(at, state.hexdigest())], columns=["leaf", "ends_sha256"])

    dealt = leaves.select("leaf", "conv_id").repartitionByRange("leaf", "conv_id").sortWithinPartitions("leaf", "conv_id")
    pieces = dealt.mapInPandas(joined, "leaf binary, first bigint, ids string")
    return pieces.repartition("leaf").sortWithinPartitions("leaf", "first").mapInPandas(hashed, "leaf binary, ends_sha256 string")


def subtree_sums(nodes: DataFrame, levels: int, values: list[str], height: int = HEIGHT) -> DataFrame:
    """(id, values): each value summed over the subtree of every node.

    ``nodes`` has id, depth, the values, and for each level from 0 to ``levels`` the ids ``own_l`` from the root of the node's band down
    to the node, and for levels from 1 on ``up_l``, the ids of the band above it. Level l holds the depths divisible by height ** l.
    """

    def at(level: int) -> DataFrame:
        return nodes.where(F.col("depth") % height**level == 0)

    def summed(rows: DataFrame) -> DataFrame:
        return settle(rows.groupBy("id").agg(*[F.sum(v).alias(v) for v in values]))

    weights = [nodes.select("id", *values)]
    for level in range(levels):
        below = at(level).select("id", F.get(f"own_{level}", F.lit(0)).alias("root"))
        weights.append(summed(below.join(weights[-1], "id").drop("id").withColumnRenamed("root", "id")))
    total = None
    for level in range(levels, -1, -1):
        parts = at(level).select("id", F.col(f"own_{level}").alias("to")).join(weights[level], "id")
        if total is not None:
            parts = parts.unionByName(at(level + 1).where("depth > 0").select("id", F.col(f"up_{level + 1}").alias("to")).join(total, "id"))
        total = summed(parts.select(F.explode("to").alias("id"), *values))
    return total


def with_bands(paths: DataFrame, levels: int, height: int = HEIGHT) -> DataFrame:
    """Rows of paths (ids: from the root on) with depth, id, parent and the ids of bands that ``subtree_sums`` asks for."""
    rows = paths.select("*", F.posexplode("ids").alias("depth", "id"))
    depth, columns = F.col("depth"), []

    def picked(first: Column, last: Column, step: int) -> Column:
        return F.transform(F.sequence(first, last, F.lit(step)), lambda i: F.get("ids", i))

    for level in range(levels + 1):
        step = height**level
        on = depth % step == 0
        columns.append(F.when(on, picked(depth - depth % (step * height), depth, step)).alias(f"own_{level}"))
        if level:
            columns.append(F.when(on & (depth > 0), picked(depth - step, depth - step // height, step // height)).alias(f"up_{level}"))
    parent = F.when(depth > 0, F.get("ids", depth - 1))
    return rows.select("*", parent.alias("parent"), *columns).drop("ids")


def prefix_trie(rebuilt_turns: DataFrame, height: int = HEIGHT) -> DataFrame:
    """A row for each node of the trie of (conv_id, turns: array of struct(key, n)).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; see the query.
    """
    step = lambda acc, t: _digest(acc, t["key"])
    none = F.array().cast("array<struct<id:binary,n:bigint>>")
    path = running(F.col("turns"), _root(), none, step, lambda acc, t: F.struct(step(acc, t).alias("id"), t["n"].alias("n")))
    told = rebuilt_turns.select("conv_id", path.alias("path"))
    told = settle(told.select("conv_id", F.when(F.size("path") > 0, F.element_at("path", -1)["id"]).otherwise(_root()).alias("leaf"), "path"))
    distinct = told.groupBy("leaf").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("path").alias("path"))
    deepest = told.agg(F.max(F.size("path"))).first()[0] or 0
    levels = next(level for level in range(64) if height ** (level + 1) > deepest)
    sizes = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("path", lambda p: p["n"]))
    ids = F.concat(F.array(_root()), F.transform("path", lambda p: p["id"]))
    rows = with_bands(distinct.select("conv_id", "n_convs", sizes.alias("sizes"), ids.alias("ids")), levels, height)
    rows = rows.withColumn("n", F.get("sizes", F.col("depth"))).drop("sizes")
    same = [c for c in rows.columns if c not in ("conv_id", "n_convs", "id")]
    nodes = settle(rows.groupBy("id").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), *[F.first(c).alias(c) for c in same]))
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    nodes = settle(nodes.join(children, "id", "left").na.fill(0, ["n_children"]))
    valued = nodes.select("*", (F.col("n_children") == 0).cast("bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n")).alias("saved_tokens"))
    sums = subtree_sums(valued, levels, ["n_leaves", "saved_tokens"], height)
    above = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.select("id", "conv_id", "depth", "parent", "n_convs", "n_children").join(above, "parent", "left").join(sums, "id")
    found = found.join(ends(told).withColumnRenamed("leaf", "id"), "id", "left")
    return found.select("conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations.

    Null roles and texts are empty; turns follow ``turn`` (null first), ties role and then a hash; repeated rows are repeated turns.
    Rows with a null conv_id take no part; other columns are left out; a conversation without turns ends at the root. An empty
    table has no nodes. Texts of any length are hashed where they are read. A conversation's turn hashes are held together in
    a task, 24 bytes a turn; no node's members, children or subtree are.
    """
    return prefix_trie(rebuilt(chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))))
