"""Chat formatting as a prefix tree.

Conversations that share initial turns share nodes. Nodes are laid out depth-first in one stream of characters, each
once; a node has its place in the stream and the position id of its first token. Tokens are code points here.

Sorted by their turns' hashes, conversations meet the tree depth-first: each adds one chunk, the turns that no
conversation before it has. Chunks follow each other in the stream, so their places are running sums inside range
partitions and over the partitions' totals, and no tree is ever gathered. What a conversation may attend to is one interval
of each chunk on its way, which keeps the intervals few even for very long conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import running, settle, table

#: Fixed values of the query: a conversation of control strings.
EXTRA = "VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"
_BYTES = 16  # of a hash


def escaped(text: Column) -> Column:
    """Control strings inside a text are broken by a backslash after their first character; backslashes are doubled."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"(<(?=/?s>)|\[(?=/?(?:INST|ANS|SYS|ROLE)\]))", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(role: Column, text: Column) -> Column:
    """One turn in the template. ``role`` and ``text`` are not null."""
    body = escaped(text)
    return (
        F.when(role == "user", F.concat(F.lit("<s>[INST] "), body, F.lit(" [/INST] </s>")))
        .when(role == "assistant", F.concat(F.lit("<s>[ANS] "), body, F.lit(" </s>")))
        .when(role == "system", F.concat(F.lit("<s>[SYS] "), body, F.lit(" </s>")))
        .otherwise(F.concat(F.lit("<s>[ROLE] "), escaped(role), F.lit(" [/ROLE] "), body, F.lit(" </s>")))
    )


def parsed(turn: Column) -> Column:
    """struct(role, text) of one formatted turn, without its ``</s>``."""
    long, short = F.substring(turn, 11, 1 << 30), F.substring(turn, 10, 1 << 30)

    def cut(x: Column, n: int) -> Column:
        return unescaped(x.substr(F.lit(1), F.length(x) - n))

    other = F.substring_index(long, " [/ROLE] ", 1)
    rest = long.substr(F.length(other) + 10, F.length(long))
    return (
        F.when(turn.startswith("<s>[INST] "), F.struct(F.lit("user").alias("role"), cut(long, 9).alias("text")))
        .when(turn.startswith("<s>[ANS] "), F.struct(F.lit("assistant").alias("role"), cut(short, 1).alias("text")))
        .when(turn.startswith("<s>[SYS] "), F.struct(F.lit("system").alias("role"), cut(short, 1).alias("text")))
        .otherwise(F.struct(unescaped(other).alias("role"), cut(rest, 1).alias("text")))
    )


def prefix_tree(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, ways, leaves) of conversations given as rows (conv_id, turn, role, text).

    nodes: id, depth, chunk, start, stop (in the stream), position (id of its first token), loss_start, loss_stop (the
    assistant's text inside the segment; equal if there is none), segment. A node attends to itself up to each token and to
    the part of its chunk's way before it. ways: leaf, attends (intervals of the stream from the root to the leaf, ancestors
    only) and seats (the starts of its nodes). leaves: conv_id, leaf.

    Null texts and roles are empty; turns are ordered by turn (null first), ties by role and then by hash; repeated rows
    are repeated turns; rows with a null conv_id are one conversation; other columns are left out. Time is linear in the
    turns of a conversation and in the length of a text. The layout moves hashes and lengths only; texts meet their nodes at
    the end. A conversation's own hashes are held together in a task; no tree or level is. An empty table gives empty tables.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    lines = turns.select("conv_id", "turn", role.alias("role"), formatted(role, text).alias("segment"))
    lines = lines.withColumn("key", F.unhex(F.substring(F.sha2("segment", 256), 1, 2 * _BYTES)))
    segments = lines.groupBy("key").agg(F.first("segment").alias("segment"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "key", F.length("segment").cast("long").alias("n"))))
    chats = lines.groupBy("conv_id").agg(ordered.alias("turns"))

    def here(at: Column, t: Column) -> Column:
        return F.unhex(F.substring(F.sha2(F.concat(at["id"], t["key"]), 256), 1, 2 * _BYTES))

    def after(at: Column, t: Column) -> Column:
        return F.struct(here(at, t).alias("id"), (at["position"] + t["n"]).alias("position"))

    def node(at: Column, t: Column) -> Column:
        return F.struct(here(at, t).alias("id"), t["key"].alias("key"), t["n"].alias("n"), (t["role"] == "assistant").alias("told"), at["position"].alias("position"))

    none = F.array().cast("array<struct<id:binary,key:binary,n:bigint,told:boolean,position:bigint>>")
    start = F.struct(F.expr("X''").alias("id"), F.lit(0).cast("long").alias("position"))
    chats = settle(chats.select("conv_id", running(F.col("turns"), start, none, after, node).alias("nodes")).select("conv_id", F.element_at("nodes", -1)["id"].alias("leaf_id"), "nodes"))
    distinct = chats.groupBy("leaf_id").agg(F.first("nodes").alias("nodes"))
    path = F.array_join(F.transform("nodes", lambda t: F.hex(t["key"])), "")
    # the id is the partition's number and the row's place in it, so it follows the order of the paths
    distinct = distinct.withColumn("path", path).repartitionByRange("path").sortWithinPartitions("path")
    distinct = settle(distinct.select(F.monotonically_increasing_id().alias("leaf"), "leaf_id", "nodes"))
    rows = distinct.select("leaf", F.posexplode("nodes").alias("depth", "t")).select("leaf", "depth", "t.*")
    nodes = rows.groupBy("id").agg(F.min("leaf").alias("chunk"), *[F.first(c).alias(c) for c in ("depth", "key", "n", "told", "position")])
    nodes = settle(nodes)
    chunks = nodes.groupBy("chunk").agg(F.sum("n").alias("size"), F.min("position").alias("first")).withColumn("part", F.shiftright("chunk", 33))
    parts = chunks.groupBy("part").agg(F.sum("size").alias("total"))  # one row for each partition
    parts = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    ahead = F.sum("size").over(Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    chunks = chunks.withColumn("ahead", ahead).join(parts, "part").select("chunk", (F.col("before") + F.col("ahead") - F.col("first")).alias("shift"))
    placed = nodes.join(chunks, "chunk").withColumn("start", F.col("shift") + F.col("position"))
    loss_start = F.when(F.col("told"), 9).otherwise(0)
    loss_stop = F.when(F.col("told"), F.col("n").cast("int") - 5).otherwise(0)
    placed = settle(placed.select("id", "key", "depth", "chunk", "start", (F.col("start") + F.col("n")).alias("stop"), "position", loss_start.alias("loss_start"), loss_stop.alias("loss_stop")))
    met = rows.select("leaf", "id").join(placed.select("id", "chunk", "start", "stop"), "id")
    met = met.groupBy("leaf", "chunk").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.collect_list("start").alias("seats"))
    ways = met.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("attends"), F.flatten(F.collect_list("seats")).alias("seats"))
    leaves = chats.select("conv_id", "leaf_id").join(distinct.select("leaf_id", "leaf"), "leaf_id").select("conv_id", "leaf")
    return placed.join(segments, "key").drop("key"), ways, leaves


def read_back(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(leaf, formatted, losses, positions) of every distinct conversation, from the nodes on its way."""
    found = ways.select("leaf", F.explode("seats").alias("start")).join(nodes.select("start", "segment", "loss_start", "loss_stop", "position"), "start")
    whole = found.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("start", "segment", "loss_start", "loss_stop", "position"))).alias("parts"))
    masked = F.transform(F.filter("parts", lambda p: p["loss_stop"] > p["loss_start"]), lambda p: p["segment"].substr(p["loss_start"] + 1, p["loss_stop"] - p["loss_start"]))
    return whole.select("leaf", F.array_join(F.transform("parts", lambda p: p["segment"]), "").alias("formatted"), masked.alias("losses"), F.transform("parts", lambda p: p["position"]).alias("positions"))


#: Parts that conversations of one way are dealt over.
SALTS = 8


def chat_digests(turns: DataFrame) -> DataFrame:
    """A row for each conv_id, read back from the laid out tree.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, turn_positions (the position id of each turn's first
    token; its others follow one by one), attends (the intervals ``start:stop`` of the stream that hold the conversation: what
    its tokens may attend to, each up to its own place). Both are joined by commas.
    """
    nodes, ways, leaves = prefix_tree(turns)
    said = F.transform(F.filter(F.split("formatted", "</s>"), lambda t: t != ""), parsed)
    loss = F.array_join(F.transform("losses", unescaped), "")
    found = read_back(nodes, ways).select("leaf", "formatted", "positions", said.alias("said"), loss.alias("loss"))
    told = F.array_join(F.transform("said", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    found = found.select(
        "leaf",
        F.size("said").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("turn_positions"),
    )
    attends = F.array_join(F.transform("attends", lambda i: F.concat_ws(":", i["start"], i["stop"])), ",")
    found = found.join(ways.select("leaf", attends.alias("attends")), "leaf").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = leaves.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int"))
    return dealt.join(found, ["leaf", "salt"]).drop("leaf", "salt")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests, positions and attention intervals of every conversation and of the extra one."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_digests(turns.unionByName(spark.sql(f"SELECT * FROM {EXTRA}")))
