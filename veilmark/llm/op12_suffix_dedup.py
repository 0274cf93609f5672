"""Repeated byte strings across and inside texts, by a sparse suffix sort with hashed comparisons.

Every string of SPAN bytes names one of its grams, the one of smallest hash (the first of equals). Equal strings name the same gram
at the same place, so strings need comparing only where their grams are equal: grams that occur once drop out in a count.
Around each other gram lies a context, the bytes of the strings that name it. Contexts of one gram are sorted as suffixes
that begin at the gram: a mergesort in which each comparison finds the common extension by binary search over prefix
polynomial hashes. The common extensions of neighbours tell how far strings agree to the right of the gram, one more
polynomial hash tells whether they agree to the left. Everything that is claimed equal is verified byte by byte.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, shared_folder, stored, table

#: Length of a repeated string and of a gram, in bytes.
SPAN, GRAM = 200, 32
#: Occurrences up to which the contexts of one gram are sorted in one task; those of others are cut into groups of longer cores.
CROWD = 4096
#: Bytes worked on at a time, window starts in a slice, contexts sorted at a time.
PIECE, SLICE, TOGETHER = 1 << 18, 1 << 18, 10_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_PLACE = np.uint64((1 << 24) - 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


#: An odd number for each byte, by a rule.
_VALUES = _mixed(_mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))) | np.uint64(1)


class Powers:
    """Powers of the base and of its inverse modulo 2**64, made once for the longest buffer so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> None:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps))


def prefix_hashes(buffer: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] the polynomial of bytes i to j, scaled by the power of i; arithmetic is modulo 2**64."""
    Powers.upto(len(buffer) + 1)
    out = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_VALUES[buffer] * Powers.up[: len(buffer)], out=out[1:])
    return out


def hashed(prefix: np.ndarray, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    return (prefix[at + length] - prefix[at]) * Powers.down[at]


def named_grams(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first, last, place, key): strings of ``span`` bytes starting at first to last name the gram at place with hash key."""
    counts = np.maximum(lengths - span + 1, 0)
    if not counts.sum():
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    prefix = prefix_hashes(buffer)
    grams = _mixed((prefix[gram:] - prefix[:-gram]) * Powers.down[: len(buffer) - gram + 1])
    wide, found = span - gram + 1, np.empty(len(buffer) - span + 1, np.int64)
    for at in range(0, len(found), SLICE):
        # the order is by 40 bits of the hash, then by place: a function of the string alone
        low = grams[at : at + SLICE + wide - 1] & ~_PLACE
        low |= np.arange(len(low), dtype=np.uint64)
        done = 1
        while 2 * done <= wide:
            low = np.minimum(low[:-done], low[done:])
            done *= 2
        if done < wide:
            low = np.minimum(low[: done - wide], low[wide - done :])
        found[at : at + len(low)] = (low & _PLACE).astype(np.int64) + at
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    place = found[at]
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.append(first[1:], len(place)) - 1
    return text[first], at[first], at[last], place[first], grams[place[first]].view(np.int64)


def _pieces(bodies: list[bytes]) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts of about PIECE bytes as one buffer, with the starts and lengths of the texts in it."""
    low, size = 0, 0
    for i in range(len(bodies) + 1):
        if i == len(bodies) or size > PIECE:
            some = bodies[low:i]
            if some:
                lengths = np.array([len(b) for b in some], np.int64)
                yield slice(low, i), np.frombuffer(b"".join(some), np.uint8), np.cumsum(lengths) - lengths, lengths
            low, size = i, 0
        if i < len(bodies):
            size += len(bodies[i])


def _with_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds ``keys`` and ``counts``: the grams that strings of a text name, with the number of their places."""
    for batch in batches:
        for part, buffer, starts, lengths in _pieces(batch["body"].tolist()):
            text, _, _, _, key = named_grams(buffer, starts, lengths)
            order = np.lexsort((key, text))
            text, key = text[order], key[order]
            new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (key[1:] != key[:-1])])) if len(text) else np.zeros(0, np.int64)
            key, times = key[new], np.diff(np.append(new, len(text))).astype(np.int32)
            bounds = np.searchsorted(text[new], np.arange(1, len(starts)))
            yield batch.iloc[part].assign(keys=np.split(key, bounds), counts=np.split(times, bounds))


def distinct_texts(docs: DataFrame, parts: int) -> DataFrame:
    """id (of the text), copies, body, keys, counts: one row for each distinct text, as a table bucketed by id.

    Later steps join by id without moving texts again. Copies meet in a partial aggregation, so a text with very many does
    not gather in a task.
    """
    spark = docs.sparkSession
    rows = docs.select(text_id().alias("id"), F.col("text").cast("binary").alias("body")).where("body is not null")
    rows = rows.groupBy("id").agg(F.first("body").alias("body"), F.count("*").alias("copies"))
    rows = rows.mapInPandas(_with_grams, "id binary, body binary, copies bigint, keys array<bigint>, counts array<int>")
    name = f"texts_{uuid.uuid4().hex}"
    rows.write.bucketBy(parts, "id").option("path", f"{shared_folder(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def text_id() -> Column:
    return F.unhex(F.substring(F.sha2("text", 256), 1, 32))


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The contexts of a text's shared grams: id, context (a hash), starts, lead (bytes before the gram), key, many, body."""
    columns = ["id", "context", "starts", "lead", "key", "many", "body"]
    for batch in batches:
        for part, buffer, starts, lengths in _pieces(batch["body"].tolist()):
            text, first, last, place, key = named_grams(buffer, starts, lengths)
            rows = []
            bounds = np.searchsorted(text, np.arange(len(starts) + 1))
            for i, (name, known) in enumerate(zip(batch["id"].iloc[part], batch["known"].iloc[part], strict=True)):
                shared = {k["key"]: k["many"] for k in known}
                own = slice(bounds[i], bounds[i + 1])
                at, keys, low, high = place[own], key[own], first[own], last[own]
                met: dict[bytes, list] = {}
                for j in np.flatnonzero(np.isin(keys, np.fromiter(shared, np.int64, len(shared)))):
                    lead, body = int(at[j] - low[j]), buffer[low[j] : high[j] + SPAN].tobytes()
                    context = hashlib.blake2b(body, digest_size=16, salt=lead.to_bytes(16, "little")).digest()
                    if context in met:
                        met[context][2].append(int(low[j] - starts[i]))
                    else:
                        met[context] = [name, context, [int(low[j] - starts[i])], lead, int(keys[j]), shared[keys[j]], body]
                rows += met.values()
            yield pd.DataFrame(rows, columns=columns)


class Suffixes:
    """Contexts of a few grams in one buffer; a suffix runs from a context's gram to the context's end."""

    def __init__(self, bodies: list[bytes], leads: np.ndarray, groups: np.ndarray):
        lengths = np.array([len(b) for b in bodies], np.int64)
        self.starts = np.cumsum(lengths) - lengths
        self.buffer = np.frombuffer(b"".join(bodies) + bytes(SPAN + 1), np.uint8)
        self.prefix = prefix_hashes(self.buffer)
        self.leads, self.groups = leads, groups
        self.at, self.size = self.starts + leads, lengths - leads

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes i and j, by binary search over prefix hashes."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        a, b = self.at[i], self.at[j]
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            same = hashed(self.prefix, a, middle) == hashed(self.prefix, b, middle)
            low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)
        return low

    def before(self, i: np.ndarray, j: np.ndarray, equal: bool) -> np.ndarray:
        """Whether suffix i sorts before suffix j; ``equal`` is the answer for equal ones."""
        n = self.common(i, j)
        ends_i, ends_j = n == self.size[i], n == self.size[j]
        smaller = self.buffer[self.at[i] + n] < self.buffer[self.at[j] + n]
        return np.where(ends_i & ends_j, equal, np.where(ends_i, True, np.where(ends_j, False, smaller)))

    def order(self) -> np.ndarray:
        """Suffixes of each group in order: a bottom-up mergesort of all groups at once, groups already contiguous."""
        order, n = np.arange(len(self.at)), len(self.at)
        begin = np.searchsorted(self.groups, self.groups, "left")
        end = np.searchsorted(self.groups, self.groups, "right")
        width = 1
        while width < (end - begin).max(initial=0):
            slot = np.flatnonzero(end - begin > width)
            run = (slot - begin[slot]) // width
            right = run % 2 == 1
            other = begin[slot] + np.where(right, run - 1, run + 1) * width
            low = np.zeros(len(slot), np.int64)
            high = np.clip(end[slot] - other, 0, width)
            while (open_ := low < high).any():
                middle = (low + high) // 2
                probe = order[np.minimum(other + middle, n - 1)]
                # equal suffixes keep their order: the left run's come first
                ahead = np.zeros(len(slot), bool)
                ahead[open_] = self.before(probe[open_], order[slot[open_]], False)
                tied = right & open_ & ~ahead
                ahead[tied] = self.before(probe[tied], order[slot[tied]], True)
                low, high = np.where(open_ & ahead, middle + 1, low), np.where(open_ & ~ahead, middle, high)
            target = np.where(right, other + slot - (begin[slot] + run * width), slot) + low
            moved = order.copy()
            moved[target] = order[slot]
            order = moved
            width *= 2
        return order

    def same_bytes(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> bool:
        for at in range(0, len(a), 10_000):
            some = slice(at, at + 10_000)
            step = np.arange(length[some].max(initial=0))
            inside = step < length[some][:, None]
            last = len(self.buffer) - 1
            left, right = (self.buffer[np.minimum(x[some][:, None] + step, last)] for x in (a, b))
            if ((left != right) & inside).any():
                return False
        return True

    def repeated(self) -> np.ndarray | None:
        """For each context and number of bytes before the gram: whether the string there occurs in two contexts.

        None if a hash collision was found.
        """
        order = self.order()
        n = len(order)
        lcp = np.zeros(n + 1, np.int64)
        inner = np.flatnonzero(self.groups[order[1:]] == self.groups[order[:-1]]) + 1
        i, j = order[inner - 1], order[inner]
        lcp[inner] = self.common(i, j)
        a, b, most = self.at[i], self.at[j], lcp[inner]
        ends_i = most == self.size[i]
        ordered = ends_i | ((most < self.size[j]) & (self.buffer[a + most] < self.buffer[b + most]))
        if not ordered.all() or not self.same_bytes(a, b, most):
            return None
        reach = np.empty(n, np.int64)
        reach[order] = np.maximum(lcp[:-1], lcp[1:])
        least = SPAN - np.minimum(self.size, reach)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        out = np.zeros((n, SPAN - GRAM + 1), bool)
        claims = []
        for lead in range(int(least.min(initial=SPAN)), int(self.leads.max(initial=-1)) + 1):
            own = np.flatnonzero((least <= lead) & (lead <= self.leads))
            if len(own) < 2:
                continue
            alike = np.cumsum(lcp[:-1] < SPAN - lead)[rank[own]]
            tag = _mixed(hashed(self.prefix, self.at[own] - lead, lead) + _mixed(alike.astype(np.uint64) * np.uint64(_BASE)))
            by = np.argsort(tag, kind="stable")
            same = tag[by][1:] == tag[by][:-1]
            u, v = own[by][:-1][same], own[by][1:][same]
            out[u, lead] = out[v, lead] = True
            claims.append((u, v, np.full(len(u), lead)))
        if claims:
            u, v, lead = (np.concatenate(x) for x in zip(*claims, strict=True))
            by = np.lexsort((lead, v, u))
            u, v, lead = u[by], v[by], lead[by]
            new = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])])) if len(u) else np.zeros(0, np.int64)
            last = np.append(new[1:], len(u)) - 1 if len(u) else new
            # from the longest reach to the left to the end of the string that reaches least to it
            if not self.same_bytes(self.at[u[new]] - lead[last], self.at[v[new]] - lead[last], lead[last] + SPAN - lead[new]):
                return None
        return out

    def repeated_plainly(self) -> np.ndarray:
        """The same without hashes."""
        out = np.zeros((len(self.at), SPAN - GRAM + 1), bool)
        whole = self.buffer.tobytes()
        strings = [(i, lead, (self.groups[i], lead, whole[self.at[i] - lead : self.at[i] - lead + SPAN])) for i in range(len(self.at)) for lead in range(max(0, SPAN - self.size[i]), self.leads[i] + 1)]
        times = Counter(s for _, _, s in strings)
        for i, lead, s in strings:
            out[i, lead] = times[s] > 1
        return out


def _runs(leads: np.ndarray, marks: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each context the ranges of bytes that its marked strings cover."""
    padded = np.zeros((len(marks), marks.shape[1] + 2), np.int8)
    padded[:, 1:-1] = marks
    step = np.diff(padded, axis=1)
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(marks))]
    for (i, low), (_, high) in zip(np.argwhere(step == 1), np.argwhere(step == -1), strict=True):
        out[i].append((int(leads[i] - (high - 1)), int(leads[i] - low + SPAN)))
    return out


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, ranges) of contexts sorted by key and context; a key's rows are whole in one task."""

    def solved(rows: pd.DataFrame) -> pd.DataFrame:
        new = (rows["context"] != rows["context"].shift()).to_numpy()
        number = np.cumsum(new) - 1
        one = rows[new]
        places = rows["starts"].map(len).to_numpy()
        copies = np.bincount(number, weights=places) > 1
        leads = one["lead"].to_numpy(np.int64)
        keys = one["key"].to_numpy(np.int64)
        _, group, size = np.unique(keys, return_inverse=True, return_counts=True)
        found: list[list[tuple[int, int]]] = [[(0, len(b))] if c else [] for b, c in zip(one["body"], copies, strict=True)]
        # those with copies are partners of the others; keys whose contexts all have copies, or with one context, are done
        left = np.bincount(group, weights=~copies)
        some = np.flatnonzero((size[group] > 1) & (left[group] > 0))
        if len(some):
            order = some[np.argsort(group[some], kind="stable")]
            suffixes = Suffixes([one["body"].iloc[i] for i in order], leads[order], group[order])
            marks = suffixes.repeated()
            if marks is None:
                marks = suffixes.repeated_plainly()
            for i, runs in zip(order, _runs(leads[order], marks), strict=True):
                if not copies[i]:
                    found[i] = runs
        out = [(name, [x for at in starts for low, high in found[k] for x in (at + low, at + high)]) for name, starts, k in zip(rows["id"], rows["starts"], number, strict=True) if found[k]]
        return pd.DataFrame(out, columns=["id", "ranges"])

    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) > TOGETHER:
            rows = pd.concat(held, ignore_index=True)
            whole = rows["key"] != rows["key"].iloc[-1]
            if whole.any():
                yield solved(rows[whole].reset_index(drop=True))
            held = [rows[~whole]]
    if held and len(rows := pd.concat(held, ignore_index=True)):
        yield solved(rows)


def _parts(rows: DataFrame, width: int) -> DataFrame:
    """Contexts (id, at, lead, places, body) cut into those of their strings with lead // ``width`` alike; adds context and key.

    ``rows`` have strings of leads in one range of 2 * ``width`` at most, so a row makes one or two. Strings that are equal
    have equal leads, so they stay together; all strings of a part hold its core, whose hash is the new key.
    """
    low = F.col("lead") - (F.length("body") - SPAN)
    cut = F.col("lead") - F.col("lead") % width

    def part(first: Column, last: Column) -> Column:
        return F.struct((F.col("at") + F.col("lead") - last).alias("at"), last.alias("lead"), F.substring("body", F.col("lead") - last + 1, SPAN + last - first).alias("body"))

    each = rows.select("id", "places", F.explode(F.filter(F.array(part(F.greatest(low, cut), F.col("lead")), part(low, cut - 1)), lambda p: F.length(p["body"]) >= SPAN)).alias("p")).select("id", "places", "p.*")
    begin = F.col("lead") - F.col("lead") % width
    end = F.least(begin + width - 1, F.lit(SPAN - GRAM))
    core = F.substring("body", F.col("lead") - begin + 1, SPAN - (end - begin))
    context = F.unhex(F.substring(F.sha2(F.concat(F.lpad(F.col("lead").cast("string"), 3, "0").cast("binary"), "body"), 256), 1, 32))
    return each.select("id", "at", "lead", "places", "body", context.alias("context"), F.xxhash64(core, begin).alias("key"))


def _met(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` joined by context with ``found`` (context, places, ...).

    Contexts of more than CROWD places are broadcast, which are at most one for CROWD places, so none gathers in a task.
    """
    wide = found.where(F.col("places") > CROWD)
    others = rows.join(F.broadcast(wide.select("context")), "context", "left_anti")
    return rows.join(F.broadcast(wide), "context").unionByName(others.join(found.where(F.col("places") <= CROWD), "context"))


def _merged(parts: DataFrame) -> DataFrame:
    """One row for each context of ``parts``; ``id`` is null where there are several places, since all its strings repeat there."""
    several = F.sum("places") > 1
    one = parts.groupBy("context").agg(F.sum("places").alias("places"), F.when(~several, F.first("id")).alias("id"), *[F.first(c).alias(c) for c in ("at", "lead", "key", "body")])
    return stored(one)


def crowded_ranges(contexts: DataFrame) -> DataFrame:
    """(id, ranges) of the contexts of grams with very many places, as ``repeated_ranges`` gives them.

    Equal contexts are merged. Grams that still have more than CROWD are cut: the contexts' strings are halved by their leads, each
    half has a longer core in common than the gram and is grouped by that, and so on down to single strings. What agrees
    in many texts merges, what does not is told apart by the core, so that only the contexts at the edges of a common passage are cut again.
    """
    none = F.lit(0).cast("bigint")
    # no place here: a context of several places is a partner of the others and done itself
    rows = contexts.select(F.col("context").alias("id"), none.alias("at"), "lead", F.size("starts").cast("bigint").alias("places"), "body", "context", "key")
    once = _merged(rows)
    ends = F.array("at", F.col("at") + F.length("body"))
    found = [once.where("places > 1").select(F.col("context").alias("id"), ends.alias("ranges"))]
    width = 1 << (SPAN - GRAM).bit_length()
    while True:
        sizes = once.groupBy("key").agg(F.count("*").alias("n"), F.count("id").alias("left")).where(F.col("n") > CROWD)
        crowds = stored(sizes)  # at most one for CROWD contexts
        few = once.join(F.broadcast(crowds.select("key")), "key", "left_anti")
        # two places stand for several
        starts = F.when(F.col("places") > 1, F.array("at", "at")).otherwise(F.array("at"))
        few = few.select("id", "context", starts.alias("starts"), "lead", "key", "body").repartition("key").sortWithinPartitions("key", "context")
        found.append(few.mapInPandas(_compared, "id binary, ranges array<bigint>").where("id is not null"))
        if crowds.where(F.col("left") > 0).isEmpty():
            break
        width //= 2
        parts = stored(_parts(once.join(F.broadcast(crowds.where(F.col("left") > 0).select("key")), "key", "left_semi"), width))
        once = _merged(parts)
        found.append(_met(parts.where("id is not null").select("id", "context", ends.alias("ranges")), once.where("places > 1").select("context", "places")).select("id", "ranges"))
    whole = reduce(DataFrame.unionByName, found).groupBy("id").agg(F.flatten(F.collect_list("ranges")).alias("found"))
    places = contexts.groupBy("context").agg(F.count("*").alias("places"))
    whole = stored(whole.join(places, F.col("id") == F.col("context")).select("context", "places", "found"))
    covered = F.flatten(F.transform("starts", lambda s: F.transform("found", lambda x: x + s)))
    return _met(contexts.select("id", "context", "starts"), whole).select("id", covered.alias("ranges"))


def repeated_ranges(texts: DataFrame) -> DataFrame:
    """(id, ranges): bytes of each distinct text that repeated strings cover, as begin, end, begin, end, ..., overlapping, unordered."""
    grams = texts.select("id", F.explode(F.arrays_zip("keys", "counts")).alias("g")).select("id", "g.keys", "g.counts")
    shared = grams.groupBy("keys").agg(F.sum("counts").alias("many")).where("many > 1")
    known = grams.join(shared, "keys").groupBy("id").agg(F.collect_list(F.struct(F.col("keys").alias("key"), "many")).alias("known"))
    contexts = texts.select("id", "body").join(known, "id").mapInPandas(_contexts, "id binary, context binary, starts array<bigint>, lead int, key bigint, many bigint, body binary")
    contexts = stored(contexts)
    few = contexts.where(F.col("many") <= CROWD).repartition("key").sortWithinPartitions("key", "context")
    ranges = few.mapInPandas(_compared, "id binary, ranges array<bigint>")
    return ranges.unionByName(crowded_ranges(contexts.where(F.col("many") > CROWD)))


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, n_bytes, removed, kept): ``removed`` are the maximal runs of covered bytes, ``kept`` the other bytes."""
    for batch in batches:
        rows = []
        for row in batch.itertuples(index=False):
            n = len(row.body)
            runs: list[list[int]] = []
            if row.copies > 1 and n >= SPAN:
                runs = [[0, n]]
            elif row.ranges is not None and len(row.ranges):
                pairs = np.asarray(row.ranges, np.int64).reshape(-1, 2)
                for low, high in pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))].tolist():
                    if runs and low <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], high)
                    else:
                        runs.append([low, high])
            ends = [0, *[x for run in runs for x in run], n]
            rows.append((row.id, n, [x for run in runs for x in run], b"".join(row.body[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))))
        yield pd.DataFrame(rows, columns=["id", "n_bytes", "removed", "kept"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """Every distinct text of ``docs`` (text): id, n_bytes, removed (begin, end, ... of the maximal runs), kept (binary).

    A null text is empty and has no row here. Texts shorter than SPAN bytes keep everything. Copies of a text of SPAN bytes or
    more lose everything, whichever row they are in; a string that repeats inside one text counts, overlapping or not. Other
    columns are left out. Texts of any length are taken whole. An empty table gives an empty one.
    """
    texts = distinct_texts(docs, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = repeated_ranges(texts).groupBy("id").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    rows = texts.select("id", "copies", "body").join(found, "id", "left")
    return rows.mapInPandas(_cut, "id binary, n_bytes bigint, removed array<bigint>, kept binary")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document when all repeated strings of 200 bytes are removed; null texts are empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = deduplicated(docs)
    size = F.size("removed")
    removed = F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0).cast("bigint"), lambda acc, i: acc + F.get("removed", i) * F.when(i % 2 == 1, 1).otherwise(-1))
    digest = left.select("id", "n_bytes", F.when(size > 0, removed).otherwise(F.lit(0)).cast("bigint").alias("n_removed"), F.floor(size / 2).alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    none = hashlib.sha256(b"").hexdigest()
    rows = docs.select("doc_id", text_id().alias("id")).join(settle(digest), "id", "left")
    zero = F.lit(0).cast("bigint")
    return rows.select("doc_id", *[F.coalesce(c, zero).alias(c) for c in ("n_bytes", "n_removed", "n_spans")], F.coalesce("kept_sha256", F.lit(none)).alias("kept_sha256"))
