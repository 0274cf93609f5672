"""Brute-force and edge-case tests of the prefix trie, the suffix sort and hard-negative mining."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("veilmark.llm.catalog")

from veilmark.llm import op11_prefix_trie, op12_suffix_dedup, op13_negatives  # noqa: E402

TURNS = "conv_id long, turn long, role string, text string, key string, n string, depth string"


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def trie_by_hand(rows):
    """Nodes as sets of tuples; ties of turns must not occur except as equal rows."""
    own = collections.defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    chats = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(math.fmod(c, 100))
        chats[c] = own.get(base, [])[:h] + turns[h:]
    members = collections.defaultdict(list)
    for c, turns in chats.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = collections.Counter(n[:-1] for n in members if n)
    out = set()
    for n, cs in members.items():
        below = [m for m in members if m[: len(n)] == n]
        ends = ",".join(map(str, sorted(c for c in cs if len(chats[c]) == len(n))))
        saved = sum((len(members[m]) - 1) * (len(m[-1][1]) if m else 0) for m in below)
        out.add((min(cs), len(n), min(members[n[:-1]]) if n else None, len(cs), kids[n], sum(not kids[m] for m in below), saved, sha(ends)))
    return out


def trie_rows(frame, height):
    got = op11_prefix_trie.prefix_trie(op11_prefix_trie.rebuilt(op11_prefix_trie.chats(frame)), height)
    return [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got.collect()]


@pytest.mark.parametrize("height", [2, 3, 8])
def test_trie_is_what_brute_force_gives(spark, height):
    r = random.Random(height)
    rows = []
    for conv in [0, 1, 2, 3, 5, 99, 100, 101, 250, 251, 307, -1, -100, -101, 10**12]:
        for turn in range(r.choice([1, 2, 4, 7])):
            rows.append((conv, turn, r.choice(["user", "assistant"]), r.choice(["a", "bb", "é日\U0001f600"]), "x", "y", "z"))
    rows += [(400 + i, turn, "user", "same", None, None, None) for i in range(40) for turn in range(3)]
    rows += [(0, turn, "user", f"deep {turn % 3}", None, None, None) for turn in range(20, 60)]
    rows += [(600, None, None, None, None, None, None), (600, None, None, None, None, None, None), (600, 3, "", "\U0001f600" * 30000, None, None, None), (None, 1, "user", "lost", None, None, None)]
    got = trie_rows(spark.createDataFrame(rows, TURNS), height)
    assert len(got) == len(set(got))
    assert set(got) == trie_by_hand(rows)


def test_trie_of_nothing_and_of_conversations_without_turns(spark):
    assert trie_rows(spark.createDataFrame([], TURNS), 4) == []
    turnless = next(c for c in range(100, 200) if zlib.crc32(str(c).encode()) % 6 >= 1 and c != 100)
    rows = [(turnless, 0, "user", "gone", None, None, None)]
    assert set(trie_rows(spark.createDataFrame(rows, TURNS), 4)) == {(turnless, 0, None, 1, 0, 1, 0, sha(str(turnless)))} == trie_by_hand(rows)


def test_many_ends_are_hashed_in_order(spark):
    ids = list(range(-50, 30000))
    random.Random(1).shuffle(ids)
    leaves = spark.createDataFrame([(bytearray(b"x" if i % 3 else b""), i) for i in ids], "leaf binary, conv_id long")
    got = {bytes(r.leaf): r.ends_sha256 for r in op11_prefix_trie.ends(leaves).collect()}
    want = {k: sha(",".join(str(i) for i in sorted(ids) if bool(i % 3) == bool(k))) for k in (b"", b"x")}
    assert got == want


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(n))


def cut_by_hand(texts, span=200):
    bodies = [(t or "").encode() for t in texts]
    times = collections.Counter(b[i : i + span] for b in bodies for i in range(len(b) - span + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if times[b[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1])), sha(kept)))
    return out


@pytest.mark.parametrize("crowd", [4096, 3])
def test_repeated_bytes_are_what_brute_force_gives(spark, tmp_path, monkeypatch, crowd):
    monkeypatch.setattr(op12_suffix_dedup, "CROWD", crowd)
    r = random.Random(7)
    shared, long = prose(r, 60), prose(r, 3000)
    texts = [None, "", "a" * 199, "a" * 5000, "ab" * 700, "a" * 4000 + prose(r, 30) + "a" * 300, long, long[2000:9000], "é日\U0001f600" * 90, "x" + "é日\U0001f600" * 40]
    texts += [prose(r, 40) + shared + prose(r, 40) for _ in range(30)]
    texts += [prose(r, 5) + shared[k : k + 201] + prose(r, 5) for k in range(0, 150, 9)]
    texts += [texts[12], texts[12], texts[13][:-1], shared[:200], shared[100:299], long[:199], long[:199]]
    r.shuffle(texts)
    rows = [(None if i == 5 else i // 2 if i > 50 else i, t, "x", "y") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, id string, body string").coalesce(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_suffix_dedup.op12_suffix_dedup(spark, str(tmp_path)).collect()
    want = [(d[0], *cut) for d, cut in zip(rows, cut_by_hand(texts), strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_crowded_grams_are_not_dealt_out_by_strings(spark, tmp_path, monkeypatch):
    r = random.Random(11)
    sizes = []

    def counted(frame, stored=op12_suffix_dedup.stored):
        done = stored(frame)
        sizes.append(done.count())
        return done

    monkeypatch.setattr(op12_suffix_dedup, "CROWD", 20)
    monkeypatch.setattr(op12_suffix_dedup, "stored", counted)
    # a common passage whose surroundings agree for a few bytes in many texts, and whole copies
    shared, edge = prose(r, 50), lambda: "".join(r.choice("ab") for _ in range(9))
    texts = [prose(r, 30) + edge() + shared + edge() + prose(r, 30) for _ in range(150)]
    texts += [edge() + shared[k:] + prose(r, 30) for k in range(0, 60, 2)] + texts[:30]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_suffix_dedup.op12_suffix_dedup(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(i, *cut) for i, cut in enumerate(cut_by_hand(texts))]
    assert max(sizes) <= 2 * sizes[0], sizes
    assert len(sizes) > 6, sizes


def test_suffix_order_and_plain_comparison(spark):
    r = random.Random(3)
    base = prose(r, 200).encode()
    bodies, leads, groups = [], [], []
    for g in range(40):
        at = r.randrange(200, 700)
        for _ in range(r.randint(1, 9)):
            low, high = at - r.randint(0, 168), at + r.randint(32, 200)
            body = bytearray(base[low : max(high, low + 200)])
            if r.random() < 0.5:
                body[r.randrange(len(body))] = 33
            bodies.append(bytes(body[: at - low + 200]))
            leads.append(at - low)
            groups.append(g)
    s = op12_suffix_dedup.Suffixes(bodies, np.array(leads), np.array(groups))
    keyed = [(g, b[n:]) for g, b, n in zip(groups, bodies, leads)]
    assert [keyed[i] for i in s.order()] == sorted(keyed)
    found = s.repeated()
    assert found is not None and (found == s.repeated_plainly()).all() and found.any()


def test_documents_without_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op12_suffix_dedup.op12_suffix_dedup(spark, str(tmp_path)).collect() == []


def negatives_by_hand(rows):
    known = []
    for i, label, v, *_ in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            known.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(x)) for x in v]))
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    anchors = {(i, label, tuple(v)) for i, label, v in known if i % 100 == 0}
    for i, label, v in anchors:
        best = sorted((-score(v, w), j) for j, other, w in known if other == label and j != i)[:5]
        for p, j in best:
            some = sorted((-score(v, w), k) for k, other, w in known if other != label and -30 * p <= 100 * score(v, w) <= -90 * p)[:10]
            out += [(i, j, rank, k, -p, -s) for rank, (s, k) in enumerate(some, 1)]
    return out


def test_negatives_are_what_brute_force_gives(spark, monkeypatch):
    monkeypatch.setattr(op13_negatives, "ROWS", 64)
    monkeypatch.setattr(op13_negatives, "ANCHOR_ROWS", 4)
    r = random.Random(5)
    vector = lambda n=20: [r.choice([0.0, 0.1, 0.5, -0.2, 1.0]) for _ in range(n)]
    rows = [(i, r.choice([0, 1, 2]), vector(), "x", "y") for i in range(0, 900, 1)]
    same = vector()
    rows += [(1000 + i, i % 3, same, None, None) for i in range(300)]
    rows += [(1700, 1, same, None, None), (1700, 1, same, None, None), (1801, 2, vector(7), None, None), (1900, 2, vector(33), None, None), (2000, 1, [], None, None)]
    rows += [(2100, None, vector(), None, None), (2200, 1, None, None, None), (2300, 1, [1.0, None], None, None), (2400, 1, [float("nan")], None, None), (2500, 1, [float("-inf")], None, None), (None, 1, vector(), None, None)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, vector string, block string").repartition(5)
    got = [tuple(x) for x in op13_negatives.hard_negatives(frame, F.col("vec_id") % 100 == 0).collect()]
    assert sorted(got) == sorted(negatives_by_hand(rows))


def test_strassen_is_exact(spark):
    r = np.random.default_rng(2)
    for shape in [(1, 1, 1), (40, 33, 70), (129, 65, 77), (0, 5, 3), (100, 1, 100)]:
        a, b = r.integers(-(2**28), 2**28, shape[:2]), r.integers(-(2**28), 2**28, shape[1:])
        assert (op13_negatives.strassen(a, b) == a @ b).all()


def test_scores_beyond_64_bits_are_an_error(spark):
    rows = [(0, 1, [1e16]), (1, 1, [1e16]), (2, 2, [1e15])]
    with pytest.raises(Exception, match="64 bits"):
        op13_negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()


def test_no_negatives_without_rows(spark):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<double>")
    assert op13_negatives.hard_negatives(none, F.col("vec_id") % 100 == 0).collect() == []
