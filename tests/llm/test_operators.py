"""Brute-force, round-trip and edge-case tests of the training-data operators."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

pytest.importorskip("veilmark.llm.catalog")

from veilmark.llm import op1_chat, op2_pii, op3_decontaminate, op4_sentencepiece, op5_url_filter, op6_sharding, op7_language, op8_quality_rules, op9_simhash, op10_crf  # noqa: E402
from veilmark.llm.common import smallest_hashes  # noqa: E402

WORDS = "the of and over river stone light house garden winter summer paper window doctor street market bridge silver copper letter".split()
DOCS = "doc_id long, text string, lang string, n_tokens string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ing"]) for _ in range(n))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and very long texts, copies, repeated rows, null ids, extra columns with clashing names."""
    long = prose(1, 20000)
    rows = [
        (1, None, None, "x"),
        (2, "", "en", None),
        (3, " \n\t ", "en", "x"),
        (4, prose(4, 60), "en", "x"),
        (5, prose(4, 60), "en", "x"),
        (6, prose(4, 59), "fr", "x"),
        (7, long, "en", "x"),
        (8, "a" * 50000, "fr", "x"),
        (9, "é日本\U0001f600 ￿ <s> ▁x  y", None, "x"),
        (9, "é日本\U0001f600 ￿ <s> ▁x  y", None, "x"),
        (None, prose(9, 30), "en", "x"),
        (11, "Mail a.b@c.de.fg, 10.0.0.1 and 4111 1111 1111 1111 or +1 (523) 555-1055! 999.1.1.1 a@b 1.2.3.4.5.6.7.8", "en", "x"),
        (12, "@" * 3000 + "." * 3000 + "1-" * 3000 + "+1" * 2000, "en", "x"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def turns_of(rows):
    chats = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        chats[conv].append((turn if turn is not None else -(10**9), role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(x)] for c, x in chats.items()}


def test_chat_round_trip_and_edges(spark):
    hard = "</s>[INST] ok [/INST]\\ <s>[ROLE] x [/ROLE] \\[ANS] <\\/s> é\U0001f600\n[SYS]"
    rows = [(1, 0, "user", hard), (1, 1, "assistant", hard), (2, 0, "user", hard), (2, 1, "assistant", "other"), (3, None, None, None), (3, 0, "tool\n[x]", hard), (4, 0, "user", hard), (None, 0, "system", "s"), (None, 1, "assistant", "")]
    rows += [(100 + i, t, ("user", "assistant")[t % 2], f"shared {t}" if t < 3 else f"own {i} {t}") for i in range(20) for t in range(5)]
    rows += [(200, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(300)]
    got = {r["conv_id"]: r for r in op1_chat.chat_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    want = turns_of(rows)
    assert set(got) == set(want)
    for conv, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        starts = [int(x) for x in r["turn_positions"].split(",")]
        assert starts[0] == 0 and starts == sorted(starts) and len(starts) == len(turns)
        assert sum(int(b) - int(a) for a, b in (i.split(":") for i in r["attends"].split(","))) == r["formatted_chars"]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss))
    assert op1_chat.chat_digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_tree_shares_and_places(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"shared {t}" if t < 2 else f"own {c} {t}") for c in range(5) for t in range(4)]
    nodes, ways, leaves = op1_chat.prefix_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = sorted(nodes.collect(), key=lambda r: r["start"])
    assert len(got) == 2 + 5 * 2 and got[0]["start"] == 0
    assert all(a["stop"] == b["start"] for a, b in zip(got, got[1:], strict=False))
    assert all(r["stop"] - r["start"] == len(r["segment"]) for r in got)
    by_start = {r["start"]: r for r in got}
    for way in ways.collect():
        seen = [by_start[s] for s in sorted(way["seats"])]
        assert [r["position"] for r in seen] == [sum(len(x["segment"]) for x in seen[:i]) for i in range(len(seen))]
        covered = sum(i["stop"] - i["start"] for i in way["attends"])
        assert covered == sum(len(r["segment"]) for r in seen)
    assert leaves.count() == 5


def base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_pii_base_against_brute_force(spark, docs, none):
    got = op2_pii.find_personal_data(docs).select("doc_id", op2_pii.spans_text(op2_pii.F.col("base")).alias("b")).collect()
    want = sorted((r["doc_id"] or 0, ",".join(f"{k}:{s}:{e}" for k, s, e in base(r["text"] or ""))) for r in docs.collect() if r["doc_id"] != 12)
    assert sorted((r["doc_id"] or 0, r["b"]) for r in got if r["doc_id"] != 12) == want
    r = random.Random(3)
    texts = ["".join(r.choice("ab1.@+- 4()") for _ in range(r.randrange(60))) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["b"] for x in op2_pii.find_personal_data(frame).select("doc_id", op2_pii.spans_text(op2_pii.F.col("base")).alias("b")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == ",".join(f"{k}:{s}:{e}" for k, s, e in base(t)), t
    assert op2_pii.find_personal_data(none).count() == 0


def test_pii_context_finds_unseen_and_leaves_clean(spark):
    rows = [(i, f"the server address 10.0.{i}.7 was seen") for i in range(8)]
    rows += [(50, "the server address 300.1.2.9 was seen"), (51, "version 300.1.2.9 is out"), (52, "nothing to see here 12 times")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["added"] for r in op2_pii.find_personal_data(frame).collect()}
    assert [(s["kind"], s["start"], s["stop"]) for s in got[50]] == [(1, 19, 28)]
    assert not any(v for k, v in got.items() if k != 50)
    text = {r["doc_id"]: r["text"] for r in op2_pii.redact_documents(frame).collect()}
    assert text[50] == "the server address [IP] was seen" and text[0] == "the server address [IP] was seen" and text[52] == rows[-1][1]


def test_pii_context_finds_other_forms(spark):
    rows = [(i, f"please call me +1 (0{i}7) 555-771{i} today") for i in range(60)]
    rows += [(100 + i, f"please write to ann{i}@mail.example.com today") for i in range(20)]
    rows += [(200 + i, f"the card number 4111 1111 1111 {v} was used") for i, v in enumerate(["1111", "1129", "1137", "1145", "1152", "1160", "1178", "1186", "1194", "1202", "1210", "1228"])]
    # no plus sign; spaced; spelt out; a card that fails the checksum
    new = {300: ("please call ", "me 017 555 7713 today", "phone"), 301: ("please call ", "me (017) 555-7714, today", "phone"), 302: ("please ", "write to bo.x at mail.example.com today", "email"), 303: ("please ", "write to bo [at] mail [dot] example.com today", "email"), 304: ("the ", "card number 4111 1111 1111 1112 was used", "card")}
    want = {300: "017 555 7713", 301: "(017) 555-7714", 302: "bo.x at mail.example.com", 303: "bo [at] mail [dot] example.com", 304: "4111 1111 1111 1112"}
    rows += [(i, a + b) for i, (a, b, _) in new.items()]
    # a pattern that only accepted identifiers vouch for
    rows += [(400 + i, f"please call me 01{i} 444 771{i} now") for i in range(8)] + [(410 + i, f"reachable under 01{i} 444 771{i} now") for i in range(8)] + [(420, "reachable under 099 444 7799 now")]
    rows += [(500, "there are 017 555 7713 stones"), (501, "please call me at noon, 12 times"), (502, "we look at house.garden in 2024")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    got = {r["doc_id"]: {(op2_pii.KINDS[s["kind"]], texts[r["doc_id"]][s["start"] : s["stop"]]) for s in r["added"]} for r in op2_pii.find_personal_data(frame).collect()}
    for i, value in want.items():
        assert (new[i][2], value) in got[i], (i, got[i])
    assert got[420] == {("phone", "099 444 7799")} and all(got[410 + i] for i in range(8))
    assert not any(got[i] for i in [*range(60), *range(100, 120), 500, 501, 502])


def accepted(seeds, unseen, support=3, trusted=0.8):
    """The graph scored with plain dicts: sets of (kind, before, value)."""
    scores = {}
    while True:
        score = {**{(k, v): s for (k, v), s in scores.items()}}
        known = {(k, b) for k, b, _ in seeds} | {(k, b) for k, b, v in unseen if score.get((k, v), 0) >= trusted}
        held = [(k, b, v) for k, b, v in unseen if (k, b) in known]
        marks = collections.defaultdict(list)
        for k, b, v in held:
            marks[k, b].append(score.get((k, v), 0.0))
        for k, b, _ in seeds:
            marks[k, b].append(1.0)
        good = {p: min(sum(m) / len(m), 0.999) for p, m in marks.items() if sum(x >= trusted for x in m) >= support}
        doubt = collections.defaultdict(lambda: 1.0)
        for k, b, v in held:
            if (k, b) in good:
                doubt[k, v] *= 1 - good[k, b]
        new = {key: round(1 - d, 2) for key, d in doubt.items()}
        if new == scores:
            return {(k, b, v) for k, b, v in held if scores.get((k, v), 0) >= trusted and good.get((k, b), 0) >= trusted}
        scores = new


def test_pii_bootstrap_against_brute_force(spark):
    r = random.Random(31)
    for seed in range(3):
        pairs = lambda n, values: sorted({(r.randrange(2), f"p{r.randrange(9)}", f"v{r.randrange(values)}") for _ in range(n)})
        seeds, unseen = pairs(40 + 20 * seed, 30), [(k, b, "u" + v) for k, b, v in pairs(25, 12)]
        columns = "kind int, before string, value string"
        got = op2_pii.bootstrapped(spark.createDataFrame(seeds, columns), spark.createDataFrame(unseen, columns)).collect()
        assert {tuple(x) for x in got} == accepted(seeds, unseen)


def test_pii_recall_of_planted_identifiers(spark):
    """Unseen forms of all kinds after cues that seeds have, in random prose; the same forms without cues stay."""
    r = random.Random(37)
    digits = lambda n: "".join(str(r.randrange(10)) for _ in range(n))
    cues = {
        "email": ["write to", "mail me", "contact address:"],
        "ip": ["server address", "logged from", "host at"],
        "card": ["card number", "account number", "paid with"],
        "phone": ["call me", "phone number", "reach her"],
        "secret": ["token =", "api key", "password is"],
    }
    seed = {
        "email": lambda: f"{r.choice(WORDS)}.{digits(4)}@{r.choice(WORDS)}.example.com",
        "ip": lambda: ".".join(str(r.randrange(256)) for _ in range(4)),
        "card": lambda: r.choice([c for c in ("4" + digits(15) for _ in range(60)) if base(c) and base(c)[0][0] == "card"]),
        "phone": lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}",
        "secret": lambda: '"' + sha(digits(9))[:40] + '"',
    }
    unseen = {
        "email": lambda: r.choice([f"{r.choice(WORDS)}{digits(3)} at {r.choice(WORDS)} dot example dot com", f"{r.choice(WORDS)}{digits(3)} [at] mail.example.com"]),
        "ip": lambda: r.choice([f"{r.randrange(300, 999)}.{digits(2)}.{digits(2)}.{digits(2)}", f"{digits(2)}[.]{digits(2)}[.]{digits(2)}[.]{digits(2)}"]),
        "card": lambda: r.choice([f"{digits(4)} {digits(4)} {digits(2)}", f"DE{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}"]),
        "phone": lambda: r.choice([f"0{digits(2)} {digits(3)} {digits(4)}", f"(0{digits(3)}) {digits(6)}"]),
        "secret": lambda: r.choice(["sk-" + digits(6) + "aZq" + digits(4), "Zx9" + digits(3) + "!pass" + digits(2)]),
    }
    rows, planted = [], {}
    for kind, words in cues.items():
        for i in range(60):
            rows.append((len(rows), f"{prose(len(rows), 20)} {r.choice(words)} {seed[kind]()} {prose(len(rows) + 1, 10)}"))
        for i in range(15):
            head, value = f"{prose(len(rows), 20)} {r.choice(words)} ", unseen[kind]()
            planted[len(rows)] = (kind, len(head), len(head) + len(value))
            rows.append((len(rows), f"{head}{value} {prose(len(rows) + 1, 10)}"))
            rows.append((len(rows), f"{prose(len(rows), 20)} {unseen[kind]()} {prose(len(rows) + 1, 10)}"))
    found = op2_pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(x["doc_id"], op2_pii.ALL_KINDS[s["kind"]], s["start"], s["stop"]) for x in found for s in x["added"]}
    seeds = {(x["doc_id"]) for x in found if any(s["kind"] == 4 for s in x["added"])} - set(planted)
    hits = {(i, *p) for i, p in planted.items()} & got
    wrong = [g for g in got if g[0] not in planted and g[0] not in seeds]
    assert len(hits) >= 0.9 * len(planted), (len(hits), len(planted))
    assert len(wrong) <= 0.05 * len(hits), wrong


def test_pii_long_texts_take_linear_time(spark):
    import time

    took = []
    for n in (8_000, 32_000):
        frame = spark.createDataFrame([(1, " ".join(["x1 a@b.c"] * (n // 2)))], "doc_id long, text string")
        start = time.time()
        assert frame.select(F.size(op2_pii.base_spans(F.col("text"))).alias("b"), F.size(op2_pii.candidates(F.col("text"))).alias("c")).first()["b"] == n // 2
        redacted = op2_pii.redacted(F.col("text"), op2_pii.places(op2_pii.base_spans(F.col("text"))))
        assert frame.select(redacted.alias("r")).first()["r"] == " ".join(["x1 [EMAIL]"] * (n // 2))
        took.append(time.time() - start)
    assert took[1] < 10 * took[0] + 5


def contaminated(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for item, body in items:
        b = words(body)
        n = min(13, len(b))
        windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


def test_contamination_against_brute_force(spark, docs, none):
    r = random.Random(5)
    items = [(i, prose(100 + i, n)) for i, n in enumerate((40, 25, 13, 12, 5, 1, 0))] + [(20, None), (21, prose(100, 40)), (22, "river, STONE é")]
    texts = []
    for i in range(60):
        body = prose(i, r.randrange(0, 300)).split()
        for _ in range(r.randrange(3)):
            part = (items[r.randrange(7)][1] or "").split()
            a = r.randrange(len(part) + 1)
            at = r.randrange(len(body) + 1)
            body[at:at] = part[a : a + r.randrange(25)]
        texts.append(" ".join(body).upper() if i % 7 == 0 else " ".join(body))
    frame = spark.createDataFrame(list(enumerate(texts)) + [(900, None), (901, ""), (902, texts[0]), (902, texts[0])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = op3_decontaminate.contamination(frame, bench).collect()
    assert len(got) == 64
    by_id = {x["doc_id"]: x for x in got}
    for i, t in enumerate(texts):
        x = by_id[i]
        assert (x["n_words"], x["n_hit"], x["items"], x["contaminated"]) == contaminated(t, items)
    assert op3_decontaminate.contamination(docs, bench).count() == 13
    assert op3_decontaminate.contamination(none, bench).count() == 0
    assert op3_decontaminate.contamination(frame, bench.limit(0)).where("n_hit > 0").count() == 0


def test_sentencepiece_equals_library(spark, docs, none):
    model = op4_sentencepiece.model_bytes()
    lib, own = sentencepiece.SentencePieceProcessor(model_proto=model), op4_sentencepiece.PrefixTable(model)
    r = random.Random(7)
    texts = ["".join(r.choice(a) for _ in range(r.choice((1, 5, 40, 200)))) for a in ("ab \n", "the ing ", "日本語 a\U0001f600é", " ▁x", "lloo ", "\x00\t1a") for _ in range(60)]
    texts += [" " * n + "x" + " " * n for n in (1, 2, 15, 16, 17, 33, 200)] + [x["text"] or "" for x in docs.collect()]
    for t in texts:
        ids = lib.encode(t)
        assert own.encode(t) == ids and own.decode(ids) == lib.decode(ids) == own.joined(t)[1]
    for x in op4_sentencepiece.encode_documents(docs, model).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        ids = lib.encode(x["text"] or "")
        assert (x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)))
    assert op4_sentencepiece.encode_documents(docs, model).count() == 13 and op4_sentencepiece.encode_documents(none, model).count() == 0
    ids = op4_sentencepiece.encoder(model)(docs["text"])
    assert docs.select(op4_sentencepiece.decoder(model)(ids).alias("t")).where("t is null").count() == 0


def test_url_rules_and_templates(spark):
    rows = [(1, None), (2, ""), (3, "no scheme/x"), (4, "https://EXAMPLE.net/en/1?x#y"), (5, "http://a.net/x"), (6, "http://anet/x"), (7, "http://b.example.com/de/1"), (8, "http://b.example.com/en/1"), (9, "http://x.org/fr/9"), (10, "http://net"), (None, "x://y.net/?q"), (1, None)]
    rows += [(100 + i, f"http://c.example.com/de/{i}") for i in range(30)] + [(200 + i, f"http://c.example.com/en/{i}") for i in range(30)]
    got = collections.defaultdict(list)
    for r in op5_url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect():
        got[r["page_id"]].append((r["host"], r["path"], r["rule"], r["verdict"]))
    assert got[1] == [("", "", None, "allow")] * 2 and got[3] == [("", "", None, "allow")]
    assert got[4] == [("example.net", "/en/1", "example.net/en/", "allow")]
    assert got[5] == [("a.net", "/x", "net/", "block")] and got[6] == [("anet", "/x", None, "allow")]
    assert got[7][0][2:] == ("example.com/de/", "block") and got[8][0][2:] == (None, "allow") and got[9][0][2:] == ("org/fr/", "allow")
    assert got[10] == [("net", "", None, "allow")] and got[None][0][2:] == ("net/", "block")
    assert all(got[200 + i][0][3] == "allow" for i in range(30))
    assert op5_url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_template_rejects_what_its_labels_reject(spark):
    rules = [("block", "h.com", "/ads/a"), ("allow", "h.com", "/news/a")]
    rows = [(i, f"http://h.com/{'ads' if i % 2 else 'news'}/{'a' if i % 40 else 'z'}{i}") for i in range(400)]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in op5_url_filter.filter_urls(spark.createDataFrame(rows + [(999, "http://h.com/ads/z9")], "page_id long, url string"), rules).collect()}
    assert got[999] == (None, "block") and got[0] == (None, "allow")


def test_url_templates_whole(spark):
    rules = [("block", "h.com", "/ads/a"), ("allow", "h.com", "/news/a"), ("block", "k.com", "/a/b/c/d/e/bad/x"), ("allow", "k.com", "/a/b/c/d/e/good/x"), ("block", "big.com", "/few/a"), ("allow", "big.com", "/b")]
    # 100 blocked, 70 unlabelled: the labelled ones decide
    rows = [(i, f"http://h.com/ads/{'a' if i < 100 else 'z'}{i}") for i in range(170)] + [(200 + i, f"http://h.com/news/a{i}") for i in range(100)]
    # the branches part at the sixth segment
    rows += [(1000 + i, f"http://k.com/a/b/c/d/e/{'bad' if i % 2 else 'good'}/{'x' if i % 40 > 1 else 'z'}{i}") for i in range(400)]
    # a branch of one in a hundred rows of its host
    rows += [(2000 + i, f"http://big.com/b{i % 10}/{i}") for i in range(2970)] + [(6000 + i, f"http://big.com/few/{'a' if i else 'z'}{i}") for i in range(30)]
    rows += [(9999, "http://deep.com/" + "/".join(map(str, range(300))))]
    got = {r["page_id"]: r for r in op5_url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert len(got) == len(rows)
    assert (got[150]["rule"], got[150]["verdict"], got[150]["template"]) == (None, "block", "/ads/*") and got[150]["purity"] == pytest.approx(102.5 / 105)
    assert (got[1001]["rule"], got[1001]["verdict"], got[1001]["template"]) == (None, "block", "/*/*/*/*/*/bad/*") and got[1000]["verdict"] == "allow"
    assert (got[6000]["rule"], got[6000]["verdict"], got[6000]["template"]) == (None, "block", "/few/*") and got[2000]["verdict"] == "allow"
    assert got[9999]["template"] == "/*" * 300 and got[9999]["purity"] == 0.5


def tree(urls):
    """{path: template} of one host's paths [(path, segments, n, block, allow)], comparing every segment with its siblings."""
    forms = ["", r"[0-9]+", r".*\.[^.]*", r".*[0-9].*", r".*[-_].*", r".*"]
    shape = lambda s: next(i for i, f in enumerate(forms) if re.fullmatch(f, s, re.S))
    angle = lambda n, b, a: 2 * np.arcsin(np.sqrt((b + (n - b - a) / 2) / n))
    branches = collections.defaultdict(lambda: collections.defaultdict(lambda: (np.zeros(3), np.zeros(19))))
    shapes = {u[0]: [shape(s) for s in u[1]] for u in urls}
    for path, segments, *counts in urls:
        for i, s in enumerate(segments):
            rest = len(segments) - i - 1
            sums, profile = branches[tuple(shapes[path][:i])][s]
            sums += counts
            profile[1 + (min(rest, 3) - 1) * 6 + shapes[path][i + 1] if rest else 0] += counts[0]
    kept = set()
    for place, siblings in branches.items():
        for s, (sums, profile) in siblings.items():
            group = [v for t, v in siblings.items() if t != s and shape(t) == shape(s) and v[1].argmax() == profile.argmax()]
            if sums[0] < 5 or len(siblings) == 1:
                continue
            others, ways = sum((v[0] for v in group), np.zeros(3)), sum((v[1] for v in group), np.zeros(19))
            n, m = sums[0], others[0]
            if not m or np.abs(profile / n - ways / m).sum() / 2 > 0.25 + np.sqrt(1 / n + 1 / m) or abs(angle(*sums) - angle(*others)) * np.sqrt(n * m / (n + m)) >= 2:
                kept.add((place, s))
    return {path: "".join("/" + s if (tuple(shapes[path][:i]), s) in kept else "/*" for i, s in enumerate(segments)) for path, segments, *_ in urls}


def test_url_trees_of_any_depth(spark):
    rules = [("block", "h.com", "/" + "a/" * 999 + "b")]
    rows = [(i, "http://h.com/" + "a/" * 999 + f"{'b' if i < 20 else 'c'}{i}") for i in range(24)] + [(99, "http://long.com/" + "x" * 2_000_000)]
    got = {r["page_id"]: r for r in op5_url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert {r["verdict"] for i, r in got.items() if i < 24} == {"block"} and got[23]["rule"] is None and got[23]["template"] == "/*" * 1000
    assert got[99]["template"] == "/*" and got[99]["verdict"] == "allow"


def test_url_branches_merge_by_what_follows(spark):
    rules = [("block", "h.com", "/alice/1"), ("block", "h.com", "/bob/1"), ("allow", "h.com", "/blog/")]
    rows = [(100 * k + i, f"http://h.com/{who}/{i + 1}") for k, who in enumerate(["alice", "bob", "carol"]) for i in range(20)]
    rows += [(1000 + i, f"http://h.com/blog/2020/{'abcdefghij'[i % 10]}-post/x") for i in range(30)] + [(2000, "http://h.com/dave/7")]
    got = {r["page_id"]: r for r in op5_url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    # users are alike and differ from the blog in how they go on; one more of few urls is judged with them
    assert {got[i]["template"] for i in (0, 101, 2000)} == {"/*/*"} and got[2000]["verdict"] == "block" and got[1000]["template"].startswith("/blog/")
    assert got[1000]["verdict"] == "allow"


def test_url_tree_against_brute_force(spark):
    r = random.Random(41)
    rules = [("block", "h.com", "/a/x"), ("block", "h.com", "/b/x"), ("allow", "h.com", "/c"), ("block", "i.com", "/q"), ("allow", "i.com", "/q/ok")]
    vocabulary = ["a", "b", "c", "q", "x1", "x2", "ok", "ok/y", "", "7"]
    rows = []
    for i in range(2500):
        path = "/".join(r.choice(vocabulary) for _ in range(r.randrange(1, 5))) + r.choice(["", f"/{r.randrange(400)}"])
        rows.append((i, f"http://{r.choice(['h.com', 'i.com', 'www.h.com'])}/{path}"))
    got = op5_url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    assert len(got) == len(rows)
    counts = collections.defaultdict(lambda: [0, 0, 0])
    for x in got:
        said = next((v for v, h, p in sorted(rules, key=lambda z: -len(z[1] + z[2])) if (x["host"] == h or x["host"].endswith("." + h)) and x["path"].startswith(p)), None)
        c = counts[x["host"], x["path"]]
        c[0] += 1
        c[1] += said == "block"
        c[2] += said == "allow"
    want = {}
    for host in {h for h, _ in counts}:
        urls = [(p, re.sub("^/+", "", p).split("/"), *c) for (h, p), c in counts.items() if h == host]
        want |= {(host, p): t for p, t in tree(urls).items()}
    sums = collections.defaultdict(lambda: [0, 0])
    for key, c in counts.items():
        for i in (0, 1):
            sums[key[0], want[key]][i] += c[i + 1]
    for x in got:
        template = want[x["host"], x["path"]]
        assert x["template"] == template, (x["host"], x["path"])
        block, allow = sums[x["host"], template]
        assert x["purity"] == pytest.approx((block + 2.5) / (block + allow + 5))
        if x["rule"] is None:
            assert x["verdict"] == ("block" if x["purity"] >= 0.8 else "allow")
    assert any(x["rule"] is None and x["verdict"] == "block" for x in got)


def test_sharding_law_and_places(spark, docs, none):
    rows = [(i, prose(i, 5 + i % 90)) for i in range(3000)]
    got = op6_sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8, 512).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() - sizes.min() < 0.01 * sizes.mean()
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    for r in got.itertuples():
        raw = rows[r.doc_id][1].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "bytes")
    edge = op6_sharding.shard_documents(docs).collect()
    assert len(edge) == 13 and {r["size"] for r in edge if r["doc_id"] == 1} == {16} and op6_sharding.shard_documents(none).count() == 0


def test_sharding_law_with_null_and_repeated_ids(spark):
    """A third of all ids is null and a third one id: the bytes of shards stay near equal."""
    rows = [([None, 7, i][i % 3], prose(i, 5 + i % 90)) for i in range(6000)]
    got = op6_sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8, 512).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(got) == 6000 and len(sizes) == 8 and sizes.max() - sizes.min() < 0.02 * sizes.mean()


def test_sharding_map_versions(spark, tmp_path):
    sizes = spark.range(64).selectExpr("int(id) as slot", "id * 10 as bytes")
    start = op6_sharding.first_map(spark, 4, 64)
    even = op6_sharding.rebalanced(start, sizes, 4)
    grown = op6_sharding.grown(even, sizes, 4)
    for m in (start, even, grown):
        op6_sharding.store_map(m, str(tmp_path / "map"))
    assert op6_sharding.stored_map(spark, str(tmp_path / "map")).first()["version"] == 2
    old = {r["slot"]: r["shard"] for r in op6_sharding.stored_map(spark, str(tmp_path / "map"), 1).collect()}
    new = {r["slot"]: r["shard"] for r in op6_sharding.stored_map(spark, str(tmp_path / "map"), 2).collect()}
    assert all(new[s] in (old[s], 4) for s in old) and 4 in new.values()


def test_sharding_against_brute_force(spark, tmp_path):
    """Slots, both versions of the map, shards and places by plain Python; the map is read back from where it is stored."""
    import struct

    import xxhash

    rows = [(i, prose(i, 3 + i % 70)) for i in range(400)] + [(None, "é"), (7, None)]
    shards, slots = 5, 64
    got = op6_sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards, slots, str(tmp_path / "map")).collect()
    size = lambda t: len((t or "").encode()) + 16

    def slot_of(i, t):
        h = 42
        for v in (i, zlib.crc32((t or "").encode()), size(t)):
            h = h if v is None else xxhash.xxh64_intdigest(struct.pack("<q", v), h)
        return (h - 2**64 if h >> 63 else h) % slots

    weight = collections.Counter()
    for i, t in rows:
        weight[slot_of(i, t)] += size(t)
    first = {s: s * shards // slots for s in range(slots)}
    target, loads, loose = sum(weight.values()) / shards, [0] * shards, []
    for shard in range(shards):
        filled = 0
        for s in sorted((s for s in first if first[s] == shard), key=lambda s: (-weight[s], s)):
            filled += weight[s]
            if filled > target and weight[s]:
                loose.append(s)
            else:
                loads[shard] += weight[s]
    second = dict(first)
    for s in sorted(loose, key=lambda s: (-weight[s], s)):
        second[s] = loads.index(min(loads))
        loads[second[s]] += weight[s]
    for version, want in ((0, first), (1, second)):
        assert {r["slot"]: r["shard"] for r in op6_sharding.stored_map(spark, str(tmp_path / "map"), version).collect()} == want
    assert all(r["version"] == 1 and r["shard"] == second[r["virtual_slot"]] for r in got)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["text_crc32"], r["virtual_slot"]) for r in got), key=key) == sorted(((i, zlib.crc32((t or "").encode()), slot_of(i, t)) for i, t in rows), key=key)
    places = collections.defaultdict(list)
    for r in got:
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and len(got) == len(rows)


def test_language_parse_and_prediction(spark, docs, none):
    sample = "banana bandana"
    step = op7_language.suffix_automaton(sample)
    for text in ("banana", "xbandxx", "naban", ""):
        count, i = 0, 0
        while i < len(text):
            n = max((n for n in range(1, len(text) - i + 1) if text[i : i + n] in sample), default=1)
            count, i = count + 1, i + n
        assert op7_language.phrases(step, text) == count, text
    rows = [(i, prose(i, 50) if i % 2 else " ".join(w[::-1] for w in prose(i, 50).split()), "en" if i % 2 else "ne", None) for i in range(200)]
    got = op7_language.identify(spark.createDataFrame(rows, DOCS)).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r["lang_pred"] == ("en" if r["doc_id"] % 2 else "ne") for r in got if r["held_out"]]
    assert len(held) > 20 and np.mean(held) > 0.95
    edge = op7_language.identify(docs).collect()
    assert len(edge) == 13 and {r["lang_pred"] for r in edge if r["doc_id"] in (1, 2, 3, 12)} == {"und"} and all(0 <= r["score"] <= 1 for r in edge)
    assert op7_language.identify(none).count() == 0


def rule_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = text.split("\n")
    dups = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(hit), len(words) < 10 or 100 * len(hit) > 20 * len(words)


def test_quality_rules(spark, docs, none):
    labels = "doc_id long, quality int, toxic int"
    noisy = lambda i: " ".join(w + "%%%" for w in prose(i, 80).split())
    rows = [(i, prose(i, 80) + "\nsame line\nsame line\n x\n" if i % 3 else noisy(i), None, None) for i in range(240)]
    frame = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(160)] + [(None, 1, 0), (3, None, None)], labels)
    got = op8_quality_rules.judge_documents(frame, marks).collect()
    for r in got:
        want = rule_counts(rows[r["doc_id"]][1])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
    held = [r["kept"] == (r["doc_id"] % 3 > 0 and not r["base_failed"]) for r in got if r["doc_id"] >= 160]
    assert np.mean(held) > 0.95
    edge = op8_quality_rules.judge_documents(docs, marks).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert len(edge) == 13
    for r in edge:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == rule_counts(texts[r["doc_id"]])
    assert op8_quality_rules.judge_documents(none, marks).count() == 0 and op8_quality_rules.judge_documents(docs, marks.limit(0)).count() == 13


def brute_simhash(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_simhash_against_brute_force(spark, docs, none):
    r = random.Random(11)
    rows = []
    for i in range(150):
        words = prose(i // 5, 120).split()
        for _ in range(i % 5):
            words[r.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(500, None), (501, ""), (502, "\n"), (503, "one two"), (504, "ONE two"), (505, rows[0][1])]
    got = {x["doc_id"]: x for x in op9_simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = {i: brute_simhash(t) for i, t in rows}
    assert all(got[i]["fp"] % 2**64 == prints[i] for i in prints)
    assert components(prints) == {i: x["component_id"] for i, x in got.items()}
    assert len(op9_simhash.near_duplicates(docs).collect()) == 13 and op9_simhash.near_duplicates(none).count() == 0


def components(prints):
    parent = {i: i for i in prints}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: top(i) for i in prints}


@pytest.mark.parametrize("bucket", [1024, 8, 3])
def test_simhash_links_lose_none(spark, bucket):
    r = random.Random(13)
    prints = {}
    for c in range(12):
        value = r.getrandbits(64)
        for k in range(25):
            prints[len(prints)] = value
            for _ in range(r.randrange(4)):
                value ^= 1 << r.randrange(64)
    signed = lambda x: x - 2**64 if x >> 63 else x
    distinct = sorted({signed(x) for x in prints.values()})
    frame = spark.createDataFrame([(x,) for x in distinct], "fp long")
    from veilmark.llm.components import connected_components

    roots = {x["node"]: x["root"] for x in connected_components(op9_simhash.close_links(frame, bucket)).collect()}
    want = components({x: x % 2**64 for x in distinct})
    groups = lambda m: sorted(tuple(sorted(k for k in distinct if m.get(k, k) == v)) for v in {m.get(k, k) for k in distinct})
    assert groups(roots) == groups(want)


def test_crf_learns_whole_chains():
    r = np.random.default_rng(5)
    features = [r.normal(size=(n, op10_crf.WIDTH)) + y for y in (0, 1) for n in (1, 2, 3, 9, 16, 50)]
    labels = np.repeat([0, 1], 6)
    whole = op10_crf.train(features, labels, steps=20, block=1000)
    for block in (1, 3, 8, 50):
        assert np.allclose(op10_crf.train(features, labels, steps=20, block=block), whole, atol=1e-9)
    # the messages against all ways through a chain of seven lines in blocks of three
    score, hop = r.normal(size=(7, 2)), r.normal(size=(2, 2))
    ways = np.array(list(itertools.product((0, 1), repeat=7)))
    odds = np.exp(score[range(7), ways].sum(axis=1) + hop[ways[:, :-1], ways[:, 1:]].sum(axis=1))
    padded, real = np.zeros((3, 3, 2)), np.arange(9).reshape(3, 3) < 7
    padded[real] = score
    a, b = op10_crf._messages(padded, real, hop, np.arange(3))
    both = np.exp(a + b)[real]
    assert np.allclose(both, [[odds[ways[:, t] == k].sum() for k in (0, 1)] for t in range(7)])


def test_crf(spark, docs, none):
    r = random.Random(17)
    same, e = (1.3, 0.4), np.array([r.uniform(-2, 2) for _ in range(6)])
    total, good = 0.0, np.zeros(6)
    for path in range(64):
        y = [path >> t & 1 for t in range(6)]
        s = sum(e[t] * y[t] for t in range(6)) + sum((same[0] if a else same[1]) * (a == b) for a, b in zip(y, y[1:], strict=False))
        total += np.exp(s)
        good += np.exp(s) * np.array(y)
    assert np.allclose(op10_crf.marginals(e, same), good / total)
    line = lambda i, bad: prose(i, 12) + "." if not bad else " ".join(w.upper() + "!!" for w in prose(i, 12).split())
    rows = [(i, "\n".join(line(i * 10 + k, i % 3 == 0) for k in range(1 + i % 6)), None, None) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = op10_crf.score_documents(spark.createDataFrame(rows, DOCS), labels).collect()
    held = [r["predicted"] == int(r["doc_id"] % 3 > 0) for r in got if r["held_out"]]
    assert len(held) > 40 and np.mean(held) > 0.95
    edge = op10_crf.score_documents(docs, labels).collect()
    assert len(edge) == 13 and all(0 <= r["score"] <= 1 for r in edge)
    assert {r["score"] for r in op10_crf.score_documents(docs, labels.limit(0)).collect()} == {0.5} and op10_crf.score_documents(none, labels).count() == 0


def test_smallest_hashes_are_those_of_a_whole_sort(spark):
    """Groups smaller and larger than the bound, a single row, and no rows at all."""
    rows = spark.range(5000).select(F.when(F.col("id") == 0, "one").when(F.col("id") < 40, "few").otherwise("many").alias("g"), F.xxhash64("id").alias("h"))
    expected = {g: sorted(r["h"] for r in rows.where(F.col("g") == g).collect())[:50] for g in ("one", "few", "many")}
    found = {}
    for r in smallest_hashes(rows, "g", "h", 50).collect():
        found.setdefault(r["g"], []).append(r["h"])
    assert {g: sorted(h) for g, h in found.items()} == expected
    assert smallest_hashes(rows.where("false"), "g", "h", 50).isEmpty()
