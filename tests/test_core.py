"""The reference vectors of scoring, edits, names, dates, splices, stability and multiple testing, as data."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilmark.functions import labels, names, texts
from veilmark.operators import draws, intervals, perturb, records, scoring, stability
from veilmark.sources import documents

GOLD = "document_id string, text string, spans array<struct<begin:bigint,end:bigint,label:string,subannotations:array<struct<begin:bigint,end:bigint,category:string>>>>, has_nested boolean, subannotations array<struct<begin:bigint,end:bigint,category:string>>"
PRED = "document_id string, spans array<struct<begin:bigint,end:bigint,label:string>>"
LOOKUPS = names.Lookups(["dr.", "mevr."], ["Eva", "Jan", "Jan Piet"], ["Claes", "Maes", "Berg"], ["van", "van den"], ["Linden"])


def flat(spark, gold, pred):
    return scoring.flattened(spark.createDataFrame(gold, GOLD), spark.createDataFrame(pred, PRED))


def test_perfect_and_other_label(spark):
    gold = [("n1", "Eva zag Bo.", [(0, 3, "Name:Patient", [(0, 3, "given")])], True, None)]
    row = scoring.score_summary(flat(spark, gold, [("n1", [(0, 3, "Name:Patient")])])).first()
    assert (row["exact_f1"], row["character_recall"], row["core_pii_recall"], row["non_pii_redacted_chars"]) == (1.0, 1.0, 1.0, 0)
    row = scoring.score_summary(flat(spark, gold, [("n1", [(0, 3, "Name:Other")])])).first()
    assert (row["exact_f1"], row["character_recall"], row["core_pii_recall"]) == (0.0, 0.0, 1.0)


def test_legacy_and_nested_subannotations(spark):
    legacy = [("n1", "abcdef", [(0, 3, "A", None)], False, [(0, 3, "given")])]
    assert scoring.score_summary(flat(spark, legacy, [("n1", [(0, 2, "A")])])).first()["core_pii_recall"] == pytest.approx(2 / 3)
    both = [("n1", "abcdef", [(0, 3, "A", [(0, 2, "given"), (2, 3, "Title")])], True, [(4, 6, "given")])]
    assert scoring.score_summary(flat(spark, both, [("n1", [(0, 2, "A")])])).first()["core_pii_recall"] == 1.0


def test_empty_sides(spark):
    row = scoring.score_summary(flat(spark, [], [])).first()
    assert (row["documents"], row["exact_precision"], row["exact_recall"], row["core_pii_recall"], row["non_pii_redaction_rate"]) == (0, 1.0, 1.0, 1.0, 0.0)
    row = scoring.score_summary(flat(spark, [("a", None, [], False, [])], [("b", [(0, 5, "X")])])).first()
    assert (row["exact_precision"], row["non_pii_characters"]) == (1.0, 0)


def brute(gold, pred):
    out = dict.fromkeys(("g", "p", "m", "core", "hit", "clear", "red"), 0)
    preds = dict(pred)
    for doc, text, spans, nested, legacy in gold:
        ps = preds.get(doc) or []
        by = lambda rows: {label: {x for b, e, la, *_ in rows if la == label for x in range(b, e)} for label in {r[2] for r in rows}}
        a, b = by(spans), by(ps)
        for label in a.keys() | b.keys():
            x, y = a.get(label, set()), b.get(label, set())
            out["g"] += len(x)
            out["p"] += len(y)
            out["m"] += len(x & y)
        red, gold_chars = set().union(*b.values()), set().union(*a.values())
        size = len(text or "") or max([0, *(s[1] for s in spans), *(s[1] for s in ps)])
        clear = set(range(size)) - gold_chars
        out["clear"] += len(clear)
        out["red"] += len(clear & red)
        subs = [s for r in spans for s in r[3] or []] if nested else legacy or []
        core = {x for s in subs if (s[2] or "None").strip().lower() not in labels.NOT_CORE for x in range(s[0], s[1])}
        out["core"] += len(core)
        out["hit"] += len(core & red)
    return out


def test_random_documents_against_positions(spark):
    r = random.Random(2)
    span = lambda: (b := r.randrange(-3, 30), b + r.randrange(-2, 12))
    gold, pred = [], []
    for i in range(80):
        spans = [(*span(), r.choice("AB"), [(*span(), r.choice(["given", "TITLE ", None, ""])) for _ in range(r.randrange(3))]) for _ in range(r.randrange(5))]
        gold.append((str(i), r.choice([None, "", "x" * r.randrange(40)]), spans, i % 3 > 0, [(*span(), "given")] if i % 2 else None))
        if i % 5:
            pred.append((str(i), [(*span(), r.choice("ABC")) for _ in range(r.randrange(5))]))
    pred.append(("other", [(0, 9, "A")]))
    f, want = flat(spark, gold, pred), brute(gold, pred)
    chars, rest = scoring.char_scores(f).first(), scoring.core_and_redaction(f).first()
    assert (chars["gold_chars"], chars["predicted_chars"], chars["matched_chars"]) == (want["g"], want["p"], want["m"])
    assert (rest["core_total"], rest["core_matched"], rest["non_pii_characters"], rest["non_pii_redacted_chars"]) == (want["core"], want["hit"], want["clear"], want["red"])
    merged = intervals.coalesced(f.gold, ["document_id", "label"]).agg(F.sum(F.col("end") - F.col("begin"))).first()[0]
    assert merged == want["g"]


def test_span_edits(spark):
    schema = "document_id string, begin long, end long, label string"
    pred = spark.createDataFrame([("a", 0, 2, "X"), ("a", 5, 7, "Y")], schema)
    gold = spark.createDataFrame([("a", 0, 2, "Z"), ("a", 9, 11, "Y")], schema)
    assert sorted(r["op"] for r in records.span_edits(gold, pred).collect()) == ["Addition", "Deletion", "Edit"]
    with pytest.raises(Exception, match="duplicate span boundary"):
        records.span_edits(gold.union(gold), pred).collect()


def test_metadata(spark):
    rows = spark.createDataFrame([("Eva", "Maes", [" E. Maes", "Eva Maes", ""])], "g string, f string, a array<string>")
    assert rows.select(records.full_names(F.col("g"), F.col("f"), F.col("a"))).first()[0] == ["E. Maes", "Eva Maes"]
    with pytest.raises(ValueError, match="retired"):
        records.checked_keys(["patient", "patient_name"])
    docs = spark.createDataFrame([("d", "Eva and Evan met E and Maes", [(0, 3)], ["Eva", "E"], ["Evan", "Maes"])], "document_id string, text string, spans array<struct<begin:bigint,end:bigint>>, patient array<string>, caregivers array<string>")
    got = sorted((r["begin"], r["end"], r["label"]) for r in records.injected(docs).collect())
    assert got == [(8, 11, "Name:Patient"), (23, 27, "Name:Caregiver")]


@pytest.mark.parametrize(
    ("text", "pattern", "first", "last"),
    [
        ("Eva Maes", "first_last", "Eva", "Maes"),
        ("dr. mevr. JAN PIET van den Linden", "first_last", "Jan Piet", "van den Linden"),
        ("Maes Eva", "last_first", "Eva", "Maes"),
        ("Maes, Eva", "last_comma_first", "Eva", "Maes"),
        ("Maes, E.", "last_comma_initial", "", "Maes"),
        ("E Maes", "initial_last", "", "Maes"),
        ("Maes E.", "last_initial", "", "Maes"),
        ("Eva J. Maes", "first_middle_initial_last", "Eva", "Maes"),
        ("eva", "first_only", "Eva", ""),
        ("MAES", "last_only", "", "MAES"),
        ("dr.", None, None, None),
        ("", None, None, None),
        ("Unknown Person", None, None, None),
    ],
)
def test_name_patterns(text, pattern, first, last):
    found = names.NameParser(LOOKUPS).parse(text)
    assert (found and (found[3], found[1], found[2])) == (pattern and (pattern, first, last))


def test_name_writing(spark):
    rows = spark.createDataFrame([("DR. EVA MAES",), ("maes",), ("Maes, e.",), ("Eva J. Maes",)], "n string").select("n", names.parsed_name(F.col("n"), LOOKUPS).alias("p"))
    parts, jan, claes = F.col("p"), F.lit("Jan"), F.lit("Claes")
    got = {r["n"]: r for r in rows.select("n", names.composed(parts, jan, claes).alias("c"), *[names.rendered(parts, f).alias(f) for f in names.FORMS]).collect()}
    assert got["DR. EVA MAES"]["c"] == "DR. JAN CLAES"
    assert [got["DR. EVA MAES"][f] for f in names.FORMS[1:]] == ["Eva MAES", "Eva", "E.M.", "Eva M.", "dr. Eva MAES"]
    assert [got["maes"][f] for f in names.FORMS] == ["maes", None, None, None, None, "dr. maes"]
    assert got["Maes, e."]["c"] == "Claes, j." and got["Eva J. Maes"]["c"] == "Jan J. Claes"
    low = spark.createDataFrame([("jan-pieter o'neil", "1jan JAN")], "a string, b string")
    assert tuple(low.select(texts.recased(F.col("a"), "full"), texts.recased(F.col("b"), "first_only")).first()) == ("Jan-Pieter O'Neil", "1Jan jan")


def test_texts(spark):
    row = spark.createDataFrame([("opname 2001, controle 2003, 12001", "jan-pieter o'NEIL")], "t string, n string")
    got = row.select(texts.years(F.col("t")), texts.years_shifted(F.col("t"), F.lit(10)), texts.recased(F.col("n"), "full"), texts.recased(F.col("n"), "first_only")).first()
    assert tuple(got) == ([2001, 2003], "opname 2011, controle 2013, 12001", "Jan-Pieter O'Neil", "Jan-pieter o'neil")
    day = spark.sql("select date'1983-05-12' as d")
    written = [day.select(texts.date_rendered(F.col("d"), p)).first()[0] for p in texts.DATE_PROFILES]
    assert written == ["12/05/1983", "12-05-1983", "12.5.1983", "12 mei 1983", "12 mei. 1983", "12-mei-1983", "do 12 mei 1983", "12/5/83"]
    back = spark.createDataFrame([(w,) for w in [*written, "43 jr", "99/99/1999", ""]], "t string").select(texts.date_parsed(F.col("t"))).collect()
    assert [str(r[0]) for r in back] == ["1983-05-12"] * 8 + ["None"] * 3
    edits = spark.createDataFrame([("a😀cdef", [(4, 6, ""), (1, 2, "bb")])], "t string, e array<struct<begin:bigint,end:bigint,replacement:string>>")
    assert edits.select(texts.replaced_all(F.col("t"), F.col("e"))).first()[0] == "abbcd"
    with pytest.raises(Exception, match="overlapping"):
        edits.select(texts.replaced_all(F.col("t"), F.array(F.struct(F.lit(0).alias("begin"), F.lit(3).alias("end"), F.lit("x").alias("replacement")), F.struct(F.lit(2).alias("begin"), F.lit(4).alias("end"), F.lit("y").alias("replacement"))))).collect()


def test_labels(spark):
    none = F.lit(None).cast("string")
    fields = dict.fromkeys(labels.LABEL_FIELDS, none) | {"Category": F.lit("Name"), "SubType": F.lit("Patient")}
    row = spark.range(1).select(labels.span_keys(fields), labels.matches(labels.span_keys(fields), ["Name:Patient"]), labels.canonical_label(fields), labels.role_of(F.lit("Name:Caregiver")), labels.subtype_of(F.lit("Date"))).first()
    assert set(row[0]) == {"name", "patient", "namepatient"} and tuple(row)[1:] == (True, "Name:Patient", "caregiver", None)


def test_variants_keep_offsets(spark):
    rows = [("d1", "Met Eva Maes op 12/05/1983, 43 jr.", [(4, 12, "Name:Patient"), (16, 26, "Date"), (28, 33, "Age_Birthdate"), (0, 99, "Date"), (4, 7, "Name:Other")])]
    notes = spark.createDataFrame(rows, "document_id string, text string, spans array<struct<begin:bigint,end:bigint,label:string>>")
    plan = perturb.Plan(trials=4, year_step=10)
    got = perturb.variants(notes, plan, LOOKUPS).collect()
    for r in got:
        t = r["target"]
        assert r["text"][t["begin"] : t["end"]] == t["text"]
        assert r["text"][: t["begin"]] == rows[0][1][: t["begin"]]
    found = {r["target"]["dimension"] for r in got}
    assert found == {"baseline", "capitalization", "format", "name_source", "date_value_shift", "date_format", "age_format"}
    assert {r["target"]["span_index"] for r in got} == {0, 1, 2} and len({r["variant_id"] for r in got}) == len(got)


def test_outcomes_and_degradation(spark):
    t = "struct<begin:bigint,end:bigint,label:string>"
    cases = [((0, 4, "Name:Patient"), [(0, 4, "Name:Other", None)], "full", "missed"), ((0, 4, "Name:Patient"), [(2, 6, "Name:Patient", "")], "partial", "partial"), ((0, 4, "Date"), [(0, 4, "Name", None)], "missed", "missed"), ((0, 4, "Date"), [(0, 4, "X", "date")], "full", "missed")]
    rows = spark.createDataFrame([(c[0], c[1]) for c in cases], f"target {t}, spans {stability.PREDICTED}")
    got = rows.select(stability.outcome(F.col("target"), F.col("spans")), stability.outcome(F.col("target"), F.col("spans"), "label")).collect()
    assert [tuple(g) for g in got] == [c[2:] for c in cases]
    said = spark.createDataFrame([("full",), ("partial",), ("missed",)], "o string")
    got = said.select(stability.outcome_score(F.col("o"), "full"), stability.outcome_score(F.col("o"))).collect()
    assert [tuple(g) for g in got] == [(1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    with pytest.raises(ValueError, match="measure"):
        stability.outcome_score(F.col("o"), "half")
    scored = [("d1", "e1", "base", 1.0), ("d1", "e1", "lower", 0.0), ("d1", "e2", "base", 1.0), ("d1", "e2", "lower", 0.0), ("d2", "e3", "base", 1.0), ("d2", "e3", "lower", 1.0)]
    frame = spark.createDataFrame([(d, e, "name", "patient", "baseline" if v == "base" else "capitalization", v, "full", s) for d, e, v, s in scored], "document_id string, entity string, kind string, role string, dimension string, dimension_value string, outcome string, score double")
    paired = stability.pairs(frame)
    row = stability.degradation(paired).first()
    assert (row["n_pairs"], row["n_clusters"]) == (3, 2) and row["mean_degradation"] == pytest.approx(2 / 3)
    stats = stability.clusters(paired, ["dimension", "role"], F.col("original") - F.col("transformed"))
    p = stability.sign_flip_p(stats, ["dimension", "role"], iterations=200).first()
    ci = stability.intervals(stats, ["dimension", "role"], iterations=200).first()
    assert 0.3 < p["p_one_sided"] < 0.7 and 0.9 < p["p_two_sided"] <= 1.0 and (ci["lower"], ci["upper"]) == (0.0, 1.0)
    flat_stats = stats.withColumn("s", F.lit(0.0))
    assert stability.sign_flip_p(flat_stats, ["dimension", "role"], iterations=50).first()["p_one_sided"] == 1.0


def test_benjamini_hochberg(spark):
    cells = spark.createDataFrame([("m", i, p) for i, p in enumerate([0.01, 0.04, 0.03])], "model string, i int, p double")
    got = {r["i"]: r["q"] for r in stability.benjamini_hochberg(cells, ["model"], "p", ["i"]).collect()}
    assert [got[i] for i in range(3)] == pytest.approx([0.03, 0.04, 0.04])
    with pytest.raises(Exception, match="must lie"):
        stability.benjamini_hochberg(cells.union(spark.createDataFrame([("m", 9, 1.5)], cells.schema)), ["model"], "p", ["i"]).collect()
    rows = [("m", s, "d", "r", n, n, 0.5, p) for s, n, p in (("a", 9, 0.01), ("b", 9, 0.04), ("c", 2, 0.001))]
    frame = spark.createDataFrame(rows, "model string, scope string, dimension string, role string, n_pairs long, n_clusters long, mean_degradation double, p_one_sided double")
    done = {r["scope"]: (r["q"], r["significant"]) for r in stability.adjusted(frame, ["a", "b", "c"]).collect()}
    assert done == {"a": (0.02, True), "b": (0.04, True), "c": (None, False)}
    with pytest.raises(ValueError, match="scopes"):
        stability.adjusted(frame, ["a", "b"])


def test_json_lines(spark, tmp_path):
    lines = [
        {"document_id": "", "doc_id": 7, "text": None, "spans": [{"begin": "3", "end": 5.9, "label": "X"}], "subannotations": [{"begin": 0, "end": 2, "category": " "}]},
        {"doc_id": "a", "spans": [{"begin": 0, "end": 1, "label": "L", "subannotations": None}], "subannotations": [{"begin": 0, "end": 9}]},
        {"doc_id": "b", "text": "old"},
        {"doc_id": "b", "text": "new"},
        {},
    ]
    path = tmp_path / "gold.jsonl"
    path.write_text("\n\n".join(map(json.dumps, lines)) + "\n")
    got = {r["document_id"]: r for r in documents.read_gold(spark, str(path)).collect()}
    assert set(got) == {"7", "a", "b", "None"} and got["b"]["text"] == "new" and got["7"]["text"] == "None" and got["a"]["text"] == ""
    assert (got["7"]["spans"][0]["begin"], got["7"]["spans"][0]["end"]) == (3, 5)
    assert got["a"]["has_nested"] and not got["7"]["has_nested"] and got["a"]["subannotations"][0]["category"] == "uncategorized"
    path.write_text('{"doc_id": "a"\n')
    with pytest.raises(Exception):  # noqa: B017
        documents.read_gold(spark, str(path)).collect()


def test_texts_and_resuming(spark, tmp_path):
    for name, body in (("m.json", '{"a": "x", "b": {"text": "y"}}'), ("l.json", '[{"document_id": "a", "text": "x"}, {"id": "b", "plain_text": "y"}]'), ("r.jsonl", '{"document_id": "a", "text": "x"}\n{"document_id": "b", "text": "", "plain_text": "y"}\n')):
        (tmp_path / name).write_text(body)
        assert {(r["document_id"], r["text"]) for r in documents.read_texts(spark, str(tmp_path / name)).collect()} == {("a", "x"), ("b", "y")}
    log = tmp_path / "log.jsonl"
    log.write_text('{"doc_id": "a", "entities": [{"begin": 0, "end": 1, "label": "L"}]}\n{"doc_id": "b", "entit')
    done = documents.read_finished(spark, str(log))
    docs = spark.createDataFrame([("a",), ("b",)], "document_id string")
    assert [r[0] for r in records.remaining(docs, done).collect()] == ["b"]
    assert {r["document_id"]: len(r["spans"]) for r in records.backfilled(docs, done).collect()} == {"a": 1, "b": 0}
    documents.write_entities(done, str(tmp_path / "out"))
    assert documents.read_finished(spark, str(tmp_path / "out")).count() == 1


def test_timings(spark):
    old = spark.createDataFrame([("m", "CUDA", 9.0, "measured", 1), ("m", "gpu", 8.0, None, 2), ("m", "cpu", 7.0, "manual", 3)], "model string, device string, seconds double, source string, ord int")
    new = spark.createDataFrame([("m", "mps", 1.234), ("m", "cpu", 2.0)], "model string, device string, seconds double")
    got = sorted((r["device"], r["seconds"], r["source"] or "") for r in records.recorded(old, new).collect())
    assert got == [("cpu", 2.0, "measured"), ("cpu", 7.0, "manual"), ("gpu", 1.23, "measured"), ("gpu", 8.0, "")]


def philox(key, lane, block):
    """One block of the generator, written out."""
    a, b = block, lane
    for i in range(10):
        product = 0xD256D193 * a
        a, b = (product >> 32) ^ ((key + i * 0x9E3779B9) % 2**32) ^ b, product % 2**32
    return a, b


def test_generator_gives_the_published_answers(spark):
    assert philox(0, 0, 0) == (0xFF1DAE59, 0x6CD10DF2) and philox(0x13198A2E, 0x85A308D3, 0x243F6A88) == (0xDD7CE038, 0xF62A4C12)
    keys, lanes = np.array([0, 2**32 - 1, 7]), np.array([0, 5, 2**32 - 1])
    got = draws.philox(keys, lanes, 9)
    assert [[tuple(row[2 * i : 2 * i + 2]) for i in range(9)] for row in got.tolist()] == [[philox(k, n, i) for i in range(9)] for k, n in zip(keys.tolist(), lanes.tolist())]
    many = draws.weights(np.arange(400), np.arange(400), 1000)
    assert abs(many.mean() - 1) < 0.01 and abs(many.var() - 1) < 0.02 and abs(draws.signs(np.arange(400), np.arange(400), 1000).mean()) < 0.01


def test_resampling_draws_against_brute_force(spark):
    def words(purpose, doc, count):
        digest = hashlib.md5(f"42:{purpose}:{doc}".encode()).hexdigest()
        return [w for i in range(count) for w in philox(int(digest[:8], 16), int(digest[8:16], 16), i)]

    r = random.Random(5)
    cells = {(d, role): {str(i): (r.choice([-1.0, 0.0, 0.5, 1.0]), r.randrange(1, 4)) for i in range(r.randrange(5, 30))} for d in ("x", "y") for role in ("a", None)}
    rows = [(*k, doc, s, n) for k, docs in cells.items() for doc, (s, n) in docs.items()]
    stats = spark.createDataFrame(rows, "dimension string, role string, document_id string, s double, n long").repartition(3)
    known = stats.where("role is not null")
    for times in (123, 10):
        p = {(x["dimension"], x["role"]): (x["p_one_sided"], x["p_two_sided"]) for x in stability.sign_flip_p(known, ["dimension", "role"], iterations=times).collect()}
        ci = {(x["dimension"], x["role"]): (x["lower"], x["upper"]) for x in stability.intervals(stats, ["dimension", "role"], iterations=times).collect()}
        assert len(ci) == 4 and len(p) == 2
        for cell, docs in cells.items():
            whole = round(sum(s for s, _ in docs.values()), 9)
            bits = {doc: words("sign", doc, 2) for doc in docs}
            flips = [round(sum(s * (1 - 2 * (bits[doc][b // 32] >> (b % 32) & 1)) for doc, (s, _) in docs.items()), 9) for b in range(times)]
            if cell in p:
                assert p[cell] == pytest.approx(((sum(v >= whole for v in flips) + 1) / (times + 1), (sum(abs(v) >= abs(whole) for v in flips) + 1) / (times + 1)))
            weight = {doc: [sum((w >> (16 * half) & 0xFFFF) >= t for t in draws.WEIGHTS) for w in words("weight", doc, 31) for half in (0, 1)] for doc in docs}
            sums = [(sum(weight[d][b] * s for d, (s, _) in docs.items()), sum(weight[d][b] * n for d, (_, n) in docs.items())) for b in range(times)]
            means = sorted(round(s / n, 9) for s, n in sums if n)
            assert ci[cell] == pytest.approx((means[int(0.025 * (len(means) - 1))], means[int(0.975 * (len(means) - 1))]))


def test_interval_is_that_of_drawing_documents(spark):
    """On many documents the interval agrees with plain drawing with replacement, whose draws are others."""
    r = random.Random(11)
    docs = [(float(r.random() < 0.3) * n, n) for n in [r.randrange(1, 4) for _ in range(400)]]
    stats = spark.createDataFrame([("x", str(i), s, n) for i, (s, n) in enumerate(docs)], "dimension string, document_id string, s double, n long")
    got = stability.intervals(stats, ["dimension"], iterations=4000).first()
    means = sorted(sum(s for s, _ in t) / sum(n for _, n in t) for t in ([r.choice(docs) for _ in docs] for _ in range(2000)))
    assert abs(got["lower"] - means[50]) < 0.01 and abs(got["upper"] - means[1950]) < 0.01


def test_registered_resampling_can_reject(spark):
    from veilmark.plans import catalog

    assert catalog.ITERATIONS == 10_000
    stats = spark.createDataFrame([("x", "a", str(i), 1.0, 1) for i in range(20)], "dimension string, role string, document_id string, s double, n long")
    p = stability.sign_flip_p(stats, ["dimension", "role"], iterations=catalog.ITERATIONS).first()
    assert p["p_one_sided"] < stability.ALPHA


def test_registered_variants_are_whole(spark, tmp_path):
    from veilmark.plans import catalog

    assert catalog.PLAN == perturb.Plan()
    orders = [(7, 3, "1995-01-02"), (8, 21, "2001-05-06")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate string").withColumn("o_orderdate", F.to_date("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(tuple(r) for r in catalog.year_shift_all_variants(spark, str(tmp_path)).collect())
    assert got == sorted((k, z, f"{z} and ({z + c % 20}) not {k + 100000}") for k, c, d in orders for z in range(1980, 2051) if z != int(d[:4]))


def test_recall_rows_have_intervals(spark):
    r = random.Random(8)
    rows = [(str(d), "name", "x", "v", s) for d in range(40) for s in [r.choice([0.0, 1.0]) for _ in range(r.randrange(1, 4))]]
    frame = spark.createDataFrame(rows, "document_id string, kind string, dimension string, dimension_value string, score double").withColumn("outcome", F.when(F.col("score") == 0, "missed").otherwise("full"))
    got = stability.recalls_with_intervals(frame, "kind", "dimension", "dimension_value").first()
    docs = [[s for d, *_, s in rows if d == str(i)] for i in range(40)]
    taken = [[docs[r.randrange(40)] for _ in docs] for _ in range(10_000)]
    means = sorted(sum(map(sum, t)) / sum(map(len, t)) for t in taken)
    assert got["lower"] == pytest.approx(means[249], abs=0.01) and got["upper"] == pytest.approx(means[9749], abs=0.01)
