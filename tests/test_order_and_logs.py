"""Orders without a task that holds them, resuming, battery input, artifacts, chart tables: small cases by hand."""

import json
import random

import pytest
from pyspark.sql import functions as F

from veilmark import cli
from veilmark.functions import labels, names, texts
from veilmark.operators import charts, order, report, stability
from veilmark.sources import artifacts, config, documents, inputs
from veilmark.streaming import results

SPANS = "document_id string, spans array<struct<begin:bigint,end:bigint,label:string>>"


def adjusted_by_hand(ps):
    m, least, out = len(ps), 1.0, {}
    for rank, (p, i) in reversed(list(enumerate(sorted((p, i) for i, p in ps.items()), 1))):
        least = min(least, p * m / rank)
        out[i] = least
    return out


def test_adjusted_values_of_a_family_over_many_parts(spark):
    r = random.Random(4)
    families = {f: {i: r.choice([0.0, 0.001, 0.01, 0.02, 0.5, 1.0, r.random()]) for i in range(n)} for f, n in (("a", 900), (None, 40), ("b", 1), ("c", 7))}
    rows = [(f, i, p) for f, ps in families.items() for i, p in ps.items()]
    r.shuffle(rows)
    cells = spark.createDataFrame(rows, "model string, i int, p double").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked, ends = order.placed(cells, ["model"], ["model", "p", "i"])
        assert ends.select("_part").distinct().count() > 1
        assert sorted(x["_rank"] for x in ranked.where("model = 'a'").collect()) == list(range(1, 901))
        got = {(x["model"], x["i"]): x["q"] for x in stability.benjamini_hochberg(cells, ["model"], "p", ["i"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {(f, i): q for f, ps in families.items() for i, q in adjusted_by_hand(ps).items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_lines_of_several_files_are_numbered_in_order(spark, tmp_path):
    sizes = {"b.jsonl": 3, "a.jsonl": 400, "c.jsonl": 1, "d.jsonl": 0}
    for name, n in sizes.items():
        (tmp_path / name).write_text("".join(json.dumps({"at": f"{name}{i}", "pad": "x" * 50}) + "\n\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        found = documents.numbered(documents.lines(spark, [str(tmp_path), str(tmp_path / "c.jsonl")])).select("number", documents.field("at").alias("at")).collect()
        docs = documents.read_gold(spark, str(tmp_path), ordinal=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [f"{n}{i}" for n in sorted(sizes) for i in range(sizes[n])] + ["c.jsonl0"]
    assert [r["at"] for r in sorted(found, key=lambda r: r["number"])] == want and sorted(r["number"] for r in found) == list(range(405))
    assert {r["document_id"] for r in docs} == {f"doc_{i}" for i in range(404)}


def test_another_name_is_never_the_original(spark):
    listed = ["Anna", "Bram", "ANNA", "Clara"]
    rows = spark.range(600).select(F.element_at(F.array(*[F.lit(x) for x in ("anna", "Bram", "CLARA", "Zoe", None)]), (F.col("id") % 5 + 1).cast("int")).alias("own"), "id")
    got = rows.select("own", names.drawn_apart(listed, F.col("id") * 7919, names.place(listed, F.col("own"))).alias("new")).collect()
    assert all(r["new"].lower() != (r["own"] or "").lower() for r in got)
    for own in ("anna", "Bram", "CLARA"):
        assert len({r["new"] for r in got if r["own"] == own}) == 2
    assert {r["new"] for r in got if r["own"] == "Zoe"} == {"Anna", "Bram", "Clara"}
    alone = rows.select(names.drawn_apart(["Anna"], F.col("id"), names.place(["Anna"], F.lit("Anna"))).alias("new"))
    assert {r["new"] for r in alone.collect()} == {"Anna"}


def entities(*ids):
    return [(i, [(0, 1, "L")]) for i in ids]


def test_a_killed_run_is_resumed(spark, tmp_path):
    log = str(tmp_path / "log")
    docs = spark.createDataFrame([(i, f"d{i}") for i in range(6)], "at long, document_id string")
    assert results.n_done(spark, log) == 0 and results.todo(docs, log).count() == 6
    results.record(spark.createDataFrame(entities("d0", "d1"), SPANS), log, 0)
    results.record(spark.createDataFrame(entities("d0", "d1"), SPANS), log, 0)  # a batch that is written again
    (tmp_path / "log/rows/batch=1").mkdir()
    (tmp_path / "log/rows/batch=1/part-0.json").write_text('{"doc_id":"d2","num_entities":0,"entities":[]}\n{"doc_id":"d3","num_ent')
    assert {r[0] for r in results.has(docs, log).select("document_id").collect()} == {"d0", "d1"}
    asked = []

    def predict(some):
        asked.append(sorted(r["document_id"] for r in some.collect()))
        return spark.createDataFrame(entities(*asked[-1]), SPANS)

    done = results.resume(docs, log, predict)
    assert asked == [["d2", "d3", "d4", "d5"]] and done.count() == 6
    results.resume(docs, log, predict)
    assert len(asked) == 1
    results.record(spark.createDataFrame([("d5", [])], SPANS), log, 7)
    rows = results.in_order(docs, results.finished(spark, log), "at").collect()
    assert [(r["document_id"], len(r["spans"])) for r in rows] == [("d0", 1), ("d1", 1), ("d2", 1), ("d3", 1), ("d4", 1), ("d5", 0)]
    missing = results.in_order(docs, results.finished(spark, log).where("document_id = 'd4'"), "at").collect()
    assert [len(r["spans"]) for r in missing] == [0, 0, 0, 0, 1, 0]
    results.record(docs, None, 0)
    assert results.finished(spark, None).count() == 0


def test_a_stream_is_logged_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    log, check = str(tmp_path / "log"), str(tmp_path / "check")
    stream = spark.readStream.schema("document_id string").json(str(tmp_path / "in"))
    predict = lambda rows: rows.withColumn("spans", F.expr("array(named_struct('begin', 0L, 'end', 1L, 'label', document_id))"))
    for n in range(3):
        (tmp_path / f"in/{n}.json").write_text(json.dumps({"document_id": f"d{n}"}) + "\n")
        results.follow(stream, log, check, predict).awaitTermination(60)
    assert sorted(r["document_id"] for r in results.finished(spark, log).collect()) == ["d0", "d1", "d2"]
    assert results.committed(spark, log).count() == 3


SOURCE = [
    {"id": "a", "raw_text": "x", "meta": {"patient": {"given_name": "Old", "birth_date": "1980-01-02"}, "extra": {"deep": [1, {"k": None}]}}, "pf": " Jan ", "pl": "Peeters", "d": 19800102},
    {"id": 0, "doc_id": 7, "raw_text": None, "cf": "Noor", "spans": [{"begin": 0}]},
    {"document_id": "z", "spans": [], "meta": {"patient": {"given_name": "Own"}, "caregivers": [{"given_name": "C"}, 3], "known_values": None, "date_shift_days": 0}},
    {"raw_text": "q", "meta": 5, "pf": 0, "d": False, "cf": ""},
]


def test_battery_input_from_another_source(spark, tmp_path, capsys):
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, SOURCE)))
    flags = ["--metadata-field", "meta", "--patient-first", "pf", "--patient-last", "pl", "--caregiver-first", "cf", "--doc-date", "d"]
    assert cli.main(["adapt", "--from", str(tmp_path / "s.jsonl"), "--out", str(tmp_path / "out"), *flags]) == 0
    assert "(4 docs)" in capsys.readouterr().out
    made = [json.loads(line) for f in sorted((tmp_path / "out").glob("part-*")) for line in f.read_text().splitlines()]
    assert made[0] == {"doc_id": "a", "text": "x", "metadata": {"extra": {"deep": [1, {"k": None}]}, "patient": {"given_name": "Jan", "family_name": "Peeters"}, "document_creation_date": "19800102"}}
    assert made[1] == {"doc_id": "7", "text": None, "metadata": {"caregivers": [{"given_name": "Noor"}]}, "spans": [{"begin": 0}]}
    assert made[2]["doc_id"] == "z" and made[2]["text"] == "" and "spans" not in made[2]
    assert made[3] == {"doc_id": "", "text": "q"}
    (tmp_path / "b.yaml").write_text(f"input: {tmp_path}/again\nadapter: {{from: {tmp_path}/s.jsonl, metadata_field: meta, metadata_fields: {{patient_first: pf}}}}\n")
    assert config.read_adapter(str(tmp_path / "b.yaml")) == (f"{tmp_path}/s.jsonl", f"{tmp_path}/again", inputs.Adapter(metadata_field="meta", metadata_fields={"patient_first": "pf"}))
    (tmp_path / "c.yaml").write_text("input: x\n")
    with pytest.raises(ValueError, match="adapter.from"):
        config.read_adapter(str(tmp_path / "c.yaml"))
    with pytest.raises(SystemExit):
        cli.main(["adapt"])
    back = inputs.read_input(spark, str(tmp_path / "out"))
    shaped = back.select("doc_id", F.to_json(inputs.postprocessed(inputs.resolved(F.col("metadata"), "from_input"))).alias("m"), F.size(inputs.resolved(F.col("metadata"))).alias("none"))
    got = {r["doc_id"]: (json.loads(r["m"]), r["none"]) for r in shaped.collect()}
    assert got["a"] == ({"patient": {"given_name": "Jan", "family_name": "Peeters"}, "document_creation_date": "19800102"}, 0)
    assert got["z"] == ({"patient": {"given_name": "Own"}, "caregivers": [{"given_name": "C"}], "date_shift_days": 0}, 0) and got[""] == ({}, 0)
    with pytest.raises(ValueError, match="unknown metadata source"):
        inputs.resolved(F.col("metadata"), "gold")


@pytest.mark.parametrize("key", ["patient_name", "caregiver_names"])
def test_retired_keys_are_rejected(spark, tmp_path, key):
    (tmp_path / "s.jsonl").write_text(json.dumps({"doc_id": "a", "text": "x", "metadata": {key: {}}}))
    rows = inputs.read_input(spark, str(tmp_path / "s.jsonl"))
    with pytest.raises(Exception, match="retired metadata key"):
        rows.select(inputs.resolved(F.col("metadata"), "from_input")).collect()


def test_settings_are_filled_in_while_they_are_read(tmp_path, monkeypatch):
    monkeypatch.setenv("SET", "here")
    monkeypatch.setenv("EMPTY", "")
    for text, want in [("$SET/x", "here/x"), ("${SET}x$", "herex$"), ("${UNSET:-a b}c", "a bc"), ("${UNSET}", ""), ("$UNSET.", "."), ("${EMPTY:-d}", ""), ("${1x} ${a b} $1 $$SET ${SET", "${1x} ${a b} $1 $here ${SET"), ("é$SETé", "éhereé")]:
        assert config.filled_in(text) == want
    (tmp_path / "c.yaml").write_text("dataset: /d/$SET\nseed: 3\nmodels: [{id: '$SET', '$SET': \"${UNSET:-v}\"}]\n")
    got = config.read_settings(str(tmp_path / "c.yaml"))
    assert got.dataset == "/d/here" and got.models[0].options == {"id": "here", "$SET": "v"}


def test_score_artifacts_as_tables(spark, tmp_path):
    one = {"core_pii_recall": 1, "exact_f1": 0.5, "non_pii_redaction_rate": 0.0, "run": {"name": "one", "seconds": 2, "device": "gpu"}, "details": {"label_confusion_chars": [{"gold_label": "A", "prediction_label": "B", "chars": 3}]}}
    two = {"core_pii_recall": 0.25, "exact_f1": 0.5, "non_pii_redaction_rate": 0.1, "run": {"seconds": 0}}
    for name, made in (("z", one), ("a", two)):
        (tmp_path / name).write_text(json.dumps(made, indent=2))
    rows = artifacts.read_artifacts(spark, [str(tmp_path / "z"), str(tmp_path / "a")])
    assert [(r["number"], r["name"], r["core_pii_recall"]) for r in rows.orderBy("number").collect()] == [(0, "one", 1.0), (1, "System 2", 0.25)]
    assert [tuple(r) for r in artifacts.detail(rows, "label_confusion_chars").collect()] == [(0, "one", "A", "B", 3)]
    assert [tuple(r) for r in charts.runtimes(rows).collect()] == [("one", 2.0, 1.0, "gpu")]
    assert cli.main(["plot", "--scores", str(tmp_path / "z"), str(tmp_path / "a"), "--output-dir", str(tmp_path / "plots")]) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "plots/tables/accuracy_runtime")).count() == 1
    (tmp_path / "bad").write_text("{}")
    with pytest.raises(Exception, match="without core_pii_recall"):
        artifacts.read_artifacts(spark, [str(tmp_path / "bad")]).collect()


ROWS = "model string, document_id string, kind string, role string, dimension string, dimension_value string, outcome string"


def scored_rows():
    r = random.Random(9)
    rows = []
    for model in ("m", "n"):
        for doc in range(12):
            for role in ("patient", "caregiver"):
                for value in ("upper", "full", "Zeta", "alpha"):
                    if (model, value) != ("n", "upper"):
                        rows.append((model, f"d{doc}", "name", role, "capitalization", value, r.choice(["full", "partial", "missed"])))
                rows.append((model, f"d{doc}", "name", role, "baseline", "original", r.choice(["full", "missed"])))
    return rows


def test_recall_tables_in_one_pass(spark):
    rows = scored_rows()
    tally = stability.tallies(spark.createDataFrame(rows, ROWS).withColumn("score", F.lit(0.0)), "model")
    got = {(r["model"], r["role"], r["dimension"], r["dimension_value"]): (r["total"], r["full"], r["partial"], r["missed"], r["n_clusters"], r["full_plus_partial_recall"]) for r in stability.recall_tables(tally, "model").collect()}
    want = {}
    for keys in (lambda x: (x[0], x[3], x[4], x[5]), lambda x: (x[0], stability.POOLED, x[4], x[5]), lambda x: (x[0], x[3], x[4], None)):
        for x in rows:
            want.setdefault(keys(x), []).append(x)
    assert got.keys() == want.keys()
    for k, xs in want.items():
        n = [sum(x[6] == o for x in xs) for o in ("full", "partial", "missed")]
        assert got[k] == (len(xs), *n, len({x[1] for x in xs}), pytest.approx((n[0] + n[1]) / len(xs)))
    found = stability.recalls_with_intervals_of(tally, "model").collect()
    assert len(found) == len([k for k in want if k[3] is not None]) and all(r["lower"] <= r["full_plus_partial_recall"] <= r["upper"] for r in found)


def test_bars_keep_order_and_what_is_missing(spark):
    rows = scored_rows()
    tally = stability.tallies(spark.createDataFrame(rows, ROWS), "model")
    got = charts.bars(stability.recalls_with_intervals_of(tally, "model")).collect()
    assert [r["dimension_value"] for r in sorted(got, key=lambda r: r["place"]) if r["model"] == "n"] == ["full", "upper", "alpha", "Zeta"]
    gap = next(r for r in got if (r["model"], r["dimension_value"]) == ("n", "upper"))
    assert (gap["recall"], gap["total"], gap["n_clusters"], gap["lower"], gap["upper"]) == (None, 0, None, None, None)
    for r in got:
        own = [x for x in rows if x[0] == r["model"] and x[5] == r["dimension_value"]]
        base = [x for x in rows if x[0] == r["model"] and x[4] == "baseline"]
        assert r["baseline"] == pytest.approx(sum(x[6] != "missed" for x in base) / len(base))
        if own:
            assert r["total"] == 24 and r["recall"] == pytest.approx(sum(x[6] != "missed" for x in own) / 24) and r["lower"] <= r["recall"] <= r["upper"]


def test_orders_of_labels_rows_and_totals(spark):
    labels = spark.createDataFrame([("Date",), ("name:b",), ("Name:Z",), ("Name:Patient",), ("Name:a",), ("Age",), ("age",)], "label string")
    got = charts.in_label_order(labels, "label", ["Name", "Date"], ["Name:Patient"]).orderBy("place").collect()
    assert [r["label"] for r in got] == ["Name:Patient", "Name:a", "Name:Z", "Date", "Age", "age", "name:b"]
    pairs = spark.createDataFrame([("format", "patient"), ("zz", "a"), ("age_format", "age"), ("aa", "b")], "dimension string, role string")
    assert [r["dimension"] for r in charts.in_forest_order(pairs).orderBy("place").collect()] == ["age_format", "format", "aa", "zz"]
    heat = spark.createDataFrame([("b", 1, 2), ("A", 3, None), ("c", 9, 0)], "label string, x int, y int")
    assert [r["label"] for r in charts.by_total(heat, "label", ["x", "y"]).orderBy("place").collect()] == ["c", "A", "b"]
    assert charts.by_total(heat.withColumn("x", F.lit(0)).withColumn("y", F.lit(0)), "label", ["x", "y"]).count() == 0


def test_report_says_what_is_not_estimated():
    cells = [{"dimension": d, "role": "patient", "n_pairs": n, "n_clusters": n, "mean_degradation": m, "p_one_sided": p} for d, n, m, p in (("format", 9, 0.25, 0.01), ("age_format", 2, 0.5, 0.01), ("name_source", 9, None, None), ("capitalization", 9, 0.1, 0.2))]
    recalls = [{"role": "patient", "dimension": "format", "dimension_value": v, "full_plus_partial_recall": 0.5, "total": 8} for v in (None, "title_dr")]
    text = report.stability_report("m", {"baseline_recall": None, "n_targets": 0}, cells, recalls, {"seed": 7})
    assert "- seed: 7" in text and "n/a over 0 targets" in text and "## format" in text and "| patient | title_dr | 50.0% | 8 |" in text
    assert "| format | patient | 50.0% | 8 | -25.0pp * (pairs=9, notes=9) |" in text and "not estimated (pairs=2, notes=2)" in text
    assert "| name_source | patient | n/a | n/a | n/a |" in text and "-10.0pp (pairs=9, notes=9)" in text


def test_dates_are_read_and_relative_ones_are_not(spark):
    cases = {"12-05-1983": "1983-05-12", "12 mei 1983": "1983-05-12", "do 12 mei 1983": "1983-05-12", "Donderdag, 12 MEI '83": "1983-05-12", "1983-05-12": "1983-05-12", "3 sept. 2001": "2001-09-03", "12/5/03": "2003-05-12", "1e maart 1999": "1999-03-01"}
    none = ["43 jr", "volgende week", "gisteren", "31-02-2001", "12-13-2001", "mei 1983", "1983", "12 mei", "", None, "12-05-1983 en 13-05-1983", "3 dagen geleden"]
    got = spark.createDataFrame([(x,) for x in [*cases, *none]], "t string").select("t", texts.date_parsed(F.col("t")).cast("string").alias("d")).collect()
    assert {r["t"]: r["d"] for r in got} == cases | dict.fromkeys(none)


def test_spans_are_validated_and_cut_out(spark, tmp_path):
    rows = [
        {"doc_id": "a", "text": "Eva zag \U0001f600 Bo.", "spans": [3, None, {"begin": 0, "end": 3, "label": "Name:Patient"}, {"start": "10", "end": 12.0, "Category": "Name", "subtype": "Caregiver"}, {"begin": 0, "end": 3, "label": "Date"}]},
        {"text": "Eva", "spans": {"begin": 0, "end": 3, "label": "Name:Patient"}},
        {"text": "Eva", "spans": [{"begin": 0, "end": 4, "label": "Name:Patient"}, {"begin": 2, "end": 2, "label": "Name:Patient"}, {"begin": "x", "end": 2, "label": "Name:Patient"}, {"end": 2, "label": "Name:Patient"}, {"begin": 1, "end": 3, "type": "NamePatient"}]},
    ]
    (tmp_path / "g.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = documents.read_target_spans(spark, str(tmp_path / "g.jsonl"), ["Name:Patient", "name-caregiver"]).collect()
    assert sorted(map(tuple, got)) == [("a", 0, 0, 3, "Name:Patient", "Eva"), ("a", 1, 10, 12, "Name:Caregiver", "Bo"), ("doc_2", 4, 1, 3, "", "va")]
    none = dict.fromkeys(labels.LABEL_FIELDS, F.lit(None).cast("string"))
    said = spark.range(1).select(labels.label_value(none | {"label": F.lit(""), "type": F.lit("T")}), labels.label_value(none)).first()
    assert tuple(said) == ("T", "")
    documents.write_lines(spark.createDataFrame([("v", None, [(1, None)])], "variant_id string, text string, spans array<struct<begin:int,label:string>>"), str(tmp_path / "out"))
    written = [line for f in (tmp_path / "out").glob("part-*") for line in f.read_text().splitlines()]
    assert [json.loads(x) for x in written] == [{"variant_id": "v", "text": None, "spans": [{"begin": 1, "label": None}]}]
