"""Command line, settings, name lists, timings and streaming, end to end on small files."""

import json

import pytest

from veilmark import cli
from veilmark.operators import report
from veilmark.sources import config
from veilmark.streaming import scores

GOLD = {"document_id": "n1", "text": "Eva zag Bo.", "spans": [{"begin": 0, "end": 3, "label": "Name:Patient", "subannotations": [{"begin": 0, "end": 3, "category": "given"}]}]}
PRED = {"document_id": "n1", "spans": [{"begin": 0, "end": 3, "label": "Name:Patient"}, {"begin": 8, "end": 10, "label": "Name:Other"}]}


def test_score_command(spark, tmp_path):
    for name, row in (("g", GOLD), ("p", PRED)):
        (tmp_path / name).write_text(json.dumps(row) + "\n")
    out = tmp_path / "s.json"
    assert cli.main(["score", "--gold", str(tmp_path / "g"), "--predictions", str(tmp_path / "p"), "--output", str(out), "--name", "one", "--seconds", "2"]) == 0
    made = json.loads(out.read_text())
    assert made["run"] == {"name": "one", "seconds": 2.0} and made["core_pii_recall"] == 1.0 and made["non_pii_redacted_chars"] == 2
    assert made["details"]["non_pii_redaction_by_predicted_label"] == [{"prediction_label": "Name:Other", "non_pii_redacted_chars": 2}, {"prediction_label": "Name:Patient", "non_pii_redacted_chars": 0}]
    with pytest.raises(ValueError, match="formats"):
        report.figures([made], str(tmp_path), ["bmp"])
    with pytest.raises(ValueError, match="own name"):
        report.figures([made, made], str(tmp_path), ["png"])
    assert isinstance(report.figures([made], str(tmp_path), ["png", "png"]), list)


def test_settings_and_lists(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("WHERE", "out")
    path = tmp_path / "c.yaml"
    path.write_text("dataset: g.jsonl\noutput_dir: ${WHERE}/x\nseed: 7\nname: {labels: ['Name:Patient', 'name-other'], other_trials: 2}\ndate: {value_shift: {year_min: '${LOW:-1999}', year_max: 2001, step: 1}}\nmodels: [{id: m}]\n")
    got = config.read_settings(str(path))
    assert (got.dataset, got.output_dir, got.plan.name_labels, got.plan.year_min, got.plan.seed) == (str(tmp_path / "g.jsonl"), str(tmp_path / "out/x"), ["Name:Patient"], 1999, 7)
    with pytest.raises(ValueError, match="missing"):
        config.read_lookups(str(tmp_path))
    for name, body in (("prefixes", "dr.\n"), ("first_names", "# list\nEva\nBo\n\n"), ("surnames", "Maes\nClaes\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "items.txt").write_text(body)
    assert config.read_lookups(str(tmp_path)).first_names == ["Eva", "Bo"]
    (tmp_path / "g.jsonl").write_text(json.dumps(GOLD) + "\n")
    made = cli.expand(spark, got, str(tmp_path), False)
    assert made["counts"]["name::baseline"] == 1 and made["counts"]["variants_total"] == sum(v for k, v in made["counts"].items() if k != "variants_total")
    variants = spark.read.parquet(f"{got.output_dir}/variants")
    variants.selectExpr("variant_id", "array(named_struct('begin', target.begin, 'end', target.end, 'label', target.label, 'category', cast(null as string))) as spans").write.parquet(f"{got.output_dir}/predictions/m")
    cli.analyze(spark, got, None)
    assert "100.0%" in (tmp_path / "out/x/m.md").read_text()
    cli.adjust(spark, {"a": got.output_dir}, str(tmp_path / "adjusted"))
    assert json.loads((tmp_path / "adjusted/stability_multiple_testing.json").read_text())[0]["family_size"] == 0
    with pytest.raises(ValueError, match="missing scopes: .'b'.; unexpected scopes: .'a'."):
        cli.adjust(spark, {"a": got.output_dir}, str(tmp_path / "adjusted"), ["b"])
    assert spark.read.option("header", True).csv(f"{got.output_dir}/recall").columns == cli.RECALL_COLUMNS
    assert cli.scopes(["a=b"]) == {"a": "b"}
    with pytest.raises(ValueError, match="NAME=PATH"):
        cli.scopes(["a=b", "a=c"])
    (tmp_path / "t.yaml").write_text("m: [{device: cpu, seconds: 1.5, source: measured}, nonsense]\nbad: 3\n")
    times = config.read_timings(spark, str(tmp_path / "t.yaml"))
    assert times.count() == 1 and config.read_timings(spark, str(tmp_path / "none.yaml")).count() == 0
    config.write_timings(times, str(tmp_path / "again.yaml"))
    assert config.read_timings(spark, str(tmp_path / "again.yaml")).count() == 1


def finder(checkpoint, device):
    return lambda variant_id, text: [{"begin": text.find("Eva"), "end": text.find("Eva") + 3, "label": "Name:Patient", "category": None}] if "Eva" in text else []


def test_run_from_documents_to_report(spark, tmp_path):
    for name, body in (("prefixes", "dr.\n"), ("first_names", "Eva\nBo\n"), ("surnames", "Maes\nClaes\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "items.txt").write_text(body)
    docs = [{"document_id": f"n{i}", "text": "Eva zag ons.", "spans": [{"begin": 0, "end": 3, "label": "Name:Patient"}, {"begin": 4, "end": 7, "label": "Name:Patient"}]} for i in (3, 1, 2)]
    (tmp_path / "g.jsonl").write_text("".join(json.dumps(d) + "\n" for d in docs))
    (tmp_path / "c.yaml").write_text("dataset: g.jsonl\nname: {other_trials: 2}\nmodels: [{id: m, loader: 'tests.test_commands:finder'}]\n")
    flags = ["--config", str(tmp_path / "c.yaml"), "--names", str(tmp_path)]
    assert cli.main(["stability", "run", *flags, "--max-docs", "2"]) == 0
    out = tmp_path / "outputs"
    made = spark.read.parquet(f"{out}/variants")
    assert {r[0] for r in made.select("document_id").distinct().collect()} == {"n3", "n1"}
    assert json.loads((out / "expand_summary.json").read_text())["counts"]["name::parse_failed"] == 2
    assert json.loads((out / "inference_summary.json").read_text())["m"]["n_variants"] == made.count()
    recall = spark.read.option("header", True).csv(f"{out}/recall").where("dimension = 'baseline' and level = 'label'").first()
    assert (recall["full_recall"], recall["bootstrap_ci95_lower"], recall["n_clusters"]) == ("1.0", "1.0", "2")
    with pytest.raises(SystemExit):
        cli.main(["stability", "analyze", *flags, "--only", "other"])


def test_streaming_scores(spark, tmp_path):
    gold = spark.createDataFrame([("n1", "Eva zag Bo.", [(0, 3, "A", [(0, 3, "given")])], True, None), ("n2", "abc", [], False, None)], "document_id string, text string, spans array<struct<begin:bigint,end:bigint,label:string,subannotations:array<struct<begin:bigint,end:bigint,category:string>>>>, has_nested boolean, subannotations array<struct<begin:bigint,end:bigint,category:string>>")
    (tmp_path / "in").mkdir()
    for number, row in enumerate((PRED, {"document_id": "n2", "spans": []})):
        (tmp_path / f"in/{number}.json").write_text(json.dumps(row))
        scores.start(spark, gold, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    row = scores.so_far(spark, str(tmp_path / "out")).first()
    assert (row["core_pii_recall"], row["non_pii_characters"], row["non_pii_redacted_chars"]) == (1.0, 11, 2)


def test_entry_stands_without_training_data():
    import __spark_entry__ as entry

    assert {"exact_scores", "bh_family"} <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
