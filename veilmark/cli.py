"""Command line: score, plot, and the steps of a stability run.

    python -m veilmark.cli score --gold g.jsonl --predictions p.jsonl --output s.json
    python -m veilmark.cli stability expand --config c.yaml --names FOLDER
"""

from __future__ import annotations

import argparse
import dataclasses
import importlib
import json
import sys
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import charts, perturb, report, scoring, stability
from .session import settle
from .sources import artifacts, config, documents, inputs


class Scope(argparse.Action):
    """Collects NAME=PATH arguments into a mapping; malformed ones and repeated names are errors."""

    def __call__(self, parser: argparse.ArgumentParser, namespace: argparse.Namespace, value: str, flag: str | None = None) -> None:
        held = dict(getattr(namespace, self.dest) or {})
        name, path = (*map(str.strip, value.split("=", 1)), "")[:2]
        if not name or not path:
            raise argparse.ArgumentError(self, f"not NAME=PATH: {value}")
        if name in held:
            raise argparse.ArgumentError(self, f"NAME=PATH with a name given twice: {name}")
        setattr(namespace, self.dest, held | {name: path})


def scopes(values: list[str]) -> dict[str, str]:
    """What ``--scope`` arguments give."""
    action, held = Scope(["--scope"], "scope"), argparse.Namespace(scope={})
    try:
        for value in values:
            action(None, held, value)
    except argparse.ArgumentError as error:
        raise ValueError(str(error)) from error
    return held.scope


#: Flags of the adapter and the source fields they name; fixed values.
FIELDS = ["patient_first", "patient_last", "patient_initials", "caregiver_first", "caregiver_last", "doc_date"]


def adapt(spark: SparkSession, args: argparse.Namespace) -> str:
    """Battery input from another source, by flags or by the settings' section; says what was written."""
    if args.config:
        source, out, how = config.read_adapter(args.config, args.out)
    elif args.source:
        fields = {f: v for f in FIELDS if (v := getattr(args, f))}
        source, out, how = args.source, args.out or "input.jsonl", inputs.Adapter(args.field, args.id_field, args.metadata_field, fields)
    else:
        raise ValueError("either --config or --from is required")
    return f"wrote {out} ({inputs.adapt(spark, source, out, how).count()} docs)"


def score(spark: SparkSession, args: argparse.Namespace) -> None:
    flat = scoring.flattened(documents.read_gold(spark, args.gold), documents.read_predictions(spark, args.predictions))
    run = {"name": args.name, "seconds": args.seconds, "device": args.device, "method_type": args.method_type}
    made = report.score_artifact(flat, run)
    if args.output:
        report.write_json(made, args.output)
    else:
        print(json.dumps(made, indent=2, sort_keys=True, ensure_ascii=False))


#: Names of the counters of variants; fixed values where they differ from the dimension.
COUNTERS = {"name_source": "other", "date_value_shift": "value_shift", "date_format": "format", "age_format": "format"}
#: Columns of the recall table and the scopes that are adjusted together; fixed values.
RECALL_COLUMNS = ["model", "level", "kind", "role", "dimension", "dimension_value", "total", "full", "partial", "missed", "full_recall", "partial_recall", "full_plus_partial_recall", "n_clusters", "bootstrap_ci95_lower", "bootstrap_ci95_upper"]
RECALL_TYPES = ", ".join(f"{c} {'bigint' if c in ('total', 'full', 'partial', 'missed', 'n_clusters') else 'double' if c.endswith(('recall', 'lower', 'upper')) else 'string'}" for c in RECALL_COLUMNS)
SCOPES = ["uza", "synthetic", "primary-care"]


def expand(spark: SparkSession, settings: config.Settings, names: str, dry_run: bool) -> dict:
    """Write variants and a summary of their counts."""
    rows = documents.read_gold(spark, settings.dataset, settings.max_docs, ordinal=True)
    if settings.text_source:
        rows = documents.with_texts(rows.withColumn("plain_text", F.lit(None).cast("string")), documents.read_texts(spark, settings.text_source))
    notes = rows.select("document_id", "text", F.transform("spans", lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end"), s["label"].alias("label"))).alias("spans"))
    lookups = config.read_lookups(names)
    made = perturb.variants(notes, settings.plan, lookups)
    if not dry_run:
        made.write.mode("overwrite").parquet(f"{settings.output_dir}/variants")
        made = spark.read.parquet(f"{settings.output_dir}/variants")
    counts = {f"{r[0]}::{COUNTERS.get(r[1], r[1])}": r[2] for r in made.groupBy("target.kind", "target.dimension").count().collect()}
    total = sum(counts.values())
    if failed := perturb.unread(notes, settings.plan, lookups).count():
        counts["name::parse_failed"] = failed
    summary = {"counts": counts | {"variants_total": total}, "dry_run": dry_run, "seed": settings.plan.seed}
    if not dry_run:
        report.write_json(summary, f"{settings.output_dir}/expand_summary.json")
    return summary


def chosen(settings: config.Settings, only: list[str] | None) -> list[config.Model]:
    """The models of a run; unknown names in ``only`` are an error."""
    if unknown := set(only or []) - {m.id for m in settings.models}:
        raise ValueError(f"no such models: {sorted(unknown)}")
    return [m for m in settings.models if not only or m.id in only]


def infer(spark: SparkSession, settings: config.Settings, only: list[str] | None) -> dict:
    """Predictions of each model for the written variants, and a summary.

    A model's option ``loader`` names a function as module:function; called with the checkpoint and the device in each task, it
    gives the function of id and text that predicts.
    """
    variants, summary = spark.read.parquet(f"{settings.output_dir}/variants"), {}
    for model in chosen(settings, only):
        module, _, name = str(model.options.get("loader") or "").partition(":")
        if not module or not name:
            raise ValueError(f"model {model.id} has no loader (module:function)")
        checkpoint, device = model.checkpoint, settings.device
        path = f"{settings.output_dir}/predictions/{model.id}"
        stability.inferred(variants, lambda m=module, n=name, c=checkpoint, d=device: getattr(importlib.import_module(m), n)(c, d)).write.mode("overwrite").parquet(path)
        totals = spark.read.parquet(path).agg(F.count("*").alias("n_variants"), F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("n_spans")).first()
        summary[model.id] = totals.asDict() | {"device": device}
    report.write_json(summary, f"{settings.output_dir}/inference_summary.json")
    return summary


def _predictions(spark: SparkSession, path: str) -> DataFrame | None:
    """A model's predictions; None if there are none at all."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def analyze(spark: SparkSession, settings: config.Settings, only: list[str] | None) -> None:
    """Recall tables, degradation and a report for each model that has predictions (variant_id, spans).

    Under the output folder: ``recall`` (CSV), ``pooled_recall`` (CSV, roles pooled) and ``degradation`` (Parquet by model and
    level), with intervals, and a report in Markdown for each model.
    """
    variants, done = spark.read.parquet(f"{settings.output_dir}/variants").drop("text"), 0
    recall, cells = [], []
    for model in chosen(settings, only):
        predictions = _predictions(spark, f"{settings.output_dir}/predictions/{model.id}")
        if predictions is None:
            continue
        done += 1
        joined = stability.with_predictions(variants, predictions)
        for level in ("category", "label"):
            rows = settle(stability.scored(joined, level))  # narrow, and read by all that follows
            mark = lambda df, m=model.id, v=level: df.withColumn("model", F.lit(m)).withColumn("level", F.lit(v))
            tally = settle(stability.tallies(rows))
            shown = stability.recalls_with_intervals_of(tally, seed=settings.plan.seed)
            recall.append(mark(shown.withColumnsRenamed({"lower": "bootstrap_ci95_lower", "upper": "bootstrap_ci95_upper"})).select(*RECALL_COLUMNS))
            paired, keys = stability.pairs(rows), ["dimension", "role"]
            stats = settle(stability.clusters(paired, keys, F.col("original") - F.col("transformed")))
            tested = stability.sign_flip_p(stats, keys, settings.plan.seed).join(stability.intervals(stats, keys, settings.plan.seed), keys)
            one = settle(stability.degradation(paired).join(tested, keys))
            cells.append(mark(one))
            if level == "category":
                run = {"dataset": settings.dataset, "seed": settings.plan.seed}
                text = report.stability_report(model.id, stability.baseline(rows).first(), [r.asDict() for r in one.collect()], [r.asDict() for r in stability.recall_tables(tally).collect()], run)
                report.write_text(text, f"{settings.output_dir}/{model.id}.md")
    if not done:
        raise ValueError("no model has predictions")
    whole = settle(reduce(DataFrame.unionByName, recall))
    for name, fits in (("recall", F.col("role") != stability.POOLED), ("pooled_recall", F.col("role") == stability.POOLED)):
        whole.where(fits).write.mode("overwrite").option("header", True).csv(f"{settings.output_dir}/{name}")
    reduce(DataFrame.unionByName, cells).write.mode("overwrite").partitionBy("model", "level").parquet(f"{settings.output_dir}/degradation")


def adjust(spark: SparkSession, files: dict[str, str], output: str, expected: list[str] | None = None) -> None:
    """Adjust degradation cells across scopes; each path is the output folder of an analysis.

    The scopes must be exactly the ``expected`` ones; by default any are taken.
    """
    if expected is not None and set(expected) != set(files):
        raise ValueError(f"missing scopes: {sorted(set(expected) - set(files))}; unexpected scopes: {sorted(set(files) - set(expected))}")
    parts = [spark.read.parquet(f"{folder}/degradation").where("level = 'category'").withColumn("scope", F.lit(scope)) for scope, folder in files.items()]
    if not parts:
        raise ValueError("no degradation tables")
    adjusted = stability.adjusted(reduce(DataFrame.unionByName, parts), list(files))
    documents.write_table(adjusted.select("model", "scope", "dimension", "role", "n_pairs", "n_clusters", "mean_degradation", "p_one_sided", "q", "significant"), f"{output}/stability_multiple_testing")
    report.write_json([r.asDict() for r in stability.manifest(adjusted).collect()], f"{output}/stability_multiple_testing.json")


def plot(spark: SparkSession, args: argparse.Namespace) -> None:
    """Tables of score artifacts as CSV under ``tables``, and figures where matplotlib is there."""
    found = settle(artifacts.read_artifacts(spark, args.scores).drop("v"))
    report.figures([r.asDict() for r in found.orderBy("number").collect()], args.output_dir, [f.strip() for f in args.formats.split(",")], args.dpi)
    rows = artifacts.read_artifacts(spark, args.scores)
    for table in artifacts.DETAILS:
        documents.write_table(artifacts.detail(rows, table), f"{args.output_dir}/tables/{table}", "overwrite")
    documents.write_table(charts.runtimes(found), f"{args.output_dir}/tables/accuracy_runtime", "overwrite")


def plot_stability(spark: SparkSession, analysis: str, output: str) -> None:
    """Tables of an analysis as they are drawn, as CSV: grouped bars, the line of years, the forest of changes."""
    tables = spark.read.option("header", True).schema(RECALL_TYPES).csv([f"{analysis}/recall", f"{analysis}/pooled_recall"]).where("level = 'category'")
    shown = tables.withColumnsRenamed({"bootstrap_ci95_lower": "lower", "bootstrap_ci95_upper": "upper"})
    cells = spark.read.parquet(f"{analysis}/degradation").where("level = 'category'")
    for name, table in (("bars", charts.bars(shown)), ("year_shift", charts.year_line(shown)), ("forest", charts.forest(cells))):
        documents.write_table(table, f"{output}/{name}", "overwrite")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="veilmark")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("score")
    for flag in ("--gold", "--predictions"):
        one.add_argument(flag, required=True)
    for flag in ("--output", "--name", "--device"):
        one.add_argument(flag)
    one.add_argument("--seconds", type=float)
    one.add_argument("--method-type", choices=report.METHODS)
    two = commands.add_parser("plot")
    two.add_argument("--scores", nargs="+", required=True)
    two.add_argument("--output-dir", required=True)
    two.add_argument("--formats", default="png,pdf")
    two.add_argument("--dpi", type=int, default=300)
    three = commands.add_parser("adapt")
    for flag in ("--config", "--metadata-field", "--out", *[f"--{f.replace('_', '-')}" for f in FIELDS]):
        three.add_argument(flag)
    three.add_argument("--from", dest="source")
    three.add_argument("--field", default=inputs.Adapter.text_field)
    three.add_argument("--id-field", default=inputs.Adapter.id_field)
    steps = commands.add_parser("stability").add_subparsers(dest="step", required=True)
    for step in ("expand", "infer", "analyze", "run"):
        sub = steps.add_parser(step)
        sub.add_argument("--config", required=True)
        sub.add_argument("--names", help="folder of name lists")
        sub.add_argument("--max-docs", type=int)
        sub.add_argument("--dry-run", action="store_true")
        sub.add_argument("--only", type=lambda v: [x.strip() for x in v.split(",") if x.strip()])
    sub = steps.add_parser("plot")
    sub.add_argument("--analysis", required=True)
    sub.add_argument("--output-dir", required=True)
    sub = steps.add_parser("adjust")
    sub.add_argument("--scope", action=Scope, required=True)
    sub.add_argument("--expected", type=lambda v: [x.strip() for x in v.split(",") if x.strip()], default=SCOPES)
    sub.add_argument("--output-dir", required=True)
    args = parser.parse_args(argv)
    try:
        if args.command == "plot":
            plot(SparkSession.builder.getOrCreate(), args)
            return 0
        spark = SparkSession.builder.getOrCreate()
        if args.command == "score":
            score(spark, args)
        elif args.command == "adapt":
            print(adapt(spark, args))
        elif args.step == "plot":
            plot_stability(spark, args.analysis, args.output_dir)
        elif args.step == "adjust":
            adjust(spark, args.scope, args.output_dir, args.expected)
        else:
            settings = config.read_settings(args.config)
            if args.max_docs is not None:
                settings = dataclasses.replace(settings, max_docs=args.max_docs)
            if args.step in ("expand", "run"):
                print(json.dumps(expand(spark, settings, args.names, args.dry_run)))
            if args.step in ("infer", "run") and not args.dry_run:
                print(json.dumps(infer(spark, settings, args.only)))
            if args.step in ("analyze", "run") and not args.dry_run:
                analyze(spark, settings, args.only)
    except ValueError as error:
        parser.error(str(error))
    return 0


if __name__ == "__main__":
    sys.exit(main())
