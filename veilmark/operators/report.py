"""Artifacts for people: the score JSON, the stability report, figures where matplotlib is there."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

from . import scoring
from .stability import ALPHA, MIN_NOTES, MIN_PAIRS, POOLED

METHODS = ["human", "rule", "neural", "generative", "unknown"]


def _rows(df: DataFrame, size: str, *names: str) -> list[dict]:
    """A detail table as dictionaries; it has a row for each label or pair of labels."""
    return [r.asDict() for r in scoring.in_report_order(df, size, *names).collect()]


def score_artifact(flat: scoring.Flat, run: dict[str, Any] | None = None) -> dict[str, Any]:
    """All headline numbers, five detail tables, and the run's filled-in metadata."""
    flat = scoring.kept(flat)
    out = scoring.summed(flat).first().asDict()
    out["details"] = {
        "recall_by_gold_label": _rows(scoring.core_recall_by(flat, "label", "gold_label"), "total_core_pii_chars", "gold_label"),
        "recall_by_subannotation_category": _rows(scoring.core_recall_by(flat, "category", "subannotation_category"), "total_core_pii_chars", "subannotation_category"),
        "non_pii_redaction_by_predicted_label": _rows(scoring.redaction_by_label(flat), "non_pii_redacted_chars", "prediction_label"),
        "label_confusion_chars": _rows(scoring.label_confusion_chars(flat), "chars", "gold_label", "prediction_label"),
        "exact_label_confusion": _rows(scoring.exact_label_confusion(flat), "spans", "gold_label", "prediction_label"),
    }
    if filled := {k: v for k, v in (run or {}).items() if v is not None}:
        out["run"] = filled
    return out


def write_json(value: Any, path: str) -> None:
    """Indented, with sorted keys, written under another name first."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(target.name + ".part")
    part.write_text(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n", encoding="utf-8")
    part.replace(target)


def write_text(text: str, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")


def percent(x: float | None) -> str:
    return "n/a" if x is None else f"{100 * x:.1f}%"


def _change(cell: dict | None) -> str:
    """A cell's change in points with its counts; a star marks a nominal one-sided p below ALPHA."""
    if not cell or cell["mean_degradation"] is None:
        return "n/a"
    counts = f"(pairs={cell['n_pairs']}, notes={cell['n_clusters']})"
    if cell["n_pairs"] < MIN_PAIRS or cell["n_clusters"] < MIN_NOTES:
        return f"not estimated {counts}"
    p = cell.get("p_one_sided")
    star = " *" if p is not None and p < ALPHA and cell["mean_degradation"] > 0 else ""
    return f"{-100 * cell['mean_degradation']:+.1f}pp{star} {counts}"


def _table(head: list[str], rows: list[list[str]]) -> list[str]:
    return ["| " + " | ".join(x) + " |" for x in (head, ["---"] * len(head), *rows)] + [""]


def stability_report(model: str, baseline: Any, cells: list[dict], recalls: list[dict] = (), run: dict[str, Any] | None = None) -> str:
    """Markdown: the run, the baseline, recall and change by dimension and role, and the values of the richest name dimensions.

    ``recalls`` are the rows of ``stability.recall_tables`` as dictionaries; those with roles pooled are left out.
    """
    own = [r for r in recalls if r["role"] != POOLED]
    lines = [f"# Stability of {model}", "", *[f"- {k}: {v}" for k, v in (run or {}).items()], f"- baseline recall: {percent(baseline['baseline_recall'])} over {baseline['n_targets']} targets", ""]
    lines += [f"`*` marks a nominal one-sided p < {ALPHA}; only q < {ALPHA} of the adjustment over all scopes confirms. Cells need {MIN_PAIRS} pairs from {MIN_NOTES} notes.", ""]
    by_cell = {(c["dimension"], c["role"]): c for c in cells}
    rolled = {(r["dimension"], r["role"]): r for r in own if r["dimension_value"] is None and r["dimension"] != "baseline"}
    shown = sorted(by_cell.keys() | rolled.keys(), key=lambda k: (k[0] or "", k[1] or ""))
    rows = [[d, role or "-", percent(r["full_plus_partial_recall"]) if (r := rolled.get((d, role))) else "n/a", str(r["total"]) if r else "n/a", _change(by_cell.get((d, role)))] for d, role in shown]
    lines += _table(["dimension", "role", "recall", "n", "change (pairs, notes)"], rows)
    for dimension in ("capitalization", "format"):
        values = sorted((r for r in own if r["dimension"] == dimension and r["dimension_value"] is not None), key=lambda r: (r["role"] or "", r["dimension_value"]))
        if values:
            lines += [f"## {dimension}", "", *_table(["role", "value", "recall", "n"], [[r["role"] or "-", r["dimension_value"], percent(r["full_plus_partial_recall"]), str(r["total"])] for r in values])]
    return "\n".join(lines)


def figures(payloads: list[dict], folder: str, formats: list[str], dpi: int = 300) -> list[str]:
    """Bars of the three headline numbers of ``artifacts.read_artifacts`` rows; nothing without matplotlib. Formats: png, pdf, svg."""
    if bad := [f for f in formats if f not in ("png", "pdf", "svg")]:
        raise ValueError(f"unknown figure formats: {bad}")
    names = [p.get("name") or (p.get("run") or {}).get("name") or f"System {i + 1}" for i, p in enumerate(payloads)]
    if not payloads or len(set(names)) != len(names):
        raise ValueError("figures need at least one score artifact, each with its own name")
    try:
        import matplotlib

        matplotlib.use("Agg")
        from matplotlib import pyplot
    except ImportError:
        return []
    figure, axes = pyplot.subplots(1, 3, figsize=(9, 3))
    for axis, metric in zip(axes, ("core_pii_recall", "exact_f1", "non_pii_redaction_rate"), strict=True):
        axis.bar(names, [p.get(metric) or 0 for p in payloads])
        axis.set_title(metric)
    Path(folder).mkdir(parents=True, exist_ok=True)
    paths = [str(Path(folder, f"overview.{f}")) for f in dict.fromkeys(formats)]
    for path in paths:
        figure.savefig(path, **({"dpi": dpi} if path.endswith("png") else {}))
    pyplot.close(figure)
    return paths
