"""Reports of one row as JSON, CSV or Markdown, and a plot of a sweep."""

from __future__ import annotations

import csv
import datetime
import io
import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

FORMATS = ("json", "csv", "markdown")


def render(report: DataFrame, kind: str, metadata: dict[str, str] | None = None, path: str | None = None, now: datetime.datetime | None = None) -> str:
    """The first row of ``report`` in a format; written to ``path`` if given."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}; known: {', '.join(FORMATS)}")
    row = report.first()
    values: dict[str, Any] = (row.asDict() if row else {}) | {"timestamp": (now or datetime.datetime.now(datetime.UTC)).isoformat()}
    more = metadata or {}
    if kind == "json":
        out = json.dumps(values | {"metadata": more}, indent=2)
    elif kind == "csv":
        text = io.StringIO()
        writer = csv.writer(text, lineterminator="\n")
        writer.writerow(["key", "value"])
        writer.writerows(values.items())
        writer.writerows((f"metadata.{k}", v) for k, v in more.items())
        out = text.getvalue()
    else:
        lines = ["# Evaluation", "", "| Metric | Value |", "| --- | --- |", *[f"| {k} | {v} |" for k, v in values.items()]]
        lines += ["", "## Metadata", "", *[f"- {k}: {v}" for k, v in more.items()]] if more else []
        out = "\n".join(lines) + "\n"
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(out)
    return out


def plot(swept: DataFrame, path: str) -> bool:
    """Draw ``far`` against ``frr`` of a sweep, a table of a few hundred rows; does nothing and says so where matplotlib is missing."""
    try:
        from matplotlib.figure import Figure
    except ImportError:
        return False
    rows = swept.orderBy("threshold").collect()
    figure = Figure(figsize=(8, 6))
    axes = figure.add_subplot()
    axes.plot([r["far"] for r in rows], [r["frr"] for r in rows])
    best = min(rows, key=lambda r: (abs(r["far"] - r["frr"]), r["threshold"]))
    axes.plot([best["far"]], [best["frr"]], "o")
    axes.set_xlabel("false accepts per hour")
    axes.set_ylabel("false reject rate")
    figure.savefig(path, dpi=150)
    return True
