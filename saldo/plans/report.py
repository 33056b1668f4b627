"""Project folders and reports of runs."""

from __future__ import annotations

import platform
import re
from pathlib import Path

import pyspark
from pyspark.sql import functions as F

from saldo.operators.table import compare_scenarios, provenance_counts
from saldo.plans.config import Project
from saldo.plans.scenario import Run, multipliers_by_scenario
from saldo.sources import files


def number(value: float | None, digits: int = 1) -> str:
    """A figure for a report; what is too small to show says so."""
    if value is None:
        return "-"
    if value and abs(value) < 0.5 * 10**-digits:
        return f"<{0.5 * 10**-digits:g}"
    return f"{value:,.{digits}f}"


MARK = "Notes:"


def references(text: str, pattern: str) -> list[str]:
    """Every match of a pattern in a text, in order of first sight."""
    return list(dict.fromkeys(m[0] for m in re.finditer(pattern, text or "")))


def annotated(text: str, pattern: str, note: str, shown: int = 8) -> str:
    """The text with one closing note that names the references in it; a text that has the note, or none of them, as it is."""
    found = references(text, pattern)
    if not found or f"\n{MARK} " in text:
        return text
    more = f" and {len(found) - shown} more" if len(found) > shown else ""
    return f"{text.rstrip()}\n\n---\n\n{MARK} {', '.join(f'`{r}`' for r in found[:shown])}{more} {note}\n"


def markdown(project: Project, runs: list[Run]) -> str:
    """The report: checks, provenance and solver notes of each scenario, and multipliers compared."""
    lines = [f"# {project.project_id}", ""]
    for r in runs:
        lines += [f"## Scenario {r.scenario_id}", ""] + [f"- {n}" for n in r.notes] + ["", "| check | passed | detail | severity |", "|-|-|-|-|"]
        lines += [f"| {c['name']} | {'yes' if c['passed'] else 'no'} | {c['detail']} | {c['severity']} |" for c in r.checks.orderBy("name").collect()]
        lines += ["", "| provenance | cells | status |", "|-|-|-|"] + [f"| {p['prov']} | {p['cells']} | {p['status']} |" for p in provenance_counts(r.cells).orderBy("prov").collect()] + [""]
    good = [r for r in runs if r.checks.where("name = 'feasible' AND NOT passed").count() == 0]
    if good:
        lines += ["## Multipliers", "", "| code | low | high | spread % |", "|-|-|-|-|"]
        lines += [f"| {m['code']} | {number(m['low'], 4)} | {number(m['high'], 4)} | {number(m['spread_pct'])} |" for m in compare_scenarios(multipliers_by_scenario(good)).orderBy("code").collect()]
    return "\n".join(lines) + "\n"


def write(project: Project, runs: list[Run], folder: str, inputs: list[dict] | None = None) -> None:
    """Cells by scenario as partitioned Parquet, checks, the manifest and the report. Partitions of former scenarios go."""
    cells = checks = None
    for r in runs:
        one = r.cells.withColumn("scenario_id", F.lit(r.scenario_id))
        two = r.checks.withColumn("scenario_id", F.lit(r.scenario_id))
        cells, checks = (one, two) if cells is None else (cells.unionByName(one), checks.unionByName(two))
    cells.write.mode("overwrite").partitionBy("scenario_id").parquet(f"{folder}/cells")
    checks.write.mode("overwrite").partitionBy("scenario_id").parquet(f"{folder}/checks")
    manifest = {"project": project, "inputs": inputs or [], "outcome": {r.scenario_id: r.notes for r in runs}, "environment": {"python": platform.python_version(), "spark": pyspark.__version__}}
    Path(folder).mkdir(parents=True, exist_ok=True)
    Path(folder, "project.json").write_text(files.to_json(manifest))
    Path(folder, "report.md").write_text(markdown(project, runs))
