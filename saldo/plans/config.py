"""Declarative projects: plain dicts (or a YAML-like JSON file) checked as a whole, gaps reported together."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from saldo.functions.kernels import TableError

KINDS = ("fixture", "bundle", "components")
METHODS = ("sut_euro", "sut_ras")
#: Target kinds and the projection method they belong to.
TARGETS = {"gva": "sut_euro", "final_use": "sut_euro", "industry_output": "sut_ras", "use_column_totals": "sut_ras", "taxes": None, "imports": None}
#: Sections that are checked but that no project run uses, and what there is instead; a project with one is refused.
UNUSED = {"targets": "call sut.project_frames", "satellites": "call split.split_satellite, then table.satellite_effects on the split table", "regionalise": "run the command line with --regionalise"}
TRUE = ("yes", "true", "1", "y", "x")


@dataclass
class Split:
    sector: int
    parts: list[int]
    labels: list[str]
    key_id: str
    keys_by_block: dict[str, str] = field(default_factory=dict)


@dataclass
class Scenario:
    """A scenario; alpha 1 treats the parts' trade with themselves and each other alike."""

    scenario_id: str
    label: str = ""
    alpha: float = 1.0
    tolerance: float = 1e-9
    max_iter: int = 10_000
    profiles: dict[int, dict[int, float]] = field(default_factory=dict)  # part -> supplier -> intensity
    constraints: dict[tuple[int, int], float] = field(default_factory=dict)  # code pair -> value, applied once


@dataclass
class Project:
    project_id: str
    table_kind: str
    table_path: str | None
    splits: list[Split]
    keys: dict[str, dict[int, float]]
    scenarios: list[Scenario]
    satellites: dict[str, dict[int, float]] = field(default_factory=dict)


def yes(value) -> bool:
    return str(value or "").strip().lower() in TRUE


def type_ii_labels(meta: dict, added: list[str], finals: list[str]) -> tuple[list[str], str] | None:
    """Income rows and household column of a type II closure by the table's own labels; None where neither is given.

    One without the other, and labels that the table doesn't have, are refused: closing on another row gives a
    number that only looks like an induced effect.
    """
    rows = [r.strip() for r in str(meta.get("type_ii_income_rows") or "").split(";") if r.strip()]
    column = str(meta.get("type_ii_household_column") or "").strip()
    if not rows and not column:
        return None
    if not rows or not column:
        raise TableError("a type II closure needs both income rows and a household column")
    missing = [r for r in rows if r not in added] + ([column] if column not in finals else [])
    if missing:
        raise TableError(f"the table has no {', '.join(missing)}; its value-added rows are {', '.join(added)}, its final-demand columns {', '.join(finals)}")
    return rows, column


def gaps(spec: dict, sectors: set[int]) -> list[tuple[str, str]]:
    """Everything wrong with a project at once: (severity, message); blocking ones stop a run."""
    out: list[tuple[str, str]] = []
    block = lambda m: out.append(("blocking", m))
    project = spec.get("project", {})
    for name in ("project_id", "table_kind"):
        if not project.get(name):
            block(f"project.{name} is missing")
    if project.get("table_kind") not in (None, "", *KINDS):
        block(f"table_kind {project['table_kind']!r} is none of {', '.join(KINDS)}")
    keys: dict[str, dict] = {}
    for row in spec.get("keys", []):
        codes = keys.setdefault(str(row.get("key_id")), {})
        if row.get("value") is None:
            block(f"key {row.get('key_id')}: {row.get('new_sector_code')} has no value; missing is not zero")
        elif row["new_sector_code"] in codes:
            block(f"key {row['key_id']}: {row['new_sector_code']} repeats")
        else:
            codes[row["new_sector_code"]] = float(row["value"])
        if not row.get("source"):
            out.append(("weak", f"key {row.get('key_id')}: no source"))
    for key, codes in keys.items():
        if codes and (min(codes.values()) < 0 or sum(codes.values()) <= 0):
            block(f"key {key}: values must not be negative and must add up to more than zero")
    made: dict[int, set[int]] = {}
    for row in spec.get("splits", []):
        made.setdefault(row["sector_code"], set()).add(row["new_code"])
        if row["sector_code"] not in sectors:
            block(f"split sector {row['sector_code']} is not in the table")
        if row["new_code"] in sectors:
            block(f"new code {row['new_code']} is in the table already")
        if row.get("key_id") not in keys:
            block(f"split of {row['sector_code']}: key {row.get('key_id')} does not exist")
    for sector, parts in made.items():
        for key in {r["key_id"] for r in spec["splits"] if r["sector_code"] == sector}:
            if key in keys and set(keys[key]) != parts:
                block(f"key {key} covers {sorted(keys[key])}, the split of {sector} makes {sorted(parts)}")
    ids = [r.get("scenario_id") for r in spec.get("scenarios", [])]
    if len(set(ids)) < len(ids):
        block("a scenario id repeats")
    if not ids:
        out.append(("weak", "no scenario: one with even inner trade is run"))
    new = set().union(*made.values()) if made else set()
    for row in spec.get("profiles", []):
        if row["scenario_id"] not in ids or row["subsector_code"] not in new or row["supplier_code"] not in sectors or float(row["intensity"]) < 0:
            block(f"profile {row}: unknown scenario, part or supplier, or a negative intensity")
    by: dict[str, dict[int, float]] = {}
    for row in spec.get("satellites", []):
        codes = by.setdefault(row["name"], {})
        if row["sector_code"] in codes:
            block(f"satellite {row['name']}: {row['sector_code']} repeats")
        codes[row["sector_code"]] = row["value"]
        if not row.get("unit"):
            block(f"satellite {row['name']}: no unit")
    for name, codes in by.items():
        if set(codes) != sectors:
            block(f"satellite {name}: missing {sorted(sectors - set(codes))[:5]}, unknown {sorted(set(codes) - sectors)[:5]}")
    kinds = {r["kind"] for r in spec.get("targets", [])}
    wants = {TARGETS[k] for k in kinds if TARGETS.get(k)}
    if kinds - set(TARGETS):
        block(f"unknown target kinds {sorted(kinds - set(TARGETS))}")
    if len(wants) > 1:
        block("targets mix those of both projection methods")
    if kinds and not wants:
        block("targets name neither value added and final use nor outputs and use totals")
    for section, instead in UNUSED.items():
        if spec.get(section):
            block(f"{section}: a project run does not use this section; {instead}")
    region = spec.get("regionalise")
    if region:
        if region.get("method", "FLQ") == "FLQ" and region.get("delta") is None:
            block("FLQ needs a delta; there is no default")
        if not region.get("activity_path"):
            block("regionalise needs an activity file")
    return out


def build(spec: dict, sectors: set[int]) -> Project:
    """The project of a spec without blocking gaps; otherwise all of them are raised together."""
    bad = [m for severity, m in gaps(spec, sectors) if severity == "blocking"]
    if bad:
        raise TableError("; ".join(bad))
    keys: dict[str, dict[int, float]] = {}
    for row in spec.get("keys", []):
        keys.setdefault(row["key_id"], {})[row["new_sector_code"]] = float(row["value"])
    splits: dict[int, Split] = {}
    for row in spec.get("splits", []):
        one = splits.setdefault(row["sector_code"], Split(row["sector_code"], [], [], row["key_id"], dict(row.get("keys_by_block", {}))))
        one.parts.append(row["new_code"])
        one.labels.append(row.get("new_label", str(row["new_code"])))
    scenarios = []
    for row in spec.get("scenarios") or [{"scenario_id": "S0"}]:
        profiles: dict[int, dict[int, float]] = {}
        for p in spec.get("profiles", []):
            if p["scenario_id"] == row["scenario_id"]:
                profiles.setdefault(p["subsector_code"], {})[p["supplier_code"]] = float(p["intensity"])
        alpha = row.get("internal_block_alpha")
        scenarios.append(Scenario(row["scenario_id"], row.get("label", ""), 1.0 if alpha in (None, "") else float(alpha), profiles=profiles))
    satellites: dict[str, dict[int, float]] = {}
    for row in spec.get("satellites", []):
        satellites.setdefault(row["name"], {})[row["sector_code"]] = float(row["value"])
    project = spec["project"]
    return Project(project["project_id"], project["table_kind"], project.get("table_path"), list(splits.values()), keys, scenarios, satellites)


def load(path: str | Path) -> dict:
    return json.loads(Path(path).read_text())


TEMPLATE = {
    "project": {"project_id": "my_project", "table_kind": "fixture", "table_path": "/path/to/tables"},
    "splits": [{"sector_code": 7, "new_code": 101, "new_label": "part one", "key_id": "k"}, {"sector_code": 7, "new_code": 102, "new_label": "part two", "key_id": "k"}],
    "keys": [{"key_id": "k", "new_sector_code": 101, "value": 2, "source": "office", "source_year": 2020, "strength": "strong"}, {"key_id": "k", "new_sector_code": 102, "value": 1, "source": "office", "source_year": 2020, "strength": "strong"}],
    "scenarios": [{"scenario_id": "S1", "label": "even inner trade", "internal_block_alpha": 1.0}],
    "profiles": [], "satellites": [], "targets": [],
}
