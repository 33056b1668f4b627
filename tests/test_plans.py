import copy
import json

import pytest

from saldo import cli
from saldo.functions import codes
from saldo.functions.kernels import TableError
from saldo.operators import diagnostics, identities, split, sut
from saldo.plans import catalogue, config, report, scenario
from saldo.sources import cubes, fixture

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def table(spark):
    t = fixture.io_table(spark, SF)
    return fixture.Table(*(getattr(t, n).checkpoint() for n in ("sector", "z", "y", "va", "x")))


def spec():
    s = copy.deepcopy(config.TEMPLATE)
    s["project"]["table_path"] = SF
    s["scenarios"].append({"scenario_id": "S2", "internal_block_alpha": 0.5})
    return s


def test_project_runs_and_writes(spark, table, tmp_path):
    project = config.build(spec(), set(range(25)))
    runs = scenario.run(table, project)
    for r in runs:
        assert all(c["passed"] for c in r.checks.collect() if c["severity"] == "error"), (r.notes, r.checks.collect())
        assert r.table.x.count() == 26
    # without a profile the parts have their parent's multiplier
    m = {(r["scenario"], r["code"]): r["value"] for r in scenario.multipliers_by_scenario(runs).collect()}
    assert abs(m["S1", "101"] - m["S1", "102"]) < 1e-6
    report.write(project, runs, str(tmp_path / "out"))
    assert "## Scenario S2" in (tmp_path / "out" / "report.md").read_text()
    assert json.loads((tmp_path / "out" / "project.json").read_text())["project"]["project_id"] == "my_project"
    assert spark.read.parquet(str(tmp_path / "out" / "cells")).select("scenario_id").distinct().count() == 2
    assert scenario.key_alternatives(table, project, project.scenarios[0]).count() == 2


def test_profile_changes_inputs(spark, table):
    s = spec()
    s["profiles"] = [{"scenario_id": "S1", "subsector_code": 101, "supplier_code": 3, "intensity": 1.02}]
    runs = scenario.run(table, config.build(s, set(range(25))))
    got = {r["j"]: r["value"] for r in runs[0].table.z.where("i = 3 AND j IN (101, 102)").collect()}
    assert runs[0].checks.where("severity = 'error' AND NOT passed").count() == 0 and got[101] / got[102] > 2.01


@pytest.mark.parametrize("change", [
    lambda s: s["project"].pop("project_id"), lambda s: s["keys"].pop(), lambda s: s["keys"][0].update(value=-1), lambda s: s["keys"][0].update(value=None), lambda s: s["splits"][0].update(sector_code=77),
    lambda s: s["splits"][0].update(new_code=3), lambda s: s["splits"][0].update(key_id="none"), lambda s: s["scenarios"].append({"scenario_id": "S1"}),
    lambda s: s.update(profiles=[{"scenario_id": "S9", "subsector_code": 101, "supplier_code": 3, "intensity": 1}]), lambda s: s.update(satellites=[{"name": "jobs", "unit": "n", "sector_code": 1, "value": 2}]),
    lambda s: s.update(targets=[{"kind": "gva"}, {"kind": "industry_output"}]), lambda s: s.update(targets=[{"kind": "taxes"}]), lambda s: s.update(regionalise={"activity_path": "a.csv"}),
])
def test_gaps_block(change):
    s = spec()
    change(s)
    with pytest.raises(TableError):
        config.build(s, set(range(25)))


def test_cli(spark, tmp_path, capsys):
    path = str(tmp_path / "p.json")
    assert cli.main(["--template", path]) == 0
    s = spec()
    s["scenarios"].pop()
    (tmp_path / "p.json").write_text(json.dumps(s))
    assert cli.main([path, "--plan", "--json"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["ready"]
    assert cli.main([path, "--check"]) == 0


def test_catalogue(spark, tmp_path):
    path = str(tmp_path / "c.json")
    cubes.write_cube(path, {"nace": ["C", "C10-12"], "geo": ["AT"], "time": ["2019", "2020"]}, {("C", "AT", "2019"): 5.0, ("C10-12", "AT", "2020"): 2.0, ("C", "AT", "2020"): 6.0})
    assert catalogue.years(spark, path) == ["2019", "2020"]
    assert {r["code"]: r["value"] for r in catalogue.proxy_values(spark, path, "AT").collect()} == {"C": 6.0, "C10-12": 2.0}
    assert catalogue.advise(spark, "C11", [path]) == {"action": "split", "source": path, "code": "C10-12"}
    assert catalogue.advise(spark, "C", [path])["action"] == "load"
    assert catalogue.advise(spark, "A01", [path])["action"] == "none"


def test_codes():
    assert codes.covers("C10-12", "C11") and not codes.covers("C11", "C10-12") and not codes.covers("C", "C")
    assert codes.coarsest(["C", "C10-12", "A", "L68A", "L68"]) == ["C", "A", "L68"]
    kept, notes = codes.finest(["C", "C10-12", "C13"], {"C": 10.0, "C10-12": 4.0, "C13": 5.0}, 1e-6)
    assert kept == ["C"] and notes
    assert codes.finest(["C", "C10-12", "C13"], {"C": 10.0, "C10-12": 4.0, "C13": None}, 1e-6)[0] == ["C"]
    assert codes.split_problems("I56", ["I561", "I562"]) == [] and codes.split_problems("56", ["571"])
    assert codes.expand_label("C20_21") == (["C20", "C21"], []) and codes.expand_label("??") is None


def test_small_operators(spark):
    series = spark.createDataFrame([("k", y, c, v) for y, c, v in [(2018, "a", 1.0), (2018, "b", 1.0), (2020, "a", 3.0), (2020, "b", 1.0)]], "key_id string, year int, code string, value double")
    for year, share, origin in ((2018, 0.5, "observed"), (2019, 0.625, "interpolated"), (2025, 0.75, "nearest")):
        got = {r["code"]: r for r in split.interpolate(series, year).collect()}
        assert abs(got["a"]["share"] - share) < 1e-12 and got["a"]["origin"] == origin
    six = diagnostics.six_pack(spark.createDataFrame([("x", 525.0, 510.0, 500.0), ("y", 1.0, 0.0, 1.0)], "code string, a double, b double, c double")).orderBy("code").collect()
    assert [round(six[0][k], 1) for k in ("price", "volume", "value_index")] == [102.9, 102.0, 105.0] and not six[1]["consistent"]
    zero = spark.createDataFrame([("a", 5.0), ("b", -5.0)], "p string, value double")
    assert all(r["passed"] for r in identities.margin_column(zero, spark.createDataFrame([("b",)], "p string")).collect())
    assert not all(r["passed"] for r in identities.margin_column(zero, spark.createDataFrame([("a",)], "p string")).collect())
    assert identities.sums_to_zero(zero).first()["passed"] and not identities.structural_zero(zero, "block").first()["passed"]
    assert sut.choose_model(False)["excluded"] and sut.choose_model(True)["recommended"] == "D"
    neg = spark.createDataFrame([("va", 2), ("z", 1), ("y", 0)], "block string, negatives long")
    ok = spark.createDataFrame([("va", "subsidies")], "block string, reason string")
    assert {r["block"]: r["reason"] for r in diagnostics.negative_triage(neg, ok).collect()} == {"va": "subsidies", "z": "UNCLASSIFIED"}


@pytest.mark.parametrize("section, value", [
    ("targets", [{"kind": "gva"}]), ("regionalise", {"activity_path": "a.csv", "method": "FLQ", "delta": 0.2}),
    ("satellites", [{"name": "jobs", "unit": "n", "sector_code": c, "value": 2} for c in (1, 2)]),
])
def test_sections_no_run_uses_are_refused(section, value):
    spec = {"project": {"project_id": "p", "table_kind": "fixture"}, section: value}
    assert [m for severity, m in config.gaps(spec, {1, 2}) if severity == "blocking"] == [f"{section}: a project run does not use this section; {config.UNUSED[section]}"]
    with pytest.raises(TableError, match="does not use this section"):
        config.build(spec, {1, 2})
