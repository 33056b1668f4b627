"""Runs of a project: every split under every scenario, balanced, checked and compared."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saldo.functions.kernels import TableError
from saldo.functions.lineage import cut
from saldo.operators import balance, split, table
from saldo.plans.config import Project, Scenario, Split
from saldo.sources.fixture import Table


@dataclass
class Run:
    """One scenario's table after its splits, with provenance, checks and what the solver reported."""

    scenario_id: str
    table: Table
    cells: DataFrame
    checks: DataFrame
    notes: list[str] = field(default_factory=list)


def weights_of(spark: SparkSession, key: dict[int, float]) -> DataFrame:
    total = sum(key.values())
    return spark.createDataFrame([(int(p), float(v) / total) for p, v in sorted(key.items())], "part int, weight double")


def split_table(t: Table, one: Split, keys: dict[str, dict[int, float]], scenario: Scenario) -> tuple[Table, DataFrame, list[str]]:
    """The table with a sector split: seed, inner block balanced to its targets, provenance; refusals name the target."""
    spark = t.x.sparkSession
    own = lambda block: weights_of(spark, keys[one.keys_by_block.get(block, one.key_id)])
    w_row, w_col, w_out = own("intermediate_rows"), own("intermediate_cols"), own("output")
    shares = None
    named = [(s, p, m) for p, by in scenario.profiles.items() if p in one.parts for s, m in by.items()]
    if named:
        shares = split.profile_shares(t.z, one.sector, w_col, spark.createDataFrame(named, "i int, part int, m double"))
    seeded = split.seed(t.z, one.sector, w_row, w_col, scenario.alpha, shares)
    x, y, va = split.split_margin(t.x, "i", one.sector, w_out), split.split_margin(t.y, "i", one.sector, own("final_demand")), split.split_margin(t.va, "j", one.sector, own("value_added"))
    seeded = cut(seeded)
    rows, cols = split.targets(x, y, va)
    r, c = (cut(df) for df in split.inner_targets(seeded, rows, cols, one.parts))
    inner = seeded.where("block = 'inner'")
    notes = []
    total = inner.agg(F.sum("value").alias("s")).first()["s"] or 0.0
    if total:
        verdict = split.feasibility(r, c, F.lit(total)).first()
        if total > 0 and not verdict["feasible"] and verdict["smallest"] < -1e-6 * abs(total):
            raise TableError(f"{scenario.scenario_id}: splitting {one.sector} needs a negative inner sum of {verdict['smallest']:.6g}; the profile asks for more than the block holds")
        fixed = {k: v for k, v in scenario.constraints.items() if k[0] in one.parts and k[1] in one.parts}
        known = spark.createDataFrame([("", i, j, v) for (i, j), v in fixed.items()], "table_id string, i int, j int, value double").drop("table_id").join(inner.select("table_id").distinct()) if fixed else None
        made = cut(balance.balance(inner, r, c, eps=scenario.tolerance, max_iter=scenario.max_iter, known=known, floor=1e-6 * abs(total)))
        facts = made.agg(F.max("iterations").alias("n"), F.bool_and("converged").alias("ok"), F.max("method").alias("how")).first()
        notes.append(f"split {one.sector}: {facts['how']} {facts['n']} iterations, {'converged' if facts['ok'] else 'not converged'}")
        after = seeded.where("block <> 'inner'").select("table_id", "i", "j", "value").unionByName(made.select("table_id", "i", "j", "value"))
    else:
        after = seeded.select("table_id", "i", "j", "value")
    cells = split.provenance(seeded, after, one.parts)
    names = spark.createDataFrame(list(zip(one.parts, one.labels)), "idx int, code string")
    home = t.sector.where(F.col("idx") == one.sector).drop("idx", "code")
    sector = t.sector.where(F.col("idx") != one.sector).unionByName(home.join(names).select(*t.sector.columns))
    return Table(sector, after, y, va, x), cells, notes


def checks(before: Table, after: Table, parents: DataFrame) -> DataFrame:
    """Rows (name, passed, detail, severity) of a split table: balance, reaggregation, negatives, new empty sectors."""
    residual = table.balance(after.z, after.y, after.va, after.x).agg(F.max(F.abs("row_residual")).alias("r"), F.max(F.abs("col_residual")).alias("c"))
    size = after.x.agg(F.max(F.abs("value")).alias("m"))
    one = residual.join(size)  # one row each
    text = lambda c: F.format_string("%.3g", c)
    rows = one.select(F.lit("balance").alias("name"), (F.greatest("r", "c") <= 1e-6 * F.greatest("m", F.lit(1.0))).alias("passed"), text(F.greatest("r", "c")).alias("detail"), F.lit("error").alias("severity"))
    back = table.reaggregation_error(before.z.select("table_id", "i", "j", "value"), table.reaggregate(after.z, parents))
    rows = rows.unionByName(back.select(F.lit("reaggregation").alias("name"), (F.coalesce("max_pct", F.lit(0.0)) <= 1e-4).alias("passed"), text(F.col("max_abs")).alias("detail"), F.lit("error").alias("severity")))
    coefficient = table.coefficients(after.z, after.x).agg(F.max("value").alias("m"), F.sum((F.col("value") > 1).cast("int")).alias("n"))
    rows = rows.unionByName(coefficient.select(F.lit("coefficients above one").alias("name"), (F.col("n") == 0).alias("passed"), text(F.col("m")).alias("detail"), F.lit("warning").alias("severity")))
    radius = table.leontief_diagnosis(table.coefficients(after.z, after.x), after.x)
    return rows.unionByName(radius.select(F.lit("spectral radius").alias("name"), (F.col("spectral_radius") < 1).alias("passed"), text(F.col("spectral_radius")).alias("detail"), F.lit("error").alias("severity")))


def run(t: Table, project: Project) -> list[Run]:
    """All scenarios; one whose targets can't be met is reported as a run without a table."""
    out = []
    spark = t.x.sparkSession
    for scenario in project.scenarios:
        now, cells, notes = t, t.z.withColumn("prov", F.lit("observed")), []
        parents = t.sector.select("table_id", "idx", F.col("idx").alias("parent"))
        try:
            for one in project.splits:
                now, cells, more = split_table(now, one, project.keys, scenario)
                notes += more
                mine = spark.createDataFrame([(p, one.sector) for p in one.parts], "idx int, parent int").join(t.sector.select("table_id").distinct())
                parents = parents.where(F.col("idx") != one.sector).unionByName(mine.select("table_id", "idx", "parent"))
        except TableError as refusal:
            out.append(Run(scenario.scenario_id, t, cells.limit(0), spark.createDataFrame([("feasible", False, str(refusal), "error")], "name string, passed boolean, detail string, severity string"), [str(refusal)]))
            continue
        out.append(Run(scenario.scenario_id, now, cells, checks(t, now, parents), notes))
    return out


def multipliers_by_scenario(runs: list[Run]) -> DataFrame:
    """(scenario, code, value): output multipliers of every run, for comparison."""
    out = None
    for r in runs:
        one = table.multipliers(table.coefficients(r.table.z, r.table.x), r.table.x).select(F.lit(r.scenario_id).alias("scenario"), F.col("j").cast("string").alias("code"), F.col("multiplier").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def key_alternatives(t: Table, project: Project, scenario: Scenario) -> DataFrame:
    """(key, code, multiplier): the run again with every other key of the same codes."""
    out = None
    for one in project.splits:
        for key, codes in sorted(project.keys.items()):
            if set(codes) != set(one.parts):
                continue
            got, _, _ = split_table(t, Split(one.sector, one.parts, one.labels, key), project.keys, scenario)
            m = table.multipliers(table.coefficients(got.z, got.x), got.x).where(F.col("j").isin(*one.parts)).select(F.lit(key).alias("key"), F.col("j").alias("code"), "multiplier")
            out = m if out is None else out.unionByName(m)
    return out
