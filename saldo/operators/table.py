"""Symmetric tables in long form: totals, coefficients, multipliers, effects, comparisons.

z (table_id, i, j, value), y (table_id, i, c, value), va (table_id, r, j, value), x (table_id, i, value).
Dense algebra runs once per table_id in a grouped map; everything else is joins and sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from saldo.functions import kernels
from saldo.functions.lineage import cut

KEY = ["table_id"]
TINY = kernels.TINY


def total(cells: DataFrame, by: str, name: str = "value") -> DataFrame:
    return cells.groupBy(*KEY, by).agg(F.sum("value").alias(name))


def row_totals(x: DataFrame, y: DataFrame) -> DataFrame:
    """Intermediate sales of each sector: output less final demand."""
    out = x.join(total(y, "i", "final"), [*KEY, "i"], "left")
    return out.select(*KEY, "i", (F.col("value") - F.coalesce("final", F.lit(0.0))).alias("value"))


def col_totals(x: DataFrame, va: DataFrame) -> DataFrame:
    """Intermediate purchases of each sector: output less value added."""
    out = x.withColumnRenamed("i", "j").join(total(va, "j", "added"), [*KEY, "j"], "left")
    return out.select(*KEY, "j", (F.col("value") - F.coalesce("added", F.lit(0.0))).alias("value"))


def balance(z: DataFrame, y: DataFrame, va: DataFrame, x: DataFrame) -> DataFrame:
    """Row and column residual of each sector: what uses, and costs, leave of output."""
    parts = (total(z, "i", "zr"), total(y, "i", "fd"), total(z.withColumnRenamed("i", "_"), "j", "zc").withColumnRenamed("j", "i"), total(va, "j", "va").withColumnRenamed("j", "i"))
    out = x
    for p in parts:
        out = out.join(p, [*KEY, "i"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(*KEY, "i", (F.col("value") - zero("zr") - zero("fd")).alias("row_residual"), (F.col("value") - zero("zc") - zero("va")).alias("col_residual"))


def coefficients(z: DataFrame, x: DataFrame) -> DataFrame:
    """Input coefficients z_ij / x_j; NaN where the buyer has no output."""
    xj = x.select(*KEY, F.col("i").alias("j"), F.col("value").alias("x"))
    return z.join(xj, [*KEY, "j"], "left").select(*KEY, "i", "j", safe_ratio(F.col("value"), F.coalesce("x", F.lit(0.0)), TINY).alias("value"))


def safe_ratio(a: Column, b: Column, tiny: float = 1e-9) -> Column:
    """a / b, NaN where b is tiny."""
    return F.when(F.abs(b) < tiny, F.lit(float("nan"))).otherwise(a / F.when(F.abs(b) >= tiny, b))


def _dense(pdf: pd.DataFrame) -> tuple[np.ndarray, dict, np.ndarray]:
    """Sectors, their positions and the matrix of a group's cells; rows with null j name a sector without cells."""
    ids = np.array(sorted(set(pdf["i"].dropna()) | set(pdf["j"].dropna())))
    at = {s: k for k, s in enumerate(ids)}
    a = np.zeros((len(ids), len(ids)))
    cells = pdf.dropna(subset=["i", "j"])
    a[cells["i"].map(at).to_numpy(int), cells["j"].map(at).to_numpy(int)] = cells["value"].to_numpy(float)
    return ids, at, a


def _with_sectors(a: DataFrame, x: DataFrame) -> DataFrame:
    return a.select(*KEY, "i", "j", "value").unionByName(x.select(*KEY, "i", F.lit(None).cast("int").alias("j"), F.lit(None).cast("double").alias("value")))


def leontief_inverse(a: DataFrame, x: DataFrame) -> DataFrame:
    """Cells (i, j, value) of (I - A)^-1 of each table."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, _, m = _dense(pdf)
        inverse, _ = kernels.leontief(m)
        i, j = np.indices(inverse.shape)
        return pd.DataFrame({"table_id": pdf["table_id"].iloc[0], "i": ids[i.ravel()].astype("int32"), "j": ids[j.ravel()].astype("int32"), "value": inverse.ravel()})

    return _with_sectors(a, x).groupBy(*KEY).applyInPandas(run, "table_id string, i int, j int, value double")


def leontief_diagnosis(a: DataFrame, x: DataFrame) -> DataFrame:
    """Condition number, spectral radius, largest column sum and negative coefficients of each table."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, info = kernels.leontief(_dense(pdf)[2])
        return pd.DataFrame([{"table_id": pdf["table_id"].iloc[0], **info}])

    return _with_sectors(a, x).groupBy(*KEY).applyInPandas(run, "table_id string, condition double, negative_coefficients double, max_column_sum double, spectral_radius double")


def multipliers(a: DataFrame, x: DataFrame) -> DataFrame:
    """Output multiplier of each sector; one solve per table, no inverse: (I - A)' m = 1."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, _, m = _dense(pdf)
        got = np.linalg.solve(np.eye(len(m)) - np.nan_to_num(m).T, np.ones(len(m)))
        return pd.DataFrame({"table_id": pdf["table_id"].iloc[0], "j": ids.astype("int32"), "multiplier": got})

    return _with_sectors(a, x).groupBy(*KEY).applyInPandas(run, "table_id string, j int, multiplier double")


def multipliers_by_series(a: DataFrame, x: DataFrame, doublings: int = 6) -> DataFrame:
    """The same by the power series 1 + 1A + 1AA + ... of 2^doublings terms, as joins and sums.

    For tables too large for one task: each round adds the sum so far times a power of A, and squares that
    power, (1 + A)(1 + AA)(1 + AAAA)..., so the plan has as many steps as the series has doublings.
    """
    power = cut(a.where(~F.isnan("value")).select(*KEY, "i", "j", "value"))
    total_ = x.select(*KEY, F.col("i").alias("j"), F.lit(1.0).alias("t"))
    for k in range(doublings):
        pulled = power.join(total_.withColumnRenamed("j", "i"), [*KEY, "i"]).select(*KEY, "j", (F.col("t") * F.col("value")).alias("t"))
        total_ = cut(total_.unionByName(pulled).groupBy(*KEY, "j").agg(F.sum("t").alias("t")))
        if k + 1 < doublings:
            right = power.select(*KEY, F.col("i").alias("j"), F.col("j").alias("k"), F.col("value").alias("w"))
            power = cut(power.join(right, [*KEY, "j"]).groupBy(*KEY, "i", F.col("k").alias("j")).agg(F.sum(F.col("value") * F.col("w")).alias("value")))
    return total_.withColumnRenamed("t", "multiplier")


def type_ii_multipliers(a: DataFrame, x: DataFrame, income: DataFrame, household: DataFrame) -> DataFrame:
    """Type II multipliers and propensity; income (i, value) is labour income, household (i, value) consumption."""
    side = lambda df, what: df.select(*KEY, "i", F.lit(None).cast("int").alias("j"), F.col("value").cast("double"), F.lit(what).alias("what"))
    rows = a.select(*KEY, "i", "j", "value", F.lit("a").alias("what")).unionByName(side(x, "x")).unionByName(side(income, "income")).unionByName(side(household, "household"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, at, m = _dense(pdf[pdf["what"].isin(["a", "x"])])
        vectors = {}
        for what in ("x", "income", "household"):
            v = np.zeros(len(ids))
            some = pdf[(pdf["what"] == what) & pdf["i"].isin(at)]
            v[some["i"].map(at).to_numpy(int)] = some["value"]
            vectors[what] = v
        got, propensity = kernels.type_ii(m, vectors["income"], vectors["household"], vectors["x"])
        return pd.DataFrame({"table_id": pdf["table_id"].iloc[0], "j": ids.astype("int32"), "multiplier": got, "propensity": propensity})

    return rows.groupBy(*KEY).applyInPandas(run, "table_id string, j int, multiplier double, propensity double")


def satellite_effects(values: DataFrame, x: DataFrame, inverse: DataFrame) -> DataFrame:
    """Direct and total effect per unit of final demand of a satellite (i, value), and multiplier total / direct."""
    e = values.withColumnRenamed("value", "e").join(x.withColumnRenamed("value", "x"), [*KEY, "i"]).select(*KEY, "i", safe_ratio(F.col("e"), F.col("x"), TINY).alias("direct"))
    all_ = inverse.join(e, [*KEY, "i"]).groupBy(*KEY, "j").agg(F.sum(F.col("value") * F.nanvl("direct", F.lit(0.0))).alias("total"))
    return all_.join(e.withColumnRenamed("i", "j"), [*KEY, "j"]).select(*KEY, "j", "direct", "total", safe_ratio(F.col("total"), F.col("direct"), TINY).alias("ratio"))


def compare_scenarios(values: DataFrame) -> DataFrame:
    """Range over scenarios of each code's value, absolute and as % of the smallest. values: (scenario, code, value)."""
    out = values.groupBy("code").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return out.select("code", "low", "high", (F.col("high") - F.col("low")).alias("spread"), (100 * safe_ratio(F.col("high") - F.col("low"), F.col("low"))).alias("spread_pct"))


def variation_driver(cells: DataFrame) -> DataFrame:
    """The cell (i, j) whose value varies most over scenarios; ties by position."""
    spread = cells.groupBy("i", "j").agg((F.max("value") - F.min("value")).alias("spread"))
    return spread.orderBy(F.desc("spread"), "i", "j").limit(1)


def input_divergence(a: DataFrame, parts: DataFrame) -> DataFrame:
    """Largest difference and cosine distance of the input columns of every two of the parts (table_id, j) of a split."""
    a = a.join(parts.select(*KEY, "j").distinct(), [*KEY, "j"], "left_semi")
    left = a.select(*KEY, "i", F.col("j").alias("a"), F.col("value").alias("va"))
    right = a.select(*KEY, "i", F.col("j").alias("b"), F.col("value").alias("vb"))
    norm = a.groupBy(*KEY, "j").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"), F.max(F.abs("value")).alias("top"))
    pairs = left.join(right, [*KEY, "i"]).where("a < b").groupBy(*KEY, "a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("dot"), F.max(F.abs(F.col("va") - F.col("vb"))).alias("gap"))
    out = pairs.join(norm.select(*KEY, F.col("j").alias("a"), F.col("norm").alias("na")), [*KEY, "a"]).join(norm.select(*KEY, F.col("j").alias("b"), F.col("norm").alias("nb")), [*KEY, "b"])
    return out.select(*KEY, "a", "b", F.col("gap").alias("max_gap"), (1 - F.col("dot") / (F.col("na") * F.col("nb"))).alias("cosine_distance"))


def cell_importance(z: DataFrame, x: DataFrame, inverse: DataFrame, change: float = 0.01, top: int = 10) -> DataFrame:
    """Cells whose relative change moves total output most: first-order effect and the exact one (Sherman-Morrison)."""
    a = coefficients(z, x)
    om = inverse.groupBy(*KEY, F.col("j").alias("i")).agg(F.sum("value").alias("om"))
    rm = inverse.groupBy(*KEY, F.col("i").alias("j")).agg(F.sum("value").alias("rm"))
    back = inverse.select(*KEY, F.col("j").alias("i"), F.col("i").alias("j"), F.col("value").alias("b"))
    out = a.join(om, [*KEY, "i"]).join(rm, [*KEY, "j"]).join(back, [*KEY, "i", "j"]).withColumn("delta", F.col("value") * change)
    out = out.withColumn("first", F.col("delta") * F.col("om") * F.col("rm")).withColumn("exact", F.col("first") / (1 - F.col("delta") * F.col("b")))
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("exact"), "i", "j"))
    return out.withColumn("rank", rank).where(F.col("rank") <= top).select(*KEY, "i", "j", "first", "exact", "rank")


def region_blocks(z: DataFrame, sector: DataFrame) -> DataFrame:
    """Flows summed from region to region."""
    side = lambda k, name: sector.select(*KEY, F.col("idx").alias(k), F.col("region_id").alias(name))
    return z.join(side("i", "origin"), [*KEY, "i"]).join(side("j", "destination"), [*KEY, "j"]).groupBy(*KEY, "origin", "destination").agg(F.sum("value").alias("value"))


def three_blocks(z: DataFrame, sector: DataFrame, home: int) -> DataFrame:
    """Home sector, rest of its region, and the rest: the flow table contracted on both axes."""
    region = sector.where(F.col("idx") == home).select(*KEY, F.col("region_id").alias("own"))
    block = F.when(F.col("idx") == home, 0).when(F.col("region_id") == F.col("own"), 1).otherwise(2)
    mapping = sector.join(region, KEY).select(*KEY, "idx", block.alias("block"))
    return reaggregate(z, mapping.withColumnRenamed("block", "parent"))


def reaggregate(z: DataFrame, mapping: DataFrame) -> DataFrame:
    """Flows summed to parents. mapping: (table_id, idx, parent)."""
    side = lambda k, name: mapping.select(*KEY, F.col("idx").alias(k), F.col("parent").alias(name))
    out = z.join(side("i", "pi"), [*KEY, "i"]).join(side("j", "pj"), [*KEY, "j"]).groupBy(*KEY, "pi", "pj").agg(F.sum("value").alias("value"))
    return out.select(*KEY, F.col("pi").alias("i"), F.col("pj").alias("j"), "value")


def reaggregation_error(before: DataFrame, after: DataFrame) -> DataFrame:
    """Largest absolute and relative difference of two tables' cells, and of their totals."""
    both = before.withColumnRenamed("value", "v0").join(after.withColumnRenamed("value", "v1"), [*KEY, "i", "j"], "full")
    gap = F.abs(F.coalesce("v0", F.lit(0.0)) - F.coalesce("v1", F.lit(0.0)))
    return both.groupBy(*KEY).agg(F.max(gap).alias("max_abs"), F.max(F.when(F.abs("v0") > TINY, 100 * gap / F.abs("v0"))).alias("max_pct"), (F.sum(F.coalesce("v1", F.lit(0.0))) - F.sum(F.coalesce("v0", F.lit(0.0)))).alias("total_gap"))


def move_to_country(z: DataFrame, sector: DataFrame, factor: float) -> DataFrame:
    """Each sector's purchases from the rest of its own region times factor, taken from its purchases abroad.

    The rise is capped so that what is bought abroad doesn't fall below zero; column totals stay.
    """
    side = lambda k, name: sector.select(*KEY, F.col("idx").alias(k), F.col("region_id").alias(name))
    kind = F.when(F.col("i") == F.col("j"), 0).when(F.col("ri") == F.col("rj"), 1).otherwise(2)
    cells = z.join(side("i", "ri"), [*KEY, "i"]).join(side("j", "rj"), [*KEY, "j"]).withColumn("kind", kind)
    col = Window.partitionBy(*KEY, "j")
    near, far = F.sum(F.when(F.col("kind") == 1, F.col("value")).otherwise(0.0)).over(col), F.sum(F.when(F.col("kind") == 2, F.col("value")).otherwise(0.0)).over(col)
    cells = cells.withColumn("near", near).withColumn("far", far)
    rise = F.least((factor - 1) * F.col("near"), F.col("far"))
    new = F.when((F.col("kind") == 1) & (F.col("near") > 0), F.col("value") * (1 + rise / F.col("near"))).when((F.col("kind") == 2) & (F.col("far") > 0) & (F.col("near") > 0), F.col("value") * (1 - rise / F.col("far"))).otherwise(F.col("value"))
    return cells.select(*KEY, "i", "j", new.alias("value"))


def spillover(inverse: DataFrame, sector: DataFrame, per_output: DataFrame) -> DataFrame:
    """Effect of a unit of each sector's final demand: total and inside its own region. per_output: (i, c)."""
    side = lambda k, name: sector.select(*KEY, F.col("idx").alias(k), F.col("region_id").alias(name))
    cells = inverse.join(per_output, [*KEY, "i"]).join(side("i", "ri"), [*KEY, "i"]).join(side("j", "rj"), [*KEY, "j"])
    effect = F.col("value") * F.col("c")
    out = cells.groupBy(*KEY, "j").agg(F.sum(effect).alias("total"), F.sum(F.when(F.col("ri") == F.col("rj"), effect).otherwise(0.0)).alias("own"))
    return out.select(*KEY, "j", "total", "own", (1 - safe_ratio(F.col("own"), F.col("total"))).alias("spill_share"))


def provenance_counts(cells: DataFrame) -> DataFrame:
    """Cells of each provenance label and the status it stands for."""
    status = F.when(F.col("prov").isin("observed", "user_constraint"), "OBSERVED").when(F.col("prov") == "balanced_adjustment", "BALANCED").otherwise("ESTIMATED")
    return cells.groupBy("prov").agg(F.count(F.lit(1)).alias("cells")).withColumn("status", status)
