"""Supply-use tables: product mix, market shares, models A-E, projection."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from saldo.functions import kernels


def live(cells: DataFrame, axis: str) -> DataFrame:
    """Cells of products or activities with a positive total."""
    total = F.sum("value").over(Window.partitionBy(axis))
    return cells.withColumn("_t", total).where("_t > 0").drop("_t")


def product_mix(v: DataFrame) -> DataFrame:
    """C (p, a): a product's share in an industry's output."""
    return v.select("p", "a", (F.col("value") / F.sum("value").over(Window.partitionBy("a"))).alias("value"))


def market_shares(v: DataFrame) -> DataFrame:
    """D (a, p): an industry's share in a product's output."""
    return v.select("a", "p", (F.col("value") / F.sum("value").over(Window.partitionBy("p"))).alias("value"))


def model_b(v: DataFrame, u: DataFrame) -> DataFrame:
    """Product by product under industry technology: S (p, q) = U C'. A join and a sum; no negatives arise."""
    c = product_mix(v).select(F.col("p").alias("q"), "a", F.col("value").alias("c"))
    return u.join(c, "a").groupBy("p", "q").agg(F.sum(F.col("value") * F.col("c")).alias("value"))


def model_d(v: DataFrame, cells: DataFrame, column: str) -> DataFrame:
    """Industry by industry under fixed product sales: rows of use or final demand (p, column) pass to industries by D."""
    d = market_shares(v).select("a", "p", F.col("value").alias("d"))
    other = cells.withColumnRenamed(column, "_c")
    return other.join(d, "p").groupBy("a", "_c").agg(F.sum(F.col("value") * F.col("d")).alias("value")).withColumnRenamed("a", "i").withColumnRenamed("_c", "j" if column == "a" else column)


def dense_model(model: str, v: DataFrame, u: DataFrame, y: DataFrame, h: DataFrame | None = None) -> DataFrame:
    """Models that need an inverse (A, C, E), and the others, as one grouped map: block, row, column, value.

    Products and activities are numbered by name; A, C and E need as many of one as of the other.
    """
    tag = lambda df, what, col: df.select(F.lit(what).alias("what"), F.col("p").cast("string").alias("r"), F.col(col).cast("string").alias("c"), "value")
    rows = tag(v, "v", "a").unionByName(tag(u, "u", "a")).unionByName(tag(y, "y", "c"))
    if h is not None:
        rows = rows.unionByName(tag(h, "h", "a"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = lambda what: pdf[pdf["what"] == what].pivot_table(index="r", columns="c", values="value", aggfunc="sum", fill_value=0.0)
        supply = grid("v")
        use = grid("u").reindex(index=supply.index, columns=supply.columns, fill_value=0.0)
        final = grid("y").reindex(index=supply.index, fill_value=0.0)
        vt, ud, yd = supply.to_numpy(float), use.to_numpy(float), final.to_numpy(float)
        hh = grid("h").reindex(index=supply.index, columns=supply.columns, fill_value=1.0).to_numpy(float) if (pdf["what"] == "h").any() else np.ones_like(vt)
        out = kernels.transform(model, vt, ud, np.zeros_like(ud), yd, np.zeros_like(yd), (vt.sum(0) - ud.sum(0))[None], hh)
        axis = supply.index if model in "ABE" else supply.columns
        rows_ = supply.index if model in "ABE" else supply.columns
        frames = [pd.DataFrame(out["Sd"], rows_, axis), pd.DataFrame(out["Yd"], rows_, final.columns), pd.DataFrame(out["E"], ["VA"], axis)]
        made = [f.rename_axis(index="r", columns="c").stack().rename("value").reset_index().assign(block=b) for f, b in zip(frames, ("Z", "Y", "VA"))]
        return pd.concat(made)[["block", "r", "c", "value"]]

    return rows.groupBy().applyInPandas(run, "block string, r string, c string, value double")


def almon(v: DataFrame, u: DataFrame) -> DataFrame:
    """Product-technology table without negatives, row by row: rows are independent, so each is its own group."""
    grid = v.groupBy().agg(F.collect_list(F.struct(F.col("p").cast("string").alias("p"), F.col("a").cast("string").alias("a"), "value")).alias("supply"))
    rows = u.groupBy(F.col("p").cast("string").alias("p")).agg(F.collect_list(F.struct(F.col("a").cast("string").alias("a"), "value")).alias("use")).join(grid)  # grid: one row, the supply table

    def run(batches):
        for pdf in batches:
            out = []
            for p, use, supply in zip(pdf["p"], pdf["use"], pdf["supply"]):
                s = pd.DataFrame([dict(r) if isinstance(r, dict) else r.asDict() for r in supply]).pivot_table(index="p", columns="a", values="value", aggfunc="sum", fill_value=0.0)
                shares = s.to_numpy(float) / s.to_numpy(float).sum(1)[:, None]
                line = pd.Series({r["a"]: r["value"] for r in use}).reindex(s.columns, fill_value=0.0)
                got = kernels.almon_row(line.to_numpy(float), shares)
                out += [(p, q, float(z), got.converged, got.row_error) for q, z in zip(s.index, got.cells)]
            yield pd.DataFrame(out, columns=["p", "q", "value", "converged", "row_error"])

    return rows.mapInPandas(run, "p string, q string, value double, converged boolean, row_error double")


def choose_model(square: bool, secondary: str | None = None) -> dict[str, str]:
    """Guidance for the choice of a model; it never chooses."""
    advice = {"recommended": "D", "why": "fixed product sales give no negatives and suit rectangular tables"}
    if not square:
        advice["excluded"] = "A and C need a square supply table"
    elif secondary == "subsidiary":
        advice["consider"] = "A: subsidiary products keep their own technology"
    elif secondary in ("by-product", "joint"):
        advice["consider"] = "B: by-products and joint products share the industry's technology"
    return advice


def project(build: Callable[[], dict], method: str) -> kernels.SutEuro | kernels.SutRas:
    """Run a projection and refuse one that didn't settle, for either method."""
    arguments = build()
    got = kernels.sut_euro(**arguments) if method == "sut_euro" else kernels.sut_ras(**arguments)
    if not got.converged:
        raise kernels.NotConverged(f"{method} stopped after {got.iterations} iterations without settling")
    return got


#: Kinds of targets that tell the projection methods apart, and those of both. Fixed values.
KINDS = {"sut_euro": ("gva", "final_use"), "sut_ras": ("industry_output", "use_column_totals")}
SHARED = ("taxes", "imports")


def choose_projection(kinds: set[str]) -> str:
    """The method that a project's targets are for; mixed, missing and unknown kinds are refused."""
    unknown = kinds - {k for v in KINDS.values() for k in v} - set(SHARED)
    if unknown:
        raise kernels.TableError(f"targets of unknown kinds: {', '.join(sorted(unknown))}")
    chosen = [m for m, names in KINDS.items() if kinds & set(names)]
    if len(chosen) != 1:
        raise kernels.TableError("targets mix those of both projection methods" if chosen else "targets name neither value added and final use nor outputs and use totals")
    missing = set(KINDS[chosen[0]]) - kinds
    if missing:
        raise kernels.TableError(f"{chosen[0]} also needs targets of {', '.join(sorted(missing))}")
    return chosen[0]


def align_targets(targets: DataFrame, axes: DataFrame) -> DataFrame:
    """Targets (kind, code, value) beside the table's codes (kind, code): value and problem, null where both have the code.

    A target without a code in the table, a code without a target and a repeated target are problems.
    """
    n = targets.groupBy("kind", "code").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"))
    both = n.join(axes.select("kind", "code", F.lit(True).alias("known")), ["kind", "code"], "full")
    problem = F.when(F.col("known").isNull(), "not in the table").when(F.col("n").isNull(), "no target").when(F.col("n") > 1, "repeated")
    return both.select("kind", "code", "value", problem.alias("problem"))


PROJECTED = "table_id string, block string, r string, c string, value double, iterations int"


def project_frames(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """Supply-use tables projected to the totals of another year, as a grouped map: one task a table (PROJECTED).

    cells: (table_id, what, r, c, value): "domestic" and "imported" use by product r and column c (industries and
    final uses), "taxes" by column c, "supply" by product r and industry c. targets: (table_id, kind, code,
    value). Industries are the columns of supply; those and products without supply are dead and dropped.
    Targets must match the live axes one to one. Both methods refuse a run that doesn't settle.
    """
    rows = cells.select("table_id", "what", "r", "c", "value").unionByName(targets.select("table_id", F.concat(F.lit("target:"), "kind").alias("what"), F.lit(None).cast("string").alias("r"), F.col("code").alias("c"), "value"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = lambda what: pdf[pdf["what"] == what].pivot_table(index="r", columns="c", values="value", aggfunc="sum", fill_value=0.0)
        supply = grid("supply")
        supply = supply.loc[supply.sum(axis=1) > 0, supply.sum() > 0]
        columns = [*supply.columns, *sorted(set(grid("domestic").columns) - set(grid("supply").columns))]
        domestic, imported = (grid(what).reindex(index=supply.index, columns=columns, fill_value=0.0) for what in ("domestic", "imported"))
        tax = pdf[pdf["what"] == "taxes"].groupby("c")["value"].sum().reindex(columns, fill_value=0.0)
        goals = {w.split(":", 1)[1]: g.set_index("c")["value"] for w, g in pdf[pdf["what"].str.startswith("target:")].groupby("what")}
        method = choose_projection(set(goals))

        def goal(kind: str, codes: list[str]) -> np.ndarray:
            have = goals[kind]
            odd = set(have.index) ^ set(codes) | set(have.index[have.index.duplicated()])
            if odd:
                raise kernels.TableError(f"{kind}: targets and table don't have the same codes once each: {', '.join(sorted(odd))}")
            return have.reindex(codes).to_numpy(float)

        ud, um, v = domestic.to_numpy(float), imported.to_numpy(float), supply.to_numpy(float)
        live, final = list(supply.columns), columns[supply.shape[1] :]
        if method == "sut_euro":
            build = lambda: {"ud0": ud, "um0": um, "taxes0": tax.to_numpy(float), "v0": v.T, "va_goal": goal("gva", live), "final_goal": goal("final_use", final), "taxes_goal": goals["taxes"].sum(), "imports_goal": goals["imports"].sum()}
        else:
            plus, minus = lambda a: np.maximum(a, 0), lambda a: np.maximum(-a, 0)
            build = lambda: {"pd_": plus(ud), "nd": minus(ud), "pm": plus(um), "nm": minus(um), "pv": plus(v.T), "nv": minus(v.T), "m": um.sum(1), "x": goal("industry_output", live), "u": goal("use_column_totals", columns), "total": goals["imports"].sum()}
        got = project(build, method)
        parts = [("domestic", got.domestic, supply.index, columns), ("imported", got.imported, supply.index, columns), ("supply", got.supply.T, supply.index, live)]
        if method == "sut_euro":
            parts += [("taxes", got.taxes[None], ["taxes"], columns), ("added", got.value_added[None], ["added"], live)]
        made = [pd.DataFrame(a, r, c).rename_axis(index="r", columns="c").stack().rename("value").reset_index().assign(block=b) for b, a, r, c in parts]
        return pd.concat(made).assign(table_id=pdf["table_id"].iloc[0], iterations=got.iterations)[["table_id", "block", "r", "c", "value", "iterations"]]

    return rows.groupBy("table_id").applyInPandas(run, PROJECTED)
