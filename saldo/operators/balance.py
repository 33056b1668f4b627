"""Balancing of tables: grouped kernels, and RAS as joins for tables beyond one task's memory."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldo.functions import kernels
from saldo.functions.lineage import cut

OUT = "table_id string, i int, j int, value double, method string, iterations int, converged boolean, step double"


def choose(negatives: bool, asked: str = "GRAS") -> str:
    """RAS only where asked for and no cell is negative; negatives with RAS are refused; else GRAS."""
    if asked == "RAS" and negatives:
        raise kernels.TableError("RAS was asked for but cells are negative; GRAS keeps their signs")
    return "RAS" if asked == "RAS" else "GRAS"


def square_margins(u: np.ndarray, v: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """Targets with one total where they differ by no more than the floor: both are scaled to the mean."""
    gap = abs(u.sum() - v.sum())
    if 0 < gap <= floor:
        mean = (u.sum() + v.sum()) / 2
        return u * mean / u.sum(), v * mean / v.sum(), True
    return u, v, False


def balance(cells: DataFrame, rows: DataFrame, cols: DataFrame, *, method: str = "GRAS", eps: float = 1e-8, max_iter: int = 10_000, known: DataFrame | None = None, floor: float = 0.0) -> DataFrame:
    """Cells of each table_id scaled to row targets (i, value) and column targets (j, value).

    known: cells (i, j, value) held as they are (GRAS works around them; RAS puts them back). A table whose
    targets can't be met raises; one that doesn't settle comes back with converged = false.
    """
    side = lambda df, what, i, j: df.select("table_id", i, j, F.col("value").cast("double"), F.lit(what).alias("what"))
    none = F.lit(None).cast("int")
    all_ = side(cells, "cell", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"))
    all_ = all_.unionByName(side(rows, "row", F.col("i").cast("int").alias("i"), none.alias("j"))).unionByName(side(cols, "col", none.alias("i"), F.col("j").cast("int").alias("j")))
    if known is not None:
        all_ = all_.unionByName(side(known, "known", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = (pdf[pdf["what"] == w].sort_values(k) for w, k in (("row", "i"), ("col", "j")))
        t = np.zeros((len(r), len(c)))

        def places(what: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            some = pdf[pdf["what"] == what]
            i, j = pd.Index(r["i"]).get_indexer(some["i"]), pd.Index(c["j"]).get_indexer(some["j"])
            if (i < 0).any() or (j < 0).any():
                odd = some[(i < 0) | (j < 0)].iloc[0]
                raise kernels.TableError(f"cell ({odd['i']:g}, {odd['j']:g}) has no target")
            return i, j, some["value"].to_numpy()

        i, j, value = places("cell")
        np.add.at(t, (i, j), value)
        held = {(int(a), int(b)): float(x) for a, b, x in zip(*places("known"))}
        u, v, _ = square_margins(r["value"].to_numpy(), c["value"].to_numpy(), floor)
        how = choose(bool((t < 0).any()), method)
        if how == "RAS":
            locked = np.zeros(t.shape, bool)
            for (i, j), value in held.items():
                t[i, j], locked[i, j] = value, True
            got = kernels.ras(t, u, v, locked, eps, max_iter)
        else:
            slack = max(floor, 1e-9 * max(np.abs(u).sum(), np.abs(v).sum()))
            got = kernels.mras(t, u, v, held, eps=eps, max_iter=max_iter, margin_floor=slack)
        i, j = np.nonzero(got.cells)
        return pd.DataFrame({
            "table_id": pdf["table_id"].iloc[0], "i": r["i"].to_numpy()[i].astype("int32"), "j": c["j"].to_numpy()[j].astype("int32"), "value": got.cells[i, j],
            "method": how, "iterations": got.iterations, "converged": got.converged, "step": got.step,
        })

    return all_.groupBy("table_id").applyInPandas(run, OUT)


def ras_rounds(cells: DataFrame, rows: DataFrame, cols: DataFrame, rounds: int) -> DataFrame:
    """A fixed number of RAS rounds as joins and sums; the lineage is cut every few rounds."""
    now, rows, cols = cut(cells.select("table_id", "i", "j", "value")), cut(rows), cut(cols)
    for k in range(rounds):
        for by, goal in (("i", rows), ("j", cols)):
            have = now.groupBy("table_id", by).agg(F.sum("value").alias("have"))
            factor = have.join(goal.withColumnRenamed("value", "goal"), ["table_id", by]).select("table_id", by, F.when(F.col("have") != 0, F.col("goal") / F.col("have")).otherwise(1.0).alias("f"))
            now = now.join(factor, ["table_id", by]).select("table_id", "i", "j", (F.col("value") * F.col("f")).alias("value"))
        if k % 3 == 2:
            now = cut(now)
    return now


def ras_joined(cells: DataFrame, rows: DataFrame, cols: DataFrame, tolerance: float = 1e-9, max_rounds: int = 300) -> tuple[DataFrame, int, bool]:
    """RAS as joins until the rows are met: cells, rounds, and whether every row is within `tolerance` of its target, relatively.

    Columns are met after each round. Rounds are checked three at a time; one figure a check comes to the driver.
    """
    now, done = cut(cells.select("table_id", "i", "j", "value")), 0
    rows, cols = cut(rows), cut(cols)
    while done < max_rounds:
        now, done = cut(ras_rounds(now, rows, cols, 3)), done + 3
        off = now.groupBy("table_id", "i").agg(F.sum("value").alias("have")).join(rows.withColumnRenamed("value", "goal"), ["table_id", "i"])
        worst = off.agg(F.max(F.abs(F.col("have") - F.col("goal")) / F.greatest(F.abs("goal"), F.lit(1.0))).alias("w")).first()["w"]
        if worst is None or worst <= tolerance:
            return now, done, True
    return now, done, False


#: Rows and columns of one table whose components one task works out from a dense grid; larger tables raise.
MOST_LINES = 8_000


def bipartite_components(cells: DataFrame) -> DataFrame:
    """Component of each row and column (side, k, component) in the graph of a table's cells that are not zero."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols = np.sort(pdf["i"].unique()), np.sort(pdf["j"].unique())
        if max(len(rows), len(cols)) > MOST_LINES:
            raise kernels.TableError(f"{len(rows)} by {len(cols)} lines are more than {MOST_LINES}: work out the components by joins")
        t = np.zeros((len(rows), len(cols)))
        t[np.searchsorted(rows, pdf["i"]), np.searchsorted(cols, pdf["j"])] = pdf["value"]
        got = kernels.components(t)
        return pd.DataFrame({"table_id": pdf["table_id"].iloc[0], "side": ["row"] * len(rows) + ["col"] * len(cols), "k": np.r_[rows, cols].astype("int32"), "component": np.array(got, "int32")})

    return cells.groupBy("table_id").applyInPandas(run, "table_id string, side string, k int, component int")
