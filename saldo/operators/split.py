"""Disaggregation of one sector into several, as joins: weights, seed, targets, feasibility, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["table_id"]


def key_weights(keys: DataFrame) -> DataFrame:
    """Shares of each key's values. Keys with a negative value or no positive total are refused: weight null, refused true."""
    own = Window.partitionBy("key_id")
    total, low = F.sum("value").over(own), F.min("value").over(own)
    bad = (low < 0) | (total <= 0)
    return keys.select("key_id", "code", F.when(~bad, F.col("value") / total).alias("weight"), bad.alias("refused"))


def resolve(weights: DataFrame, blocks: list[tuple[str, str | None]], fallback: str) -> DataFrame:
    """Weights of each block: its own key's, else the fallback key's, flagged as inherited. (block, code, weight, inherited)"""
    out = None
    for block, key in blocks:
        one = weights.where(F.col("key_id") == (key or fallback)).select(F.lit(block).alias("block"), "code", "weight", F.lit(key is None).alias("inherited"))
        out = one if out is None else out.unionByName(one)
    return out


def interpolate(series: DataFrame, year: int) -> DataFrame:
    """Shares of (key_id, year, code, value) for one year: exact, else linear between neighbours, else the nearest year."""
    own = Window.partitionBy("key_id", "year")
    share = series.withColumn("share", F.col("value") / F.sum("value").over(own))
    ends = share.groupBy("key_id", "code").agg(
        F.max(F.when(F.col("year") <= year, F.struct("year", "share"))).alias("lo"), F.min(F.when(F.col("year") >= year, F.struct("year", "share"))).alias("hi"),
    )
    t = (F.lit(float(year)) - F.col("lo.year")) / (F.col("hi.year") - F.col("lo.year"))
    value = F.when(F.col("lo").isNull(), F.col("hi.share")).when(F.col("hi").isNull() | (F.col("lo.year") == F.col("hi.year")), F.col("lo.share")).otherwise(F.col("lo.share") + t * (F.col("hi.share") - F.col("lo.share")))
    how = F.when(F.col("lo.year") == F.col("hi.year"), "observed").when(F.col("lo").isNull() | F.col("hi").isNull(), "nearest").otherwise("interpolated")
    return ends.select("key_id", "code", value.alias("share"), how.alias("origin"))


def profile_shares(z: DataFrame, parent: int, w_col: DataFrame, profiles: DataFrame) -> DataFrame:
    """Share of each part b in the parent's purchases from i: weight times intensity m (1 where unnamed), normalised per i.

    w_col: (part, weight); profiles: (i, part, m), m not negative.
    """
    base = z.where(F.col("j") == parent).select(*KEY, "i").join(w_col.select("part", "weight"))
    m = base.join(profiles, ["i", "part"], "left").withColumn("wm", F.col("weight") * F.coalesce("m", F.lit(1.0)))
    return m.select(*KEY, "i", "part", (F.col("wm") / F.sum("wm").over(Window.partitionBy(*KEY, "i"))).alias("share"))


def seed(z: DataFrame, parent: int, w_row: DataFrame, w_col: DataFrame, alpha: float = 1.0, shares: DataFrame | None = None) -> DataFrame:
    """Cells after the split, before balancing; parts take the ids of `part` in the weights.

    Rows go by w_row, columns by w_col (or shares (i, part, share)), and the inner block by both: alpha on its
    diagonal and beta = (1 - alpha d) / (1 - d) off it, d the sum of products of equal parts' weights.
    """
    wr, wc = w_row.select(F.col("part").alias("a"), F.col("weight").alias("wa")), w_col.select(F.col("part").alias("b"), F.col("weight").alias("wb"))
    d = wr.join(wc, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("wa") * F.col("wb")), F.lit(0.0)).alias("d"))
    inner = z.where((F.col("i") == parent) & (F.col("j") == parent)).join(wr).join(wc).join(d)
    beta = F.when(F.abs(1 - F.col("d")) < 1e-12, 1.0).otherwise((1 - alpha * F.col("d")) / (1 - F.col("d")))
    factor = F.when(F.col("a") == F.col("b"), F.lit(alpha)).otherwise(beta)
    inner = inner.select(*KEY, F.col("a").alias("i"), F.col("b").alias("j"), (F.col("value") * F.col("wa") * F.col("wb") * factor).alias("value"), F.lit("inner").alias("block"))
    row = z.where((F.col("i") == parent) & (F.col("j") != parent)).join(wr).select(*KEY, F.col("a").alias("i"), "j", (F.col("value") * F.col("wa")).alias("value"), F.lit("row").alias("block"))
    outer = z.where((F.col("i") != parent) & (F.col("j") == parent))
    if shares is None:
        col = outer.join(wc).select(*KEY, "i", F.col("b").alias("j"), (F.col("value") * F.col("wb")).alias("value"), F.lit("column").alias("block"))
    else:
        col = outer.join(shares, [*KEY, "i"]).select(*KEY, "i", F.col("part").alias("j"), (F.col("value") * F.col("share")).alias("value"), F.lit("column").alias("block"))
    rest = z.where((F.col("i") != parent) & (F.col("j") != parent)).select(*KEY, "i", "j", "value", F.lit("rest").alias("block"))
    return rest.unionByName(row).unionByName(col).unionByName(inner)


def split_margin(cells: DataFrame, at: str, parent: int, weights: DataFrame) -> DataFrame:
    """Final demand, value added or output with the parent's entry divided by weights (part, weight)."""
    parts = cells.where(F.col(at) == parent).join(weights.select("part", "weight"))
    others = [c for c in cells.columns if c not in (at, "value")]
    one = parts.select(*others, F.col("part").alias(at), (F.col("value") * F.col("weight")).alias("value"))
    return cells.where(F.col(at) != parent).select(*others, at, "value").unionByName(one)


def targets(x: DataFrame, y: DataFrame, va: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Row targets (i, value) = output less final demand, column targets (j, value) = output less value added."""
    from saldo.operators.table import col_totals, row_totals

    return row_totals(x, y), col_totals(x, va)


def inner_targets(seeded: DataFrame, rows: DataFrame, cols: DataFrame, parts: list[int]) -> tuple[DataFrame, DataFrame]:
    """What the inner block has to add up to: the parts' targets less their cells outside the block."""
    out = seeded.where(F.col("block") != "inner")
    r = rows.where(F.col("i").isin(*parts)).join(out.groupBy(*KEY, "i").agg(F.sum("value").alias("o")), [*KEY, "i"], "left").select(*KEY, "i", (F.col("value") - F.coalesce("o", F.lit(0.0))).alias("value"))
    c = cols.where(F.col("j").isin(*parts)).join(out.groupBy(*KEY, "j").agg(F.sum("value").alias("o")), [*KEY, "j"], "left").select(*KEY, "j", (F.col("value") - F.coalesce("o", F.lit(0.0))).alias("value"))
    return r, c


def feasibility(r: DataFrame, c: DataFrame, inner_total: Column) -> DataFrame:
    """Targets of a positive inner block must not be negative: smallest target, headroom in % of the block, verdict."""
    both = r.select(*KEY, "value").unionByName(c.select(*KEY, "value")).groupBy(*KEY).agg(F.min("value").alias("smallest"))
    return both.select(*KEY, "smallest", (100 * F.col("smallest") / inner_total).alias("headroom_pct"), (F.col("smallest") >= 0).alias("feasible"))


def provenance(before: DataFrame, after: DataFrame, parts: list[int]) -> DataFrame:
    """Label of each cell: moved by the solver, in a row or column of a part, else observed."""
    joined = after.join(before.select(*KEY, "i", "j", F.col("value").alias("was")), [*KEY, "i", "j"], "left")
    moved = F.abs(F.col("value") - F.coalesce("was", F.lit(0.0))) > 1e-9
    label = F.when(moved, "balanced_adjustment").when(F.col("i").isin(*parts) | F.col("j").isin(*parts), "proxy_estimated").otherwise("observed")
    return joined.select(*KEY, "i", "j", "value", label.alias("prov"))


def corroborate(used: DataFrame, other: DataFrame) -> DataFrame:
    """Relative gap of each code's weight between two keys of the same codes: (implied - measured) / measured."""
    both = used.select("code", F.col("weight").alias("implied")).join(other.select("code", F.col("weight").alias("measured")), "code")
    return both.select("code", ((F.col("implied") - F.col("measured")) / F.col("measured")).alias("gap"))


def profile_shift(z: DataFrame, parent: int, w_col: DataFrame, profiles: DataFrame) -> DataFrame:
    """How far a profile moves each part's purchases from the level its weight gives, against the parent's own block.

    Rows (part, shift, share_of_inner, neutral); suppliers other than the parent itself count. share_of_inner is
    null where the parent buys nothing from itself.
    """
    outer = z.where((F.col("j") == parent) & (F.col("i") != parent))
    bought = profile_shares(outer, parent, w_col, profiles).join(outer.select(*KEY, "i", "value"), [*KEY, "i"])
    got = bought.groupBy(*KEY, "part").agg(F.sum(F.col("share") * F.col("value")).alias("got"))
    all_ = outer.groupBy(*KEY).agg(F.sum("value").alias("all")).join(z.where((F.col("j") == parent) & (F.col("i") == parent)).select(*KEY, F.abs("value").alias("inner")), KEY, "left")
    both = got.join(all_, KEY).join(w_col.select("part", "weight"), "part")
    shift = F.col("got") - F.col("weight") * F.col("all")
    return both.select(*KEY, "part", shift.alias("shift"), F.when(F.col("inner") > 1e-12, F.abs(shift) / F.col("inner")).alias("share_of_inner"), (F.abs(shift) <= 1e-6 * F.greatest(F.abs("all"), F.lit(1.0))).alias("neutral"))


def neutral_profile(z: DataFrame, parent: int, w_col: DataFrame, profiles: DataFrame, max_iter: int = 2000, tol: float = 1e-12) -> DataFrame:
    """Profiles (i, part, m) scaled, part by part, so that no part's purchases leave the level of its weight.

    A part's named intensities keep their ratios; suppliers it doesn't name stay at 1. One part's scales are a
    fixed point of square-root steps over the parent's column, which one task holds. Refuses what doesn't settle.
    """
    import numpy as np
    import pandas as pd

    from saldo.functions.kernels import NotConverged

    column = z.where((F.col("j") == parent) & (F.col("i") != parent)).select(*KEY, "i", F.col("value").alias("v"))
    rows = column.join(w_col.select("part", "weight")).join(profiles, ["i", "part"], "left")  # suppliers times parts

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = lambda c: pdf.pivot_table(index="i", columns="part", values=c, aggfunc="first", dropna=False)
        m = grid("m")
        named, m0 = m.notna().to_numpy(), m.fillna(1.0).to_numpy(float)
        v, w = pdf.groupby("i")["v"].first().to_numpy(float), pdf.groupby("part")["weight"].first().to_numpy(float)
        goal, scale, moves = w * v.sum(), np.ones(len(w)), named.any(0)
        for _ in range(max_iter):
            wm = w * np.where(named, m0 * scale, 1.0)
            got = v @ (wm / wm.sum(1, keepdims=True))
            if np.abs(got - goal).max(initial=0) < tol * max(abs(v.sum()), 1.0):
                break
            fix = moves & (got > 1e-12)
            scale[fix] *= np.sqrt(goal[fix] / got[fix])
        else:
            raise NotConverged(f"the profile of {parent} can't be made neutral: purchases are off by {np.abs(got - goal).max():g}")
        at = np.argwhere(named)
        return pd.DataFrame({"table_id": pdf["table_id"].iloc[0], "i": m.index.to_numpy()[at[:, 0]], "part": m.columns.to_numpy()[at[:, 1]], "m": (m0 * scale)[named]})

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return rows.groupBy(*KEY).applyInPandas(run, f"table_id string, i {kind(z, 'i')}, part {kind(w_col, 'part')}, m double")


def split_satellite(values: DataFrame, parent: int, weights: DataFrame) -> DataFrame:
    """A satellite (i, value, origin) divided as output is: the parts share the parent's intensity and are marked estimated."""
    made = split_margin(values.select("i", "origin", "value"), "i", parent, weights)
    part = weights.select(F.col("part").alias("i"), F.lit(True).alias("new"))
    return made.join(part, "i", "left").select("i", "value", F.when(F.col("new"), "estimated").otherwise(F.col("origin")).alias("origin"))
