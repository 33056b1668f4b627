"""Figures that reports give beside the tables: parts, vintages, landings, spreads, ranks, verdicts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from saldo.operators.table import KEY, safe_ratio


def subsector_table(z: DataFrame, y: DataFrame, va: DataFrame, x: DataFrame, multipliers: DataFrame, parts: DataFrame) -> DataFrame:
    """Output, intermediate sales, final demand, value added, purchases and multiplier of the sectors in parts (i)."""
    total = lambda df, at, name: df.groupBy(*KEY, F.col(at).alias("i")).agg(F.sum("value").alias(name))
    out = x.withColumnRenamed("value", "output").join(parts.select("i"), "i", "left_semi")
    for part in (total(z, "i", "sales"), total(y, "i", "final"), total(va, "j", "added"), total(z, "j", "purchases"), multipliers.select(*KEY, F.col("j").alias("i"), "multiplier")):
        out = out.join(part, [*KEY, "i"], "left")
    return out.select("i", "output", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("sales", "final", "added", "purchases")], "multiplier")


def size_per_percent(parts: DataFrame) -> DataFrame:
    """What one percent of error in the key moves: a hundredth of output, value added and purchases, and no multiplier."""
    return parts.select("i", *[(F.col(c) / 100).alias(c) for c in ("output", "added", "purchases")])


def vintage_gaps(used: DataFrame, keys: DataFrame, table_year: int) -> DataFrame:
    """Years between each block's key and the table. used: (block, key_id, inherited); keys: (key_id, source_year, strength)."""
    gap = F.col("source_year") - F.lit(table_year)
    return used.join(keys, "key_id", "left").select(
        "block", "key_id", F.when(F.col("inherited"), "inherited").otherwise("chosen").alias("origin"), F.coalesce("strength", F.lit("unstated")).alias("strength"), gap.cast("long").alias("gap"),
        F.when(gap.isNull(), "unknown").when(gap == 0, "same year").otherwise("other year").alias("verdict"),
    )


def type_ii_uplift(first: DataFrame, second: DataFrame) -> DataFrame:
    """Type I and type II multipliers side by side, and what households add. Frames: (table_id, j, multiplier)."""
    both = first.select(*KEY, "j", F.col("multiplier").alias("type_i")).join(second.select(*KEY, "j", F.col("multiplier").alias("type_ii")), [*KEY, "j"])
    return both.select("j", "type_i", "type_ii", (safe_ratio(F.col("type_ii"), F.col("type_i")) - 1).alias("uplift"))


def indirect_share(effects: DataFrame) -> DataFrame:
    """Share of a satellite's total effect that arises in other sectors' production: 1 - direct / total."""
    return effects.select("j", (1 - safe_ratio(F.col("direct"), F.col("total"), 1e-300)).alias("indirect"))


def landings(inverse: DataFrame, blocks: DataFrame, intensity: DataFrame | None = None) -> DataFrame:
    """Share of what one unit of demand for j sets off that arises in each block; in jobs, with an intensity (i, c).

    blocks: (idx, block). Every sector and block has a row.
    """
    cells = inverse.join(blocks.select(F.col("idx").alias("i"), "block"), "i")
    cells = cells.join(intensity.select("i", "c"), "i").withColumn("value", F.col("value") * F.col("c")) if intensity is not None else cells
    made = cells.groupBy(*KEY, "j", "block").agg(F.sum("value").alias("v"))
    return made.select("j", "block", safe_ratio(F.col("v"), F.sum("v").over(Window.partitionBy(*KEY, "j")), 1e-300).alias("share"))


def top_receivers(inverse: DataFrame, sector: DataFrame, k: int = 5) -> DataFrame:
    """The k regions where most of a region's spillover arises, with their shares of all that leaves it."""
    at = sector.select(*KEY, "idx", "region_id")
    cells = inverse.join(at.select(*KEY, F.col("idx").alias("i"), F.col("region_id").alias("to")), [*KEY, "i"]).join(at.select(*KEY, F.col("idx").alias("j"), F.col("region_id").alias("origin")), [*KEY, "j"])
    left = cells.where((F.col("to") != F.col("origin")) & (F.col("value") > 0)).groupBy("origin", "to").agg(F.sum("value").alias("v"))
    own = Window.partitionBy("origin")
    ranked = left.withColumn("share", F.col("v") / F.sum("v").over(own)).withColumn("rank", F.row_number().over(own.orderBy(F.desc("v"), "to")))
    return ranked.where(F.col("rank") <= k).select("origin", "to", "share", "rank")


def evidence_spread(gaps: DataFrame) -> DataFrame:
    """Per scenario: the keys that agree best and worst with what it used, and how many there are. gaps: (scenario, key_id, gap)."""
    worst = gaps.groupBy("scenario", "key_id").agg(F.max(F.abs("gap")).alias("gap"))
    order = F.struct("gap", "key_id")
    ends = worst.groupBy("scenario").agg(F.min(order).alias("lo"), F.max(order).alias("hi"), F.count(F.lit(1)).alias("keys"))
    return ends.select("scenario", F.col("lo.key_id").alias("best"), F.col("lo.gap").alias("least"), F.col("hi.key_id").alias("worst"), F.col("hi.gap").alias("most"), "keys")


#: Median and worst multiplier errors of back-tested splits, by number of parts. Fixed values, in percent.
BANDS = {"two": (5.4, 41.6), "more": (10.6, 49.2)}


def risk_band(splits: DataFrame) -> DataFrame:
    """Error band of a split from its number of parts, the only thing known before it that predicts it. splits: (code, part)."""
    n = splits.groupBy("code").agg(F.countDistinct("part").alias("parts"))
    few = F.col("parts") <= 2
    return n.select("code", "parts", *[F.when(few, BANDS["two"][k]).otherwise(BANDS["more"][k]).alias(c) for k, c in enumerate(("median_pct", "worst_pct"))])


def load_verdicts(wanted: DataFrame, recorded: DataFrame) -> DataFrame:
    """The recorded verdict on loading each geography by each route; never tried where there is none."""
    return wanted.join(recorded, ["geo", "route"], "left").select("geo", "route", F.coalesce("verdict", F.lit("never tried")).alias("verdict"))


def tiling_verdict(parts: Column, total: Column, tolerance: Column) -> Column:
    """Why parts don't make a total: levels mixed (over by a factor), incomplete (short), or components that disagree."""
    ratio = parts / total
    return F.when(F.abs(parts - total) <= tolerance, "adds up").when(ratio > 1.05, "mixes levels").when(ratio < 0.999, "incomplete").otherwise("components disagree")


def flip_allowed(cells: DataFrame, label: str, flippable: DataFrame) -> DataFrame:
    """cells with `may_flip`: whether the label is listed as one that may change its sign. flippable: (label)."""
    listed = flippable.select(F.col("label").alias(label), F.lit(True).alias("_listed")).distinct()
    return cells.join(F.broadcast(listed), label, "left").withColumn("may_flip", F.coalesce("_listed", F.lit(False))).drop("_listed")  # a list written by hand


def truncated(first: Column, ratio: Column, order: int) -> Column:
    """The first `order` terms of a geometric series."""
    return sum((first * F.pow(ratio, F.lit(float(k))) for k in range(1, order)), first)


def rank_agreement(values: DataFrame, by: list[str]) -> DataFrame:
    """Spearman correlation of the ranks of columns a and b, and the first rank they give to different rows (0: none).

    Ranks are ordinal; ties are broken by the columns `by`. Rows are a table's cells: one task ranks them.
    """
    ranked = values.select(F.row_number().over(Window.orderBy("a", *by)).alias("ra"), F.row_number().over(Window.orderBy("b", *by)).alias("rb"), F.row_number().over(Window.orderBy(F.desc("a"), *by)).alias("da"), F.row_number().over(Window.orderBy(F.desc("b"), *by)).alias("db"))
    return ranked.agg(F.corr("ra", "rb").alias("spearman"), F.coalesce(F.min(F.when(F.col("da") != F.col("db"), F.least("da", "db"))), F.lit(0)).cast("long").alias("first_disagreement"))


def sibling_blocks(z: DataFrame, x: DataFrame, sector: DataFrame) -> DataFrame:
    """alpha and beta of pairs of sectors of one region, as if each pair were a split sector.

    alpha is the pair's own-use over what weights by output predict, beta the same off the diagonal. Pairs that
    trade nothing or have no output are left out.
    """
    at = sector.select(*KEY, F.col("idx").alias("i"), "region_id").join(x.withColumnRenamed("value", "x"), [*KEY, "i"])
    a, b = (at.select(*KEY, "region_id", F.col("i").alias(p), F.col("x").alias(f"x{p}")) for p in "pq")
    pairs = a.join(b, [*KEY, "region_id"]).where("p < q AND xp > 0 AND xq > 0")
    # a pair's four cells by equi-joins: own cells by sector, the others by both
    own = z.where("i = j").select(*KEY, F.col("i").alias("s"), F.col("value").alias("v"))
    for p in "pq":
        pairs = pairs.join(own.select(*KEY, F.col("s").alias(p), F.col("v").alias(f"own_{p}")), [*KEY, p], "left")
    for p, q, name in (("p", "q", "pq"), ("q", "p", "qp")):
        pairs = pairs.join(z.select(*KEY, F.col("i").alias(p), F.col("j").alias(q), F.col("value").alias(name)), [*KEY, p, q], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    inside, across = zero("own_p") + zero("own_q"), zero("pq") + zero("qp")
    share = F.col("xp") / (F.col("xp") + F.col("xq"))
    d = share * share + (1 - share) * (1 - share)
    all_ = inside + across
    return pairs.withColumn("all", all_).where("all > 0").select("p", "q", (inside / (d * F.col("all"))).alias("alpha"), (across / ((1 - d) * F.col("all"))).alias("beta"))


def rounding_probe(spark, matrix: np.ndarray, half_unit: float, trials: int, seed: int = 0) -> DataFrame:
    """Half the range of each cell of the inverse of market shares, over tables drawn within the rounding of a printed one.

    matrix: supply, industries by products, square and small. Trials are spread over tasks, each of which keeps
    its least and largest inverse. Rows (i, j, half_width).
    """
    matrix = np.asarray(matrix, float)
    n = len(matrix)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low = high = None
        for pdf in batches:
            for t in pdf["id"]:
                v = matrix + np.random.default_rng((seed, int(t))).uniform(-half_unit, half_unit, matrix.shape)
                made = np.linalg.inv(v / v.sum(0))
                low, high = (made, made) if low is None else (np.minimum(low, made), np.maximum(high, made))
        if low is not None:
            at = np.indices((n, n)).reshape(2, -1)
            yield pd.DataFrame({"i": at[0], "j": at[1], "low": low.ravel(), "high": high.ravel()})

    some = spark.range(trials).mapInPandas(run, "i int, j int, low double, high double")
    return some.groupBy("i", "j").agg(((F.max("high") - F.min("low")) / 2).alias("half_width"))
