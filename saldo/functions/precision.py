"""Tolerances that follow from the decimals a source prints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_DECIMALS = 6
LEVEL_SHARE = 0.05
EPSILON = 2.220446049250313e-16


def decimals_needed(v: Column) -> Column:
    """Fewest decimals, up to six, that print the value; null where more are needed."""
    out = F.lit(None).cast("int")
    for d in range(MOST_DECIMALS, -1, -1):
        out = F.when(F.abs(v - F.round(v, d)) < 1e-7 * F.greatest(F.lit(1.0), F.abs(v)), d).otherwise(out)
    return out


def printed_decimals(values: DataFrame, by: list[str], value: str = "value", share: float = LEVEL_SHARE) -> DataFrame:
    """Decimals of each group's source: the most that at least `share` of its values use; null where it isn't rounded.

    Zeros and values that are not finite say nothing and are left out.
    """
    v = F.col(value)
    some = values.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")) & (v != 0)).select(*by, decimals_needed(v).alias("d"))
    levels = some.groupBy(*by, "d").agg(F.count(F.lit(1)).alias("n"))
    totals = levels.groupBy(*by).agg(F.sum("n").alias("_all"), F.sum(F.when(F.col("d").isNull(), F.col("n")).otherwise(0)).alias("_more")) if by else levels.agg(F.sum("n").alias("_all"), F.sum(F.when(F.col("d").isNull(), F.col("n")).otherwise(0)).alias("_more"))
    joined = levels.join(totals, by) if by else levels.crossJoin(totals)  # one row of totals
    used = F.max(F.when(F.col("n") >= share * F.col("_all"), F.col("d")))
    return joined.groupBy(*by, "_all", "_more").agg(used.alias("d")).select(*by, F.when(F.col("_more") < share * F.col("_all"), F.col("d")).alias("decimals"))


def tolerance(decimals: Column, terms: Column, magnitude: Column) -> Column:
    """What a sum of so many printed terms may be off by: half a unit of the last decimal each, else rounding noise."""
    noise = F.greatest(terms * EPSILON * magnitude, F.lit(1e-300))
    return F.when(decimals.isNotNull(), 0.5 * F.pow(F.lit(10.0), -decimals) * terms).otherwise(noise)


def tolerance_floor(values: DataFrame, by: list[str], terms: int, value: str = "value") -> DataFrame:
    """The tolerance of each group's sums of `terms` values."""
    sizes = values.groupBy(*by).agg(F.sum(F.abs(value)).alias("mass"))
    return printed_decimals(values, by, value).join(sizes, by).select(*by, "decimals", tolerance(F.col("decimals"), F.lit(float(terms)), F.col("mass")).alias("tolerance"))


def close(a: Column, b: Column, absolute: float = 1e-6, relative: float = 1e-9) -> Column:
    return F.abs(a - b) <= absolute + relative * F.greatest(F.abs(a), F.abs(b))


def negative_census(cells: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Count, share, smallest and sum of the negative values of each block."""
    neg = F.col(value) < 0
    return cells.groupBy(*by).agg(
        F.sum(neg.cast("long")).alias("negatives"), F.avg(neg.cast("double")).alias("share"), F.least(F.min(value), F.lit(0.0)).alias("smallest"), F.sum(F.when(neg, F.col(value)).otherwise(0.0)).alias("mass"),
    )


#: Slack over what inconsistent margins force, a fixed value; and the flat tolerances of a solver.
FLOOR_SLACK = 10.0
FLAT, RELATIVE = 1e-6, 1e-9


def mixed_floor(values: DataFrame, terms: DataFrame, value: str = "value") -> DataFrame:
    """Tolerance of an identity over populations that are not printed alike: the sum of their own floors.

    values: (population, value); terms: (population, terms). One row: populations, tolerance.
    """
    sizes = values.groupBy("population").agg(F.sum(F.abs(value)).alias("mass"))
    own = printed_decimals(values, ["population"], value).join(sizes, "population").join(terms, "population")
    floor = tolerance(F.col("decimals"), F.col("terms").cast("double"), F.col("mass"))
    return own.agg(F.count(F.lit(1)).alias("populations"), F.sum(floor).alias("tolerance"))


def margin_floors(rows: DataFrame, cols: DataFrame) -> DataFrame:
    """What a solver can be held to for row targets (i, value) and column targets (j, value). One row.

    gap is the difference of their sums, which no table can meet; floor the larger of |gap| / (m + n) and the
    targets' own rounding; tolerance is flat unless |gap| / (m + n) exceeds that, then FLOOR_SLACK floors.
    """
    both = rows.select(F.lit(1).alias("s"), "value").unionByName(cols.select(F.lit(-1).alias("s"), "value"))
    side = lambda s: F.sum(F.when(F.col("s") == s, 1).otherwise(0))
    size = both.agg(F.sum(F.col("s") * F.col("value")).alias("gap"), side(1).alias("m"), side(-1).alias("n"), F.sum(F.abs("value")).alias("mass"), F.max(F.abs("value")).alias("top"))
    one = size.join(printed_decimals(both, []), how="left")  # one row each
    forced = F.abs("gap") / (F.col("m") + F.col("n"))
    flat = FLAT + RELATIVE * F.col("top")
    floor = F.greatest(forced, tolerance(F.col("decimals"), F.greatest("m", "n").cast("double"), F.col("mass")))
    return one.select("gap", floor.alias("floor"), F.when(forced <= flat, flat).otherwise(F.greatest(flat, FLOOR_SLACK * floor)).alias("tolerance"))
