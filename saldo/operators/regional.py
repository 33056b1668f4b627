"""Regional tables from national ones by location quotients."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METHODS = ("SLQ", "CILQ", "RLQ", "FLQ")


def location_quotients(activity: DataFrame) -> DataFrame:
    """SLQ of each (region, i) from activity (region, i, value): its share in the region over its share in the nation."""
    total = activity.groupBy("i").agg(F.sum("value").alias("ni"))
    region = activity.groupBy("region").agg(F.sum("value").alias("r"))
    nation = activity.agg(F.sum("value").alias("n"))
    out = activity.groupBy("region", "i").agg(F.sum("value").alias("value")).join(total, "i").join(region, "region").join(nation)  # nation: one row
    return out.select("region", "i", ((F.col("value") / F.col("r")) / (F.col("ni") / F.col("n"))).alias("slq"), (F.col("r") / F.col("n")).alias("size"))


def regionalise(a: DataFrame, activity: DataFrame, method: str, delta: float | None = None) -> DataFrame:
    """Regional coefficients (region, i, j, national, value) of national ones a (i, j, value).

    SLQ takes the seller's quotient, CILQ the seller's over the buyer's, RLQ the seller's over log2(1 + the
    buyer's), FLQ the CILQ times [log2(1 + size)] ** delta; none above one. FLQ has no default delta.
    """
    if method not in METHODS:
        raise ValueError(f"no method {method!r}")
    if method == "FLQ" and (delta is None or not 0 <= delta < 1):
        raise ValueError("FLQ needs a delta of at least 0 and below 1")
    lq = location_quotients(activity)
    si = lq.select("region", "i", F.col("slq").alias("si"), "size")
    sj = lq.select("region", F.col("i").alias("j"), F.col("slq").alias("sj"))
    cells = a.select("i", "j", F.col("value").alias("national")).join(si, "i").join(sj, ["region", "j"])
    lam = F.pow(F.log2(1 + F.col("size")), F.lit(float(delta or 0.0))) if method == "FLQ" else F.lit(1.0)
    cross = {"SLQ": F.col("si"), "CILQ": F.col("si") / F.col("sj"), "FLQ": F.col("si") / F.col("sj") * lam, "RLQ": F.col("si") / F.log2(1 + F.col("sj"))}[method]
    q = F.least(F.lit(1.0), F.when(F.col("i") == F.col("j"), F.col("si") * lam).otherwise(cross))
    return cells.select("region", "i", "j", "national", (F.col("national") * q).alias("value"))


def implicit_imports(regional: DataFrame, output: DataFrame) -> DataFrame:
    """What each region has to import of product i: (national - regional coefficient) times output. output: (region, i, value)."""
    x = output.select("region", F.col("i").alias("j"), F.col("value").alias("x"))
    return regional.join(x, ["region", "j"]).groupBy("region", "i").agg(F.sum((F.col("national") - F.col("value")) * F.col("x")).alias("imports"))


def regional_satellite(values: DataFrame, national: DataFrame, regional: DataFrame) -> DataFrame:
    """A national satellite (i, value) scaled by each region's share in output; nothing where the nation makes nothing."""
    out = regional.withColumnRenamed("value", "xr").join(national.withColumnRenamed("value", "xn"), "i").join(values, "i")
    return out.select("region", "i", F.when(F.col("xn") == 0, 0.0).otherwise(F.col("value") * F.col("xr") / F.col("xn")).alias("value"), F.lit("estimated").alias("origin"))


def regional_table(regional: DataFrame, output: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flows (region, i, j, value) of a region, and residuals (region, i, final, added) that close its rows and columns."""
    x = output.select("region", F.col("i").alias("j"), F.col("value").alias("x"))
    z = regional.join(x, ["region", "j"]).select("region", "i", "j", (F.col("value") * F.col("x")).alias("value"))
    rows = z.groupBy("region", "i").agg(F.sum("value").alias("sold"))
    cols = z.groupBy("region", F.col("j").alias("i")).agg(F.sum("value").alias("bought"))
    out = output.join(rows, ["region", "i"], "left").join(cols, ["region", "i"], "left")
    return z, out.select("region", "i", (F.col("value") - F.coalesce("sold", F.lit(0.0))).alias("final"), (F.col("value") - F.coalesce("bought", F.lit(0.0))).alias("added"))


def employment(cells: DataFrame, recode: DataFrame, redrawn: list[str] | None = None, total: str = "TOTAL", tolerance: float = 0.5) -> DataFrame:
    """Employed persons by region and the table's codes, beside what the source states as the region's total.

    cells: (region, code, value), code `total` being the stated sum; recode: (code, to). Regions that were redrawn
    are refused (value null). Rows (region, code, value, stated, adds_up); each published figure may be off by
    `tolerance`. Codes without a place in the table are left out and so keep a region from adding up.
    """
    bad = F.col("region").isin(redrawn or []) if redrawn else F.lit(False)
    parts = cells.where(F.col("code") != total).join(recode, "code").groupBy("region", F.col("to").alias("code")).agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"))
    sums = parts.groupBy("region").agg(F.sum("value").alias("made"), F.sum("n").alias("terms"))
    stated = cells.where(F.col("code") == total).groupBy("region").agg(F.sum("value").alias("stated"))
    out = parts.join(sums, "region").join(stated, "region", "left")
    adds = F.coalesce(F.abs(F.col("made") - F.col("stated")) <= tolerance * (F.col("terms") + 1), F.lit(False)) & ~bad
    return out.select("region", "code", F.when(~bad, F.col("value")).alias("value"), "stated", adds.alias("adds_up"))
