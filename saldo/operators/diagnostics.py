"""Price, volume and credibility diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldo.operators.table import safe_ratio


def six_pack(values: DataFrame) -> DataFrame:
    """Indices from current value a, current value in last year's prices b, and last year's value c: (code, a, b, c)."""
    ratio = lambda p, q: 100 * safe_ratio(F.col(p), F.col(q))
    out = values.select("code", ratio("a", "b").alias("price"), ratio("b", "c").alias("volume"), ratio("a", "c").alias("value_index"))
    return out.withColumn("consistent", F.coalesce(F.abs(F.col("value_index") - F.col("price") * F.col("volume") / 100) < 1e-6, F.lit(False)))


def mad_outliers(ratios: DataFrame, by: list[str], limit: float = 5.0) -> DataFrame:
    """Values further than limit median absolute deviations from their group's median: (…, value) with median, mad, outlier."""
    medians = ratios.groupBy(*by).agg(F.percentile("value", F.lit(0.5)).alias("median"))
    off = ratios.join(medians, by).withColumn("off", F.abs(F.col("value") - F.col("median")))
    mads = off.groupBy(*by).agg(F.percentile("off", F.lit(0.5)).alias("mad"))
    return off.join(mads, by).withColumn("outlier", F.col("off") > limit * F.col("mad")).drop("off")


def volume_coherence(output: DataFrame, inputs: DataFrame, points: float = 5.0) -> DataFrame:
    """Industries whose volume index of output and of inputs differ by more than some points. Frames: (code, volume)."""
    both = output.select("code", F.col("volume").alias("vo")).join(inputs.select("code", F.col("volume").alias("vi")), "code")
    return both.select("code", (F.col("vo") - F.col("vi")).alias("gap"), (F.abs(F.col("vo") - F.col("vi")) > points).alias("flagged"))


def productivity(now: DataFrame, before: DataFrame, most: float = 0.10) -> DataFrame:
    """Growth of output per worker; falls and rises above `most` are flagged. Frames: (code, output, workers)."""
    per = lambda df, name: df.select("code", safe_ratio(F.col("output"), F.col("workers")).alias(name))
    growth = safe_ratio(F.col("new"), F.col("old")) - 1
    return per(now, "new").join(per(before, "old"), "code").select("code", growth.alias("growth"), ((growth < 0) | (growth > most)).alias("flagged"))


def implied_tax(taxes: DataFrame, base: DataFrame, legal: DataFrame) -> DataFrame:
    """Implied rate of a product tax against the legal one. Frames: (code, value)."""
    df = taxes.withColumnRenamed("value", "t").join(base.withColumnRenamed("value", "b"), "code").join(legal.withColumnRenamed("value", "l"), "code")
    rate = safe_ratio(F.col("t"), F.col("b"))
    return df.select("code", rate.alias("rate"), F.col("l").alias("legal"), (rate > F.col("l") + 1e-9).alias("flagged"))


def triage(gaps: DataFrame) -> DataFrame:
    """Discrepancies to settle by rule: small against their scale and no diagnostic fired. gaps: (code, gap, scale, fired)."""
    small = F.abs("gap") <= 1.0 + 1e-3 * F.abs("scale")
    return gaps.select("code", "gap", F.when(small & ~F.col("fired"), "automatic").when(~small, "too large").otherwise("diagnostic fired").alias("verdict"))


def negative_triage(census: DataFrame, legitimate: DataFrame) -> DataFrame:
    """Blocks with negatives: those on the list are legitimate, the others unclassified. legitimate: (block, reason)."""
    found = census.where("negatives > 0").join(legitimate, "block", "left")
    return found.select("block", "negatives", F.coalesce("reason", F.lit("UNCLASSIFIED")).alias("reason"))
