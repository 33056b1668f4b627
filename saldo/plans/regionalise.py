"""A regional table from a national one and an activity file."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saldo.functions.kernels import TableError
from saldo.operators import regional, table
from saldo.sources import files
from saldo.sources.fixture import Table


def run(t: Table, activity: DataFrame, method: str = "FLQ", delta: float | None = None) -> dict[str, DataFrame]:
    """Coefficients, flows, residuals and implicit imports of the region of an activity frame (code, regional, national).

    Output is the region's share in activity times national output, so flows are in the table's unit whatever
    the activity is counted in. A sector without national activity can't have any in the region.
    """
    bad = activity.where("national < 0 OR regional < 0 OR regional > national OR (national = 0 AND regional > 0)").limit(5).collect()
    if bad:
        raise TableError("activity of the region is negative or exceeds the nation's: " + ", ".join(r["code"] for r in bad))
    number = t.sector.select(F.col("idx").alias("i"), "code")
    act = activity.join(number, "code").where("national > 0").select("i", "regional", "national")
    both = act.select(F.lit("region").alias("region"), "i", F.col("regional").alias("value")).unionByName(act.select(F.lit("rest").alias("region"), "i", (F.col("national") - F.col("regional")).alias("value")))
    made = regional.regionalise(table.coefficients(t.z, t.x).where(~F.isnan("value")), both, method, delta).where("region = 'region'")
    output = act.join(t.x.select("i", F.col("value").alias("x")), "i").select(F.lit("region").alias("region"), "i", (F.col("x") * F.col("regional") / F.col("national")).alias("value"))
    flows, residual = regional.regional_table(made, output)
    return {"coefficients": made, "flows": flows, "residuals": residual, "imports": regional.implicit_imports(made, output)}


def run_files(spark: SparkSession, bundle: str, activity: str, out: str, method: str = "FLQ", delta: float | None = None) -> dict[str, DataFrame]:
    """The same from an interchange folder and an activity CSV; writes one CSV folder per result and a note of what was done."""
    t, meta = files.read_bundle(spark, bundle)
    output = t.x.join(t.sector.select(F.col("idx").alias("i"), "code"), "i").select("code", "value")
    got = run(t, files.read_activity(spark, activity, t.sector.select("code"), output), method, delta)
    for name, df in got.items():
        df.coalesce(1).write.mode("overwrite").csv(f"{out}/{name}", header=True)
    caveats = ["quotients above one are cut to one: a region imports what it lacks and exports nothing of it elsewhere", "every cell is proxy_estimated; final demand and value added are single residuals"]
    Path(out, "assumptions.json").write_text(files.to_json({"method": method, "delta": delta, "national": meta, "caveats": caveats}))
    return got
