"""What cubes hold, and what to do to get a code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saldo.functions import codes
from saldo.sources.cubes import pin, read_cube


def scan(spark: SparkSession, path: str, dimension: str, time: str = "time", geo: str = "geo") -> DataFrame:
    """One row per cube file: codes of a dimension that have values, years and places, newest first."""
    cube = read_cube(spark, path)
    live = cube.agg(F.array_sort(F.collect_set(F.col("dims")[dimension])).alias("codes"), F.max(F.col("dims")[time]).alias("last_year"), F.array_sort(F.collect_set(F.col("dims")[time])).alias("years"), F.array_sort(F.collect_set(F.col("dims")[geo])).alias("geos"))
    return live.select(F.lit(path).alias("id"), "*").orderBy(F.desc("last_year"), "id")


def years(spark: SparkSession, path: str, time: str = "time") -> list[str]:
    """Years with at least one value, in order."""
    return [r["y"] for r in read_cube(spark, path).select(F.col("dims")[time].alias("y")).distinct().orderBy("y").collect()]


def proxy_values(spark: SparkSession, path: str, geo: str, year: str | None = None, dimension: str = "nace") -> DataFrame:
    """(code, value) for one place and year (the latest by default); a further open dimension is refused."""
    cube = read_cube(spark, path).where(F.col("dims")["geo"] == geo)
    year = year or cube.agg(F.max(F.col("dims")["time"]).alias("y")).first()["y"]
    return pin(cube, {"geo": geo, "time": year}, [dimension]).withColumnRenamed(dimension, "code")


def advise(spark: SparkSession, target: str, paths: list[str], dimension: str = "nace") -> dict:
    """Verdict over cubes: load, ask the publisher, split the finest holder, or nothing."""
    rows = [scan(spark, p, dimension).first() for p in paths]
    return codes.advise(target, [{"id": r["id"], "codes": r["codes"], "geos": r["geos"]} for r in rows])
