"""JSON-stat 2.0 cubes as DataFrames."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saldo.functions.kernels import TableError

SCHEMA = "version string, class string, label string, id array<string>, size array<int>, dimension map<string,struct<label:string,category:struct<index:string,label:map<string,string>>>>, value string"


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    """(dims map<string,string>, value double) of the cubes below path; absent cells have no row.

    The value and category index may be lists or maps. Anything that isn't a JSON-stat dataset is refused by name.
    """
    text = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_name"))
    doc = text.select("file", F.from_json("value", SCHEMA, {"primitivesAsString": "false"}).alias("d"))
    bad = [r["file"] for r in doc.where("d.id IS NULL OR d.size IS NULL OR d.value IS NULL OR size(d.id) <> size(d.size)").select("file").limit(5).collect()]
    if bad:
        raise TableError(f"not a JSON-stat dataset: {', '.join(bad)}")
    as_map = lambda c: F.when(c.startswith("["), F.map_from_entries(F.transform(F.from_json(c, "array<string>"), lambda v, i: F.struct(i.cast("string").alias("key"), v.alias("value"))))).otherwise(F.from_json(c, "map<string,string>"))
    cells = doc.select("d", F.explode(as_map(F.col("d.value"))).alias("pos", "v")).where(F.col("v").isNotNull()).withColumn("p", F.col("pos").cast("long"))
    # row-major: the last dimension runs fastest
    after = lambda k: F.aggregate(F.slice(F.col("d.size"), k + 2, F.size("d.size")), F.lit(1).cast("long"), lambda a, s: a * s)
    spot = lambda k: F.floor(F.col("p") / after(k)) % F.element_at("d.size", k + 1)

    def code(dim, k):
        category = F.element_at(F.col("d.dimension"), dim)["category"]
        index = category["index"]
        listed = F.element_at(F.from_json(index, "array<string>"), (spot(k) + 1).cast("int"))
        mapped = F.filter(F.map_entries(F.from_json(index, "map<string,string>")), lambda e: e["value"].cast("long") == spot(k))
        single = F.element_at(F.map_keys(category["label"]), 1)
        return F.when(index.isNull(), single).when(index.startswith("["), listed).otherwise(F.get(F.transform(mapped, lambda e: e["key"]), 0))

    dims = F.map_from_entries(F.transform("d.id", lambda dim, k: F.struct(dim.alias("key"), code(dim, k).alias("value"))))
    return cells.select(dims.alias("dims"), F.col("v").cast("double").alias("value"))


def pin(cube: DataFrame, fixed: dict[str, str], keep: list[str]) -> DataFrame:
    """Cells of the fixed categories with the kept dimensions as columns; a further dimension with more than one category is refused."""
    for k, c in fixed.items():
        cube = cube.where(F.col("dims")[k] == c)
    rest = cube.select(F.explode("dims").alias("k", "c")).where(~F.col("k").isin(*fixed, *keep)).groupBy("k").agg(F.countDistinct("c").alias("n")).where("n > 1").limit(5).collect()
    if rest:
        raise TableError("more than one category of " + ", ".join(sorted(r["k"] for r in rest)))
    return cube.select(*[F.col("dims")[k].alias(k) for k in keep], "value")


def write_cube(path: str, dims: dict[str, list[str]], values: dict[tuple[str, ...], float], label: str = "") -> None:
    """A small cube as a JSON-stat file on the driver, for fixtures and exports."""
    strides, n = {}, 1
    for k in reversed(dims):
        strides[k], n = n, n * len(dims[k])
    value = {str(sum(strides[k] * dims[k].index(c) for k, c in zip(dims, key))): v for key, v in values.items()}
    body = {"version": "2.0", "class": "dataset", "label": label, "id": list(dims), "size": [len(c) for c in dims.values()], "value": value,
            "dimension": {k: {"label": k, "category": {"index": {c: i for i, c in enumerate(cs)}, "label": {c: c for c in cs}}} for k, cs in dims.items()}}
    with open(path, "w") as f:
        json.dump(body, f)
