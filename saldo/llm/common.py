"""Shared pieces: reading tables, checkpoints, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saldo.functions.lineage import cut as checkpointed

#: Rows of one Arrow batch; Spark bounds its bytes besides (spark.sql.execution.arrow.maxBytesPerBatch).
ARROW_ROWS = "1024"

__all__ = ["checkpointed", "connected_components", "slices", "table"]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A driver table, only the named columns. Sets the session's Arrow batches to ARROW_ROWS rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def slices(sizes: list[int], bound: int) -> list[tuple[int, int]]:
    """Consecutive stretches (start, end) of at most `bound` in all, one item at least."""
    out, start, held = [], 0, 0
    for k, n in enumerate(sizes):
        if k > start and held + n > bound:
            out.append((start, k))
            start, held = k, 0
        held += n
    return out + [(start, len(sizes))] if len(sizes) > start else out


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    edges: two long columns a and b, any order, repeats and loops allowed. Returns (node, component).
    Large-star and small-star rounds: each hangs neighbours on the smallest neighbour, until every
    component is a star around its smallest node. Only per-node minima are aggregated (combined before
    the shuffle) and joined back, so a node with very many links never becomes one collected list; AQE
    can split such a key in the joins. Every round is checkpointed. Rounds go on until one changes
    nothing; each that does hangs a node on a smaller one. An empty input gives no rows.
    """
    a, b, u, v, m = (F.col(c) for c in "abuvm")
    now = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(u > v).distinct())
    before = None
    while True:
        both = now.select("u", "v").unionByName(now.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large-star: every larger neighbour hangs on the smallest one
        large = both.where(v > u).join(low, "u").select(v.alias("u"), m.alias("v")).where(u > v).distinct()
        # small-star: every smaller neighbour, and the node itself, hang on the smallest one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(v.alias("u"), m.alias("v")).where(u > v)
        now = checkpointed(small.unionByName(low.select("u", m.alias("v"))).distinct())
        after = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == after:
            break
        before = after
    return now.select(u.alias("node"), v.alias("component")).unionByName(now.select(v.alias("node"), v.alias("component")).distinct())
