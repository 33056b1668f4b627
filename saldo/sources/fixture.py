"""An input-output table, a supply-use table and keys, derived from the star schema.

Sectors are nations: a line item is a sale of the supplier's nation to the customer's. Sales to customers
of the INTERMEDIATE segments are intermediate use, the other segments are final-demand columns. Sectors
without sales are dead: their purchases become a final-demand column of their own, so rows still balance.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saldo.functions.lineage import cut

INTERMEDIATE = ("BUILDING", "MACHINERY")
TABLE_ID = "stars"


@dataclass
class Table:
    """A symmetric table in long form: sector, z (i, j), y (i, c), va (r, j), x (i); all with table_id."""

    sector: DataFrame
    z: DataFrame
    y: DataFrame
    va: DataFrame
    x: DataFrame


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales (i, j, seg, value) by supplying nation, buying nation and market segment."""
    item = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"))
    seller = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("i"))
    # one shuffle of the line items, by order; what follows is at most nations squared times segments a partition
    sold = item.join(seller, F.col("l_suppkey") == F.col("s_suppkey")).join(_buyers(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))
    return sold.groupBy("i", "j", "seg").agg(F.sum("value").alias("value"))


def _buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buying nation and market segment of every order (o_orderkey, j, seg)."""
    order = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    buyer = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("j"), F.col("c_mktsegment").alias("seg"))
    return order.join(buyer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "j", "seg")


def io_table(spark: SparkSession, sf_dir: str) -> Table:
    """The table of live sectors; final-demand columns are the other segments and DEAD.

    The flows, nations squared times segments, are written once, so that the line items are read once for all blocks.
    """
    flow = cut(flows(spark, sf_dir).withColumn("table_id", F.lit(TABLE_ID)))
    x = flow.groupBy("table_id", "i").agg(F.sum("value").alias("value"))
    live = x.select("table_id", F.col("i").alias("j"), F.lit(True).alias("live"))
    marked = flow.join(live, ["table_id", "j"], "left")
    inner = F.col("seg").isin(*INTERMEDIATE)
    z = marked.where(inner & F.col("live")).groupBy("table_id", "i", "j").agg(F.sum("value").alias("value"))
    y = marked.where(~inner | F.col("live").isNull()).groupBy("table_id", "i", F.when(inner, "DEAD").otherwise(F.col("seg")).alias("c")).agg(F.sum("value").alias("value"))
    used = z.groupBy("table_id", "j").agg(F.sum("value").alias("used"))
    va = x.withColumnRenamed("i", "j").join(used, ["table_id", "j"], "left").select("table_id", F.lit(0).alias("r"), "j", (F.col("value") - F.coalesce("used", F.lit(0.0))).alias("value"))
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    sector = x.select("table_id", "i").join(nation, F.col("i") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    sector = sector.select("table_id", F.col("i").alias("idx"), F.col("n_name").alias("code"), F.col("r_name").alias("region"), F.col("n_regionkey").alias("region_id"))
    return Table(sector, z, y, va, x)


@dataclass
class SupplyUse:
    """Rectangular tables in long form: supply v (p, a), use u (p, a), final use y (p, c)."""

    v: DataFrame
    u: DataFrame
    y: DataFrame


def supply_use(spark: SparkSession, sf_dir: str) -> SupplyUse:
    """Products are part types, activities regions: supply by the seller's region, use by the buyer's."""
    item = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"))
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("p"))
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    seller = read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("a"))
    sold = item.join(part, F.col("l_partkey") == F.col("p_partkey")).join(seller, F.col("l_suppkey") == F.col("s_suppkey"))
    sold = sold.join(_buyers(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("p", "a", "j", "seg").agg(F.sum("value").alias("value"))
    region = nation.select(F.col("n_nationkey").alias("j"), F.col("n_regionkey").alias("b"))
    sold = cut(sold.join(region, "j").groupBy("p", "a", "b", "seg").agg(F.sum("value").alias("value")))
    inner = F.col("seg").isin(*INTERMEDIATE)
    return SupplyUse(
        sold.groupBy("p", "a").agg(F.sum("value").alias("value")),
        sold.where(inner).groupBy("p", F.col("b").alias("a")).agg(F.sum("value").alias("value")),
        sold.where(~inner).groupBy("p", F.col("seg").alias("c")).agg(F.sum("value").alias("value")),
    )
