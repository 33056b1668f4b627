"""Registered queries and their DuckDB oracles.

Every query runs over the whole star schema through the operators; the SQL states the same result on its
own. Figures that are sums of prices are rounded to the four decimals they exactly have, ratios to nine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saldo.functions import codes, precision
from saldo.operators import balance, diagnostics, identities, regional, split, sut, table
from saldo.sources import fixture
from saldo.streaming import flows as stream

QUERIES: dict = {}
ORACLE_SQL: dict = {}

PARENT, PARTS = 7, (100, 101, 102, 103, 104)

FLOW = """
flow AS (SELECT s_nationkey AS i, c_nationkey AS j, c_mktsegment AS seg, sum(l_extendedprice * (1 - l_discount)) AS v
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
x AS (SELECT i, sum(v) AS v FROM flow GROUP BY i),
z AS (SELECT i, j, sum(v) AS v FROM flow WHERE seg IN ('BUILDING', 'MACHINERY') AND j IN (SELECT i FROM x) GROUP BY i, j),
y AS (SELECT i, CASE WHEN seg IN ('BUILDING', 'MACHINERY') THEN 'DEAD' ELSE seg END AS c, sum(v) AS v
  FROM flow WHERE NOT (seg IN ('BUILDING', 'MACHINERY') AND j IN (SELECT i FROM x)) GROUP BY 1, 2),
zc AS (SELECT j, sum(v) AS v FROM z GROUP BY j),
va AS (SELECT x.i AS j, x.v - coalesce(zc.v, 0) AS v FROM x LEFT JOIN zc ON zc.j = x.i),
a AS (SELECT z.i, z.j, z.v / x.v AS v FROM z JOIN x ON x.i = z.j),
sector AS (SELECT x.i AS idx, n_name AS code, n_regionkey AS region_id FROM x JOIN nation ON n_nationkey = x.i)"""
SUT = """
sold AS (SELECT p_type AS p, sn.n_regionkey AS a, cn.n_regionkey AS b, c_mktsegment AS seg, sum(l_extendedprice * (1 - l_discount)) AS v
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey GROUP BY 1, 2, 3, 4),
sv AS (SELECT p, a, sum(v) AS v FROM sold GROUP BY 1, 2),
su AS (SELECT p, b AS a, sum(v) AS v FROM sold WHERE seg IN ('BUILDING', 'MACHINERY') GROUP BY 1, 2),
sy AS (SELECT p, seg AS c, sum(v) AS v FROM sold WHERE seg NOT IN ('BUILDING', 'MACHINERY') GROUP BY 1, 2)"""
#: Inverse of I - A as a power series; its spectral radius on these tables is below 0.5.
INVERSE = """
s(k, i, j, v) AS (SELECT 0, x.i, x.i, 1.0::DOUBLE FROM x UNION ALL SELECT * FROM (SELECT s.k + 1, s.i, a.j, sum(s.v * a.v) FROM s JOIN a ON a.i = s.j WHERE s.k < 70 GROUP BY 1, 2, 3)),
l AS (SELECT i, j, sum(v) AS v FROM s GROUP BY 1, 2)"""
WEIGHTS = """
ks AS (SELECT o_orderpriority AS code, count(*) AS v FROM orders GROUP BY 1),
w AS (SELECT 99 + row_number() OVER (ORDER BY code) AS part, v / sum(v) OVER () AS w FROM ks)"""
ACTIVITY = "act AS (SELECT n_regionkey AS r, o_orderpriority AS i, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return keep


def r4(c):
    return F.round(c, 4)


def r9(c):
    return F.round(c, 9)


def v(c, digits=4, name="value"):
    return F.round(F.col(c), digits).alias(name)


def io(spark, sf_dir):
    return fixture.io_table(spark, sf_dir)


# --- the table and its totals -------------------------------------------------


@query(f"WITH {FLOW} SELECT i, j, round(v, 4) AS value FROM z")
def io_z_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io(spark, sf_dir).z.select("i", "j", v("value"))


@query(f"WITH {FLOW} SELECT i, c, round(v, 4) AS value FROM y")
def io_y_matrix(spark, sf_dir):
    return io(spark, sf_dir).y.select("i", "c", v("value"))


@query(f"WITH {FLOW} SELECT j, round(v, 4) AS value FROM va")
def io_va_residual(spark, sf_dir):
    return io(spark, sf_dir).va.select("j", v("value"))


@query(f"WITH {FLOW} SELECT i, round(v, 4) AS value FROM x")
def io_output(spark, sf_dir):
    return io(spark, sf_dir).x.select("i", v("value"))


@query(f"""WITH {FLOW} SELECT x.i, abs(x.v - coalesce((SELECT sum(v) FROM z WHERE z.i = x.i), 0) - coalesce((SELECT sum(v) FROM y WHERE y.i = x.i), 0)) < 0.001 AS row_ok,
  abs(x.v - coalesce((SELECT sum(v) FROM z WHERE z.j = x.i), 0) - (SELECT sum(v) FROM va WHERE va.j = x.i)) < 0.001 AS col_ok FROM x""")
def io_balance(spark, sf_dir):
    t = io(spark, sf_dir)
    return table.balance(t.z, t.y, t.va, t.x).select("i", (F.abs("row_residual") < 1e-3).alias("row_ok"), (F.abs("col_residual") < 1e-3).alias("col_ok"))


@query(f"WITH {FLOW} SELECT x.i, round(x.v - coalesce((SELECT sum(v) FROM y WHERE y.i = x.i), 0), 4) AS value FROM x")
def io_row_totals(spark, sf_dir):
    t = io(spark, sf_dir)
    return table.row_totals(t.x, t.y).select("i", v("value"))


@query(f"WITH {FLOW} SELECT x.i AS j, round(x.v - (SELECT sum(v) FROM va WHERE va.j = x.i), 4) AS value FROM x")
def io_col_totals(spark, sf_dir):
    t = io(spark, sf_dir)
    return table.col_totals(t.x, t.va).select("j", v("value"))


@query(f"WITH {FLOW} SELECT c.prov, c.cells, CASE c.prov WHEN 'balanced_adjustment' THEN 'BALANCED' WHEN 'proxy_estimated' THEN 'ESTIMATED' ELSE 'OBSERVED' END AS status FROM (SELECT CASE WHEN i = {PARENT} OR j = {PARENT} THEN 'proxy_estimated' ELSE 'observed' END AS prov, count(*) AS cells FROM z GROUP BY 1) c")
def provenance_counts(spark, sf_dir):
    z = io(spark, sf_dir).z
    return table.provenance_counts(split.provenance(z, z, [PARENT]))


# --- coefficients, multipliers, effects ---------------------------------------


@query(f"WITH {FLOW} SELECT i, j, round(v, 9) AS value FROM a")
def tech_coefficients(spark, sf_dir):
    t = io(spark, sf_dir)
    return table.coefficients(t.z, t.x).select("i", "j", v("value", 9))


@query(f"WITH RECURSIVE {FLOW}, {INVERSE} SELECT j, round(sum(v), 8) AS multiplier FROM l GROUP BY j")
def io_multipliers(spark, sf_dir):
    """Output multiplier of every live sector."""
    t = io(spark, sf_dir)
    return table.multipliers(table.coefficients(t.z, t.x), t.x).select("j", v("multiplier", 8, "multiplier"))


@query(f"WITH RECURSIVE {FLOW}, {INVERSE} SELECT j, round(sum(v), 8) AS multiplier FROM l GROUP BY j")
def io_multipliers_series(spark, sf_dir):
    t = io(spark, sf_dir)
    return table.multipliers_by_series(table.coefficients(t.z, t.x), t.x).select("j", v("multiplier", 8, "multiplier"))


@query(f"WITH RECURSIVE {FLOW}, {INVERSE} SELECT x.i, y.i AS j, round(coalesce(l.v, 0), 8) AS value FROM x JOIN x y ON true LEFT JOIN l ON l.i = x.i AND l.j = y.i")
def leontief_inverse(spark, sf_dir):
    t = io(spark, sf_dir)
    return table.leontief_inverse(table.coefficients(t.z, t.x), t.x).select("i", "j", (F.round("value", 8) + 0.0).alias("value"))


@query()
def leontief_diagnosis(spark, sf_dir):
    t = io(spark, sf_dir)
    return table.leontief_diagnosis(table.coefficients(t.z, t.x), t.x)


def type_ii(spark, sf_dir):
    t = io(spark, sf_dir)
    income = t.va.select("table_id", F.col("j").alias("i"), F.greatest(F.col("value") * 0.5, F.lit(0.0)).alias("value"))
    household = t.y.where("c = 'HOUSEHOLD'").select("table_id", "i", (F.col("value") * 0.5).alias("value"))
    return table.type_ii_multipliers(table.coefficients(t.z, t.x), t.x, income, household)


CLOSED = """inc AS (SELECT j AS i, greatest(0.5 * v, 0) AS v FROM va), hh AS (SELECT i, 0.5 * v AS v FROM y WHERE c = 'HOUSEHOLD'),
a2 AS (SELECT i, j, v FROM a UNION ALL SELECT -1, inc.i, inc.v / x.v FROM inc JOIN x ON x.i = inc.i UNION ALL SELECT hh.i, -1, hh.v / (SELECT sum(v) FROM inc) FROM hh JOIN x ON x.i = hh.i),
n2 AS (SELECT i FROM x UNION ALL SELECT -1),
t2(k, i, j, v) AS (SELECT 0, i, i, 1.0::DOUBLE FROM n2 UNION ALL SELECT * FROM (SELECT t2.k + 1, t2.i, a2.j, sum(t2.v * a2.v) FROM t2 JOIN a2 ON a2.i = t2.j WHERE t2.k < 160 GROUP BY 1, 2, 3)),
m2 AS (SELECT j, sum(v) AS v FROM t2 WHERE i >= 0 AND j >= 0 GROUP BY 1)"""


@query(f"WITH RECURSIVE {FLOW}, {CLOSED} SELECT j, round(v, 7) AS multiplier, round((SELECT sum(v) FROM hh) / (SELECT sum(v) FROM inc), 9) AS propensity FROM m2")
def type2_multipliers(spark, sf_dir):
    """Type II closure with half of value added as income and half of one final-demand column as consumption."""
    return type_ii(spark, sf_dir).select("j", v("multiplier", 7, "multiplier"), v("propensity", 9, "propensity"))


@query(f"""WITH RECURSIVE {FLOW}, {INVERSE}, jobs AS (SELECT s_nationkey AS i, count(*) AS e FROM supplier GROUP BY 1), d AS (SELECT x.i, jobs.e / x.v AS d FROM jobs JOIN x ON x.i = jobs.i),
  tot AS (SELECT l.j, sum(d.d * l.v) AS t FROM l JOIN d ON d.i = l.i GROUP BY 1)
SELECT tot.j, round(d.d, 12) AS direct, round(tot.t, 12) AS total FROM tot JOIN d ON d.i = tot.j""")
def satellite_effects(spark, sf_dir):
    t = io(spark, sf_dir)
    jobs = fixture.read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("i")).agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("table_id", F.lit(fixture.TABLE_ID))
    out = table.satellite_effects(jobs, t.x, table.leontief_inverse(table.coefficients(t.z, t.x), t.x))
    return out.select("j", v("direct", 12, "direct"), v("total", 12, "total"))


@query(f"""WITH RECURSIVE {FLOW}, {INVERSE} SELECT l.j, round(sum(l.v), 8) AS total, round(sum(CASE WHEN si.region_id = sj.region_id THEN l.v ELSE 0 END), 8) AS own
FROM l JOIN sector si ON si.idx = l.i JOIN sector sj ON sj.idx = l.j GROUP BY l.j""")
def jobs_spillover(spark, sf_dir):
    t = io(spark, sf_dir)
    inverse = table.leontief_inverse(table.coefficients(t.z, t.x), t.x)
    return table.spillover(inverse, t.sector, t.x.select("table_id", "i", F.lit(1.0).alias("c"))).select("j", v("total", 8, "total"), v("own", 8, "own"))


@query(f"""WITH RECURSIVE {FLOW}, {INVERSE}, om AS (SELECT j AS i, sum(v) AS om FROM l GROUP BY 1), rm AS (SELECT i AS j, sum(v) AS rm FROM l GROUP BY 1),
 e AS (SELECT a.i, a.j, 0.01 * a.v * om.om * rm.rm AS f, 0.01 * a.v * l.v AS t FROM a JOIN om ON om.i = a.i JOIN rm ON rm.j = a.j JOIN l ON l.i = a.j AND l.j = a.i)
SELECT i, j, round(f / (1 - t), 9) AS exact, row_number() OVER (ORDER BY f / (1 - t) DESC, i, j) AS rank FROM e QUALIFY rank <= 10""")
def cell_importance_topk(spark, sf_dir):
    t = io(spark, sf_dir)
    out = table.cell_importance(t.z, t.x, table.leontief_inverse(table.coefficients(t.z, t.x), t.x))
    return out.select("i", "j", v("exact", 9, "exact"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {FLOW}, h AS (SELECT idx FROM sector WHERE region_id = (SELECT region_id FROM sector WHERE idx = {PARENT})), ah AS (SELECT a.* FROM a JOIN h ON h.idx = a.j), n AS (SELECT j, sqrt(sum(v * v)) AS n FROM ah GROUP BY j)
SELECT p.j AS a, q.j AS b, round(max(abs(p.v - q.v)), 9) AS max_gap, round(1 - sum(p.v * q.v) / (any_value(np.n) * any_value(nq.n)), 9) AS cosine_distance
FROM ah p JOIN ah q ON p.i = q.i AND p.j < q.j JOIN n np ON np.j = p.j JOIN n nq ON nq.j = q.j GROUP BY 1, 2""")
def input_divergence(spark, sf_dir):
    """The split sector's region as parts."""
    t = io(spark, sf_dir)
    home = t.sector.where(F.col("idx") == PARENT).select("table_id", "region_id")
    parts = t.sector.join(home, ["table_id", "region_id"], "left_semi").select("table_id", F.col("idx").alias("j"))
    return table.input_divergence(table.coefficients(t.z, t.x), parts).select("a", "b", v("max_gap", 9, "max_gap"), (F.round("cosine_distance", 9) + 0.0).alias("cosine_distance"))


@query("""WITH s AS (SELECT o_orderpriority AS code, CAST(year(o_orderdate) AS VARCHAR) AS scenario, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2)
SELECT code, round(min(v), 4) AS low, round(max(v), 4) AS high, round(max(v) - min(v), 4) AS spread, round(100 * (max(v) - min(v)) / min(v), 7) AS spread_pct FROM s GROUP BY code""")
def scenario_compare(spark, sf_dir):
    years = fixture.read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("code"), F.year("o_orderdate").cast("string").alias("scenario")).agg(F.sum("o_totalprice").alias("value"))
    return table.compare_scenarios(years).select("code", v("low", 4, "low"), v("high", 4, "high"), v("spread", 4, "spread"), v("spread_pct", 7, "spread_pct"))


@query("""WITH f AS (SELECT s_nationkey AS i, c_nationkey AS j, l_returnflag AS scenario, sum(l_extendedprice * (1 - l_discount)) AS v
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)
SELECT i, j, round(max(v) - min(v), 4) AS spread FROM f GROUP BY i, j ORDER BY max(v) - min(v) DESC, i, j LIMIT 1""")
def variation_driver(spark, sf_dir):
    item, order = fixture.read(spark, sf_dir, "lineitem"), fixture.read(spark, sf_dir, "orders")
    seller, buyer = fixture.read(spark, sf_dir, "supplier"), fixture.read(spark, sf_dir, "customer")
    sold = item.join(seller, F.col("l_suppkey") == F.col("s_suppkey")).join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(buyer, F.col("o_custkey") == F.col("c_custkey"))
    cells = sold.groupBy(F.col("s_nationkey").alias("i"), F.col("c_nationkey").alias("j"), "l_returnflag").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"))
    return table.variation_driver(cells).select("i", "j", v("spread", 4, "spread"))


# --- regions and aggregation --------------------------------------------------


@query(f"WITH {FLOW} SELECT si.region_id AS origin, sj.region_id AS destination, round(sum(z.v), 4) AS value FROM z JOIN sector si ON si.idx = z.i JOIN sector sj ON sj.idx = z.j GROUP BY 1, 2")
def regional_block(spark, sf_dir):
    t = io(spark, sf_dir)
    return table.region_blocks(t.z, t.sector).select("origin", "destination", v("value"))


BLOCK = f"b AS (SELECT idx, CASE WHEN idx = {PARENT} THEN 0 WHEN region_id = (SELECT region_id FROM sector WHERE idx = {PARENT}) THEN 1 ELSE 2 END AS b FROM sector)"


@query(f"WITH {FLOW}, {BLOCK} SELECT bi.b AS i, bj.b AS j, round(sum(z.v), 4) AS value FROM z JOIN b bi ON bi.idx = z.i JOIN b bj ON bj.idx = z.j WHERE EXISTS (SELECT 1 FROM sector WHERE idx = {PARENT}) GROUP BY 1, 2")
def three_block_aggregate(spark, sf_dir):
    t = io(spark, sf_dir)
    return table.three_blocks(t.z, t.sector, PARENT).select("i", "j", v("value"))


@query(f"""WITH {FLOW}, k AS (SELECT z.i, z.j, z.v, CASE WHEN z.i = z.j THEN 0 WHEN si.region_id = sj.region_id THEN 1 ELSE 2 END AS k FROM z JOIN sector si ON si.idx = z.i JOIN sector sj ON sj.idx = z.j),
 c AS (SELECT j, sum(CASE WHEN k = 1 THEN v ELSE 0 END) AS near, sum(CASE WHEN k = 2 THEN v ELSE 0 END) AS far FROM k GROUP BY j)
SELECT k.i, k.j, round(CASE WHEN k = 1 AND near > 0 THEN v * (1 + least(3 * near, far) / near) WHEN k = 2 AND far > 0 AND near > 0 THEN v * (1 - least(3 * near, far) / far) ELSE v END, 4) AS value FROM k JOIN c ON c.j = k.j""")
def trade_counterfactual(spark, sf_dir):
    t = io(spark, sf_dir)
    return table.move_to_country(t.z, t.sector, 4.0).select("i", "j", (F.round("value", 4) + 0.0).alias("value"))


# --- balancing ----------------------------------------------------------------

RAS = ", ".join(
    f"r{k} AS (SELECT c{k - 1}.i, c{k - 1}.j, c{k - 1}.v * g.g / h.h AS v FROM c{k - 1} JOIN (SELECT i, sum(v) AS h FROM c{k - 1} GROUP BY 1) h ON h.i = c{k - 1}.i JOIN (SELECT i, 1.1 * sum(v) AS g FROM z GROUP BY 1) g ON g.i = c{k - 1}.i), "
    f"c{k} AS (SELECT r{k}.i, r{k}.j, r{k}.v * g.g / h.h AS v FROM r{k} JOIN (SELECT j, sum(v) AS h FROM r{k} GROUP BY 1) h ON h.j = r{k}.j JOIN (SELECT j, 1.1 * sum(v) AS g FROM z GROUP BY 1) g ON g.j = r{k}.j)"
    for k in range(1, 6)
)
BENT = "c0 AS (SELECT i, j, v * (1 + (i + 2 * j) % 5) AS v FROM z)"


def bent(t):
    """The intermediate block distorted cell by cell, and targets of a tenth above its own totals."""
    cells = t.z.withColumn("value", F.col("value") * (1 + (F.col("i") + 2 * F.col("j")) % 5))
    rows = t.z.groupBy("table_id", "i").agg((1.1 * F.sum("value")).alias("value"))
    return cells, rows, t.z.groupBy("table_id", "j").agg((1.1 * F.sum("value")).alias("value"))


@query(f"WITH {FLOW}, {BENT}, {RAS} SELECT i, j, round(v, 3) AS value FROM c5")
def ras_k5(spark, sf_dir):
    return balance.ras_rounds(*bent(io(spark, sf_dir)), 5).select("i", "j", v("value", 3))


@query()
def gras_cells(spark, sf_dir):
    """GRAS of a block with negative cells to targets a tenth above its totals."""
    t = io(spark, sf_dir)
    signed = t.z.withColumn("value", F.when((F.col("i") + F.col("j")) % 11 == 0, -0.2 * F.col("value")).otherwise(F.col("value")))
    rows, cols = (signed.groupBy("table_id", k).agg((1.1 * F.sum("value")).alias("value")) for k in "ij")
    return balance.balance(signed, rows, cols)


@query()
def mras_known_cells(spark, sf_dir):
    cells, rows, cols = bent(io(spark, sf_dir))
    known = io(spark, sf_dir).z.where("i = j").select("table_id", "i", "j", "value")
    return balance.balance(cells, rows, cols, known=known)


@query(f"WITH {FLOW}, n AS (SELECT 'row' AS side, i AS k FROM z UNION SELECT 'col', j FROM z) SELECT count(DISTINCT 1) AS components, count(*) AS nodes FROM n")
def connected_components(spark, sf_dir):
    got = balance.bipartite_components(io(spark, sf_dir).z)
    return got.agg(F.countDistinct("component").alias("components"), F.count(F.lit(1)).alias("nodes"))


# --- supply and use -----------------------------------------------------------


@query(f"WITH {SUT} SELECT p, a, round(v / sum(v) OVER (PARTITION BY a), 9) AS value FROM sv")
def product_mix(spark, sf_dir):
    return sut.product_mix(fixture.supply_use(spark, sf_dir).v).select("p", "a", v("value", 9))


@query(f"WITH {SUT} SELECT a, p, round(v / sum(v) OVER (PARTITION BY p), 9) AS value FROM sv")
def market_shares(spark, sf_dir):
    return sut.market_shares(fixture.supply_use(spark, sf_dir).v).select("a", "p", v("value", 9))


@query(f"WITH {SUT}, c AS (SELECT p, a, v / sum(v) OVER (PARTITION BY a) AS c FROM sv) SELECT su.p, c.p AS q, round(sum(su.v * c.c), 3) AS value FROM su JOIN c ON c.a = su.a GROUP BY 1, 2")
def sut_to_iot_b(spark, sf_dir):
    s = fixture.supply_use(spark, sf_dir)
    return sut.model_b(s.v, s.u).select("p", "q", v("value", 3))


@query(f"WITH {SUT}, d AS (SELECT a, p, v / sum(v) OVER (PARTITION BY p) AS d FROM sv) SELECT d.a AS i, su.a AS j, round(sum(su.v * d.d), 3) AS value FROM su JOIN d ON d.p = su.p GROUP BY 1, 2")
def sut_to_iot_d(spark, sf_dir):
    s = fixture.supply_use(spark, sf_dir)
    return sut.model_d(s.v, s.u, "a").select("i", "j", v("value", 3))


@query(f"WITH {SUT}, d AS (SELECT a, p, v / sum(v) OVER (PARTITION BY p) AS d FROM sv) SELECT d.a AS i, sy.c, round(sum(sy.v * d.d), 3) AS value FROM sy JOIN d ON d.p = sy.p GROUP BY 1, 2")
def sut_final_demand_d(spark, sf_dir):
    s = fixture.supply_use(spark, sf_dir)
    return sut.model_d(s.v, s.y, "c").select("i", "c", v("value", 3))


def square(s):
    """The supply-use pair with the two last products merged, so that there are as many as activities."""
    merge = lambda df: df.withColumn("p", F.when(F.col("p") >= "SMALL", "SMALL+").otherwise(F.col("p")))
    return tuple(merge(df).groupBy("p", other).agg(F.sum("value").alias("value")) for df, other in ((s.v, "a"), (s.u, "a"), (s.y, "c")))


def _dense(model):
    def run(spark, sf_dir):
        return sut.dense_model(model, *square(fixture.supply_use(spark, sf_dir)))

    run.__name__ = f"sut_to_iot_{model.lower()}"
    return run


for _model in "ACE":
    QUERIES[f"sut_to_iot_{_model.lower()}"] = _dense(_model)


@query()
def almon_purified(spark, sf_dir):
    """The use table purified row by row; supply with its diagonal raised, so that an own product leads each industry."""
    vt, u, _ = square(fixture.supply_use(spark, sf_dir))
    own = F.dense_rank().over(table.Window.partitionBy("a").orderBy("p")) - 1 == F.col("a")
    return sut.almon(vt.withColumn("value", F.when(own, F.col("value") * 10).otherwise(F.col("value"))), u)


# --- splits -------------------------------------------------------------------


def weights(spark, sf_dir):
    """A key of five parts from order counts."""
    keys = fixture.read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("code")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    order = F.row_number().over(table.Window.partitionBy("key_id").orderBy("code")) + 99
    return split.key_weights(keys.withColumn("key_id", F.lit("orders"))).withColumn("part", order).select("part", "code", "weight")


@query("""WITH k AS (SELECT c_mktsegment AS code, 'balance' AS key_id, sum(c_acctbal) AS v FROM customer GROUP BY 1 UNION ALL SELECT c_mktsegment, 'signed', min(c_acctbal) FROM customer GROUP BY 1),
b AS (SELECT key_id, sum(v) AS t, min(v) < 0 OR sum(v) <= 0 AS bad FROM k GROUP BY 1) SELECT k.key_id, code, CASE WHEN NOT bad THEN round(v / t, 9) END AS weight, bad AS refused FROM k JOIN b ON b.key_id = k.key_id""")
def key_weights(spark, sf_dir):
    by = fixture.read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("code"))
    keys = by.agg(F.sum("c_acctbal").alias("value")).withColumn("key_id", F.lit("balance")).unionByName(by.agg(F.min("c_acctbal").alias("value")).withColumn("key_id", F.lit("signed")))
    return split.key_weights(keys).select("key_id", "code", v("weight", 9, "weight"), "refused")


@query("""WITH s AS (SELECT o_orderpriority AS code, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders WHERE year(o_orderdate) IN (1996, 1999) GROUP BY 1, 2), h AS (SELECT code, y, v / sum(v) OVER (PARTITION BY y) AS s FROM s),
q AS (SELECT 'orders' AS key_id, code, sum(s) FILTER (y = 1996) AS a, sum(s) FILTER (y = 1999) AS b FROM h GROUP BY code)
SELECT key_id, code, round(a + (b - a) * 2 / 3, 9) AS share, 'interpolated' AS origin FROM q""")
def key_interpolation(spark, sf_dir):
    years = fixture.read(spark, sf_dir, "orders").where(F.year("o_orderdate").isin(1996, 1999))
    series = years.groupBy(F.lit("orders").alias("key_id"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("code")).agg(F.sum("o_totalprice").alias("value"))
    return split.interpolate(series, 1998).select("key_id", "code", v("share", 9, "share"), "origin")


@query("""WITH k AS (SELECT 'a' AS key_id, o_orderpriority AS code, count(*)::DOUBLE AS v FROM orders GROUP BY 2 UNION ALL SELECT 'b', o_orderpriority, sum(o_totalprice) FROM orders GROUP BY 2), w AS (SELECT key_id, code, v / sum(v) OVER (PARTITION BY key_id) AS w FROM k)
SELECT p.code, round((p.w - q.w) / q.w, 9) AS gap FROM w p JOIN w q ON p.code = q.code AND p.key_id = 'a' AND q.key_id = 'b'""")
def corroborate_keys(spark, sf_dir):
    by = fixture.read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("code"))
    keys = by.agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("key_id", F.lit("a")).unionByName(by.agg(F.sum("o_totalprice").alias("value")).withColumn("key_id", F.lit("b")))
    w = split.key_weights(keys)
    return split.corroborate(w.where("key_id = 'a'"), w.where("key_id = 'b'")).select("code", (F.round("gap", 9) + 0.0).alias("gap"))


SEED = f"""dd AS (SELECT sum(w * w) AS d FROM w),
seed AS (
  SELECT i, j, v, 'rest' AS block FROM z WHERE i <> {PARENT} AND j <> {PARENT}
  UNION ALL SELECT part, j, v * w, 'row' FROM z, w WHERE i = {PARENT} AND j <> {PARENT}
  UNION ALL SELECT i, part, v * w, 'column' FROM z, w WHERE i <> {PARENT} AND j = {PARENT}
  UNION ALL SELECT p.part, q.part, v * p.w * q.w * CASE WHEN p.part = q.part THEN 0.5 ELSE (1 - 0.5 * d) / (1 - d) END, 'inner' FROM z, w p, w q, dd WHERE i = {PARENT} AND j = {PARENT})"""


def seeded(spark, sf_dir, alpha=0.5):
    t, w = io(spark, sf_dir), weights(spark, sf_dir)
    return t, w, split.seed(t.z, PARENT, w, w, alpha)


@query(f"WITH {FLOW}, {WEIGHTS}, {SEED} SELECT i, j, round(v, 4) AS value, block FROM seed")
def split_seed(spark, sf_dir):
    return seeded(spark, sf_dir)[2].select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), v("value", 4), "block")


@query(f"""WITH {FLOW}, {WEIGHTS}, m AS (SELECT z.i, w.part, w.w * CASE WHEN z.i % 3 = w.part % 3 THEN 2.0 ELSE 1.0 END AS wm FROM z, w WHERE z.j = {PARENT})
SELECT i, part, round(wm / sum(wm) OVER (PARTITION BY i), 9) AS share FROM m""")
def split_profiled_shares(spark, sf_dir):
    t, w = io(spark, sf_dir), weights(spark, sf_dir)
    profile = t.z.where(F.col("j") == PARENT).select("i").join(w.select("part")).where("i % 3 = part % 3").withColumn("m", F.lit(2.0))
    return split.profile_shares(t.z, PARENT, w, profile).select("i", F.col("part").cast("long").alias("part"), v("share", 9, "share"))


@query(f"WITH {FLOW}, {WEIGHTS} SELECT j, round(v, 4) AS value FROM va WHERE j <> {PARENT} UNION ALL SELECT part, round(v * w, 4) FROM va, w WHERE j = {PARENT}")
def split_va_rows(spark, sf_dir):
    t, w = io(spark, sf_dir), weights(spark, sf_dir)
    return split.split_margin(t.va, "j", PARENT, w).select(F.col("j").cast("long").alias("j"), v("value", 4))


INNER = f"""o AS (SELECT part, (SELECT v FROM x WHERE i = {PARENT}) * w - coalesce((SELECT sum(v) FROM y WHERE i = {PARENT}), 0) * w - coalesce((SELECT sum(v) FROM seed WHERE i = part AND block <> 'inner'), 0) AS r,
  (SELECT v FROM x WHERE i = {PARENT}) * w - coalesce((SELECT sum(v) FROM va WHERE j = {PARENT}), 0) * w - coalesce((SELECT sum(v) FROM seed WHERE j = part AND block <> 'inner'), 0) AS c FROM w WHERE EXISTS (SELECT 1 FROM x WHERE i = {PARENT}))"""


def inner(spark, sf_dir):
    t, w, s = seeded(spark, sf_dir)
    x, y, va = (split.split_margin(df, at, PARENT, w) for df, at in ((t.x, "i"), (t.y, "i"), (t.va, "j")))
    rows, cols = split.targets(x, y, va)
    return s, *split.inner_targets(s, rows, cols, list(PARTS))


@query(f"WITH {FLOW}, {WEIGHTS}, {SEED}, {INNER} SELECT part, round(r, 3) AS row_target, round(c, 3) AS col_target FROM o")
def internal_block_targets(spark, sf_dir):
    _, r, c = inner(spark, sf_dir)
    both = r.withColumnRenamed("value", "r").join(c.select("table_id", F.col("j").alias("i"), F.col("value").alias("c")), ["table_id", "i"])
    return both.select(F.col("i").cast("long").alias("part"), v("r", 3, "row_target"), v("c", 3, "col_target"))


@query()
def split_balanced(spark, sf_dir):
    """The split's inner block balanced by GRAS to its targets, with provenance of every cell."""
    s, r, c = inner(spark, sf_dir)
    made = balance.balance(s.where("block = 'inner'"), r, c, floor=1e-3).select("table_id", "i", "j", "value")
    after = s.where("block <> 'inner'").select("table_id", "i", "j", "value").unionByName(made)
    return split.provenance(s, after, list(PARTS))


@query(f"WITH {FLOW} SELECT i, j, round(v, 4) AS value, round(v, 4) AS was FROM z")
def split_reaggregates(spark, sf_dir):
    """A split summed back to its parent beside the table it came from."""
    t, _, s = seeded(spark, sf_dir)
    mapping = t.sector.select("table_id", "idx", F.col("idx").alias("parent")).unionByName(weights(spark, sf_dir).select(F.lit(fixture.TABLE_ID).alias("table_id"), F.col("part").alias("idx"), F.lit(PARENT).alias("parent")))
    back = table.reaggregate(s, mapping)
    both = t.z.join(back.withColumnRenamed("value", "v1"), ["table_id", "i", "j"], "full")
    return both.select("i", "j", F.round("v1", 4).alias("value"), v("value", 4, "was"))


# --- regionalisation ----------------------------------------------------------


def activity(spark, sf_dir):
    nation = fixture.read(spark, sf_dir, "nation")
    buyer = fixture.read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("region"))
    return fixture.read(spark, sf_dir, "orders").join(buyer, F.col("o_custkey") == F.col("c_custkey")).groupBy("region", F.col("o_orderpriority").alias("i")).agg(F.sum("o_totalprice").alias("value"))


NATIONAL = """nat AS (SELECT p.i, q.i AS j, 0.6 * p.v / (SELECT sum(v) FROM tot) + 0.01 AS v FROM tot p, tot q)"""
LQ = f"""{ACTIVITY}, tot AS (SELECT i, sum(v) AS v FROM act GROUP BY 1), size AS (SELECT r, sum(v) / (SELECT sum(v) FROM act) AS s FROM act GROUP BY 1), reg AS (SELECT r, sum(v) AS v FROM act GROUP BY 1),
slq AS (SELECT act.r, act.i, (act.v / reg.v) / (tot.v / (SELECT sum(v) FROM act)) AS q, size.s FROM act JOIN reg ON reg.r = act.r JOIN tot ON tot.i = act.i JOIN size ON size.r = act.r), {NATIONAL}"""


def national(act):
    """National coefficients from the sectors' shares in activity."""
    tot = act.groupBy("i").agg(F.sum("value").alias("v"))
    all_ = act.agg(F.sum("value").alias("n"))
    return tot.join(all_).join(tot.select(F.col("i").alias("j"))).select("i", "j", (0.6 * F.col("v") / F.col("n") + 0.01).alias("value"))


@query(f"WITH {LQ} SELECT r AS region, i, round(q, 9) AS slq, round(s, 9) AS size FROM slq")
def slq(spark, sf_dir):
    return regional.location_quotients(activity(spark, sf_dir)).select("region", "i", v("slq", 9, "slq"), v("size", 9, "size"))


def _lq(method, cross, diagonal="p.q", delta=None):
    def run(spark, sf_dir):
        act = activity(spark, sf_dir)
        return regional.regionalise(national(act), act, method, delta).select("region", "i", "j", v("value", 9))

    name = f"lq_{method.lower()}"
    run.__name__ = name
    QUERIES[name] = run
    ORACLE_SQL[name] = f"WITH {LQ} SELECT p.r AS region, nat.i, nat.j, round(nat.v * least(1, CASE WHEN nat.i = nat.j THEN {diagonal} ELSE {cross} END), 9) AS value FROM nat JOIN slq p ON p.i = nat.i JOIN slq b ON b.i = nat.j AND b.r = p.r"


_lq("SLQ", "p.q")
_lq("CILQ", "p.q / b.q")
_lq("RLQ", "p.q / log2(1 + b.q)")
_lq("FLQ", "p.q / b.q * pow(log2(1 + p.s), 0.2)", "p.q * pow(log2(1 + p.s), 0.2)", 0.2)


@query(f"""WITH {LQ}, ra AS (SELECT p.r, nat.i, nat.j, nat.v AS nv, nat.v * least(1, CASE WHEN nat.i = nat.j THEN p.q ELSE p.q / b.q END) AS v FROM nat JOIN slq p ON p.i = nat.i JOIN slq b ON b.i = nat.j AND b.r = p.r)
SELECT ra.r AS region, ra.i, round(sum((ra.nv - ra.v) * act.v), 4) AS imports FROM ra JOIN act ON act.r = ra.r AND act.i = ra.j GROUP BY 1, 2""")
def implicit_imports(spark, sf_dir):
    act = activity(spark, sf_dir)
    return regional.implicit_imports(regional.regionalise(national(act), act, "CILQ"), act).select("region", "i", v("imports", 4, "imports"))


@query(f"WITH {LQ} SELECT act.r AS region, act.i, round(act.v * (SELECT count(*) FROM orders o WHERE o.o_orderpriority = act.i) / tot.v, 6) AS value, 'estimated' AS origin FROM act JOIN tot ON tot.i = act.i")
def regional_satellites(spark, sf_dir):
    act = activity(spark, sf_dir)
    counts = fixture.read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("i")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return regional.regional_satellite(counts, act.groupBy("i").agg(F.sum("value").alias("value")), act).select("region", "i", v("value", 6), "origin")


# --- identities, precision, codes ---------------------------------------------


TALLY = "count(*) AS rows, count(*) FILTER (abs(gap) > tol) AS failed, count(*) FILTER (abs(gap) > tol) = 0 AS passed"


def raised(df, key, which, by):
    """df with the values of one key raised, so that an identity has something to find."""
    return df.withColumn("value", F.when(F.col(key) == which, by * F.col("value")).otherwise(F.col("value")))


@query(f"WITH {SUT}, o AS (SELECT p, sum(v) * CASE WHEN p = 'PROMO' THEN 1.01 ELSE 1 END AS o FROM sv GROUP BY 1), u AS (SELECT p, sum(v) AS u FROM (SELECT p, v FROM su UNION ALL SELECT p, v FROM sy) GROUP BY 1), k AS (SELECT o - u AS gap, 1e-3 + 1e-9 * greatest(o, u) AS tol FROM o JOIN u ON u.p = o.p) SELECT 'ID-01' AS name, {TALLY} FROM k")
def id01_product_balance(spark, sf_dir):
    """One product's supply is a hundredth too large."""
    s = fixture.supply_use(spark, sf_dir)
    return identities.report(identities.product_balance(raised(s.v, "p", "PROMO", 1.01), s.v.where("false"), s.u, s.y)).select("name", "rows", "failed", "passed")


@query(f"""WITH {SUT}, ic AS (SELECT a, sum(v) AS v FROM su GROUP BY 1), g AS (SELECT a, sum(v) AS v FROM sv GROUP BY 1) SELECT 'ID-02' AS name, count(*) AS rows, count(*) FILTER (abs(0.6 * g.v - (g.v - ic.v)) > 0.001 + 1e-9 * greatest(abs(ic.v + 0.6 * g.v), g.v)) AS failed,
 count(*) FILTER (abs(0.6 * g.v - (g.v - ic.v)) > 0.001 + 1e-9 * greatest(abs(ic.v + 0.6 * g.v), g.v)) = 0 AS passed FROM g JOIN ic ON ic.a = g.a""")
def id02_industry_identity(spark, sf_dir):
    """Value added put at six tenths of output: the identity fails where inputs are not the other four."""
    s = fixture.supply_use(spark, sf_dir)
    added = s.v.withColumn("value", 0.6 * F.col("value"))
    return identities.report(identities.industry_identity(s.u, added, s.v)).select("name", "rows", "failed", "passed")


@query(f"WITH {SUT}, k AS (SELECT 'ID-07 industries' AS name, sum(v) * CASE WHEN a = 2 THEN 0.5 ELSE 0 END AS gap, 1e-3 + 1e-9 * 1.5 * sum(v) AS tol FROM sv GROUP BY a UNION ALL SELECT 'ID-07 products', 0.0, 1e-3 FROM sv GROUP BY p) SELECT name, {TALLY} FROM k GROUP BY name")
def id07_supply_totals(spark, sf_dir):
    """Stated outputs by product hold; one industry's is half as large again as its products."""
    s = fixture.supply_use(spark, sf_dir)
    q, g = s.v.groupBy("p").agg(F.sum("value").alias("value")), s.v.groupBy("a").agg(F.sum("value").alias("value"))
    return identities.report(identities.supply_totals(s.v, q, raised(g, "a", 2, 1.5))).select("name", "rows", "failed", "passed")


@query(f"WITH {FLOW}, k AS (SELECT 'ID-11 rows' AS name, coalesce((SELECT sum(v) FROM y WHERE y.i = x.i), 0) * CASE WHEN i = {PARENT} THEN -0.1 ELSE 0 END AS gap, 1e-3 AS tol FROM x UNION ALL SELECT 'ID-11 columns', 0, 1e-3 FROM x) SELECT name, {TALLY} FROM k GROUP BY name")
def id11_table_balance(spark, sf_dir):
    """A table with one sector's final demand a tenth too large: its row fails, its column doesn't."""
    t = io(spark, sf_dir)
    return identities.report(identities.table_balance(table.balance(t.z, raised(t.y, "i", PARENT, 1.1), t.va, t.x))).select("name", "rows", "failed", "passed")


@query(f"WITH RECURSIVE {FLOW}, {INVERSE}, k AS (SELECT l.i, l.v * 0.1 * (SELECT sum(v) FROM y WHERE y.i = {PARENT}) AS gap, 1e-6 + 1e-9 * x.v AS tol FROM x LEFT JOIN l ON l.i = x.i AND l.j = {PARENT}), kk AS (SELECT coalesce(gap, 0) AS gap, tol FROM k) SELECT 'ID-12' AS name, {TALLY} FROM kk")
def id12_leontief(spark, sf_dir):
    """Final demand of one sector a tenth too large: outputs of all that supply it, directly or not, are off."""
    t = io(spark, sf_dir)
    final = table.total(raised(t.y, "i", PARENT, 1.1), "i").select("table_id", "i", "value")
    return identities.report(identities.leontief_solution(table.leontief_inverse(table.coefficients(t.z, t.x), t.x), final, t.x)).select("name", "rows", "failed", "passed")


@query(f"WITH {SUT}, k AS (SELECT sum(v) FILTER (a = 1 AND p = 'LARGE') AS gap, 1e-3 + 1e-9 * sum(v) AS tol FROM sv GROUP BY a), kk AS (SELECT coalesce(gap, 0) AS gap, tol FROM k) SELECT 'ID-03' AS name, {TALLY} FROM kk")
def id03_value_added_parts(spark, sf_dir):
    """Output by region against the same by part type, as value added and its components; one component is missing."""
    s = fixture.supply_use(spark, sf_dir)
    return identities.report(identities.value_added_parts(s.v.groupBy("a").agg(F.sum("value").alias("value")), s.v.where("NOT (a = 1 AND p = 'LARGE')"))).select("name", "rows", "failed", "passed")


@query(f"WITH {SUT}, s AS (SELECT sum(v) AS s, sum(v) FILTER (seg <> 'FURNITURE') AS u FROM sold), k AS (SELECT greatest(s, u) - least(s, u) AS gap, 1e-3 + 1e-9 * greatest(s, u) AS tol FROM s) SELECT 'ID-06' AS name, {TALLY} FROM k")
def id06_gdp(spark, sf_dir):
    """Total sales from the supply side, from the use side without one final use, and from the table's outputs."""
    s, t = fixture.supply_use(spark, sf_dir), io(spark, sf_dir)
    one = lambda df, name: df.agg(F.sum("value").alias(name))
    df = one(s.v, "supply").join(one(s.u.select("value").unionByName(s.y.where("c <> 'FURNITURE'").select("value")), "use")).join(one(t.x, "output"))  # one row each
    return identities.report(identities.gdp(F.col("supply"), F.col("use"), F.col("output"), df)).select("name", "rows", "failed", "passed")


@query(f"WITH {FLOW} SELECT 'ID-08' AS name, 1::BIGINT AS rows, 0::BIGINT AS failed, true AS passed")
def id08_residuals_cancel(spark, sf_dir):
    """Value added and final demand of the whole table cancel: what is earned is what is finally bought."""
    t = io(spark, sf_dir)
    both = t.va.select("value").unionByName(t.y.select((-F.col("value")).alias("value")))
    return identities.report(identities.sums_to_zero(both)).select("name", "rows", "failed", "passed")


@query(f"WITH {SUT}, k AS (SELECT sum(v) * CASE WHEN a = 3 THEN 0.25 ELSE 0 END AS gap, 1e-3 + 1e-9 * sum(v) AS tol FROM su GROUP BY a) SELECT 'ID-14' AS name, {TALLY} FROM k")
def id14_intermediate_totals(spark, sf_dir):
    """Stated intermediate consumption of one region is a quarter too small."""
    s = fixture.supply_use(spark, sf_dir)
    stated = s.u.groupBy("a").agg(F.sum("value").alias("value"))
    return identities.report(identities.intermediate_totals(s.u, raised(stated, "a", 3, 0.75))).select("name", "rows", "failed", "passed")


@query(f"""WITH {FLOW}, {SUT.strip()} SELECT 'ID-01' AS name, count(DISTINCT p) AS rows, true AS passed FROM sv UNION ALL SELECT 'ID-07 industries', count(DISTINCT a), true FROM sv UNION ALL SELECT 'ID-07 products', count(DISTINCT p), true FROM sv
UNION ALL SELECT 'ID-11 columns', count(*), true FROM x UNION ALL SELECT 'ID-11 rows', count(*), true FROM x""")
def check_report(spark, sf_dir):
    s, t = fixture.supply_use(spark, sf_dir), io(spark, sf_dir)
    q, g = s.v.groupBy("p").agg(F.sum("value").alias("value")), s.v.groupBy("a").agg(F.sum("value").alias("value"))
    checks = identities.product_balance(s.v, s.v.where("false"), s.u, s.y).unionByName(identities.supply_totals(s.v, q, g)).unionByName(identities.table_balance(table.balance(t.z, t.y, t.va, t.x)))
    return identities.report(checks).select("name", "rows", "passed")


@query("""WITH m AS (SELECT p_type AS p, CASE WHEN p_type LIKE 'PROMO%' THEN -(SELECT sum(p_retailprice) FROM part WHERE p_type NOT LIKE 'PROMO%') / (SELECT count(DISTINCT p_type) FROM part WHERE p_type LIKE 'PROMO%') ELSE sum(p_retailprice) END AS v FROM part GROUP BY 1)
SELECT 'ID-19' AS name, 1::BIGINT AS rows, 0::BIGINT AS failed, true AS passed UNION ALL SELECT 'ID-19 signs', 1, count(*) FILTER (v < 0 AND p NOT LIKE 'PROMO%'), count(*) FILTER (v < 0 AND p NOT LIKE 'PROMO%') = 0 FROM m""")
def id19_margin_column(spark, sf_dir):
    part = fixture.read(spark, sf_dir, "part").groupBy(F.col("p_type").alias("p")).agg(F.sum("p_retailprice").alias("value"))
    promo = F.col("p").startswith("PROMO")
    rest = part.agg(F.sum(F.when(~promo, F.col("value"))).alias("s"), F.count(F.when(promo, 1)).alias("n"))  # one row
    margins = part.join(rest).select("p", F.when(promo, -F.col("s") / F.col("n")).otherwise(F.col("value")).alias("value"))
    return identities.report(identities.margin_column(margins, part.where(promo).select("p"))).select("name", "rows", "failed", "passed")


@query(f"WITH {FLOW} SELECT 'va' AS block, count(*) FILTER (v < 0) AS negatives, round(avg(CASE WHEN v < 0 THEN 1.0 ELSE 0 END), 9) AS share, round(least(min(v), 0), 4) AS smallest, round(sum(CASE WHEN v < 0 THEN v ELSE 0 END), 4) AS mass FROM va UNION ALL SELECT 'z', count(*) FILTER (v < 0), round(avg(CASE WHEN v < 0 THEN 1.0 ELSE 0 END), 9), round(least(min(v), 0), 4), round(sum(CASE WHEN v < 0 THEN v ELSE 0 END), 4) FROM z")
def negative_census(spark, sf_dir):
    t = io(spark, sf_dir)
    cells = t.va.select(F.lit("va").alias("block"), "value").unionByName(t.z.select(F.lit("z").alias("block"), "value"))
    return precision.negative_census(cells, ["block"]).select("block", "negatives", v("share", 9, "share"), v("smallest", 4, "smallest"), v("mass", 4, "mass"))


DECIMALS = """vals AS (SELECT 'retail' AS source, p_retailprice AS v FROM part UNION ALL SELECT 'balance', s_acctbal FROM supplier UNION ALL SELECT 'size', p_size FROM part),
need AS (SELECT source, CASE WHEN abs(v - round(v, 0)) < 1e-7 * greatest(1, abs(v)) THEN 0 WHEN abs(v - round(v, 1)) < 1e-7 * greatest(1, abs(v)) THEN 1 WHEN abs(v - round(v, 2)) < 1e-7 * greatest(1, abs(v)) THEN 2
 WHEN abs(v - round(v, 3)) < 1e-7 * greatest(1, abs(v)) THEN 3 WHEN abs(v - round(v, 4)) < 1e-7 * greatest(1, abs(v)) THEN 4 WHEN abs(v - round(v, 5)) < 1e-7 * greatest(1, abs(v)) THEN 5 WHEN abs(v - round(v, 6)) < 1e-7 * greatest(1, abs(v)) THEN 6 END AS d FROM vals WHERE v <> 0),
lv AS (SELECT source, d, count(*) AS n, sum(count(*)) OVER (PARTITION BY source) AS total FROM need GROUP BY 1, 2),
pd AS (SELECT source, CASE WHEN coalesce(sum(n) FILTER (d IS NULL), 0) < 0.05 * any_value(total) THEN max(d) FILTER (n >= 0.05 * total) END AS decimals FROM lv GROUP BY 1)"""


def _values(spark, sf_dir):
    part, seller = fixture.read(spark, sf_dir, "part"), fixture.read(spark, sf_dir, "supplier")
    one = lambda df, name, c: df.select(F.lit(name).alias("source"), F.col(c).cast("double").alias("value"))
    return one(part, "retail", "p_retailprice").unionByName(one(seller, "balance", "s_acctbal")).unionByName(one(part, "size", "p_size"))


@query(f"WITH {DECIMALS} SELECT source, decimals FROM pd")
def printed_decimals(spark, sf_dir):
    return precision.printed_decimals(_values(spark, sf_dir), ["source"])


@query(f"WITH {DECIMALS}, m AS (SELECT source, sum(abs(v)) AS mass FROM vals GROUP BY 1) SELECT pd.source, decimals, round(CASE WHEN decimals IS NOT NULL THEN 0.5 * pow(10, -decimals) * 12 ELSE 12 * 2.220446049250313e-16 * mass END, 9) AS tolerance FROM pd JOIN m ON m.source = pd.source")
def tolerance_floor(spark, sf_dir):
    return precision.tolerance_floor(_values(spark, sf_dir), ["source"], 12).select("source", "decimals", v("tolerance", 9, "tolerance"))


@query("SELECT DISTINCT b.p_brand AS code FROM part b WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT substr(p_brand, 1, 7) AS c FROM part UNION SELECT DISTINCT p_brand FROM part) o WHERE o.c <> b.p_brand AND starts_with(b.p_brand, o.c)) UNION SELECT DISTINCT substr(p_brand, 1, 7) FROM part")
def prefix_tiling(spark, sf_dir):
    brand = fixture.read(spark, sf_dir, "part").select(F.col("p_brand").alias("code"))
    return codes.prefix_tiling(brand.unionByName(brand.select(F.substring("code", 1, 7).alias("code"))).distinct())


TILES = ["C", "C10-12", "C13", "CPA_A01", "A", "L68", "L68A", "G45", "G46_47", "F"]


@query("SELECT * FROM (VALUES ('C'), ('A'), ('L68'), ('G45'), ('G46_47'), ('F')) t(code)")
def coarsest_tiling(spark, sf_dir):
    return codes.coarsest_tiling(spark.createDataFrame([(c,) for c in TILES], "code string"))


# --- diagnostics --------------------------------------------------------------


@query("""WITH y AS (SELECT o_orderpriority AS code, sum(o_totalprice) FILTER (year(o_orderdate) = 1997) AS a, sum(o_totalprice * 0.98) FILTER (year(o_orderdate) = 1997) AS b, sum(o_totalprice) FILTER (year(o_orderdate) = 1996) AS c FROM orders GROUP BY 1)
SELECT code, round(100 * a / b, 8) AS price, round(100 * b / c, 8) AS volume, round(100 * a / c, 8) AS value_index, true AS consistent FROM y""")
def six_pack(spark, sf_dir):
    order = fixture.read(spark, sf_dir, "orders")
    year = lambda n, f: F.sum(F.when(F.year("o_orderdate") == n, F.col("o_totalprice") * f))
    vals = order.groupBy(F.col("o_orderpriority").alias("code")).agg(year(1997, 1.0).alias("a"), year(1997, 0.98).alias("b"), year(1996, 1.0).alias("c"))
    return diagnostics.six_pack(vals).select("code", v("price", 8, "price"), v("volume", 8, "volume"), v("value_index", 8, "value_index"), "consistent")


@query("""WITH r AS (SELECT p_type AS g, p_brand AS code, sum(p_retailprice * p_size) / sum(p_size) AS v FROM part GROUP BY 1, 2), m AS (SELECT g, median(v) AS med FROM r GROUP BY 1), d AS (SELECT r.g, median(abs(v - med)) AS mad FROM r JOIN m ON m.g = r.g GROUP BY 1)
SELECT r.g, r.code, round(v, 7) AS value, round(med, 7) AS median, round(mad, 7) AS mad, abs(v - med) > 5 * mad AS outlier FROM r JOIN m ON m.g = r.g JOIN d ON d.g = r.g""")
def credibility_mad(spark, sf_dir):
    part = fixture.read(spark, sf_dir, "part")
    ratio = part.groupBy(F.col("p_type").alias("g"), F.col("p_brand").alias("code")).agg((F.sum(F.col("p_retailprice") * F.col("p_size")) / F.sum("p_size")).alias("value"))
    return diagnostics.mad_outliers(ratio, ["g"]).select("g", "code", v("value", 7), v("median", 7, "median"), v("mad", 7, "mad"), "outlier")


@query("""WITH t AS (SELECT p_type AS code, sum(l_tax * l_extendedprice) AS t, sum(l_extendedprice) AS b FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) SELECT code, round(t / b, 9) AS rate, 0.04::DOUBLE AS legal, t / b > 0.04 + 1e-9 AS flagged FROM t""")
def implied_tax_rate(spark, sf_dir):
    item = fixture.read(spark, sf_dir, "lineitem").join(fixture.read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    sums = item.groupBy(F.col("p_type").alias("code")).agg(F.sum(F.col("l_tax") * F.col("l_extendedprice")).alias("t"), F.sum("l_extendedprice").alias("b"))
    named = lambda c: sums.select("code", F.col(c).alias("value"))
    return diagnostics.implied_tax(named("t"), named("b"), sums.select("code", F.lit(0.04).alias("value"))).select("code", v("rate", 9, "rate"), "legal", "flagged")


YEARS = "y AS (SELECT o_orderpriority AS code, year(o_orderdate) AS y, sum(o_totalprice) AS v, count(*) AS n FROM orders WHERE year(o_orderdate) IN (1996, 1997) GROUP BY 1, 2)"


def _years(spark, sf_dir):
    order = fixture.read(spark, sf_dir, "orders").where(F.year("o_orderdate").isin(1996, 1997))
    return order.groupBy(F.col("o_orderpriority").alias("code"), F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("output"), F.count(F.lit(1)).cast("double").alias("workers"))


@query(f"WITH {YEARS}, g AS (SELECT b.code, (b.v / b.n) / (a.v / a.n) - 1 AS g FROM y a JOIN y b ON a.code = b.code AND a.y = 1996 AND b.y = 1997) SELECT code, round(g, 9) AS growth, g < 0 OR g > 0.1 AS flagged FROM g")
def labour_productivity(spark, sf_dir):
    """Order value per order as output per worker."""
    y = _years(spark, sf_dir)
    return diagnostics.productivity(y.where("y = 1997"), y.where("y = 1996")).select("code", (F.round("growth", 9) + 0.0).alias("growth"), "flagged")


@query(f"WITH {YEARS}, g AS (SELECT b.code, 100 * b.v / a.v - 100.0 * b.n / a.n AS g FROM y a JOIN y b ON a.code = b.code AND a.y = 1996 AND b.y = 1997) SELECT code, round(g, 7) AS gap, abs(g) > 5 AS flagged FROM g")
def volume_coherence(spark, sf_dir):
    y = _years(spark, sf_dir)
    both = y.where("y = 1997").join(y.where("y = 1996").select("code", F.col("output").alias("o0"), F.col("workers").alias("w0")), "code")
    index = lambda a, b: both.select("code", (100 * F.col(a) / F.col(b)).alias("volume"))
    return diagnostics.volume_coherence(index("output", "o0"), index("workers", "w0")).select("code", (F.round("gap", 7) + 0.0).alias("gap"), "flagged")


@query("""WITH g AS (SELECT n_name AS code, sum(c_acctbal) AS gap, sum(abs(c_acctbal)) AS scale, count(*) % 2 = 0 AS fired FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT code, round(gap, 4) AS gap, CASE WHEN abs(gap) <= 1 + 0.001 * abs(scale) AND NOT fired THEN 'automatic' WHEN abs(gap) > 1 + 0.001 * abs(scale) THEN 'too large' ELSE 'diagnostic fired' END AS verdict FROM g""")
def discrepancy_triage(spark, sf_dir):
    buyer = fixture.read(spark, sf_dir, "customer").join(fixture.read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    gaps = buyer.groupBy(F.col("n_name").alias("code")).agg(F.sum("c_acctbal").alias("gap"), F.sum(F.abs("c_acctbal")).alias("scale"), (F.count(F.lit(1)) % 2 == 0).alias("fired"))
    return diagnostics.triage(gaps).select("code", v("gap", 4, "gap"), "verdict")


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1, 2")
def streamed_daily_flows(spark, sf_dir):
    """An extension: the flow of events by day, read as a stream and drained."""
    return stream.daily_flows(spark, sf_dir).select("event_type", F.col("day").cast("timestamp_ntz").alias("day"), "n", v("value", 6))
