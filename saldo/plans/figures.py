"""Registered queries of report figures, solver tolerances, further identities, satellites and projections, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from saldo.functions import precision
from saldo.operators import balance, identities, metrics, regional, split, sut, table
from saldo.plans.registry import ACTIVITY, BENT, BLOCK, CLOSED, DECIMALS, FLOW, INNER, INVERSE, PARENT, QUERIES, ORACLE_SQL, PARTS, RAS, SEED, SUT, WEIGHTS, _values, bent, io, query, seeded, square, type_ii, v, weights
from saldo.sources import fixture

__all__ = ["ORACLE_SQL", "QUERIES"]


def inverse_of(t):
    return table.leontief_inverse(table.coefficients(t.z, t.x), t.x)


def plus(c, digits):
    """Rounded, without a negative zero."""
    return (F.round(c, digits) + 0.0).alias(c)


# --- figures of the report ----------------------------------------------------

PARTS_SQL = f"""part AS (SELECT idx FROM sector WHERE region_id = (SELECT region_id FROM sector WHERE idx = {PARENT})),
st AS (SELECT x.i, x.v AS output, coalesce((SELECT sum(v) FROM z WHERE z.i = x.i), 0) AS sales, coalesce((SELECT sum(v) FROM y WHERE y.i = x.i), 0) AS final, (SELECT sum(v) FROM va WHERE va.j = x.i) AS added, coalesce((SELECT sum(v) FROM z WHERE z.j = x.i), 0) AS purchases FROM x JOIN part ON part.idx = x.i)"""


def _parts(spark, sf_dir):
    t = io(spark, sf_dir)
    home = t.sector.where(F.col("idx") == PARENT).select("table_id", "region_id")
    parts = t.sector.join(home, ["table_id", "region_id"], "left_semi").select(F.col("idx").alias("i"))
    return metrics.subsector_table(t.z, t.y, t.va, t.x, table.multipliers(table.coefficients(t.z, t.x), t.x), parts)


@query(f"WITH RECURSIVE {FLOW}, {INVERSE}, {PARTS_SQL} SELECT st.i, round(output, 4) AS output, round(sales, 4) AS sales, round(final, 4) AS final, round(added, 4) AS added, round(purchases, 4) AS purchases, round((SELECT sum(v) FROM l WHERE l.j = st.i), 8) AS multiplier FROM st")
def subsector_table(spark, sf_dir):
    """The sectors of the split sector's region as parts."""
    return _parts(spark, sf_dir).select("i", *[v(c, 4, c) for c in ("output", "sales", "final", "added", "purchases")], v("multiplier", 8, "multiplier"))


@query(f"WITH {FLOW}, {PARTS_SQL} SELECT i, round(output / 100, 5) AS output, round(added / 100, 5) AS added, round(purchases / 100, 5) AS purchases FROM st")
def size_per_percent(spark, sf_dir):
    return metrics.size_per_percent(_parts(spark, sf_dir)).select("i", *[v(c, 5, c) for c in ("output", "added", "purchases")])


@query("""WITH k AS (SELECT o_orderpriority AS key_id, max(year(o_orderdate)) AS y, CASE WHEN count(*) > (SELECT count(*) / 5 FROM orders) THEN 'strong' ELSE 'weak' END AS strength FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1),
u AS (SELECT DISTINCT c_mktsegment AS block, CASE WHEN c_mktsegment < 'C' THEN '1-URGENT' WHEN c_mktsegment < 'H' THEN '3-MEDIUM' ELSE '5-LOW' END AS key_id, c_mktsegment >= 'H' AS inherited FROM customer)
SELECT block, u.key_id, CASE WHEN inherited THEN 'inherited' ELSE 'chosen' END AS origin, coalesce(strength, 'unstated') AS strength, y - 1997 AS gap, CASE WHEN y IS NULL THEN 'unknown' WHEN y = 1997 THEN 'same year' ELSE 'other year' END AS verdict FROM u LEFT JOIN k ON k.key_id = u.key_id""")
def key_vintages(spark, sf_dir):
    """Order priorities as keys of market segments; the last priority is a key that no year is known of."""
    order = fixture.read(spark, sf_dir, "orders")
    fifth = order.agg((F.count(F.lit(1)) / 5).cast("long").alias("fifth"))  # one row
    keys = order.where("o_orderpriority <> '5-LOW'").groupBy(F.col("o_orderpriority").alias("key_id")).agg(F.max(F.year("o_orderdate")).alias("source_year"), F.count(F.lit(1)).alias("n")).join(fifth)
    keys = keys.select("key_id", "source_year", F.when(F.col("n") > F.col("fifth"), "strong").otherwise("weak").alias("strength"))
    seg = F.col("block")
    used = fixture.read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("block")).distinct()
    used = used.select("block", F.when(seg < "C", "1-URGENT").when(seg < "H", "3-MEDIUM").otherwise("5-LOW").alias("key_id"), (seg >= "H").alias("inherited"))
    return metrics.vintage_gaps(used, keys, 1997)


@query(f"WITH RECURSIVE {FLOW}, {INVERSE}, {CLOSED}, m1 AS (SELECT j, sum(v) AS v FROM l GROUP BY 1) SELECT m1.j, round(m1.v, 7) AS type_i, round(m2.v, 7) AS type_ii, round(m2.v / m1.v - 1, 7) AS uplift FROM m1 JOIN m2 ON m2.j = m1.j")
def type2_uplift(spark, sf_dir):
    """Type I beside type II multipliers, with half of value added as income."""
    t = io(spark, sf_dir)
    second = type_ii(spark, sf_dir)
    return metrics.type_ii_uplift(table.multipliers(table.coefficients(t.z, t.x), t.x), second).select("j", plus("type_i", 7), plus("type_ii", 7), plus("uplift", 7))


@query(f"""WITH RECURSIVE {FLOW}, {INVERSE}, jobs AS (SELECT s_nationkey AS i, count(*) AS e FROM supplier GROUP BY 1), d AS (SELECT x.i, jobs.e / x.v AS d FROM jobs JOIN x ON x.i = jobs.i),
  tot AS (SELECT l.j, sum(d.d * l.v) AS t FROM l JOIN d ON d.i = l.i GROUP BY 1) SELECT tot.j, round(1 - d.d / tot.t, 8) AS indirect FROM tot JOIN d ON d.i = tot.j""")
def indirect_share(spark, sf_dir):
    t = io(spark, sf_dir)
    jobs = fixture.read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("i")).agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("table_id", F.lit(fixture.TABLE_ID))
    return metrics.indirect_share(table.satellite_effects(jobs, t.x, inverse_of(t))).select("j", plus("indirect", 8))


@query(f"WITH RECURSIVE {FLOW}, {INVERSE}, {BLOCK} SELECT l.j, CAST(b.b AS INTEGER) AS block, round(sum(l.v) / (SELECT sum(v) FROM l q WHERE q.j = l.j), 8) AS share FROM l JOIN b ON b.idx = l.i GROUP BY 1, 2 HAVING sum(l.v) > 1e-15")
def impulse_landing(spark, sf_dir):
    """Share of what demand for a sector sets off in the parent, the rest of its region, and the other regions."""
    t = io(spark, sf_dir)
    home = t.sector.where(F.col("idx") == PARENT).select("table_id", F.col("region_id").alias("home"))
    blocks = t.sector.join(home, "table_id", "left").select("idx", F.when(F.col("idx") == PARENT, 0).when(F.col("region_id") == F.col("home"), 1).otherwise(2).alias("block"))
    return metrics.landings(inverse_of(t), blocks).where("share > 1e-15").select("j", "block", plus("share", 8))


@query(f"""WITH RECURSIVE {FLOW}, {INVERSE}, o AS (SELECT sj.region_id AS origin, si.region_id AS dest, sum(l.v) AS v FROM l JOIN sector si ON si.idx = l.i JOIN sector sj ON sj.idx = l.j WHERE si.region_id <> sj.region_id GROUP BY 1, 2),
r AS (SELECT *, v / sum(v) OVER (PARTITION BY origin) AS share, row_number() OVER (PARTITION BY origin ORDER BY v DESC, dest) AS rank FROM o) SELECT origin, dest AS "to", round(share, 8) AS share, rank FROM r WHERE rank <= 5""")
def top_receivers(spark, sf_dir):
    t = io(spark, sf_dir)
    return metrics.top_receivers(inverse_of(t), t.sector).select("origin", "to", plus("share", 8), F.col("rank").cast("long").alias("rank"))


@query("""WITH s AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS scenario, o_orderpriority AS code, count(*)::DOUBLE AS n, sum(o_totalprice) AS p, max(o_totalprice) AS m FROM orders GROUP BY 1, 2),
w AS (SELECT scenario, code, n / sum(n) OVER q AS n, p / sum(p) OVER q AS p, m / sum(m) OVER q AS m FROM s WINDOW q AS (PARTITION BY scenario)),
g AS (SELECT scenario, 'price' AS key_id, max(abs((n - p) / p)) AS gap FROM w GROUP BY 1 UNION ALL SELECT scenario, 'largest', max(abs((n - m) / m)) FROM w GROUP BY 1)
SELECT scenario, arg_min(key_id, gap) AS best, round(min(gap), 8) AS least, arg_max(key_id, gap) AS worst, round(max(gap), 8) AS most, count(*) AS keys FROM g GROUP BY 1""")
def evidence_spread(spark, sf_dir):
    """A scenario a year: counts as the key used, sums and largest prices as keys that were not."""
    by = fixture.read(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("string").alias("scenario"), F.col("o_orderpriority").alias("code"))
    rows = by.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("o_totalprice").alias("p"), F.max("o_totalprice").cast("double").alias("m"))
    own = table.Window.partitionBy("scenario")
    w = rows.select("scenario", "code", *[(F.col(c) / F.sum(c).over(own)).alias(c) for c in "npm"])
    gaps = F.explode(F.array(*[F.struct(F.lit(name).alias("key_id"), ((F.col("n") - F.col(c)) / F.col(c)).alias("gap")) for name, c in (("price", "p"), ("largest", "m"))]))
    return metrics.evidence_spread(w.select("scenario", gaps.alias("g")).select("scenario", "g.key_id", "g.gap")).select("scenario", "best", plus("least", 8), "worst", plus("most", 8), "keys")


@query("SELECT r_name AS code, count(DISTINCT p_size % 3 + r_regionkey) AS parts, CASE WHEN count(DISTINCT p_size % 3 + r_regionkey) <= 2 THEN 5.4 ELSE 10.6 END::DOUBLE AS median_pct, CASE WHEN count(DISTINCT p_size % 3 + r_regionkey) <= 2 THEN 41.6 ELSE 49.2 END::DOUBLE AS worst_pct FROM region JOIN part ON p_partkey % 5 = r_regionkey AND (r_regionkey > 1 OR p_size % 3 < 2) GROUP BY 1")
def risk_band(spark, sf_dir):
    """Regions split into two or three parts."""
    region, part = fixture.read(spark, sf_dir, "region"), fixture.read(spark, sf_dir, "part")
    both = part.withColumn("r_regionkey", (F.col("p_partkey") % 5).cast("int")).join(region, "r_regionkey").where("r_regionkey > 1 OR p_size % 3 < 2")
    return metrics.risk_band(both.select(F.col("r_name").alias("code"), (F.col("p_size") % 3 + F.col("r_regionkey")).alias("part")))


@query("""SELECT n_name AS geo, route, CASE WHEN route = 'iot' AND n_regionkey < 2 THEN 'loads' WHEN route = 'sut' AND n_regionkey = 3 THEN 'refused: incomplete' ELSE 'never tried' END AS verdict FROM nation, (VALUES ('iot'), ('sut')) r(route)""")
def load_verdicts(spark, sf_dir):
    nation = fixture.read(spark, sf_dir, "nation")
    wanted = nation.select(F.col("n_name").alias("geo"), F.explode(F.array(F.lit("iot"), F.lit("sut"))).alias("route"))
    recorded = nation.where("n_regionkey < 2").select(F.col("n_name").alias("geo"), F.lit("iot").alias("route"), F.lit("loads").alias("verdict"))
    recorded = recorded.unionByName(nation.where("n_regionkey = 3").select(F.col("n_name").alias("geo"), F.lit("sut").alias("route"), F.lit("refused: incomplete").alias("verdict")))
    return metrics.load_verdicts(wanted, recorded)


@query("""WITH t AS (SELECT p_brand AS code, sum(p_retailprice) AS total, sum(p_retailprice * CASE WHEN p_brand < 'Brand#20' THEN 1 WHEN p_brand < 'Brand#30' THEN 1.2 WHEN p_brand < 'Brand#40' THEN 0.9 ELSE 1.01 END) AS parts FROM part GROUP BY 1)
SELECT code, CASE WHEN abs(parts - total) <= 0.01 THEN 'adds up' WHEN parts / total > 1.05 THEN 'mixes levels' WHEN parts / total < 0.999 THEN 'incomplete' ELSE 'components disagree' END AS verdict FROM t""")
def tiling_verdicts(spark, sf_dir):
    brand = F.col("p_brand")
    factor = F.when(brand < "Brand#20", 1.0).when(brand < "Brand#30", 1.2).when(brand < "Brand#40", 0.9).otherwise(1.01)
    t = fixture.read(spark, sf_dir, "part").groupBy(brand.alias("code")).agg(F.sum("p_retailprice").alias("total"), F.sum(F.col("p_retailprice") * factor).alias("parts"))
    return t.select("code", metrics.tiling_verdict(F.col("parts"), F.col("total"), F.lit(0.01)).alias("verdict"))


@query(f"WITH {FLOW} SELECT i, c, round(v, 4) AS value, c IN ('DEAD', 'FURNITURE') AS may_flip FROM y")
def flip_whitelist(spark, sf_dir):
    listed = spark.createDataFrame([("DEAD",), ("FURNITURE",)], "label string")
    return metrics.flip_allowed(io(spark, sf_dir).y, "c", listed).select("i", "c", v("value"), "may_flip")


@query(f"""WITH RECURSIVE {FLOW}, {INVERSE}, om AS (SELECT j AS i, sum(v) AS om FROM l GROUP BY 1), rm AS (SELECT i AS j, sum(v) AS rm FROM l GROUP BY 1),
 e AS (SELECT a.i, a.j, 0.01 * a.v * om.om * rm.rm AS f, 0.01 * a.v * l.v AS t FROM a JOIN om ON om.i = a.i JOIN rm ON rm.j = a.j JOIN l ON l.i = a.j AND l.j = a.i),
 k AS (SELECT row_number() OVER (ORDER BY f, i, j) AS ra, row_number() OVER (ORDER BY f / (1 - t), i, j) AS rb, row_number() OVER (ORDER BY f DESC, i, j) AS da, row_number() OVER (ORDER BY f / (1 - t) DESC, i, j) AS db FROM e)
SELECT round(corr(ra, rb), 9) AS spearman, coalesce(min(least(da, db)) FILTER (da <> db), 0) AS first_disagreement FROM k""")
def rank_comparison(spark, sf_dir):
    """Cells ranked by their first-order and by their exact importance."""
    t = io(spark, sf_dir)
    cells = table.cell_importance(t.z, t.x, inverse_of(t), top=2**31 - 1)
    return metrics.rank_agreement(cells.select("i", "j", F.col("first").alias("a"), F.col("exact").alias("b")), ["i", "j"]).select(plus("spearman", 9), "first_disagreement")


@query(f"""WITH {FLOW}, s AS (SELECT p.idx AS p, q.idx AS q, xp.v / (xp.v + xq.v) AS r, coalesce(pp.v, 0) + coalesce(qq.v, 0) AS inside, coalesce(pq.v, 0) + coalesce(qp.v, 0) AS across FROM sector p JOIN sector q ON q.region_id = p.region_id AND p.idx < q.idx
  JOIN x xp ON xp.i = p.idx JOIN x xq ON xq.i = q.idx LEFT JOIN z pp ON pp.i = p.idx AND pp.j = p.idx LEFT JOIN z qq ON qq.i = q.idx AND qq.j = q.idx LEFT JOIN z pq ON pq.i = p.idx AND pq.j = q.idx LEFT JOIN z qp ON qp.i = q.idx AND qp.j = p.idx)
SELECT p, q, round(inside / ((r * r + (1 - r) * (1 - r)) * (inside + across)), 8) AS alpha, round(across / ((1 - (r * r + (1 - r) * (1 - r))) * (inside + across)), 8) AS beta FROM s WHERE inside + across > 0""")
def sibling_blocks(spark, sf_dir):
    t = io(spark, sf_dir)
    return metrics.sibling_blocks(t.z, t.x, t.sector).select("p", "q", plus("alpha", 8), plus("beta", 8))


@query()
def rounding_probe(spark, sf_dir):
    """How far the inverse of market shares moves within the rounding of a table printed in thousands."""
    s = square(fixture.supply_use(spark, sf_dir))[0].toPandas()  # at most a few products by as many regions
    grid = s.pivot_table(index="a", columns="p", values="value", aggfunc="sum", fill_value=0.0)
    own = (grid / 1000).round(0) + 10 * (grid.max().max() / 1000) * (grid.index.to_numpy()[:, None] == range(grid.shape[1]))
    return metrics.rounding_probe(spark, own.to_numpy(float), 0.5, 400)


# --- tolerances and identities ------------------------------------------------


@query(f"WITH {DECIMALS}, m AS (SELECT source, sum(abs(v)) AS mass FROM vals GROUP BY 1) SELECT count(*) AS populations, round(sum(CASE WHEN decimals IS NOT NULL THEN 0.5 * pow(10, -decimals) * n.n ELSE n.n * 2.220446049250313e-16 * mass END), 9) AS tolerance FROM pd JOIN m ON m.source = pd.source JOIN (VALUES ('retail', 9), ('balance', 4), ('size', 1)) n(source, n) ON n.source = pd.source")
def tolerance_mixed(spark, sf_dir):
    values = _values(spark, sf_dir).withColumnRenamed("source", "population")
    terms = spark.createDataFrame([("retail", 9), ("balance", 4), ("size", 1)], "population string, terms int")
    return precision.mixed_floor(values, terms).select("populations", plus("tolerance", 9))


SIDES = """off AS (SELECT 'SOLVER rows' AS name, abs(sum(c.v) - any_value(g.g)) AS off FROM {cells} c JOIN gi g ON g.k = c.i GROUP BY c.i UNION ALL SELECT 'SOLVER columns', abs(sum(c.v) - any_value(g.g)) FROM {cells} c JOIN gj g ON g.k = c.j GROUP BY c.j),
b AS (SELECT 1 AS s, g FROM gi UNION ALL SELECT -1, g FROM gj), f AS (SELECT sum(s * g) AS gap, count(*) AS mn, 1e-6 + 1e-9 * max(abs(g)) AS flat FROM b),
tol AS (SELECT CASE WHEN abs(gap) / mn <= flat THEN flat ELSE greatest(flat, 10 * abs(gap) / mn) END AS tol FROM f)
SELECT name, round(max(off), 2) AS worst, count(*) FILTER (off > tol) AS failed, count(*) FILTER (off > tol) = 0 AS passed, round(any_value(tol), 4) AS tolerance FROM off, tol GROUP BY name"""


def _attained(df):
    return df.select("name", v("worst", 2, "worst"), "failed", "passed", v("tolerance", 4, "tolerance"))


@query(f"WITH {FLOW}, {BENT}, {RAS}, gi AS (SELECT i AS k, 1.1 * sum(v) AS g FROM z GROUP BY 1), gj AS (SELECT j AS k, 1.1 * sum(v) AS g FROM z GROUP BY 1), {SIDES.format(cells='c5')}")
def margins_after_rounds(spark, sf_dir):
    """Five rounds of RAS meet the columns and not yet the rows: the check says so."""
    cells, rows, cols = bent(io(spark, sf_dir))
    return _attained(identities.margins_attained(balance.ras_rounds(cells, rows, cols, 5), rows, cols))


@query(f"WITH {FLOW}, gi AS (SELECT i AS k, 1.1 * sum(v) AS g FROM z GROUP BY 1), gj AS (SELECT j AS k, 1.2 * sum(v) AS g FROM z GROUP BY 1), half AS (SELECT i, j, 1.15 * v AS v FROM z), {SIDES.format(cells='half')}")
def margins_inconsistent(spark, sf_dir):
    """Targets whose sums differ: the tolerance widens to what they force."""
    z = io(spark, sf_dir).z
    rows, cols = (z.groupBy(k).agg((f * F.sum("value")).alias("value")) for k, f in (("i", 1.1), ("j", 1.2)))
    return _attained(identities.margins_attained(z.withColumn("value", 1.15 * F.col("value")), rows, cols))


def _report(checks):
    return identities.report(checks).select("name", "rows", "failed", "passed", v("worst", 3, "worst"))


REPORT = "SELECT name, count(*) AS rows, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (NOT ok) = 0 AS passed, round(max(abs(gap)), 3) AS worst FROM c GROUP BY name"


@query(f"WITH {FLOW}, n AS (SELECT j, v, CASE WHEN j = {PARENT} THEN 1.5 * v ELSE v END AS a FROM va), g AS (SELECT 'ID-13 cells' AS name, v - a AS gap, greatest(abs(v), abs(a)) AS top FROM n UNION ALL SELECT 'ID-13 total', sum(v) - sum(a), greatest(abs(sum(v)), abs(sum(a))) FROM n), c AS (SELECT *, abs(gap) <= 1e-6 + 1e-9 * top AS ok FROM g) {REPORT}")
def id13_value_added(spark, sf_dir):
    """A transformation that moved one industry's value added: both forms of the identity fail, the first in one cell."""
    va = io(spark, sf_dir).va
    after = va.withColumn("value", F.when(F.col("j") == PARENT, 1.5 * F.col("value")).otherwise(F.col("value")))
    return _report(identities.value_added_preserved(va, after, True).unionByName(identities.value_added_preserved(va, after, False)))


TAXES = "SELECT p_type AS p, c_mktsegment AS c, sum(l_extendedprice * l_tax) AS v FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"


@query(f"WITH t AS ({TAXES}), s AS (SELECT p, sum(v) AS v FROM t GROUP BY 1), m AS (SELECT p, sum(v) AS m, sum(abs(v)) AS mass FROM t WHERE NOT (p = 'PROMO' AND c = 'BUILDING') GROUP BY 1), c AS (SELECT 'ID-15' AS name, s.v - m.m AS gap, abs(s.v - m.m) <= 1e-6 + 1e-9 * mass AS ok FROM s JOIN m ON m.p = s.p) {REPORT}")
def id15_valuation_matrix(spark, sf_dir):
    """Taxes by product against their matrix by users, one of whose cells is missing."""
    item = fixture.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_extendedprice") * F.col("l_tax")).alias("value"))
    part = fixture.read(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("p"))
    taxed = item.join(part, F.col("l_partkey") == F.col("p_partkey"))
    matrix = taxed.join(fixture._buyers(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("p", F.col("seg").alias("c")).agg(F.sum("value").alias("value"))
    column = taxed.groupBy("p").agg(F.sum("value").alias("value"))
    return _report(identities.valuation_matrix(column, matrix.where("NOT (p = 'PROMO' AND c = 'BUILDING')")))


@query(f"""WITH i AS (SELECT l_suppkey % 25 AS a, sum(l_extendedprice) AS g, sum(l_extendedprice * (1 - l_discount)) AS s, sum(l_extendedprice * l_discount) AS d FROM lineitem GROUP BY 1),
g AS (SELECT s + 0.5 * d + 0.6 * d - CASE WHEN a = 3 THEN 0 ELSE 0.1 * d END - g AS gap, g FROM i), c AS (SELECT 'ID-17' AS name, gap, abs(gap) <= 1e-6 + 1e-9 * abs(g) AS ok FROM g) {REPORT}""")
def id17_income_approach(spark, sf_dir):
    """Production of suppliers' groups from its income side; one group's subsidies are missing."""
    base = fixture.read(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 25).alias("a")).agg(F.sum("l_extendedprice").alias("g"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("s"), F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("d"))
    part = lambda e: base.select("a", F.expr(e).alias("value"))
    return _report(identities.income_approach(part("g"), part("s"), part("0.5D * d"), part("0.6D * d"), part("CASE WHEN a = 3 THEN 0D ELSE 0.1D * d END")))


@query(f"WITH g AS (SELECT sum(l_extendedprice) - sum(l_extendedprice * (1 - l_discount)) AS gap, sum(l_extendedprice) AS top FROM lineitem), c AS (SELECT 'ID-10 totals' AS name, gap, abs(gap) <= 1e-6 + 1e-9 * top AS ok FROM g) {REPORT}")
def id10_cif_fob(spark, sf_dir):
    """Prices before and after discount as cif and fob: the totals differ."""
    item = fixture.read(spark, sf_dir, "lineitem")
    return _report(identities.cif_fob_totals(item.select(F.col("l_extendedprice").alias("value")), item.select((F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"))))


TARGETS = f"SELECT 'row' AS axis, i AS k, round({{f}} * sum({{v}}), -1) AS value FROM z GROUP BY i UNION ALL SELECT 'column', j, round({{f}} * sum({{v}}), -1) FROM z GROUP BY j"


def _totals(cells):
    side = lambda axis, k: cells.groupBy(F.lit(axis).alias("axis"), F.col(k).cast("long").alias("k")).agg(F.sum("value").alias("value"))
    return side("row", "i").unionByName(side("column", "j")).select("axis", "k", v("value", -1))


@query(f"WITH {FLOW} {TARGETS.format(f=1.1, v='CASE WHEN (i + j) % 11 = 0 THEN -0.2 * v ELSE v END')}")
def gras_totals(spark, sf_dir):
    """Row and column totals after GRAS of the block with negative cells: the targets."""
    return _totals(QUERIES["gras_cells"](spark, sf_dir))


@query(f"WITH {FLOW} {TARGETS.format(f=1.1, v='v')} UNION ALL SELECT 'known', i, round(v, 4) FROM z WHERE i = j")
def mras_totals(spark, sf_dir):
    """Totals after M-RAS, and the cells it was to leave alone."""
    made = QUERIES["mras_known_cells"](spark, sf_dir)
    return _totals(made).unionByName(made.where("i = j").select(F.lit("known").alias("axis"), F.col("i").cast("long").alias("k"), v("value", 4)))


@query(f"WITH {FLOW} {TARGETS.format(f=1.1, v='v')} UNION ALL SELECT 'settled', 0, 1")
def ras_totals(spark, sf_dir):
    """Totals after RAS by joins, and whether it settled."""
    made, _, settled = balance.ras_joined(*bent(io(spark, sf_dir)))
    return _totals(made).unionByName(spark.createDataFrame([("settled", 0, float(settled))], "axis string, k long, value double"))


@query(f"WITH {FLOW}, {WEIGHTS}, {SEED}, {INNER} SELECT 'row' AS axis, part AS k, round(r, -1) AS value FROM o UNION ALL SELECT 'column', part, round(c, -1) FROM o")
def split_totals(spark, sf_dir):
    """Totals of the split's inner block after balancing: its targets."""
    made = QUERIES["split_balanced"](spark, sf_dir)
    return _totals(made.where(F.col("i").isin(*PARTS) & F.col("j").isin(*PARTS)))


# --- profiles and satellites --------------------------------------------------

SHIFT = f"""m AS (SELECT z.i, z.v, w.part, w.w, w.w * CASE WHEN z.i % 3 = w.part % 3 THEN 2.0 ELSE 1.0 END AS wm FROM z, w WHERE z.j = {PARENT} AND z.i <> {PARENT}),
sh AS (SELECT part, any_value(w) AS w, sum(v * wm / s) AS got FROM (SELECT *, sum(wm) OVER (PARTITION BY i) AS s FROM m) GROUP BY 1), tot AS (SELECT sum(v) AS t FROM z WHERE j = {PARENT} AND i <> {PARENT}), own AS (SELECT max(abs(v)) AS d FROM z WHERE i = {PARENT} AND j = {PARENT})"""


def _profile(t, w):
    return t.z.where(F.col("j") == PARENT).select("i").join(w.select("part")).where("i % 3 = part % 3").withColumn("m", F.lit(2.0))


@query(f"WITH {FLOW}, {WEIGHTS}, {SHIFT} SELECT part, round(got - w * t, 4) AS shift, round(abs(got - w * t) / d, 8) AS share_of_inner, abs(got - w * t) <= 1e-6 * greatest(abs(t), 1) AS neutral FROM sh, tot, own")
def profile_level_shift(spark, sf_dir):
    t, w = io(spark, sf_dir), weights(spark, sf_dir)
    return split.profile_shift(t.z, PARENT, w, _profile(t, w)).select(F.col("part").cast("long").alias("part"), plus("shift", 4), plus("share_of_inner", 8), "neutral")


@query(f"WITH {FLOW}, {WEIGHTS}, {SHIFT} SELECT part, round(w * t, 3) AS level, true AS neutral FROM sh, tot")
def profile_neutral(spark, sf_dir):
    """The same profile made neutral: each part's purchases are back at its weight's share."""
    t, w = io(spark, sf_dir), weights(spark, sf_dir)
    outer = t.z.where((F.col("j") == PARENT) & (F.col("i") != PARENT))
    neutral = split.neutral_profile(t.z, PARENT, w, _profile(t, w))
    bought = split.profile_shares(outer, PARENT, w, neutral.drop("table_id")).join(outer.select("table_id", "i", "value"), ["table_id", "i"])
    level = bought.groupBy("part").agg(F.sum(F.col("share") * F.col("value")).alias("level"))
    return level.join(split.profile_shift(t.z, PARENT, w, neutral.drop("table_id")).select("part", "neutral"), "part").select(F.col("part").cast("long").alias("part"), v("level", 3, "level"), "neutral")


@query(f"WITH {WEIGHTS}, s AS (SELECT s_nationkey AS i, count(*) AS v FROM supplier GROUP BY 1) SELECT i::BIGINT AS i, round(v, 9) AS value, 'observed' AS origin FROM s WHERE i <> {PARENT} UNION ALL SELECT part, round(v * w, 9), 'estimated' FROM s, w WHERE i = {PARENT}")
def split_satellites(spark, sf_dir):
    jobs = fixture.read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("i")).agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("origin", F.lit("observed"))
    return split.split_satellite(jobs, PARENT, weights(spark, sf_dir)).select(F.col("i").cast("long").alias("i"), v("value", 9), "origin")


@query("""WITH e AS (SELECT n_regionkey AS region, c_mktsegment AS code, count(*)::DOUBLE AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
r(code, dest) AS (VALUES ('AUTOMOBILE', 'C'), ('MACHINERY', 'C'), ('BUILDING', 'F'), ('FURNITURE', 'C'), ('HOUSEHOLD', 'T')), p AS (SELECT region, dest AS code, sum(v) AS v, count(*) AS n FROM e JOIN r ON r.code = e.code GROUP BY 1, 2),
s AS (SELECT region, sum(v) + CASE WHEN region = 1 THEN 40 ELSE 1 END AS stated FROM e GROUP BY 1), t AS (SELECT region, sum(v) AS made, sum(n) AS n FROM p GROUP BY 1)
SELECT p.region, p.code, CASE WHEN p.region <> 4 THEN p.v END AS value, s.stated, p.region <> 4 AND abs(made - stated) <= 0.5 * (t.n + 1) AS adds_up FROM p JOIN s ON s.region = p.region JOIN t ON t.region = p.region""")
def regional_employment(spark, sf_dir):
    """Customers as employed persons by region: one region's total is off, one was redrawn."""
    buyer = fixture.read(spark, sf_dir, "customer").join(fixture.read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    parts = buyer.groupBy(F.col("n_regionkey").alias("region"), F.col("c_mktsegment").alias("code")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    stated = parts.groupBy("region").agg((F.sum("value") + F.when(F.col("region") == 1, 40.0).otherwise(1.0)).alias("value")).select("region", F.lit("TOTAL").alias("code"), "value")
    recode = spark.createDataFrame([("AUTOMOBILE", "C"), ("MACHINERY", "C"), ("BUILDING", "F"), ("FURNITURE", "C"), ("HOUSEHOLD", "T")], "code string, to string")
    return regional.employment(parts.unionByName(stated), recode, redrawn=[4])


# --- projections --------------------------------------------------------------


def _pair(spark, sf_dir):
    """A supply-use pair with a tenth of each use imported and taxes of one percent of each column, as (cells, columns)."""
    vt, u, y = square(fixture.supply_use(spark, sf_dir))
    use = u.select("p", F.col("a").cast("string").alias("c"), "value").unionByName(y.select("p", F.col("c").cast("string").alias("c"), "value"))
    part = lambda what, f: use.select(F.lit(what).alias("what"), F.col("p").alias("r"), "c", (f * F.col("value")).alias("value"))
    supply = vt.select(F.lit("supply").alias("what"), F.col("p").alias("r"), F.col("a").cast("string").alias("c"), (0.9 * F.col("value")).alias("value"))
    taxes = use.groupBy("c").agg((0.01 * F.sum("value")).alias("value")).select(F.lit("taxes").alias("what"), F.lit(None).cast("string").alias("r"), "c", "value")
    cells = part("domestic", 0.9).unionByName(part("imported", 0.1)).unionByName(supply).unionByName(taxes)
    return cells.withColumn("table_id", F.lit("pair")), use


def _targets(*parts):
    out = None
    for kind, df in parts:
        one = df.select(F.lit("pair").alias("table_id"), F.lit(kind).alias("kind"), "code", "value")
        out = one if out is None else out.unionByName(one)
    return out


SQUARE = """sq AS (SELECT CASE WHEN p >= 'SMALL' THEN 'SMALL+' ELSE p END AS p, CAST(a AS VARCHAR) AS a, sum(v) AS v FROM sv GROUP BY 1, 2),
us AS (SELECT CASE WHEN p >= 'SMALL' THEN 'SMALL+' ELSE p END AS p, CAST(a AS VARCHAR) AS c, sum(v) AS v FROM su GROUP BY 1, 2 UNION ALL SELECT CASE WHEN p >= 'SMALL' THEN 'SMALL+' ELSE p END, c, sum(v) FROM sy GROUP BY 1, 2)"""


@query(f"WITH {SUT}, {SQUARE} SELECT 'domestic' AS block, p AS r, c, round(0.99 * v, 2) AS value FROM us UNION ALL SELECT 'imported', p, c, round(0.11 * v, 2) FROM us UNION ALL SELECT 'supply', p, a, round(0.99 * v, 2) FROM sq")
def sut_euro_project(spark, sf_dir):
    """All totals a tenth higher: the projection is the base a tenth higher, in every cell."""
    cells, use = _pair(spark, sf_dir)
    total = lambda df, by: df.groupBy(F.col(by).alias("code")).agg(F.sum("value").alias("value"))
    supply = cells.where("what = 'supply'")
    industries = supply.select("c").distinct()
    inputs = total(use.join(industries, "c", "left_semi"), "c").select("code", (1.01 * F.col("value")).alias("used"))
    gva = total(supply, "c").join(inputs, "code", "left").select("code", (1.1 * (F.col("value") - F.coalesce("used", F.lit(0.0)))).alias("value"))
    final = total(use.join(industries, "c", "left_anti"), "c").select("code", (1.1 * 1.01 * F.col("value")).alias("value"))
    every = use.agg(F.sum("value").alias("s")).select(F.lit("total").alias("code"), "s")
    targets = _targets(("gva", gva), ("final_use", final), ("taxes", every.select("code", (0.011 * F.col("s")).alias("value"))), ("imports", every.select("code", (0.11 * F.col("s")).alias("value"))))
    return sut.project_frames(cells, targets).where("block IN ('domestic', 'imported', 'supply')").select("block", "r", "c", v("value", 2))


@query(f"""WITH {SUT}, {SQUARE}, o AS (SELECT a, 0.9 * sum(v) * (1.05 + 0.02 * CAST(a AS INTEGER)) AS x FROM sq GROUP BY a), col AS (SELECT c, sum(v) AS u FROM us GROUP BY c), f AS (SELECT ((SELECT sum(x) FROM o) + 0.1 * 1.2 * sum(u)) / sum(u) AS f, sum(u) AS u FROM col)
SELECT 'industry' AS axis, a AS code, round(x, -1) AS value FROM o UNION ALL SELECT 'column', c, round(u * (SELECT f FROM f), -1) FROM col UNION ALL SELECT 'imports', 'total', round(0.12 * u, -1) FROM f""")
def sut_ras_project(spark, sf_dir):
    """Industries that grow apart: the projected tables have the outputs, column totals and imports asked for."""
    cells, use = _pair(spark, sf_dir)
    output = cells.where("what = 'supply'").groupBy(F.col("c").alias("code")).agg(F.sum("value").alias("value")).withColumn("value", F.col("value") * (1.05 + 0.02 * F.col("code").cast("int")))
    column = use.groupBy(F.col("c").alias("code")).agg(F.sum("value").alias("value"))
    size = column.agg(F.sum("value").alias("u")).join(output.agg(F.sum("value").alias("x")))  # one row each
    scaled = column.join(size).select("code", (F.col("value") * (F.col("x") + 0.12 * F.col("u")) / F.col("u")).alias("value"))
    imports = size.select(F.lit("total").alias("code"), (0.12 * F.col("u")).alias("value"))
    made = sut.project_frames(cells, _targets(("industry_output", output), ("use_column_totals", scaled), ("imports", imports)))
    sums = made.where("block = 'supply'").groupBy(F.lit("industry").alias("axis"), F.col("c").alias("code")).agg(F.sum("value").alias("value"))
    sums = sums.unionByName(made.where("block <> 'supply'").groupBy(F.lit("column").alias("axis"), F.col("c").alias("code")).agg(F.sum("value").alias("value")))
    return sums.unionByName(made.where("block = 'imported'").groupBy(F.lit("imports").alias("axis"), F.lit("total").alias("code")).agg(F.sum("value").alias("value"))).select("axis", "code", v("value", -1))


@query(f"""WITH {SUT}, {SQUARE}, have AS (SELECT DISTINCT 'industry_output' AS kind, a AS code FROM sq), t AS (SELECT kind, code, 1.0 AS v FROM have WHERE code <> '2' UNION ALL VALUES ('industry_output', '9', 1.0), ('industry_output', '1', 2.0)), n AS (SELECT kind, code, sum(v) AS v, count(*) AS n FROM t GROUP BY 1, 2)
SELECT coalesce(n.kind, have.kind) AS kind, coalesce(n.code, have.code) AS code, CAST(n.v AS DOUBLE) AS value, CASE WHEN have.code IS NULL THEN 'not in the table' WHEN n.code IS NULL THEN 'no target' WHEN n > 1 THEN 'repeated' END AS problem FROM n FULL JOIN have ON have.kind = n.kind AND have.code = n.code""")
def targets_aligned(spark, sf_dir):
    """Targets with one code missing, one unknown and one twice."""
    have = square(fixture.supply_use(spark, sf_dir))[0].select(F.lit("industry_output").alias("kind"), F.col("a").cast("string").alias("code")).distinct()
    odd = spark.createDataFrame([("industry_output", "9", 1.0), ("industry_output", "1", 2.0)], "kind string, code string, value double")
    return sut.align_targets(have.where("code <> '2'").withColumn("value", F.lit(1.0)).unionByName(odd), have)
