"""Accounting identities as queries: each gives rows (name, key, gap, passed)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.functions.precision import close


def check(df: DataFrame, name: str, key: str | Column, left: Column, right: Column, absolute: float = 1e-6) -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    return df.select(F.lit(name).alias("name"), key.cast("string").alias("key"), (left - right).alias("gap"), close(left, right, absolute).alias("passed"))


def zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def sums(cells: DataFrame, by: str, name: str) -> DataFrame:
    return cells.groupBy(F.col(by).alias("k")).agg(F.sum("value").alias(name))


def aligned(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b, "k", "full"), parts)


def product_balance(output: DataFrame, additions: DataFrame, use: DataFrame, final: DataFrame) -> DataFrame:
    """ID-01: output, imports, margins and net taxes of a product equal its uses. All frames: (p, value)."""
    df = aligned(sums(output, "p", "o"), sums(additions, "p", "m"), sums(use, "p", "u"), sums(final, "p", "f"))
    return check(df, "ID-01", "k", zero("o") + zero("m"), zero("u") + zero("f"), 1e-3)


def industry_identity(inputs: DataFrame, added: DataFrame, output: DataFrame) -> DataFrame:
    """ID-02: intermediate consumption and value added make output. Frames: (a, value)."""
    df = aligned(sums(inputs, "a", "ic"), sums(added, "a", "va"), sums(output, "a", "x"))
    return check(df, "ID-02", "k", zero("ic") + zero("va"), zero("x"), 1e-3)


def value_added_parts(added: DataFrame, parts: DataFrame) -> DataFrame:
    """ID-03: value added is the sum of its components. Frames: (a, value)."""
    return check(aligned(sums(added, "a", "va"), sums(parts, "a", "s")), "ID-03", "k", zero("va"), zero("s"), 1e-3)


def gdp(production: Column, expenditure: Column, income: Column | None, df: DataFrame) -> DataFrame:
    """ID-06: gross product by production, expenditure and, where given, income."""
    ways = [production, expenditure, *([income] if income is not None else [])]
    return check(df, "ID-06", F.lit("total"), F.greatest(*ways), F.least(*ways), 1e-3)


def supply_totals(v: DataFrame, q: DataFrame, g: DataFrame) -> DataFrame:
    """ID-07: supply by product and by industry are the row and column sums of V."""
    rows = check(aligned(sums(v, "p", "s"), sums(q, "p", "q")), "ID-07 products", "k", zero("s"), zero("q"), 1e-3)
    return rows.unionByName(check(aligned(sums(v, "a", "s"), sums(g, "a", "g")), "ID-07 industries", "k", zero("s"), zero("g"), 1e-3))


def sums_to_zero(values: DataFrame, name: str = "ID-08") -> DataFrame:
    """ID-08, ID-10: margins, and cif/fob adjustments, cancel; the tolerance follows their size."""
    df = values.agg(F.sum("value").alias("s"), F.sum(F.abs("value")).alias("mass"))
    return df.select(F.lit(name).alias("name"), F.lit("total").alias("key"), zero("s").alias("gap"), (F.abs(zero("s")) <= 1e-6 + 1e-9 * zero("mass")).alias("passed"))


def table_balance(residuals: DataFrame) -> DataFrame:
    """ID-11 and ID-18: a symmetric table's rows and columns add up to output (see table.balance)."""
    row = residuals.select(F.lit("ID-11 rows").alias("name"), F.col("i").cast("string").alias("key"), F.col("row_residual").alias("gap"), (F.abs("row_residual") <= 1e-3).alias("passed"))
    return row.unionByName(residuals.select(F.lit("ID-11 columns").alias("name"), F.col("i").cast("string").alias("key"), F.col("col_residual").alias("gap"), (F.abs("col_residual") <= 1e-3).alias("passed")))


def leontief_solution(inverse: DataFrame, final: DataFrame, x: DataFrame) -> DataFrame:
    """ID-12: the inverse times final demand gives output. final: (table_id, i, value), one row per sector."""
    made = inverse.join(final.select("table_id", F.col("i").alias("j"), F.col("value").alias("f")), ["table_id", "j"]).groupBy("table_id", "i").agg(F.sum(F.col("value") * F.col("f")).alias("made"))
    df = x.join(made, ["table_id", "i"], "left")
    top = F.lit(1e-6)
    return df.select(F.lit("ID-12").alias("name"), F.col("i").cast("string").alias("key"), (zero("made") - F.col("value")).alias("gap"), (F.abs(zero("made") - F.col("value")) <= top + 1e-9 * F.abs("value")).alias("passed"))


def intermediate_totals(u: DataFrame, inputs: DataFrame) -> DataFrame:
    """ID-14: use by industry adds up to the intermediate consumption stated for it (which must be given)."""
    return check(aligned(sums(u, "a", "u"), sums(inputs, "a", "ic")), "ID-14", "k", zero("u"), zero("ic"), 1e-3)


def margin_column(margins: DataFrame, services: DataFrame) -> DataFrame:
    """ID-19: a margin column cancels, is not positive on margin services (p) and not negative elsewhere. margins: (p, value)."""
    service = F.coalesce("_service", F.lit(False))
    wrong = margins.join(services.select("p", F.lit(True).alias("_service")).distinct(), "p", "left")
    wrong = wrong.where((service & (F.col("value") > 1e-6)) | (~service & (F.col("value") < -1e-6)))
    sign = wrong.agg(F.count(F.lit(1)).alias("n")).select(F.lit("ID-19 signs").alias("name"), F.lit("total").alias("key"), F.col("n").cast("double").alias("gap"), (F.col("n") == 0).alias("passed"))
    return sums_to_zero(margins, "ID-19").unionByName(sign)


def structural_zero(cells: DataFrame, name: str) -> DataFrame:
    """A block that has to be empty: its largest absolute value is within 1e-6."""
    df = cells.agg(F.coalesce(F.max(F.abs("value")), F.lit(0.0)).alias("m"))
    return df.select(F.lit(name).alias("name"), F.lit("block").alias("key"), F.col("m").alias("gap"), (F.col("m") <= 1e-6).alias("passed"))


def report(checks: DataFrame) -> DataFrame:
    """Rows, failures and largest gap by check, and whether it holds."""
    return checks.groupBy("name").agg(F.count(F.lit(1)).alias("rows"), F.sum((~F.col("passed")).cast("long")).alias("failed"), F.max(F.abs("gap")).alias("worst"), F.bool_and("passed").alias("passed"))


def margins_attained(cells: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Whether a balanced table has the totals asked for, as closely as they permit: one row a side. Not an accounting identity.

    cells: (i, j, value); rows: (i, value); cols: (j, value).
    """
    from saldo.functions.precision import margin_floors

    def side(at: str, goal: DataFrame) -> DataFrame:
        made = aligned(sums(cells, at, "made"), sums(goal, at, "goal"))
        return made.select(F.lit(f"SOLVER {'rows' if at == 'i' else 'columns'}").alias("name"), F.abs(zero("made") - zero("goal")).alias("off"))

    off = side("i", rows).unionByName(side("j", cols)).join(margin_floors(rows, cols))  # one row of floors
    return off.groupBy("name", "gap", "floor", "tolerance").agg(
        F.max("off").alias("worst"), F.sum((F.col("off") > F.col("tolerance")).cast("long")).alias("failed"), F.bool_and(F.col("off") <= F.col("tolerance")).alias("passed")
    )


def cif_fob_totals(cif: DataFrame, fob: DataFrame) -> DataFrame:
    """ID-10, second part: imports add up to the same at cif and at fob prices. Frames: (value)."""
    one = cif.agg(F.sum("value").alias("c")).join(fob.agg(F.sum("value").alias("f")))  # one row each
    return check(one, "ID-10 totals", F.lit("total"), zero("c"), zero("f"))


def value_added_preserved(before: DataFrame, after: DataFrame, by_industry: bool) -> DataFrame:
    """ID-13: a transformation by industries leaves the value-added block as it was, one by products its total. Frames: (r, j, value)."""
    if by_industry:
        both = before.select("r", "j", F.col("value").alias("b")).join(after.select("r", "j", F.col("value").alias("a")), ["r", "j"], "full")
        return check(both, "ID-13 cells", F.concat_ws(":", F.col("r").cast("string"), F.col("j").cast("string")), zero("b"), zero("a"))
    one = before.agg(F.sum("value").alias("b")).join(after.agg(F.sum("value").alias("a")))  # one row each
    return check(one, "ID-13 total", F.lit("total"), zero("b"), zero("a"))


def valuation_matrix(column: DataFrame, matrix: DataFrame) -> DataFrame:
    """ID-15: a product's margins or taxes in the supply table are the total of its valuation matrix over users.

    column: (p, value); matrix: (p, c, value). The tolerance follows the matrix row's gross size, as rows may cancel.
    """
    made = matrix.groupBy(F.col("p").alias("k")).agg(F.sum("value").alias("m"), F.sum(F.abs("value")).alias("mass"))
    df = sums(column, "p", "c").join(made, "k", "full")
    gap = zero("c") - zero("m")
    return df.select(F.lit("ID-15").alias("name"), F.col("k").cast("string").alias("key"), gap.alias("gap"), (F.abs(gap) <= 1e-6 + 1e-9 * zero("mass")).alias("passed"))


def income_approach(production: DataFrame, surplus: DataFrame, wages: DataFrame, taxes: DataFrame, subsidies: DataFrame | None = None) -> DataFrame:
    """ID-17: surplus, wages and other taxes less other subsidies on production make gross value added. Frames: (a, value).

    Where surplus was itself the balancing item the identity holds by construction and tests nothing.
    """
    parts = [sums(production, "a", "gva"), sums(surplus, "a", "s"), sums(wages, "a", "w"), sums(taxes, "a", "t")]
    df = aligned(*parts, *([sums(subsidies, "a", "b")] if subsidies is not None else []))
    return check(df, "ID-17", "k", zero("s") + zero("w") + zero("t") - (zero("b") if subsidies is not None else F.lit(0.0)), zero("gva"))
