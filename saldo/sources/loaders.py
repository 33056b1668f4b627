"""Tables from grids and cubes, and the gate every loaded table passes."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from datetime import UTC, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saldo.functions import codes, precision
from saldo.functions.kernels import TableError
from saldo.operators import table as ops
from saldo.sources.fixture import SupplyUse, Table


@dataclass
class Layout:
    """Where a sheet keeps a symmetric table; rows and columns are found by label, never by place."""

    sheet: str
    header_row: int
    label_col: int
    finals: list[str]
    added: list[str]
    output: str = "Output"
    totals: list[str] = field(default_factory=list)  # printed totals: left out of the table


def gate(t: Table, inherited: float = 0.0) -> Table:
    """The table, if its rows and columns balance within what the printed decimals allow; else a refusal naming the worst lines."""
    # blocks are printed with decimals of their own: unrounded cells must not outvote rounded totals
    parts = [("z", t.z, t.x.count()), ("y", t.y, t.y.select("c").distinct().count()), ("va", t.va, t.va.select("r").distinct().count()), ("x", t.x, 1)]
    values, terms = None, t.x.sparkSession.createDataFrame([(name, max(n, 1)) for name, _, n in parts], "population string, terms int")
    for name, df, _ in parts:
        one = df.select(F.lit(name).alias("population"), "value")
        values = one if values is None else values.unionByName(one)
    floor = precision.mixed_floor(values, terms).first()
    allowed = max(1e-6, floor["tolerance"] or 0.0) + inherited
    left = ops.balance(t.z, t.y, t.va, t.x)
    worst = left.where(F.greatest(F.abs("row_residual"), F.abs("col_residual")) > allowed).orderBy(F.desc(F.greatest(F.abs("row_residual"), F.abs("col_residual")))).limit(5).collect()
    if worst:
        raise TableError(f"out of balance by more than {allowed:.3g}: " + ", ".join(f"sector {r['i']} row {r['row_residual']:.4g} column {r['col_residual']:.4g}" for r in worst))
    return t


def from_labels(cells: DataFrame, sectors: list[str], finals: list[str], added: list[str], output: str, table_id: str, residual: str | None = None) -> Table:
    """A table of labelled cells (row_label, col_label, value). residual names a final-demand column that closes the rows."""
    spark = cells.sparkSession
    number = spark.createDataFrame(list(enumerate(sectors)), "idx int, code string")
    i, j = (number.select(F.col("idx").alias(k), F.col("code").alias(c)) for k, c in (("i", "row_label"), ("j", "col_label")))
    tag = lambda df: df.withColumn("table_id", F.lit(table_id))
    z = tag(cells.join(i, "row_label").join(j, "col_label").select("i", "j", "value"))
    y = tag(cells.where(F.col("col_label").isin(finals)).join(i, "row_label").select("i", F.col("col_label").alias("c"), "value"))
    rank = F.array_position(F.array(*[F.lit(a) for a in added]), F.col("row_label")) - 1
    va = tag(cells.where(F.col("row_label").isin(added)).join(j, "col_label").select(rank.cast("int").alias("r"), "j", "value"))
    x = tag(cells.where(F.col("col_label") == output).join(i, "row_label").select("i", "value"))
    have = {r["i"] for r in x.collect()}
    if have != set(range(len(sectors))):
        raise TableError("no output for " + ", ".join(s for k, s in enumerate(sectors) if k not in have))
    if residual:
        gap = ops.balance(z, y, va, x).select("table_id", "i", F.lit(residual).alias("c"), F.col("row_residual").alias("value"))
        y = y.unionByName(gap)
    sector = number.select(F.lit(table_id).alias("table_id"), "idx", "code", F.lit(None).cast("string").alias("region"), F.lit(None).cast("int").alias("region_id"))
    return Table(sector, z, y, va, x)


def table_from_grid(grid: DataFrame, layout: Layout, table_id: str, unbalanced: str = "refuse") -> Table:
    """A symmetric table of a sheet: sectors are the labels on both axes that are neither final demand, value added nor totals.

    Final-demand codes that begin another one are its aggregates and drop out. unbalanced="residual_column"
    closes the rows by a column of their own instead of refusing.
    """
    from saldo.sources.grids import labelled_block

    cells = labelled_block(grid, layout.sheet, layout.header_row, layout.label_col)
    apart = [*layout.finals, *layout.added, layout.output, *layout.totals]
    rows = [r["l"] for r in grid.where((F.col("sheet") == layout.sheet) & (F.col("col") == layout.label_col) & (F.col("row") > layout.header_row)).orderBy("row").select(F.trim("text").alias("l")).collect()]
    heads = {r["l"] for r in cells.select(F.col("col_label").alias("l")).distinct().collect()}
    sectors = [r for r in dict.fromkeys(rows) if r in heads and r not in apart]
    lonely = [r for r in rows if r not in heads and r not in apart]
    if lonely:
        raise TableError("rows without a column: " + ", ".join(lonely[:5]))
    finals = [f for f in layout.finals if not any(o != f and o.startswith(f) for o in layout.finals)]
    t = from_labels(cells, sectors, finals, layout.added, layout.output, table_id, "residual" if unbalanced == "residual_column" else None)
    return t if unbalanced == "residual_column" else gate(t)


def tile(cube: DataFrame, axes: tuple[str, str], total: str) -> tuple[list[str], list[str]]:
    """Codes of the finest tiling with a total on both axes, and notes on parents kept whole. cube: (row, col, value)."""
    a, b = axes
    rows = {r["k"]: r["value"] for r in cube.where(F.col(b) == total).select(F.col(a).alias("k"), "value").collect()}
    cols = {r["k"] for r in cube.where(F.col(a) == total).select(F.col(b).alias("k")).collect()}
    both = sorted(k for k in rows if k in cols and codes.covered(k))
    return codes.finest(both, rows, 0.5)


def table_from_cube(cube: DataFrame, table_id: str, *, row: str, col: str, total: str, finals: list[list[str]], added: list[str], output: str) -> Table:
    """A symmetric table of a cube (row, col, value): sectors by the finest tiling; of each group of alternative
    final-demand codes the first that has values counts."""
    sectors, _ = tile(cube, (row, col), total)
    live = {r["k"] for r in cube.select(F.col(col).alias("k")).distinct().collect()}
    chosen = [next((c for c in group if c in live), None) for group in finals]
    cells = cube.select(F.col(row).alias("row_label"), F.col(col).alias("col_label"), "value")
    return gate(from_labels(cells, sectors, [c for c in chosen if c], added, output, table_id))


def supply_use_from_cubes(supply: DataFrame, use: DataFrame, *, row: str, col: str, finals: list[str]) -> SupplyUse:
    """A supply-use pair of two cubes (row = product, col = activity or final use, value), each axis its coarsest tiling."""
    products = codes.coarsest(sorted({r["k"] for r in supply.select(F.col(row).alias("k")).distinct().collect() if codes.covered(r["k"])}))
    activities = codes.coarsest(sorted({r["k"] for r in supply.select(F.col(col).alias("k")).distinct().collect() if codes.covered(r["k"])}))
    inside = lambda df: df.where(F.col(row).isin(products))
    v = inside(supply).where(F.col(col).isin(activities)).select(F.col(row).alias("p"), F.col(col).alias("a"), "value")
    u = inside(use).where(F.col(col).isin(activities)).select(F.col(row).alias("p"), F.col(col).alias("a"), "value")
    return SupplyUse(v, u, inside(use).where(F.col(col).isin(finals)).select(F.col(row).alias("p"), F.col(col).alias("c"), "value"))


def shortfall(parts: float, total: float) -> str:
    """Why parts don't add up: levels of a classification mixed, or codes missing."""
    ratio = parts / total if total else float("inf")
    return "levels are mixed: parts exceed the total" if ratio > 1.05 else "codes are missing: parts fall short" if ratio < 0.999 else "within rounding"


def printed_in(value: float, text: str) -> bool:
    """Whether a figure stands in a text as a reader would read it, with points and commas grouping digits or as decimal marks.

    Blanks part numbers, unless they group digits by three throughout.
    """
    want = Decimal(f"{abs(value):.10g}")
    for m in re.finditer(r"\d{1,3}(?:[ \u00a0\u2009\u202f']\d{3})+(?:[.,]\d+)?(?!\d)|\d+(?:[.,]\d+)*", text):
        plain = re.sub(r"[ \u00a0\u2009\u202f']", "", m[0])
        runs = [plain, *re.findall(r"\d+(?:[.,]\d+)*", m[0])] if plain != m[0] else [plain]
        for run in runs:
            readings = [re.sub(r"[.,]", "", run)] + [re.sub(r"[.,](?=.*[.,])", "", run).replace(",", ".")]
            if any(Decimal(r) == want for r in readings):
                return True
    return False


def key_from_report(figures: list[tuple[str, float, str]]) -> dict[str, float]:
    """Values of a key by code, each backed by a quotation of at least 25 characters that prints it."""
    for code, value, quote in figures:
        if len(quote.strip()) < 25 or not printed_in(value, quote):
            raise TableError(f"{code}: the quotation doesn't print {value:g}, or is too short to check")
    return {code: value for code, value, _ in figures}


def sidecar(content: bytes, url: str, dataset: str, why: str) -> dict:
    """Provenance of an acquired file, to be written beside it."""
    return {"url": url, "dataset": dataset, "bytes": len(content), "sha256": hashlib.sha256(content).hexdigest(), "retrieved_at": datetime.now(UTC).isoformat(timespec="seconds"), "why": why}


def keys_frame(spark: SparkSession, key_id: str, values: dict[str, float]) -> DataFrame:
    return spark.createDataFrame([(key_id, c, float(v)) for c, v in values.items()], "key_id string, code string, value double")
