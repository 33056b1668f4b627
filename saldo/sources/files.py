"""Delimited sources and the table interchange: keys, activity, component tables, Parquet bundles, strict JSON."""

from __future__ import annotations

import io
import json
import math
import zipfile
from dataclasses import asdict, is_dataclass
from datetime import date, datetime
from enum import Enum
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saldo.functions.kernels import TableError
from saldo.sources.fixture import Table

STRENGTH = ("strong", "medium", "weak")
ALIASES = {"code": ("code", "new_sector_code", "sector", "subsector"), "value": ("value", "figure", "amount"), "source": ("source", "origin"), "source_year": ("source_year", "year"), "strength": ("strength", "quality")}


def read_key(spark: SparkSession, path: str) -> DataFrame:
    """Allocation key (code, value, source, source_year, strength) of a CSV with any of the known headings.

    One source and one year are allowed; the key's strength is the weakest of its rows.
    """
    raw = spark.read.csv(path, header=True)
    have = {c.strip().lower(): c for c in raw.columns}
    pick = {k: next((have[a] for a in names if a in have), None) for k, names in ALIASES.items()}
    if not pick["code"] or not pick["value"]:
        raise TableError(f"no code or value column among {raw.columns}")
    col = lambda k: F.col(f"`{pick[k]}`") if pick[k] else F.lit(None).cast("string")
    out = raw.select(F.trim(col("code")).alias("code"), F.expr(f"try_cast(trim(`{pick['value']}`) AS double)").alias("value"), col("source").alias("source"), col("source_year").try_cast("int").alias("source_year"), F.lower(col("strength")).alias("strength"))
    facts = out.agg(F.countDistinct("source").alias("s"), F.countDistinct("source_year").alias("y"), F.max(F.array_position(F.array(*[F.lit(s) for s in STRENGTH]), F.col("strength"))).alias("w"), F.count(F.when(F.col("value").isNull(), 1)).alias("gaps")).first()
    if facts["s"] > 1 or facts["y"] > 1:
        raise TableError("a key has one source and one year")
    if facts["gaps"]:
        raise TableError("a key has a value for every code; missing is not zero")
    return out.withColumn("strength", F.lit(STRENGTH[facts["w"] - 1] if facts["w"] else STRENGTH[-1]))


def cover(have: DataFrame, need: DataFrame, code: str = "code") -> None:
    """Refuse tables whose codes don't match one to one: names codes missing, extra and repeated."""
    missing = need.select(code).join(have.select(code), code, "left_anti").limit(5).collect()
    extra = have.select(code).join(need.select(code), code, "left_anti").limit(5).collect()
    twice = have.groupBy(code).count().where("count > 1").limit(5).collect()
    for what, rows in (("missing", missing), ("unknown", extra), ("repeated", twice)):
        if rows:
            raise TableError(f"{what}: {', '.join(str(r[code]) for r in rows)}")


def read_activity(spark: SparkSession, path: str, sectors: DataFrame, output: DataFrame) -> DataFrame:
    """(code, regional, national) of a CSV, every sector exactly once; national is output where it isn't given."""
    raw = spark.read.csv(path, header=True)
    national = F.expr("try_cast(national AS double)") if "national" in raw.columns else F.lit(None).cast("double")
    out = raw.select(F.trim("sector_code").alias("code"), F.expr("try_cast(regional AS double)").alias("regional"), national.alias("national"))
    cover(out, sectors)
    return out.join(output.select("code", F.col("value").alias("x")), "code").select("code", "regional", F.coalesce("national", "x").alias("national"))


def read_components(spark: SparkSession, path: str) -> DataFrame:
    """(row, column, value) of a wide component table with a leading label column, by unpivoting it."""
    raw = spark.read.csv(path, header=True)
    first, *rest = raw.columns
    numbers = raw.select(F.trim(F.col(f"`{first}`")).alias("row"), *[F.expr(f"coalesce(try_cast(`{c}` AS double), 0D)").alias(c.strip().replace(".", "_")) for c in rest])
    return numbers.unpivot("row", [F.col(f"`{c}`") for c in numbers.columns if c != "row"], "column", "value")


def split_components(cells: DataFrame, sectors: int, finals: int) -> dict[str, DataFrame]:
    """Intermediate block, final demand, totals of a component table whose labels begin with their number."""
    lead = lambda c: F.regexp_extract(c, r"^\s*(\d+)", 1).try_cast("int")
    at = cells.withColumn("i", lead("row")).withColumn("j", lead("column"))
    return {
        "z": at.where(F.col("i").between(1, sectors) & F.col("j").between(1, sectors)).select("i", "j", "value"),
        "y": at.where(F.col("i").between(1, sectors) & F.col("j").between(sectors + 1, sectors + finals)).select("i", "j", "value"),
        "rest": at.where(F.col("i").isNull() | ~F.col("i").between(1, sectors)).select("row", "j", "value"),
    }


def write_bundle(table: Table, path: str, meta: dict[str, str]) -> None:
    """The interchange: a folder with one Parquet table per block and the metadata. Replaces what is there."""
    need = {"country", "year", "unit", "classification", "source"} - set(meta)
    if need:
        raise TableError(f"metadata lacks {', '.join(sorted(need))}")
    for name in ("sector", "z", "y", "va", "x"):
        getattr(table, name).write.mode("overwrite").parquet(f"{path}/{name}")
    spark = table.x.sparkSession
    spark.createDataFrame([(k, str(v)) for k, v in sorted(meta.items())], "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def read_bundle(spark: SparkSession, path: str) -> tuple[Table, dict[str, str]]:
    """A table and its metadata from an interchange folder."""
    blocks = {name: spark.read.parquet(f"{path}/{name}") for name in ("sector", "z", "y", "va", "x")}
    return Table(**blocks), {r["key"]: r["value"] for r in spark.read.parquet(f"{path}/metadata").collect()}


def write_table_csv(table: Table, path: str) -> None:
    """Z, Y and output as one wide CSV with six decimals, value added and output below; columns in sector order."""
    order = [r["idx"] for r in table.sector.select("idx").distinct().orderBy("idx").collect()]
    finals = [r["c"] for r in table.y.select("c").distinct().orderBy("c").collect()]
    cells = table.z.select(F.col("i").alias("k"), F.lpad(F.col("j").cast("string"), 6, "0").alias("c"), "value")
    cells = cells.unionByName(table.y.select(F.col("i").alias("k"), "c", "value")).unionByName(table.x.select(F.col("i").alias("k"), F.lit("Output").alias("c"), "value"))
    below = table.va.select((F.lit(10**6) + F.col("r")).alias("k"), F.lpad(F.col("j").cast("string"), 6, "0").alias("c"), "value")
    below = below.unionByName(table.x.select(F.lit(2 * 10**6).alias("k"), F.lpad(F.col("i").cast("string"), 6, "0").alias("c"), "value"))
    columns = [f"{k:06d}" for k in order] + finals + ["Output"]
    wide = cells.unionByName(below).groupBy("k").pivot("c", columns).agg(F.sum("value")).orderBy("k")
    label = F.when(F.col("k") == 2 * 10**6, "Output").when(F.col("k") >= 10**6, F.concat(F.lit("VA"), (F.col("k") - 10**6).cast("string"))).otherwise(F.col("k").cast("string"))
    wide.select(label.alias("code"), *[F.format_string("%.6f", F.coalesce(F.col(f"`{c}`"), F.lit(0.0))).alias(c) for c in columns]).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_provenance_csv(cells: DataFrame, path: str) -> None:
    """Provenance labels as a grid of rows by columns."""
    order = [r["j"] for r in cells.select("j").distinct().orderBy("j").collect()]
    cells.groupBy("i").pivot("j", order).agg(F.first("prov")).orderBy("i").coalesce(1).write.mode("overwrite").csv(path, header=True)


def plain(obj):
    """An object as strict JSON: dataclasses, enums, dates, and null for what isn't a finite number."""
    if is_dataclass(obj) and not isinstance(obj, type):
        return plain(asdict(obj))
    if isinstance(obj, dict):
        return {str(k.value if isinstance(k, Enum) else k): plain(v) for k, v in obj.items()}
    if isinstance(obj, (list, tuple, set, frozenset)):
        return [plain(v) for v in (sorted(obj) if isinstance(obj, (set, frozenset)) else obj)]
    if isinstance(obj, Enum):
        return plain(obj.value)
    if isinstance(obj, (date, datetime)):
        return obj.isoformat()
    if hasattr(obj, "item"):
        return plain(obj.item())
    if isinstance(obj, float) and not math.isfinite(obj):
        return None
    return obj


def to_json(obj) -> str:
    return json.dumps(plain(obj), indent=2, allow_nan=False, ensure_ascii=False)


def strict_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines with NaN and infinities as null."""
    clean = [F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*clean).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of input files, for manifests."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _column(k: int) -> str:
    out = ""
    while k >= 0:
        out, k = chr(65 + k % 26) + out, k // 26 - 1
    return out


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """An .xlsx workbook of sheets of rows; strings are kept inline, None and what isn't a finite number are left empty."""
    kinds = "http://schemas.openxmlformats.org"
    clean = lambda t: escape("".join(c for c in t if c >= " " or c in "\t\n"), {'"': "&quot;"})

    def cell(row: int, col: int, value) -> str:
        value = plain(value)
        at = f"{_column(col)}{row}"
        if value is None:
            return ""
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return f'<c r="{at}"><v>{value!r}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{clean(str(value))}</t></is></c>'

    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    n = range(1, len(sheets) + 1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in n)
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{kinds}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{kinds}/package/2006/relationships"><Relationship Id="rId1" Type="{kinds}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{kinds}/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{kinds}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in n) + "</Relationships>")
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{kinds}/spreadsheetml/2006/main" xmlns:r="{kinds}/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{clean(name)[:31]}" sheetId="{k}" r:id="rId{k}"/>' for k, name in zip(n, sheets)) + "</sheets></workbook>")
        for k, rows in zip(n, sheets.values()):
            body = "".join(f'<row r="{r}">' + "".join(cell(r, c, value) for c, value in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'{head}<worksheet xmlns="{kinds}/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


#: Cells of a result that a workbook may hold; larger tables belong in a bundle.
MOST_CELLS = 4_000_000


def write_xlsx(table: Table, cells: DataFrame, path: str, metadata: dict[str, str] | None = None) -> None:
    """A result as a workbook: Z, FinalDemand, ValueAdded, Output, Provenance (all four labels kept) and metadata.

    cells: (i, j, prov). The driver holds the table, of at most MOST_CELLS cells.
    """
    sectors = [(r["idx"], r["code"]) for r in table.sector.select("idx", "code").orderBy("idx").collect()]
    if len(sectors) ** 2 > MOST_CELLS:
        raise ValueError(f"{len(sectors)} sectors are too many for a workbook; write a bundle")
    codes = dict(sectors)

    def grid(df: DataFrame, row: str, col: str, rows: list, cols: list, names: dict, value: str = "value") -> list[list]:
        at = {(r[row], r[col]): r[value] for r in df.select(row, col, value).collect()}
        return [["code", *[names.get(c, c) for c in cols]], *[[names.get(r, r), *[at.get((r, c)) for c in cols]] for r in rows]]

    order = [i for i, _ in sectors]
    finals = sorted(r["c"] for r in table.y.select("c").distinct().collect())
    added = sorted(r["r"] for r in table.va.select("r").distinct().collect())
    output = {r["i"]: r["value"] for r in table.x.collect()}
    sheets = {
        "Z": grid(table.z, "i", "j", order, order, codes), "FinalDemand": grid(table.y, "i", "c", order, finals, codes),
        "ValueAdded": grid(table.va.withColumn("r", F.concat(F.lit("VA"), F.col("r").cast("string"))), "r", "j", [f"VA{k}" for k in added], order, codes),
        "Output": [["code", "output"], *[[code, output.get(i)] for i, code in sectors]], "Provenance": grid(cells, "i", "j", order, order, codes, "prov"), "metadata": [["key", "value"], *[[k, v] for k, v in (metadata or {}).items()]],
    }
    Path(path).write_bytes(workbook(sheets))
