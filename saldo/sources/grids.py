"""Spreadsheet cells as rows, by a Python data source over the zip and XML of .xlsx files."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
SCHEMA = "sheet string, row int, col int, text string, value double"


def cells(raw) -> Iterator[tuple[str, int, int, str, float | None]]:
    """(sheet, row, column, text, number) of every filled cell of a workbook, rows and columns from 1."""
    with zipfile.ZipFile(raw) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{_main}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_main}sheet"):
            target = targets[sheet.get(_rel)].lstrip("/")
            with z.open(target if target.startswith("xl/") else f"xl/{target}") as f:
                for _, c in ElementTree.iterparse(f):
                    if c.tag != f"{_main}c":
                        continue
                    v, inline = c.find(f"{_main}v"), c.find(f"{_main}is")
                    text = "".join(t.text or "" for t in inline.iter(f"{_main}t")) if inline is not None else (v.text or "") if v is not None else ""
                    if c.get("t") == "s" and text:
                        text = shared[int(text)]
                    if text:
                        letters, row = re.match(r"([A-Z]+)(\d+)", c.get("r")).groups()
                        col = 0
                        for letter in letters:
                            col = col * 26 + ord(letter) - 64
                        yield sheet.get("name"), int(row), col, text, number(text)
                    c.clear()


def number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


class GridSource(DataSource):
    """spark.read.format("grid").load(path): one partition per workbook."""

    @classmethod
    def name(cls) -> str:
        return "grid"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"].split(","))


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        yield from cells(partition.value)


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """Cells of the workbooks below a path of any file system; .csv files that are workbooks inside count too."""
    import io

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for content in pdf["content"]:
                rows = list(cells(io.BytesIO(content)))
                if rows:
                    yield pd.DataFrame(rows, columns=["sheet", "row", "col", "text", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, SCHEMA)


def block(grid: DataFrame, sheet: str, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Numbers of a rectangle as (i, j, value), from 0; what isn't a number counts as zero."""
    inside = (F.col("sheet") == sheet) & F.col("row").between(*rows) & F.col("col").between(*cols)
    return grid.where(inside).select((F.col("row") - rows[0]).alias("i"), (F.col("col") - cols[0]).alias("j"), F.coalesce("value", F.lit(0.0)).alias("value"))


def labelled_block(grid: DataFrame, sheet: str, header_row: int, label_col: int) -> DataFrame:
    """Numbers as (row_label, col_label, value), labels from a header row and a label column, by join and not by place."""
    own = grid.where(F.col("sheet") == sheet)
    heads = own.where((F.col("row") == header_row) & (F.col("col") > label_col)).select("col", F.trim("text").alias("col_label"))
    labels = own.where((F.col("col") == label_col) & (F.col("row") > header_row)).select("row", F.trim("text").alias("row_label"))
    return own.where(F.col("value").isNotNull()).join(heads, "col").join(labels, "row").select("row_label", "col_label", "value")
