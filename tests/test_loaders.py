import pytest

from saldo.functions.kernels import TableError
from saldo.sources import loaders

CELLS = [  # rows A and B sell to A, B, households; value added closes the columns
    ("A", "A", 1.0), ("A", "B", 2.0), ("A", "HH", 7.0), ("A", "Output", 10.0), ("B", "A", 3.0), ("B", "B", 4.0), ("B", "HH", 13.0), ("B", "Output", 20.0),
    ("VA", "A", 6.0), ("VA", "B", 14.0), ("Output", "A", 10.0), ("Output", "B", 20.0),
]


def sheet(spark, cells):
    rows, cols = list(dict.fromkeys(r for r, _, _ in cells)), list(dict.fromkeys(c for _, c, _ in cells))
    out = [("IOT", 4, 2 + k, c, None) for k, c in enumerate(cols)] + [("IOT", 5 + k, 1, r, None) for k, r in enumerate(rows)]
    out += [("IOT", 5 + rows.index(r), 2 + cols.index(c), str(v), v) for r, c, v in cells]
    return spark.createDataFrame(out, "sheet string, row int, col int, text string, value double")


LAYOUT = loaders.Layout("IOT", 4, 1, ["HH"], ["VA"])


def test_grid_table(spark):
    t = loaders.table_from_grid(sheet(spark, CELLS), LAYOUT, "t")
    assert {(r["i"], r["j"]): r["value"] for r in t.z.collect()} == {(0, 0): 1, (0, 1): 2, (1, 0): 3, (1, 1): 4}
    assert [r["code"] for r in t.sector.orderBy("idx").collect()] == ["A", "B"] and t.va.count() == 2


def test_gate_refuses_or_adds_a_residual(spark):
    off = [(r, c, v + (5 if (r, c) == ("A", "HH") else 0)) for r, c, v in CELLS]
    with pytest.raises(TableError, match="sector 0"):
        loaders.table_from_grid(sheet(spark, off), LAYOUT, "t")
    t = loaders.table_from_grid(sheet(spark, off), LAYOUT, "t", unbalanced="residual_column")
    assert {r["i"]: r["value"] for r in t.y.where("c = 'residual'").collect()} == {0: -5.0, 1: 0.0}
    with pytest.raises(TableError, match="rows without a column"):
        loaders.table_from_grid(sheet(spark, [*CELLS, ("C", "HH", 1.0)]), LAYOUT, "t")


def test_cubes(spark):
    rows = [("C10-12", "C10-12", 1.0), ("C10-12", "C13", 2.0), ("C13", "C10-12", 3.0), ("C13", "C13", 4.0), ("C10-12", "P3", 7.0), ("C13", "P3", 13.0), ("B1G", "C10-12", 6.0), ("B1G", "C13", 14.0)]
    rows += [("C10-12", "TU", 10.0), ("C13", "TU", 20.0), ("C", "TU", 30.0), ("TU", "C10-12", 10.0), ("TU", "C13", 20.0), ("TU", "C", 30.0)]
    cube = spark.createDataFrame(rows, "induse string, prod string, value double")
    t = loaders.table_from_cube(cube, "t", row="induse", col="prod", total="TU", finals=[["P3_S14", "P3"]], added=["B1G"], output="TU")
    assert [r["code"] for r in t.sector.orderBy("idx").collect()] == ["C10-12", "C13"] and t.y.count() == 2
    fine = cube.where("induse <> 'C' AND prod <> 'C'")
    pair = loaders.supply_use_from_cubes(fine, fine, row="induse", col="prod", finals=["P3"])
    assert pair.v.count() == 4 and pair.y.count() == 2


def test_reports_and_sidecars():
    quote = "The office counted 1 234 567 persons employed in hotels in 2020."
    assert loaders.printed_in(1234567, quote) and not loaders.printed_in(1234568, quote)
    assert loaders.key_from_report([("HOT", 1234567.0, quote)]) == {"HOT": 1234567.0}
    for bad in (("HOT", 3.0, quote), ("HOT", 1234567.0, "1234567")):
        with pytest.raises(TableError):
            loaders.key_from_report([bad])
    assert loaders.sidecar(b"abc", "https://example.org/x", "x", "test")["bytes"] == 3
    assert "mixed" in loaders.shortfall(120, 100) and "missing" in loaders.shortfall(90, 100)
