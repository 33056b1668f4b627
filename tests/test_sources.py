import json
import zipfile

import pytest
from pyspark.sql import functions as F

from saldo.functions.kernels import TableError
from saldo.sources import cubes, files, fixture, grids

SF = "/root/testdata/sf0.001"


def test_cube(spark, tmp_path):
    path = str(tmp_path / "cube.json")
    dims = {"unit": ["EUR"], "nace": ["A", "B", "C"], "geo": ["AT", "ES"]}
    values = {("EUR", "A", "AT"): 1.5, ("EUR", "B", "ES"): 2.0, ("EUR", "C", "AT"): -3.0}
    cubes.write_cube(path, dims, values)
    cube = cubes.read_cube(spark, path)
    got = {(r["dims"]["unit"], r["dims"]["nace"], r["dims"]["geo"]): r["value"] for r in cube.collect()}
    assert got == values
    assert {r["nace"]: r["value"] for r in cubes.pin(cube, {"geo": "AT"}, ["nace"]).collect()} == {"A": 1.5, "C": -3.0}
    with pytest.raises(TableError):
        cubes.pin(cube, {}, ["nace"])
    body = json.loads(open(path).read())
    body["value"] = [1.5, None, None, 2.0, -3.0, None]
    body["dimension"]["nace"]["category"]["index"] = ["A", "B", "C"]
    (tmp_path / "list.json").write_text(json.dumps(body))
    assert cubes.read_cube(spark, str(tmp_path / "list.json")).count() == 3
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(TableError):
        cubes.read_cube(spark, str(tmp_path / "bad.json"))


def workbook(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="IOT" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>A</t></si><si><t>B</t></si><si><r><t>code</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>2</v></c><c r="B1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>'
                   '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2"><v>1.5</v></c><c r="C2"><v>2</v></c></row><row r="3"><c r="A3" t="inlineStr"><is><t>B</t></is></c><c r="B3"><v>3</v></c><c r="AA3" t="str"><v>n/a</v></c></row></sheetData></worksheet>')


def test_grid(spark, tmp_path):
    path = str(tmp_path / "table.xlsx")
    workbook(path)
    spark.dataSource.register(grids.GridSource)
    for grid in (spark.read.format("grid").load(path), grids.read_grid(spark, path)):
        assert grid.count() == 9 and grid.agg(F.max("col")).first()[0] == 27
        assert {(r["i"], r["j"]): r["value"] for r in grids.block(grid, "IOT", (2, 3), (2, 3)).collect()} == {(0, 0): 1.5, (0, 1): 2.0, (1, 0): 3.0}
        assert {(r["row_label"], r["col_label"]): r["value"] for r in grids.labelled_block(grid, "IOT", 1, 1).collect()} == {("A", "A"): 1.5, ("A", "B"): 2.0, ("B", "A"): 3.0}


def test_keys_and_activity(spark, tmp_path):
    (tmp_path / "key.csv").write_text("Sector,Figure,Origin,Year,Quality\nHOT,3,office,2020,strong\nRES,1,office,2020,weak\n")
    key = files.read_key(spark, str(tmp_path / "key.csv")).collect()
    assert {r["code"]: r["value"] for r in key} == {"HOT": 3.0, "RES": 1.0} and {r["strength"] for r in key} == {"weak"}
    for text in ("code,value,source\nA,1,x\nB,2,y\n", "code,value\nA,\n", "what\n1\n"):
        (tmp_path / "bad.csv").write_text(text)
        with pytest.raises(TableError):
            files.read_key(spark, str(tmp_path / "bad.csv"))
    sectors = spark.createDataFrame([("A", 10.0), ("B", 20.0)], "code string, value double")
    (tmp_path / "act.csv").write_text("sector_code,regional\nA,1\nB,2\n")
    assert {r["code"]: r["national"] for r in files.read_activity(spark, str(tmp_path / "act.csv"), sectors, sectors).collect()} == {"A": 10.0, "B": 20.0}
    for text in ("sector_code,regional\nA,1\n", "sector_code,regional\nA,1\nB,2\nC,3\n", "sector_code,regional\nA,1\nA,1\nB,2\n"):
        (tmp_path / "act.csv").write_text(text)
        with pytest.raises(TableError):
            files.read_activity(spark, str(tmp_path / "act.csv"), sectors, sectors)


def test_components(spark, tmp_path):
    (tmp_path / "c.csv").write_text("IOMAT,1 Agri,2 Ind,3 Households,Total\n1 Agri,1,2,3,6\n2 Ind,4,5,6,15\n70 Imports,1,1,0,2\n")
    parts = files.split_components(files.read_components(spark, str(tmp_path / "c.csv")), 2, 1)
    assert {(r["i"], r["j"]): r["value"] for r in parts["z"].collect()} == {(1, 1): 1, (1, 2): 2, (2, 1): 4, (2, 2): 5}
    assert {r["i"]: r["value"] for r in parts["y"].collect()} == {1: 3, 2: 6}


def test_bundle_and_sinks(spark, tmp_path):
    table = fixture.io_table(spark, SF)
    at = str(tmp_path / "bundle")
    with pytest.raises(TableError):
        files.write_bundle(table, at, {"country": "X"})
    files.write_bundle(table, at, {"country": "X", "year": "2000", "unit": "USD", "classification": "nations", "source": "stars"})
    back, meta = files.read_bundle(spark, at)
    assert meta["year"] == "2000" and back.z.count() == table.z.count()
    files.write_table_csv(back, str(tmp_path / "csv"))
    wide = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert wide.count() == back.x.count() + 2 and wide.columns[0] == "code" and wide.columns[-1] == "Output"
    files.strict_json(spark.createDataFrame([(1, float("nan")), (2, 2.0)], "a int, b double"), str(tmp_path / "json"))
    assert {r["a"]: r["b"] for r in spark.read.json(str(tmp_path / "json")).collect()} == {1: None, 2: 2.0}
    assert json.loads(files.to_json({"x": float("inf"), "y": {1, 2}, "z": (1.0,)})) == {"x": None, "y": [1, 2], "z": [1.0]}
    assert files.file_hashes(spark, at + "/metadata/*.parquet").count() >= 1
