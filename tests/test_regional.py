import numpy as np
import pytest

from saldo import cli
from saldo.functions.kernels import TableError
from saldo.operators import regional
from saldo.plans import regionalise
from saldo.sources import files, fixture

# Published example: three sectors, two regions; results printed to three decimals
Z = np.array([[40.0, 5, 5], [5, 15, 10], [5, 5, 25]])
X = np.array([100.0, 50, 80])
Q = np.array([[70.0, 20, 10], [30.0, 30, 70]])
COEFFICIENTS = {
    "SLQ": [[[0.400, 0.100, 0.063], [0.046, 0.276, 0.115], [0.014, 0.029, 0.090]], [[0.212, 0.053, 0.033], [0.050, 0.300, 0.125], [0.050, 0.100, 0.313]]],
    "CILQ": [[[0.400, 0.100, 0.063], [0.029, 0.276, 0.125], [0.009, 0.031, 0.090]], [[0.212, 0.050, 0.021], [0.050, 0.300, 0.086], [0.050, 0.100, 0.313]]],
    "RLQ": [[[0.400, 0.100, 0.063], [0.033, 0.276, 0.125], [0.010, 0.031, 0.090]], [[0.212, 0.051, 0.025], [0.050, 0.300, 0.098], [0.050, 0.100, 0.313]]],
}
IMPORTS = {"SLQ": [[0.000, 0.860, 6.145], [9.091, 0.000, 0.000]], "CILQ": [[0.000, 1.980, 6.477], [10.006, 2.750, 0.000]], "RLQ": [[0.000, 1.653, 6.389], [9.759, 1.867, 0.000]]}


@pytest.mark.parametrize("method", ["SLQ", "CILQ", "RLQ"])
def test_published_example(spark, method):
    a = spark.createDataFrame([(i, j, float(Z[i, j] / X[j])) for i in range(3) for j in range(3)], "i int, j int, value double")
    activity = spark.createDataFrame([(r, i, float(Q[r, i])) for r in range(2) for i in range(3)], "region int, i int, value double")
    got = regional.regionalise(a, activity, method)
    for r in got.collect():
        assert abs(r["value"] - COEFFICIENTS[method][r["region"]][r["i"]][r["j"]]) < 6e-4
    for r in regional.implicit_imports(got, activity).collect():
        assert abs(r["imports"] - IMPORTS[method][r["region"]][r["i"]]) < 6e-4


def test_refusals(spark):
    empty = spark.createDataFrame([], "i int, j int, value double")
    activity = spark.createDataFrame([], "region int, i int, value double")
    for method, delta in (("XLQ", None), ("FLQ", None), ("FLQ", 1.0), ("FLQ", -0.1)):
        with pytest.raises(ValueError):
            regional.regionalise(empty, activity, method, delta)


def test_regional_table_of_files(spark, tmp_path):
    t = fixture.io_table(spark, "/root/testdata/sf0.001")
    at = str(tmp_path / "national")
    files.write_bundle(t, at, {"country": "X", "year": "2000", "unit": "USD", "classification": "nations", "source": "stars"})
    codes = [r["code"] for r in t.sector.collect()]
    (tmp_path / "act.csv").write_text("sector_code,regional,national\n" + "".join(f"{c},{k + 1},20\n" for k, c in enumerate(codes)))
    out = str(tmp_path / "out")
    assert cli.main(["--regionalise", str(tmp_path / "act.csv"), "--national", at, "--delta", "0.2", "--out", out]) == 0
    got = regionalise.run_files(spark, at, str(tmp_path / "act.csv"), out, "FLQ", 0.2)
    assert got["residuals"].count() == len(codes) and got["coefficients"].where("value > national + 1e-12").count() == 0
    (tmp_path / "act.csv").write_text("sector_code,regional,national\n" + "".join(f"{c},30,20\n" for c in codes))
    with pytest.raises(TableError):
        regionalise.run_files(spark, at, str(tmp_path / "act.csv"), out, "FLQ", 0.2)
