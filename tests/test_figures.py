import numpy as np
import pytest
from pyspark.errors import PythonException

from saldo.functions.kernels import TableError
from saldo.operators import balance, metrics, split, sut
from saldo.sources import loaders


def table(spark, grid):
    return spark.createDataFrame([("t", i, j, float(x)) for (i, j), x in np.ndenumerate(grid)], "table_id string, i int, j int, value double")


def test_neutral_profile_by_plain_loops(spark):
    rng = np.random.default_rng(1)
    z = rng.uniform(1, 50, (6, 6))
    parent, w = 2, {10: 0.5, 11: 0.3, 12: 0.2}
    named = {(0, 10): 3.0, (1, 10): 0.5, (3, 11): 2.0, (5, 11): 0.1}
    weights = spark.createDataFrame(list(w.items()), "part int, weight double")
    profile = spark.createDataFrame([(i, p, m) for (i, p), m in named.items()], "i int, part int, m double")
    got = {(r["i"], r["part"]): r["m"] for r in split.neutral_profile(table(spark, z), parent, weights, profile).collect()}
    assert set(got) == set(named)
    for a, b in (((0, 10), (1, 10)), ((3, 11), (5, 11))):
        assert np.isclose(got[a] / got[b], named[a] / named[b])
    outer = [i for i in range(6) if i != parent]
    bought = dict.fromkeys(w, 0.0)
    for i in outer:
        wm = {p: w[p] * got.get((i, p), 1.0) for p in w}
        for p in w:
            bought[p] += z[i, parent] * wm[p] / sum(wm.values())
    assert all(np.isclose(bought[p], w[p] * sum(z[i, parent] for i in outer), rtol=1e-9) for p in w)
    before = {r["part"]: r for r in split.profile_shift(table(spark, z), parent, weights, profile).collect()}
    assert not any(r["neutral"] for r in before.values()) and abs(sum(r["shift"] for r in before.values())) < 1e-9


def test_rounding_probe_bounds(spark):
    """The range grows with the unit and is near the first-order bound of one cell."""
    grid = np.array([[90.0, 5.0], [8.0, 70.0]])
    small = {(r["i"], r["j"]): r["half_width"] for r in metrics.rounding_probe(spark, grid, 0.005, 300).collect()}
    large = {(r["i"], r["j"]): r["half_width"] for r in metrics.rounding_probe(spark, grid, 0.5, 300).collect()}
    assert all(0 < small[k] < 1e-3 and 50 < large[k] / small[k] < 200 for k in small)


def test_projection_refusals(spark):
    assert sut.choose_projection({"gva", "final_use", "taxes", "imports"}) == "sut_euro"
    for kinds in ({"gva", "industry_output"}, {"taxes"}, {"gva"}, {"gva", "final_use", "jobs"}):
        with pytest.raises(TableError):
            sut.choose_projection(kinds)
    cells = spark.createDataFrame([("t", "domestic", "p", "0", 1.0), ("t", "supply", "p", "0", 1.0)], "table_id string, what string, r string, c string, value double")
    targets = spark.createDataFrame([("t", "industry_output", "9", 1.0), ("t", "use_column_totals", "0", 1.0), ("t", "imports", "total", 0.0)], "table_id string, kind string, code string, value double")
    with pytest.raises(PythonException, match="same codes"):
        sut.project_frames(cells, targets).collect()


def test_printed_figures():
    for value, text in ((100, "sales of 100, 200 and 300 units"), (300, "sales of 100, 200 and 300 units"), (12.5, "share 12.50 %"), (2019, "in 2019 361 firms"), (361, "in 2019 361 firms"), (361296, "361.296 persons"), (361.296, "361.296 persons"), (1234567.89, "1.234.567,89 euros"), (1234567, "1 234 567")):
        assert loaders.printed_in(value, text), (value, text)
    for value, text in ((100200, "sales of 100, 200"), (125, "share 12.51 %"), (2019361, "in 2019 361 firms"), (1, "12 and 13")):
        assert not loaders.printed_in(value, text), (value, text)


def test_gate_takes_each_block_by_its_own_decimals(spark):
    """Unrounded cells beside rounded totals: half a unit off is within what the totals print, three units are not."""
    from saldo.sources.fixture import Table

    rng = np.random.default_rng(3)
    n = 40
    z = rng.uniform(1, 5, (n, n))
    y = np.round(rng.uniform(50, 90, n))
    x = np.round(z.sum(1) + y)
    va = x - z.sum(0)

    def made(off):
        one = lambda cols, rows: spark.createDataFrame(rows, cols)
        return Table(
            one("table_id string, idx int, code string", [("t", k, str(k)) for k in range(n)]), table(spark, z), one("table_id string, i int, c string, value double", [("t", k, "F", float(y[k])) for k in range(n)]),
            one("table_id string, r int, j int, value double", [("t", 0, k, float(va[k])) for k in range(n)]), one("table_id string, i int, value double", [("t", k, float(x[k] + (off if k == 3 else 0))) for k in range(n)]),
        )

    loaders.gate(made(0))
    with pytest.raises(TableError):
        loaders.gate(made(4.0))


def test_unknown_cells_are_refused_in_balancing(spark):
    z = table(spark, np.ones((2, 2)))
    rows, cols = (spark.createDataFrame([("t", 0, 2.0)], f"table_id string, {k} int, value double") for k in "ij")
    with pytest.raises(PythonException, match="no target"):
        balance.balance(z, rows, cols).collect()


def test_ras_by_joins_says_whether_it_settled(spark):
    rng = np.random.default_rng(5)
    grid = rng.uniform(1, 9, (5, 5))
    goal = rng.uniform(1, 9, (5, 5))
    rows, cols = (spark.createDataFrame([("t", k, float(s)) for k, s in enumerate(goal.sum(a))], f"table_id string, {c} int, value double") for a, c in ((1, "i"), (0, "j")))
    made, rounds, settled = balance.ras_joined(table(spark, grid), rows, cols, 1e-8)
    assert settled and rounds < 60
    got = {(r["i"], r["j"]): r["value"] for r in made.collect()}
    assert np.allclose([sum(got[i, j] for j in range(5)) for i in range(5)], goal.sum(1), rtol=1e-7)
    assert not balance.ras_joined(table(spark, grid), rows, cols, 1e-13, max_rounds=3)[2]


def test_workbooks_read_back(spark, tmp_path):
    import io

    from saldo.plans import registry
    from saldo.sources import files, grids

    rows = [["code", "a<b & \"c\"", None], ["é\x01", 1.5, float("nan")], [" x ", -2, 10**15]]
    got = list(grids.cells(io.BytesIO(files.workbook({"One": rows, "Two & more": [["z"] * 30]}))))
    assert [c[:4] for c in got if c[0] == "One"] == [("One", 1, 1, "code"), ("One", 1, 2, 'a<b & "c"'), ("One", 2, 1, "é"), ("One", 2, 2, "1.5"), ("One", 3, 1, " x "), ("One", 3, 2, "-2"), ("One", 3, 3, str(10**15))]
    assert [c[2] for c in got if c[0] == "Two & more"] == list(range(1, 31))
    t = registry.io(spark, "/root/testdata/sf0.001")
    labels = ["observed", "proxy_estimated", "balanced_adjustment", "user_constraint"]
    cells = t.z.select("i", "j").rdd.map(lambda r: (r["i"], r["j"], labels[(r["i"] + r["j"]) % 4])).toDF("i int, j int, prov string")
    files.write_xlsx(t, cells, f"{tmp_path}/t.xlsx", {"unit": "dollars"})
    back = grids.read_grid(spark, f"{tmp_path}/t.xlsx")
    made = {(r["row_label"], r["col_label"]): r["value"] for r in grids.labelled_block(back, "Z", 1, 1).collect()}
    code = {r["idx"]: r["code"] for r in t.sector.collect()}
    assert made == {(code[r["i"]], code[r["j"]]): r["value"] for r in t.z.collect()}
    assert {r["text"] for r in back.where("sheet = 'Provenance' AND row > 1 AND col > 1").collect()} == set(labels)


def test_notes_are_added_once():
    from saldo.plans import report

    text = "See N-02, then N-01 and N-02."
    once = report.annotated(text, r"N-\d\d", "are kept elsewhere.")
    assert "`N-02`, `N-01` are kept" in once and report.annotated(once, r"N-\d\d", "are kept elsewhere.") == once
    assert report.annotated("nothing", r"N-\d\d", "x") == "nothing" and report.references("", "a") == []
    assert "and 4 more" in report.annotated(" ".join(f"N-{k}" for k in range(10, 22)), r"N-\d\d", "x")


def test_type_ii_labels():
    from saldo.plans.config import type_ii_labels

    have = (["Wages", "Social", "Surplus"], ["Households", "Exports"])
    assert type_ii_labels({}, *have) is None
    assert type_ii_labels({"type_ii_income_rows": "Wages; Social", "type_ii_household_column": "Households"}, *have) == (["Wages", "Social"], "Households")
    for meta in ({"type_ii_income_rows": "Wages"}, {"type_ii_household_column": "Households"}, {"type_ii_income_rows": "Pay", "type_ii_household_column": "Households"}, {"type_ii_income_rows": "Wages", "type_ii_household_column": "Homes"}):
        with pytest.raises(TableError):
            type_ii_labels(meta, *have)
