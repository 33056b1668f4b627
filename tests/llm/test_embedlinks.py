import numpy as np
import pytest

from saldo.llm import embedlinks, registry


def brute(ids, vectors, threshold=0.9):
    ok = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(c != 0 for c in v) for v in vectors]
    n = [0] * len(ids)
    comp = list(ids)
    links = []
    for a in range(len(ids)):
        for b in range(a):
            if ok[a] and ok[b] and len(vectors[a]) == len(vectors[b]):
                x, y = np.array(vectors[a], float), np.array(vectors[b], float)
                if (x @ y) / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                    links.append((a, b))
                    n[a] += 1
                    n[b] += 1
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            changed |= comp[a] != comp[b]
            comp[a] = comp[b] = low
    return sorted(zip(ids, n, comp))


def clouds(seed=0, dim=8):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(20):
        centre = rng.normal(size=dim)
        for _ in range(9):
            out.append((centre + rng.normal(size=dim) * rng.choice([0.01, 0.15, 0.3])).tolist())
    return out


@pytest.mark.parametrize("max_pivots,chunk_rows,slice_rows,block", [(16, 8192, 8192, 2048), (5, 7, 30, 2), (40, 12, 1000, 5), (1, 40, 50, 16)])
def test_matches_brute_force(spark, max_pivots, chunk_rows, slice_rows, block):
    vectors = clouds() + [None, [], [0.0] * 8, [1.0] * 7 + [None], [1.0] * 7 + [float("nan")], [float("inf")] * 8, [1.0, 0.0], [2.0, 0.0]]
    vectors += [vectors[0]] * 5 + [[2 * x for x in vectors[3]]]
    ids = [int(i) for i in np.random.default_rng(1).permutation(len(vectors)) * 3]
    df = spark.createDataFrame(list(zip(ids, vectors, [9] * len(ids))), "vec_id long, embedding array<double>, links int")
    got = embedlinks.near_duplicates(df, max_pivots=max_pivots, chunk_rows=chunk_rows, slice_rows=slice_rows, block=block)
    assert sorted(tuple(r) for r in got.collect()) == brute(ids, vectors)


def test_very_large_and_small_components(spark):
    vectors = [[1e200, 2e200], [1.0, 2.0], [1e-200, 2e-200], [2.0, -1.0]]
    got = embedlinks.near_duplicates(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>"))
    assert sorted(tuple(r) for r in got.collect()) == [(0, 2, 0), (1, 2, 0), (2, 2, 0), (3, 0, 3)]


def test_empty(spark):
    assert embedlinks.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_repeated_null_and_large_ids(spark):
    big = 2**60
    near, far = [1.0, 0.01], [0.0, 1.0]
    rows = [(1, [1.0, 0.0]), (1, far), (2, near), (3, [1.0, 0.0]), (None, [2.0, 0.0]), (None, [-1.0, 0.0]), (None, None), (big + 1, [0.0, 2.0]), (big + 3, [-1.0, 0.01]), (None, [-1.0, 0.02])]
    got = embedlinks.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    order = lambda r: tuple((x is not None, x or 0) for x in r)
    want = [(1, 3, 1), (1, 1, 1), (2, 3, 1), (3, 3, 1), (None, 3, 1), (None, 2, big + 3), (None, 0, None), (big + 1, 1, 1), (big + 3, 2, big + 3), (None, 2, big + 3)]
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def test_many_lengths(spark):
    rng = np.random.default_rng(4)
    vectors = [rng.normal(size=n).tolist() for n in range(1, 13) for _ in range(6)]
    vectors += [[x * 3 + 1e-3 for x in v] for v in vectors[::4]]
    ids = list(range(len(vectors)))
    got = embedlinks.near_duplicates(spark.createDataFrame(list(zip(ids, vectors)), "vec_id long, embedding array<double>"), chunk_rows=3)
    assert sorted(tuple(r) for r in got.collect()) == brute(ids, vectors)


def test_query(spark):
    import duckdb

    for sf in ("/root/testdata/sf0.01",):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
        want = sorted(con.execute(registry.ORACLE_SQL["op2_embedlinks"]).fetchall())
        assert sorted(tuple(r) for r in registry.op2_embedlinks(spark, sf).collect()) == want
