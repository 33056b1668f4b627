import numpy as np

from saldo.llm.common import connected_components


def test_chains_stars_and_loops(spark):
    rng = np.random.default_rng(0)
    ids = rng.permutation(400).tolist()
    edges = list(zip(ids[:150], ids[1:151]))  # a long chain of random ids
    edges += [(ids[200], k) for k in ids[201:300]]  # a star
    edges += [(ids[310], ids[310]), (ids[320], ids[321]), (ids[321], ids[320]), (ids[320], ids[321])]  # a loop, repeats
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {}
    for group in (ids[:151], ids[200:300], ids[320:322]):
        want |= {k: min(group) for k in group}
    assert got == want


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
