import zlib

import numpy as np

from saldo.llm import registry, toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_ranking(spark):
    got = registry.op8_toxicity(spark, SF).toPandas()
    labels = spark.read.parquet(SF + "/labels.parquet").select("doc_id", "toxic").toPandas()
    assert len(got) == 10000 and got["score"].between(0, 1).all()
    assert (got["predicted"] == (got["score"] >= 0.7)).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]).all()
    test = got[got["held_out"]].merge(labels, on="doc_id")
    pos, neg = test[test["toxic"] == 1]["score"], test[test["toxic"] == 0]["score"]
    auc = np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos])
    assert auc > 0.97
    assert (neg >= 0.7).mean() < 0.01 and (pos >= 0.7).mean() > 0.7


def test_swapping_identity_terms_lowers_false_positives():
    """Insults come with one group's name in training; a neutral mention of the group must not score high."""
    rng = np.random.default_rng(1)
    fill = ["word%s" % "abcdefghijklmnopqrst"[i] for i in range(20)]
    texts, labels = [], []
    for k in range(600):
        words = list(rng.choice(fill, 12))
        if k % 3 == 0:
            words += ["muslims", ["awful", "vile"][k % 2]]
        elif k % 3 == 1:
            words += ["christians"]
        texts.append("\n".join(sorted(toxicity.features(" ".join(words)))))
        labels.append(int(k % 3 == 0))
    neutral = "muslims " + " ".join(fill[:12])
    with_swaps = toxicity.train(texts, labels, swap_penalty=4.0)
    without = toxicity.train(texts, labels, swap_penalty=0.0)
    assert with_swaps.weights.get("muslims", 0) < 0.3 * without.weights["muslims"]
    assert with_swaps.score(neutral) < 0.5 < without.score(neutral)
    assert with_swaps.score("muslims awful " + " ".join(fill[:12])) > 0.7


def test_swapped_features():
    got = toxicity.swapped(toxicity.features("the Muslims came"))
    assert "christians" in got and "muslims" not in got and "chris*" in got and "musli*" not in got
    assert toxicity.swapped(toxicity.features("nobody here")) is None


def test_nulls_ties_empty_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "bad", "x"), (3, "bad", "x")], "doc_id long, text string, toxicity string")
    labels = spark.createDataFrame([(1, 1), (3, 1), (3, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model)
    assert got.columns == ["doc_id", "text", "toxicity"] and got.count() == 4
    assert toxicity.score(docs, toxicity.fit(docs.limit(0), labels)).count() == 4
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).count() == 4
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_gradient_by_finite_differences():
    rng = np.random.default_rng(6)
    cols = [rng.choice(12, 5, replace=False).astype(np.int32) for _ in range(15)]
    y = np.arange(15) % 3 == 0
    pairs = [(k, rng.choice(12, 2, replace=False).tolist(), rng.choice(12, 1).tolist()) for k in range(0, 15, 2)]
    goal = toxicity.Objective(cols, y.astype(float), np.arange(1, 14), pairs, 12, 2.5)
    w, b = rng.normal(size=12), 0.3
    z = np.array([w[cols[k]].sum() + b for k in range(1, 14)])
    change = np.array([w[a].sum() - w[c].sum() for k, a, c in pairs if 1 <= k < 14])
    value, grad, d_bias = goal.value_and_gradient(w, b)
    plain = (goal.weight * np.log1p(np.exp(np.where(y[1:14], -z, z)))).mean() + 2.5 * (change**2).mean()
    assert np.isclose(value, plain)
    step = 1e-6
    for k in range(12):
        e = np.eye(12)[k] * step
        assert np.isclose((goal.value_and_gradient(w + e, b)[0] - goal.value_and_gradient(w - e, b)[0]) / (2 * step), grad[k], atol=1e-6)
    assert np.isclose((goal.value_and_gradient(w, b + step)[0] - goal.value_and_gradient(w, b - step)[0]) / (2 * step), d_bias, atol=1e-6)


def test_descent_reaches_the_least_value():
    """Against a coordinate search on the same objective."""
    rng = np.random.default_rng(7)
    cols = [rng.choice(4, 2, replace=False).astype(np.int32) for _ in range(30)]
    y = (np.array([0 in c for c in cols]) ^ (rng.random(30) < 0.2)).astype(float)
    goal = toxicity.Objective(cols, y, np.arange(30), [(k, [1], [2]) for k in range(30)], 4, 1.0)
    l1 = 0.01
    w, b = goal.descend(l1, 3000)
    at = lambda w, b: goal.value_and_gradient(w, b)[0] + l1 * np.abs(w).sum()
    x = np.zeros(5)
    best = at(x[:4], x[4])
    for size in (0.3, 0.1, 0.03, 0.01, 0.003, 0.001, 0.0003):
        while True:
            tried = [x + sign * size * e for e in np.eye(5) for sign in (1, -1)]
            values = [at(t[:4], t[4]) for t in tried]
            if min(values) >= best - 1e-12:
                break
            best, x = min(values), tried[int(np.argmin(values))]
    assert abs(at(w, b) - best) < 1e-3


def test_scores_do_not_move_when_terms_are_swapped(spark):
    """On held-out documents, each with a neutral mention of a group."""
    docs = spark.read.parquet(SF + "/documents.parquet")
    labels = spark.read.parquet(SF + "/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs.select("doc_id", "text"), labels.where(~registry.held_out("doc_id", 3, 1)))
    texts = [r["text"] for r in docs.join(labels, "doc_id").where(registry.held_out("doc_id", 3, 1)).orderBy("doc_id").select("text").collect()]
    changes = toxicity.swap_changes(model, texts)
    assert len(changes) > 1000 and max(changes) < 0.05 and np.mean(changes) < 0.005


def test_one_id_many_times_and_very_long_texts(spark):
    docs = spark.createDataFrame([(1, "bad words here")] * 300 + [(k, "fine words there") for k in range(2, 40)] + [(50, "word " * 400_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] + [(k, 0) for k in range(2, 40)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert toxicity.score(docs, model).count() == docs.count()
