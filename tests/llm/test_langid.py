import zlib

import numpy as np

from saldo.llm import langid, registry

SF = "/root/testdata/sf0.01"


def slow_counts(text):
    """N-grams of one text by plain loops, as strings."""
    s = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    out = []
    for n in langid.NGRAMS:
        for i in range(len(s) - n + 1):
            g = s[i : i + n]
            inner = g if n == 1 else g[1:-1]
            if " " not in inner and g.strip():
                out.append(g)
    return len(out)


def test_counts_cover_whole_texts():
    texts = ["the cat", "", None, "x", "Été à l'an", "12 !", "word " * 5000]
    for t, c in zip(texts, langid.subword_counts(texts)):
        assert c.sum() == slow_counts(t or "")
    alone = [next(iter(langid.subword_counts([t]))) for t in texts]
    assert all((a == b).all() for a, b in zip(alone, langid.subword_counts(texts)))


def test_held_out_accuracy(spark):
    got = registry.op10_langid(spark, SF).toPandas()
    truth = spark.read.parquet(SF + "/documents.parquet").select("doc_id", "lang").toPandas()
    assert len(got) == len(truth) and set(got.columns) >= {"doc_id", "held_out", "lang_pred", "score"}
    both = got.merge(truth, on="doc_id")
    assert (both["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in both["doc_id"]]).all()
    test = both[both["held_out"]]
    assert (test["lang_pred"] == test["lang"]).mean() > 0.98
    assert got["score"].between(0, 1).all()


def test_nulls_no_letters_and_clashing_columns(spark):
    model = langid.train(np.array(list(langid.subword_counts(["the of and", "der und die"] * 10)), np.float32), ["en", "de"] * 10)
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 34", "x"), (4, "the and", "x"), (4, "the and", "x")], "doc_id long, text string, lang_pred string")
    got = langid.identify(docs, model)
    assert got.columns == ["doc_id", "text", "lang_pred", "lang_score", "lang_rejected"]
    rows = sorted((r["doc_id"], r["lang_pred"], r["lang_rejected"]) for r in got.collect())
    assert rows == [(1, "und", True), (2, "und", True), (3, "und", True), (4, "en", False), (4, "en", False)]
    assert got.limit(0).count() == 0


def test_empty_training_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.labels == [] and model.predict(["abc"]) == (["und"], [0.0], [True])


def test_gradients_by_finite_differences():
    rng = np.random.default_rng(2)
    x, y = rng.random((6, 9)), np.array([0, 1, 2, 1, 0, 2])
    emb, out, bias = rng.normal(size=(9, 4)), rng.normal(size=(4, 3)), rng.normal(size=3)
    loss, *grads = langid.loss_and_gradients(emb, out, bias, x, y)
    z = x @ emb @ out + bias
    assert np.isclose(loss, np.mean([np.log(np.exp(r).sum()) - r[k] for r, k in zip(z, y)]))
    step = 1e-6
    for n, (part, grad) in enumerate(zip((emb, out, bias), grads)):
        for at in np.ndindex(part.shape):
            moved = []
            for sign in (1, -1):
                parts = [emb.copy(), out.copy(), bias.copy()]
                parts[n][at] += sign * step
                moved.append(langid.loss_and_gradients(*parts, x, y)[0])
            assert np.isclose((moved[0] - moved[1]) / (2 * step), grad[at], atol=1e-6)


def test_very_long_texts_in_slices(monkeypatch):
    texts = ["the cat and the dog " * 300, "", "x" * 500, "Été à l'an " * 200, "12 34"]
    whole = [c.copy() for c in langid.subword_counts(texts)]
    for n in (1, 7, 100, 1000):
        monkeypatch.setattr(langid, "SLICE_CHARS", n)
        assert all((a == b).all() for a, b in zip(whole, langid.subword_counts(texts), strict=True))


def test_one_id_many_times(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en")] * 500 + [(k, "der Hund und die Katze", "de") for k in range(2, 40)] + [(None, "the", "en")] * 50, "doc_id long, text string, lang string")
    assert langid.fit(docs).labels == ["de", "en"]
