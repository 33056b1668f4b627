import itertools
from collections import Counter

import numpy as np
import pytest

from saldo.llm import registry, sampling

PATH = registry.tokenizer_path("piece_bpe_32k.model")
ODD = ["", None, "a", " ", " a", "  a b ", "a\nb\t", "日本語 ☃", "ﬁ Ａ é 😀", "x" * 300, "the cat sat", " " * 40]


@pytest.fixture(scope="module")
def sampler():
    return sampling.Sampler(PATH)


def brute(sampler, text):
    """Log-probability of every segmentation of a text, by enumeration."""
    vocab = sampler.vocab
    ids = {vocab.sp.id_to_piece(i): i for i in range(3, vocab.sp.get_piece_size()) if not vocab.sp.is_byte(i)}
    full = (sampling.SPACE + text).replace(" ", sampling.SPACE)

    def paths(at):
        if at == len(full):
            yield (), 0.0
        for end in range(at + 1, len(full) + 1):
            piece = full[at:end]
            if piece in ids:
                head, lp = (ids[piece],), vocab.log_prob[ids[piece]]
            elif end == at + 1:
                raw = piece.encode()
                head, lp = tuple(int(vocab.byte_id[b]) for b in raw), len(raw) * vocab.log_prob[vocab.byte_id[0]]
            else:
                continue
            for tail, rest in paths(end):
                yield head + tail, lp + rest

    scores = dict(paths(0))
    total = np.logaddexp.reduce(list(scores.values()))
    return {k: v - total for k, v in scores.items()}


@pytest.mark.parametrize("text", ["the cat", "é☃ab", "  in a", " in", "a "])
def test_probabilities_and_order_of_all_segmentations(sampler, text):
    want = brute(sampler, text)
    got = list(sampler.sample([5], [text], len(want) + 3))
    assert len(got) == len(want)
    for _, _, ids, lp, _, _ in got:
        assert abs(want[tuple(ids.tolist())] - lp) < 1e-9
    values = [g for *_, g, _ in got]
    assert values == sorted(values, reverse=True)


def test_sampling_without_replacement_has_the_right_frequencies(sampler):
    want = brute(sampler, "the cat")
    n = 6000
    first, pairs = Counter(), Counter()
    included, scores = Counter(), Counter()
    for key in range(0, n, 1000):
        rows = list(sampler.sample(list(range(key, key + 1000)), ["the cat"] * 1000, 2))
        for _, group in itertools.groupby(rows, lambda r: r[0]):
            a, b = list(group)
            first[tuple(a[2].tolist())] += 1
            pairs[tuple(a[2].tolist()), tuple(b[2].tolist())] += 1
            for s in (a, b):
                included[tuple(s[2].tolist())] += 1
                scores[tuple(s[2].tolist())] += np.exp(s[3] - s[5])
    for seg, lp in want.items():
        p = np.exp(lp)
        assert abs(first[seg] / n - p) < 4 * np.sqrt(p * (1 - p) / n) + 1e-3
        assert abs(scores[seg] / n - p) < 0.03  # p over its inclusion score is unbiased
        for other, lq in want.items():
            if other != seg:
                q = p * np.exp(lq) / (1 - p)
                assert abs(pairs[seg, other] / n - q) < 4 * np.sqrt(q * (1 - q) / n) + 1e-3


def test_round_trip_distinct_and_independent_of_batches(sampler, monkeypatch):
    texts = [t or "" for t in ODD] * 2
    keys = list(range(len(texts)))
    together = list(sampler.sample(keys, texts, 3))
    for i, rows in itertools.groupby(together, lambda r: r[0]):
        rows = list(rows)
        assert len({tuple(r[2].tolist()) for r in rows}) == len(rows) <= 3
        for r in rows:
            assert sampler.vocab.decode(r[2]) == texts[i] == sampler.vocab.sp.decode(r[2].tolist())
            assert r[5] <= 0
    monkeypatch.setattr(sampling, "CACHE_ARCS", 0)
    fresh = sampling.Sampler(PATH)
    alone = [(k, *r[1:]) for k, t in zip(keys, texts) for r in fresh.sample([k], [t], 3)]
    for a, b in zip(together, alone, strict=True):
        assert a[0] == b[0] and a[2].tolist() == b[2].tolist() and np.allclose(a[3:], b[3:])


def test_dataframes(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)] + [(ODD.index("the cat sat"), "the cat sat", 1)], "doc_id long, text string, sample int")
    got = sampling.sample_encode(df, PATH, k=3)
    back = sampling.decode(got, PATH).collect()
    assert all(r["decoded"] == (ODD[r["doc_id"]] or "") for r in back)
    assert sum(r["doc_id"] == ODD.index("the cat sat") for r in back) == 6
    assert sampling.sample_encode(df.limit(0), PATH).count() == 0
    best = sampling.decode(sampling.encode(df, PATH), PATH).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in best)


def test_query(spark):
    import zlib

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(sf + "/documents.parquet").collect()}
    rows = registry.op6_sampling(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        assert r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
    assert len({(r["doc_id"], r["ids_crc32"]) for r in rows}) == len(rows)


def test_looking_at_all_prefixes_changes_nothing_and_shallow_ones_do():
    vocab_path = registry.tokenizer_path("piece_bpe_32k.model")
    texts = ["the quick brown fox jumps over the lazy dog " * 12, "Ein sehr langes Wort: Donaudampfschifffahrt", "a", ""]
    made = {}
    for deep in (sampling.DEEP, None, 0.0):
        got = sampling.Sampler(vocab_path).sample(list(range(len(texts))), texts, 3, deep)
        made[deep] = [(i, s, ids.tolist(), lp, g, inc) for i, s, ids, lp, g, inc in got]
    assert made[sampling.DEEP] == made[None] and made[0.0] != made[None]
