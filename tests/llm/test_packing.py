import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from saldo.llm import packing, registry

SF = "/root/testdata/sf0.01"
PATH = registry.tokenizer_path("word_bpe_49k.json")
ODD = ["", None, " \n", "It's <|endoftext|>x THE", "ΣΑΣ İstanbul ǅ", "a\x1cb c", "a\xa0b c", "été ÉTÉ 12½", "😀😀 x's", "don't can't'll", "­ soft­hyphen", "x" * 3000, "日本語 text", "ﬁ ligature Å"]


def test_ids_match_the_library():
    lib, tok = Tokenizer.from_file(PATH), packing.CachedTokenizer(PATH)
    import pyarrow.parquet as pq

    texts = [t or "" for t in ODD] + pq.read_table(SF + "/documents.parquet")["text"].to_pylist()[:150]
    for _ in range(2):
        words, start, length, pool = tok.shard(texts)
        for t, w in zip(texts, words):
            assert packing.gather(w, start, length, pool)[:-1].tolist() == lib.encode(t, add_special_tokens=False).ids, t[:50]


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 3)
    lib, tok = Tokenizer.from_file(PATH), packing.CachedTokenizer(PATH)
    for texts in (["a b c d", "e f"], ["a b", "g's h. i"], ["", "a\x1cb x"]):
        words, start, length, pool = tok.shard(texts)
        for t, w in zip(texts, words, strict=True):
            assert packing.gather(w, start, length, pool)[:-1].tolist() == lib.encode(t, add_special_tokens=False).ids


def test_bm25_matches_the_formula():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 30, rng.integers(0, 25)).astype(np.int32) for _ in range(40)]
    index = packing.Bm25(docs)
    avg = np.mean([len(d) for d in docs])
    for seed in range(40):
        terms = sorted({t for t in docs[seed] if sum(t in d for d in docs) > 1}, key=lambda t: t)
        if len(terms) > packing.QUERY_TERMS:
            continue
        score = {}
        for k, d in enumerate(docs):
            s = 0.0
            for t in terms:
                df, tf = sum(t in x for x in docs), int((d == t).sum())
                s += np.log1p((40 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / avg))
            score[k] = s
        used = np.zeros(40, bool)
        used[seed] = True
        want = sorted((k for k in score if k != seed and score[k] > 0), key=lambda k: (-round(score[k], 9), k))[:8]
        got = index.neighbours(seed, used)
        assert np.allclose([score[k] for k in got], [score[k] for k in want])


def check(rows, texts, window=2048):
    """Every id of every document once, sequences gapless, whole or a power of two."""
    lib = Tokenizer.from_file(PATH)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for i, t in texts.items():
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == window or (at < window and at & (at - 1) == 0)


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(SF + "/documents.parquet").collect()}
    check(registry.op7_packing(spark, SF).collect(), texts)


@pytest.mark.parametrize("shard_chars", [1, 50, 8_000_000])
def test_odd_texts_and_small_windows(spark, shard_chars):
    texts = dict(enumerate(ODD))
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, ids string")
    rows = packing.pack(df, PATH, window=16, shard_chars=shard_chars, emit=packing.crc32_ids, schema=packing.DIGEST).collect()
    assert packing.pack(df, PATH, window=16).agg({"length": "sum"}).first()[0] == sum(r["length"] for r in rows)
    check(rows, texts, 16)
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_neighbours_share_windows():
    words = [np.array(w, np.int32) for w in ([1, 2, 3, 9], [4, 5, 6, 9], [1, 2, 3, 9], [4, 5, 6, 9])]
    pieces = packing.order_and_cut(np.array([4, 4, 4, 4]), packing.Bm25(words), 8)
    assert [[p[0] for p in pieces if p[3] == s] for s in (0, 1)] == [[0, 2], [1, 3]]


def test_seeds_of_many_terms_match_the_formula():
    rng = np.random.default_rng(7)
    docs = [rng.integers(0, 120, 90).astype(np.int32) for _ in range(50)]
    index = packing.Bm25(docs)
    df = np.array([sum(t in d for d in docs) for t in range(120)])
    idf = np.log1p((50 - df + 0.5) / (df + 0.5))
    for seed in range(50):
        terms = [t for t in set(docs[seed].tolist()) if df[t] > 1]
        assert len(terms) > packing.QUERY_TERMS
        score = np.array([sum(idf[t] * (tf := int((d == t).sum())) * 2.2 / (tf + 1.2) for t in terms) for d in docs])
        used = np.arange(50) % 3 == 0
        used[seed] = True
        want = sorted(np.flatnonzero(~used).tolist(), key=lambda k: (-score[k], k))[:8]
        assert np.allclose(score[index.neighbours(seed, used)], score[want])
        # with only the last three left unused, each still counts as a neighbour
        used = np.arange(50) < 47
        assert len(index.neighbours(seed, used)) == 3


def test_copies_from_other_partitions_share_windows(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 400, 60)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t + " more") for i, t in enumerate(texts)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string")
    of = defaultdict(set)
    for r in packing.pack(df, PATH, window=512).collect():
        of[r["doc_id"]].add(r["sequence_id"])
    assert sum(bool(of[i] & of[100 + i]) for i in range(30)) >= 20
