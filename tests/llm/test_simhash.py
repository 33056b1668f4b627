import re

import numpy as np
import xxhash

from saldo.llm import simhash


def brute(rows):
    """Components over all pairs, with fingerprints computed bit by bit."""
    def fp(text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
        if not words:
            return 0
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    f = {i: fp(t) for i, t in rows}
    comp = {i: i for i in f}
    changed = True
    while changed:
        changed = False
        for a in f:
            for b in f:
                if bin(f[a] ^ f[b]).count("1") <= 3 and comp[a] < comp[b]:
                    comp[b] = comp[a]
                    changed = True
    return {(i, f"{f[i]:016x}", comp[i]) for i in f}


def corpus():
    rng = np.random.default_rng(5)
    vocab = ["w%d" % i for i in range(60)]
    base = [" ".join(rng.choice(vocab, 300)) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "One"), (5, "a b"), (6, "Ärger ÄRGER x y"), (7, "a b c")]
    for k, text in enumerate(base):
        words = text.split()
        for n in range(12):
            edited = list(words)
            for p in rng.integers(0, len(words), n // 2):
                edited[p] = "edit%d" % n
            rows.append((100 * (k + 1) + n, " ".join(edited)))
    return rows


def test_query_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, fp int")
    for cell_rows in (1024, 3):
        got = simhash.near_duplicates(docs, cell_rows=cell_rows)
        assert {tuple(r) for r in got.collect()} == brute(rows)


def test_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    assert sorted((r["id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()) == [(1, 1), (1, 1), (2, 1)]


def test_random_fingerprints_link_exactly(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 62, 40).tolist()
    fps = set(centres)
    for c in centres:
        for _ in range(15):
            x = c
            for b in rng.integers(0, 64, rng.integers(1, 7)):
                x ^= 1 << int(b)
            fps.add(simhash._signed(x))
    fps = sorted(fps)
    want = {(i, j) for i in range(len(fps)) for j in range(i) if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= 3}
    root = {i: i for i in range(len(fps))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in want:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    points = spark.createDataFrame(list(enumerate(fps)), "id long, fp long")
    from saldo.llm.common import connected_components

    for rows in (1024, 4):
        comps = {r["node"]: r["component"] for r in connected_components(simhash.link_edges(points, cell_rows=rows)).collect()}
        assert {i: comps.get(i, i) for i in root} == {i: find(i) for i in root}


def test_null_ids(spark):
    big = 2**60
    docs = spark.createDataFrame([(None, "a b c d"), (big + 1, "a b c d"), (big + 3, "a b c d"), (None, "x y z v w"), (None, None), (5, "")], "doc_id long, text string")
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r["id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 5), (0, big + 1), (5, 5), (big + 1, big + 1), (big + 3, big + 1)]


def test_very_long_texts(spark):
    rng = np.random.default_rng(2)
    long_ = " ".join("w%d" % k for k in rng.integers(0, 5000, 300_000))
    docs = spark.createDataFrame([(1, long_), (2, long_ + " end"), (3, "x" * 2_000_000), (4, "short")], "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    assert sorted(r["doc_id"] for r in simhash.keep_first(docs).collect()) == [1, 3, 4]


def edited(words, share, rng):
    words = list(words)
    for k in rng.choice(len(words), max(1, int(share * len(words))), replace=False):
        words[k] = "new%d" % rng.integers(1 << 30)
    return words


def likeness(a, b):
    sets = [{" ".join(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_copies_are_linked_and_others_not(spark):
    """Pairs of shingle likeness 0.8 or more are linked in 95 of 100 cases; texts that share less than half never."""
    rng = np.random.default_rng(8)
    vocab = ["v%d" % i for i in range(3000)]
    rows, pairs = [], []
    for k in range(300):
        words = list(rng.choice(vocab, int(rng.integers(80, 600))))
        a, b = " ".join(words), " ".join(edited(words, rng.uniform(0.001, 0.06 if k % 3 else 0.3), rng))
        pairs.append((len(rows), len(rows) + 1, likeness(a, b)))
        rows += [a, b]
    passage = list(rng.choice(vocab, 60))
    rows += [" ".join([*rng.choice(vocab, 120), *passage, *rng.choice(vocab, 120)]) for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    group = {r["doc_id"]: r["group"] for r in simhash.near_copies(docs).collect()}
    alike = [group[a] == group[b] for a, b, j in pairs if j >= 0.8]
    assert len(alike) > 60 and np.mean(alike) >= 0.95
    assert not any(group[a] == group[b] for a, b, j in pairs if j < 0.5)
    assert len({group[i] for i in range(600, 700)}) == 100


def test_near_copies_match_all_pairs(spark):
    """Groups against a plain comparison of all fingerprints; cells may lose a link of likeness well below 0.8 only."""
    rng = np.random.default_rng(9)
    vocab = ["v%d" % i for i in range(500)]
    rows = []
    for _ in range(25):
        words = list(rng.choice(vocab, 200))
        rows += [" ".join(edited(words, 0.01, rng)) for _ in range(8)]
    rows += ["", None, rows[0], "one two"]
    cache = simhash._WordHashes()
    fps = [simhash.wide_print(simhash.shingle_hashes(t, cache))[0] for t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sum(int(a ^ b).bit_count() for a, b in zip(fps[i], fps[j])) <= simhash.WIDE_RADIUS:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for cell_rows in (1024, 3):
        group = {r["doc_id"]: r["group"] for r in simhash.near_copies(docs, cell_rows=cell_rows).collect()}
        got = {}
        for i, g in group.items():
            got.setdefault(g, set()).add(root[i])
        assert all(len(x) == 1 for x in got.values()) and len(got) == len(set(root))


def test_keep_first_by_id_then_content(spark):
    words = " ".join("w%d" % k for k in range(90))
    rows = [(1, words, "a"), (1, words + " z", "b"), (1, "another text", "c"), (1, "another text", "c"), (None, words, "a"), (None, "alone", None), (0, "another text", "d"), (3, None, "e"), (2, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string")
    once = sorted(simhash.keep_first(docs).collect(), key=str)
    assert sorted(simhash.keep_first(docs.repartition(3)).collect(), key=str) == once
    kept = [(r["doc_id"], r["text"]) for r in once]
    assert len(kept) == 4 and (None, "alone") in kept and (0, "another text") in kept and (2, "") in kept
    assert sum(i == 1 for i, _ in kept) == 1
    assert simhash.keep_first(docs.limit(0)).count() == 0
