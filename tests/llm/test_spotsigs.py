import hashlib
import re

import pytest
from pyspark.sql import functions as F

from saldo.llm import registry, spotsigs


def words_of(text):
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def brute(text):
    """Spots (anchor, chain) by a plain loop."""
    words = words_of(text)
    content = [w for w in words if w not in spotsigs.ANCHORS]
    spots = set()
    done = 0
    for w in ["^", *words]:
        if w == "^" or w in spotsigs.ANCHORS:
            chain = content[done : done + 3]
            if chain or not content:
                spots.add((w, tuple(chain)))
        else:
            done += 1
    return spots


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b) if a or b else 0.0


TEXTS = ["", None, "the", "the of", "Quick brown fox", "the quick of the brown fox", "the the cat sat on a mat and the dog ran", "Ein Haus und die Katze, für alle!", "x " * 500 + "the y", "\x01the\x01 cat", "the quick of the brown fox"]


def test_signatures_count_spots(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, sigs string")
    got = {r["doc_id"]: r for r in spotsigs.signatures(df, "text", "sigs").withColumn("fp", spotsigs.fingerprint(spotsigs.F.col("sigs"))).collect()}
    for i, t in enumerate(TEXTS):
        want = brute(t or "")
        if words_of(t or "") and all(w in spotsigs.ANCHORS for w in words_of(t)):
            assert len(got[i]["sigs"]) >= 1
        else:
            assert len(got[i]["sigs"]) == (len(want) if words_of(t or "") else 0), t
        assert len(got[i]["fp"]) == 8 * len(got[i]["sigs"]) and got[i]["sigs"] == sorted(set(got[i]["sigs"]))
    assert got[5]["fp"] == got[10]["fp"]


def follow(spark, rows, **options):
    """Each row's next row's text, by a plain sort."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = spotsigs.with_next(df, ["text"], text="text", id_col="doc_id", **options)
    hashes = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]], r[1]))
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["doc_id"], r["text"], r["next_text"]) for r in got.collect()), key=key) == sorted(((*r, order[(k + 1) % len(order)][1]) for k, r in enumerate(order)), key=key)


@pytest.mark.parametrize("ids", [[7], [3, 9], list(range(0, 90, 3)), [5, 5, 5, 1, 9], [None, 4, None, -3, 2**62], [None] * 3])
@pytest.mark.parametrize("range_chars", [1, 20, 10**6])
def test_next_by_descending_id(spark, ids, range_chars):
    follow(spark, [(i, f"t{k:03d}") for k, i in enumerate(ids)], range_chars=range_chars)


def test_next_where_one_id_or_null_holds_a_third_of_all_rows(spark):
    rows = [(i if i % 3 else 50, f"t{i * 7919 % 10007:05d}") for i in range(600)] + [(None, f"n{k}") for k in range(200)]
    follow(spark, rows, range_chars=40)
    follow(spark, rows, range_chars=40, max_ranges=11)


def test_five_thousand_ranges(spark):
    rows = [(i, f"text {i}") for i in range(0, 40_000, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = spotsigs.with_next(df, ["text"], text="text", id_col="doc_id", range_chars=40)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN") < 20
    assert {r["doc_id"]: r["next_text"] for r in got.collect()} == {i: f"text {i - 2 if i else 39_998}" for i, _ in rows}


def test_many_shuffle_partitions_and_very_long_texts(spark, tmp_path):
    long_ = "the quick of the brown fox " * 80_000
    spark.createDataFrame([(1, long_), (2, "x" * 1_000_000), (3, long_ + "end"), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1000")
    try:
        got = {r["doc_id"]: r for r in registry.op4_spotsigs(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[3]["edited_sha256"] == hashlib.sha256(((long_ + "end")[: len(long_) + 3 - (len(long_) + 3) // 2] + "x" * 1_000_000).encode()).hexdigest()


def test_query_matches_brute_force(spark, tmp_path):
    texts = [t for t in TEXTS if not t or "\x01" not in t] + ["Été à la plage 😀😀 the end of it", "only the of"]
    rows = [(i * 7 % 31, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in registry.op4_spotsigs(spark, str(tmp_path)).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    for k, (i, t) in enumerate(order):
        n = order[(k + 1) % len(order)][1]
        h = len(t) // 2
        edited = t[: len(t) - h] + n[:h]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        if all(any(w not in spotsigs.ANCHORS for w in words_of(x)) or not words_of(x) for x in (t, n, edited)):
            assert abs(r["near_edited"] - jaccard(brute(t) if words_of(t) else set(), brute(edited) if words_of(edited) else set())) < 1e-12
            assert abs(r["near_next"] - jaccard(brute(t) if words_of(t) else set(), brute(n) if words_of(n) else set())) < 1e-12
    assert len(got) == len(rows)


def test_no_python_in_the_plan(spark):
    plan = registry.op4_spotsigs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert registry.op4_spotsigs(spark, str(tmp_path)).count() == 0


def test_similar_pairs_match_brute_force(spark):
    import random

    rng = random.Random(3)
    vocab = ["w%s" % c for c in "abcdefghijklmnopqrstuv"] + ["the", "of", "a"] * 4
    rows = []
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(20, 120))]
        for _ in range(6):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(words + base[: rng.randint(0, 12)])))
    rows += [(len(rows), rows[0][1]), (len(rows) + 1, ""), (len(rows) + 2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for threshold in (0.8, 0.5):
        pairs, members = spotsigs.similar_pairs(df, threshold=threshold)
        sets = {i: brute(t) if words_of(t or "") else set() for i, t in rows}
        cls = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
        assert {r["id"]: r["class"] for r in members.collect()} == cls
        reps = sorted(set(cls.values()))
        want = {(a, b) for a in reps for b in reps if a < b and sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= threshold}
        assert {(r["a"], r["b"]) for r in pairs.collect()} == want and want
    assert spotsigs.similar_pairs(df.limit(0))[0].count() == 0


def test_links_query_matches_brute_force(spark, tmp_path):
    import random

    rng = random.Random(5)
    vocab = [f"w{c}{d}" for c in "abcdefghij" for d in "klmno"]
    rows = []
    for g in range(8):
        base = [rng.choice(vocab + ["the", "of"] * 9) for _ in range(rng.randint(30, 90))]
        for _ in range(5):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows), rows[0][1]), (len(rows) + 1, ""), (len(rows) + 2, None), (len(rows) + 3, "??")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = {i: brute(t) if words_of(t or "") else set() for i, t in rows}
    linked = {i: {j for j in sets if j != i and sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= 0.8} for i in sets}
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            low = min([comp[i], *(comp[j] for j in linked[i])])
            changed |= low != comp[i]
            comp[i] = low
    got = {r["doc_id"]: (r["n_links"], r["component_id"]) for r in registry.spotsigs_links(spark, str(tmp_path)).collect()}
    assert got == {i: (len(linked[i]), comp[i]) for i in sets} and max(n for n, _ in got.values()) > 2
    plan = spotsigs.similar_pairs(spark.read.parquet(f"{tmp_path}/documents.parquet"))[0]._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
