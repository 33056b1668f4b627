import corpus_pipeline
from saldo.llm import langid, packing, secrets, simhash, toxicity
from saldo.llm.registry import held_out
from tests.llm.test_packing import check
from tests.llm.test_secrets import brute_base

SF = "/root/testdata/sf0.01"


def plain_redact(text, spans):
    out, at = "", 0
    for s, e, _ in spans:
        if e > at:
            out += text[at:s] + "[SECRET]" if s >= at else ""
            at = e
    return out + text[at:]


def test_pipeline_matches_plain_python(spark):
    docs = spark.read.parquet(SF + "/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    language = langid.fit(docs)
    kept = {i for i, t in rows.items() if not language.predict([t])[2][0]}
    assert len(kept) > 0.99 * len(rows)
    labels = spark.read.parquet(SF + "/labels.parquet")
    left = docs.where(docs["doc_id"].isin(*kept))
    mood = toxicity.fit(left, labels.select("doc_id", "toxic").where(~held_out("doc_id", 3, 1)))
    kept = {i for i in kept if mood.score(rows[i]) < toxicity.THRESHOLD}
    marked = {r["doc_id"] for r in labels.where("toxic = 0").collect()}
    assert len(kept & marked) > 0.98 * len(marked & set(rows))
    # five-word prints of 256 bits, all pairs; the stage may lose a link of likeness well below 0.8 only
    cache = simhash._WordHashes()
    fps = {i: int.from_bytes(simhash.wide_print(simhash.shingle_hashes(rows[i], cache))[0].tobytes(), "big") for i in kept}
    groups = []
    for i in sorted(kept):
        near = [g for g in groups if any((fps[i] ^ x).bit_count() <= simhash.WIDE_RADIUS for x in g[1])]
        groups = [g for g in groups if g not in near] + [(min([i, *(g[0] for g in near)]), {fps[i]}.union(*(g[1] for g in near)))]
    kept = {g[0] for g in groups}
    field = secrets.train()
    texts = {}
    for i in kept:
        base, spans = secrets.scan_text(rows[i], field)
        assert base == brute_base(rows[i])
        texts[i] = plain_redact(rows[i], spans)
    check(corpus_pipeline.run(spark, SF).collect(), texts)


def test_stages_on_odd_tables(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1, "the cat and the dog", "en", None, 19), (1, "the cat and the dog", "en", None, 19), (2, None, None, None, None), (3, "", "de", "s", 0), (None, "le chat et le chien", None, "s", 1)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, kind)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == list(corpus_pipeline.COLUMNS), name
            out.count()
        assert corpus_pipeline.pack(spark, docs, str(tmp_path)).count() >= len(rows)
    docs = spark.createDataFrame(odd, kind)
    assert sorted(r["doc_id"] or 0 for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()) == [0, 1, 2]


def test_stages_keep_repeated_ids_long_texts_and_columns(spark, tmp_path):
    """Different texts under one id both stay; clashing columns don't reach the result."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    long_ = " ".join(f"w{k * k % 9973}" for k in range(200_000))
    rows = [(1, "the cat and the dog", "en", "s", 19, "a", 1), (1, long_, "en", "s", len(long_), "b", 2), (1, long_, "en", "s", len(long_), "c", 2), (2, "quite another text", "en", "s", 18, "d", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string, _h long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = [(r["doc_id"], r["text"]) for r in stage(spark, docs, str(tmp_path)).collect()]
        assert set(got) == {(r[0], r[1]) for r in rows} and len(got) == (3 if name == "simhash" else 4), name
