"""Queries of the language-model operators, as the driver entry registers them."""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saldo.llm import chat, embedlinks, langid, packing, sampling, secrets, simhash, spotsigs, toxicity, urlfilter
from saldo.llm.common import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return simhash.near_duplicates(docs).withColumnRenamed("id", "doc_id")


def held_out(column: str, folds: int, fold: int):
    """Whether crc32 of the id as text falls into one fold."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(folds)) == fold


@query
def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = langid.fit(docs.where(~held_out("doc_id", 4, 2)))
    said = langid.identify(docs.select("doc_id", "text"), model)
    return said.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(~held_out("doc_id", 3, 1)))
    scored = toxicity.score(docs, model, name="score")
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def _read_back(batches):
    """Digest of each conversation from its formatted examples, which come in order and next to each other."""
    def line(conv, last, loss, chars):
        turns = chat.parse(last)
        said = "".join(loss)
        return {
            "conv_id": conv, "n_turns": len(turns), "turns_sha256": sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
            "loss_chars": len(said), "loss_sha256": sha256(said.encode()).hexdigest(), "formatted_chars": chars,
        }

    now, last, loss, chars = None, "", [], 0
    for pdf in batches:
        out = []
        for conv, formatted, a, b, n in zip(pdf["conv_id"], pdf["formatted"], pdf["loss_start"], pdf["loss_end"], pdf["example"]):
            if n == 0:
                if now is not None:
                    out.append(line(now[0], last, loss, chars))
                now, loss, chars = (conv,), [], 0
            last, chars = formatted, chars + len(formatted)
            loss.append(chat.unescape(formatted[a:b]))
        yield pd.DataFrame(out, columns=DIGEST)
    if now is not None:
        yield pd.DataFrame([line(now[0], last, loss, chars)], columns=DIGEST)


DIGEST = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


@query
def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations expanded to one example per assistant turn, and read back."""
    said = "</s>[INST] ok [/INST]"
    columns = ["conv_id", "turn", "role", "text"]
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    convs = table(spark, sf_dir, "conversations", *columns).unionByName(extra)
    return chat.examples(convs).mapInPandas(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


ORACLE_SQL["op9_chat"] = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (
  SELECT *, coalesce(role, '') = 'assistant' AS says,
    length('<|start|>' || coalesce(role, '') || '<|text|>' || text || '<|end|>') + len(regexp_extract_all(coalesce(role, '') || chr(10) || text,
      '<\\*(/?s>|<SYS>>|</SYS>>|\|(start|text|end|im_start|im_end|endoftext|system|user|assistant)\|>)|\[\\*/?INST\]')) AS chars FROM t),
r AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn) AS upto,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM s)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (says), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (says), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (says OR back = 1) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id"""


@query
def op2_embedlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.9 or more."""
    got = embedlinks.near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return got.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


ORACLE_SQL["op2_embedlinks"] = """
WITH RECURSIVE e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    AND list_cosine_similarity(a.v, b.v) >= 0.9),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN n ON n.vec_id = c.vec_id"""


@query
def op5_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the fixed rules on every page's url; unlisted urls are allowed."""
    got = urlfilter.judge(table(spark, sf_dir, "pages", "page_id", "url"), urlfilter.entries(spark))
    return got.withColumnRenamed("id", "page_id")


ORACLE_SQL["op5_urlfilter"] = r"""
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(h, p, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (
  SELECT page_id, host, path, r.h || r.p AS rule, verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(r.h) DESC NULLS LAST, length(r.p) DESC) AS n
  FROM q LEFT JOIN r ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE n = 1"""


@query
def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SpotSigs fingerprints of every document and of its text half replaced by the next document's."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = spotsigs.with_next(docs, ["text", "sigs"], text="text", id_col="doc_id", prepare=lambda rows: spotsigs.signatures(rows, "text", "sigs"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    both = spotsigs.signatures(pairs.select("doc_id", F.length("text").cast("long").alias("n_chars"), "sigs", "next_sigs", edited.alias("edited")), "edited", "edited_sigs")
    return both.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        spotsigs.fingerprint(F.col("sigs")).alias("fingerprint"), spotsigs.fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        spotsigs.likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), spotsigs.likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


@query
def spotsigs_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, number of links and component of every document at SpotSigs likeness 0.8, by the join partitioned by set length."""
    return spotsigs.links(table(spark, sf_dir, "documents", "doc_id", "text")).withColumnRenamed("id", "doc_id")


def _spans_text(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: fixed patterns and what the field adds."""
    found = secrets.scan(table(spark, sf_dir, "documents", "doc_id", "text"), secrets.train())
    kinds = F.transform("base_spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(_spans_text(F.col("base_spans")), 256).alias("base_sha256"), _spans_text(F.col("spans")).alias("spans"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 tokens by lexical retrieval."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    pieces = packing.pack(docs, tokenizer_path("word_bpe_49k.json"), emit=packing.crc32_ids, schema=packing.DIGEST)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op6_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document, without replacement, as digests; the text's crc32 is that of the decoded ids."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return sampling.sample_encode(docs, tokenizer_path("piece_bpe_32k.model"), emit=sampling.digest, schema=sampling.DIGEST)
