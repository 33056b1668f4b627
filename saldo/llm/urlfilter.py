"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join. DataFrame functions only.

A list holds canonical entries (host, path, verdict): an entry fits its host and all subdomains of it where
the url's path starts with the entry's path; the longest entry (host, then path) wins. A url is expanded to
the keys it could be listed under: every host suffix at a dot, with the path cut to each path length that
the list holds. Keys are probed in a Bloom filter of 256-bit blocks (four longs): one block by the key's
hash, PROBES bits in it, so a probe reads one row. Hits then meet the list in an exact equi-join, which
removes false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 12
BLOCK_BITS = 256
PROBES = 6
#: Filters and lists of up to this many rows are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000
SALTS = 32
SEP = "\x00"
#: The contract's list: host/path entries, fixed values.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or no "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return _lower(host), path


def canonical(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit(SEP), path)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _words(key: Column) -> list[Column]:
    """The four longs of the key's bits in its block, from bytes of a second hash."""
    h = F.xxhash64(key, F.lit(1))
    spots = [F.pmod(F.shiftrightunsigned(h, 8 * k), F.lit(BLOCK_BITS)).cast("int") for k in range(PROBES)]
    out = []
    for w in range(BLOCK_BITS // 64):
        word = F.lit(0).cast("long")
        for s in spots:
            word = word.bitwiseOR(F.when(F.floor(s / 64) == w, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(s, F.lit(64)))).otherwise(F.lit(0).cast("long")))
        out.append(word)
    return out


def bloom_filter(keys: DataFrame, key: str, n: int) -> tuple[DataFrame, int]:
    """Blocks (block, w0..w3) of a filter over n keys, and their number."""
    blocks = max(1, -(-n * BITS_PER_KEY // BLOCK_BITS))
    words = _words(F.col(key))
    made = keys.select(_block(F.col(key), blocks).alias("block"), *[w.alias(f"w{k}") for k, w in enumerate(words)])
    return made.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(len(words))]), blocks


def entries(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def judge(pages: DataFrame, listed: DataFrame, *, url: str = "url", id_col: str = "page_id", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) per row of pages; rule is the winning entry (host and path) or null, verdict then `default`.

    listed: (host, path, verdict), host lower-case. A null in it drops the entry; of repeated entries with
    different verdicts, block wins. Urls repeat freely: they are judged once and joined back by their value,
    so a url or host that very many rows share costs one row. Nulls and urls without "://" have empty parts,
    which no entry fits. Empty tables give empty or unlisted results; other columns are ignored.
    """
    clean = listed.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL AND host <> ''")
    clean = clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("key", canonical(F.col("host"), F.col("path")))
    sizes = clean.groupBy(F.length("path").alias("n")).agg(F.count(F.lit(1)).alias("c")).collect()  # as many rows as path lengths
    n = sum(r["c"] for r in sizes)
    lengths = sorted(r["n"] for r in sizes)
    host, path = parts(F.col(url))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    if not n:
        return rows.select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    small = n <= BROADCAST_ROWS
    hint = F.broadcast if small else (lambda df: df)
    blocks, n_blocks = bloom_filter(clean, "key", n)
    # one row for each host and each cut path, whatever the number of urls below it
    cut = max(lengths)
    sites = rows.select("host", F.substring("path", 1, cut).alias("start")).distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    heads = F.array(*[F.when(F.length("start") >= k, F.substring("start", 1, k)) for k in lengths])
    keys = sites.where("host <> ''").select("host", "start", F.explode(suffixes).alias("suffix")).select("host", "start", "suffix", F.explode(heads).alias("head")).where("head IS NOT NULL")
    keys = keys.withColumn("key", canonical(F.col("suffix"), F.col("head"))).withColumn("block", _block(F.col("key"), n_blocks))
    words = _words(F.col("key"))
    maybe = keys.join(hint(blocks), "block").where(
        (words[0].bitwiseAND(F.col("w0")) == words[0]) & (words[1].bitwiseAND(F.col("w1")) == words[1]) & (words[2].bitwiseAND(F.col("w2")) == words[2]) & (words[3].bitwiseAND(F.col("w3")) == words[3])
    ).select("host", "start", "key", "suffix", "head")
    hits = maybe.join(hint(clean.select("key", "verdict")), "key")
    best = hits.groupBy("host", "start").agg(F.max(F.struct(F.length("suffix"), F.length("head"), F.concat("suffix", "head").alias("rule"), F.col("verdict"))).alias("b"))
    best = best.select(F.col("host").alias("h"), F.col("start").alias("s"), F.col("b.rule").alias("rule"), F.col("b.verdict").alias("verdict"))
    # a host may hold a third of all rows: each verdict is laid out SALTS times and rows spread over them by id
    best = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    joined = rows.join(best, (rows["host"] == best["h"]) & (F.substring("path", 1, cut) == best["s"]) & (rows["part"] == best["salt"]), "left")
    return joined.select("id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
