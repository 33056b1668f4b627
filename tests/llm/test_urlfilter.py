import random

from pyspark.sql import functions as F

from saldo.llm import registry, urlfilter

SF = "/root/testdata/sf0.01"


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] + [len(tail)])]
    fits = [(len(h), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, default)


URLS = [
    None, "", "nothing", "http://", "http:///x", "https://Example.NET/en/a?b#c", "http://a.example.net/en", "http://a.example.net/en/", "http://net", "http://net/", "http://NET?x/",
    "http://xnet/", "http://a.b.example.com/de/q", "http://notexample.com/de/q", "https://x.org/fr/1#z", "https://x.org/FR/1", "http://É.net/\n/y", "a://b://c.net/", "http://.net/", "http://net./", "http://x..net/a",
    "ftp://org/fr/", "http://example.net:80/en/", "http://u@example.net/en/",
]


def test_rules_match_brute_force(spark):
    rows = [(i, u, "clash") for i, u in enumerate(URLS + URLS[5:9])]
    got = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, rule string"), urlfilter.entries(spark))
    assert sorted(tuple(r) for r in got.collect()) == sorted((i, *brute(u, urlfilter.RULES)) for i, u, _ in rows)


def test_long_list_with_false_positives(spark, monkeypatch):
    rng = random.Random(4)
    hosts = [f"h{k}.{t}" for k in range(300) for t in ("com", "net")]
    rules = [(h, p, rng.choice(["block", "allow"])) for h in hosts[::2] for p in ("/", "/a/b/", "/c")]
    urls = [(k, f"http://{rng.choice(['', 'www.', 'x.y.'])}{rng.choice(hosts)}{rng.choice(['', '/', '/a/b/c', '/cd', '/a/b'])}") for k in range(500)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    want = sorted((i, *brute(u, rules)) for i, u in urls)
    for bits, rows in ((12, 200_000), (1, 200_000), (12, 10)):
        monkeypatch.setattr(urlfilter, "BITS_PER_KEY", bits)
        monkeypatch.setattr(urlfilter, "BROADCAST_ROWS", rows)
        assert sorted(tuple(r) for r in urlfilter.judge(pages, urlfilter.entries(spark, rules)).collect()) == want


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    blocks, n = urlfilter.bloom_filter(keys, "key", 5000)
    probe = spark.range(20000).select("id", F.concat(F.lit("k"), "id").alias("key"))
    words = urlfilter._words(F.col("key"))
    ok = F.lit(True)
    for k, w in enumerate(words):
        ok &= w.bitwiseAND(F.col(f"w{k}")) == w
    hit = probe.withColumn("block", urlfilter._block(F.col("key"), n)).join(blocks, "block").where(ok)
    inside, outside = hit.where("id < 5000").count(), hit.where("id >= 5000").count()
    assert inside == 5000 and outside < 0.03 * 15000


def test_empty_tables_and_nulls_in_list(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    none = urlfilter.entries(spark, [("net", None, "block"), (None, "/", "block"), ("", "/", "block")])
    assert urlfilter.judge(pages, none).collect()[0]["verdict"] == "allow"
    assert urlfilter.judge(pages.limit(0), urlfilter.entries(spark)).count() == 0


def test_oracle(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = sorted(con.execute(registry.ORACLE_SQL["op5_urlfilter"]).fetchall())
    assert sorted(tuple(r) for r in registry.op5_urlfilter(spark, SF).select("page_id", "host", "path", "rule", "verdict").collect()) == want
