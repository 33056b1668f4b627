from pyspark.sql import functions as F

from saldo.streaming import flows

SF = "/root/testdata/sf0.001"


def days(df):
    return sorted((r["event_type"], str(r["day"]), r["n"], round(r["value"], 6)) for r in df.collect())


def test_many_batches_in_any_order_lose_no_event(spark, tmp_path):
    events = spark.read.parquet(SF + "/events.parquet")
    events.repartition(7, F.xxhash64("ts")).write.parquet(f"{tmp_path}/events.parquet")
    newest = events.orderBy(F.desc("ts")).limit(50)
    newest.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    both = events.unionByName(newest)
    want = days(both.groupBy("event_type", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")))
    got = flows.daily_flows(spark, str(tmp_path), files_per_batch=1)
    assert days(got) == want


def test_a_single_file(spark):
    assert flows.daily_flows(spark, SF).agg(F.sum("n")).first()[0] == spark.read.parquet(SF + "/events.parquet").count()
