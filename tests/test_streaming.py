from quoin.streaming.landing import LANDING_SCHEMA, stories_from

NOW = 1_764_547_200_000


def test_batches_are_parsed_once(spark, tmp_path):
    src = spark.createDataFrame([("p", "Pub", "#1", "pub.example", [])], "id string, name string, color string, domain string, plan array<struct<kind string, arg array<string>, types array<string>>>")
    item = "<item><title>Title {}</title><link>https://pub.example/{}</link></item>"

    def land(n):
        spark.createDataFrame([("p", 0, "rss", "u", 0, item.format(n, n), n, 200), ("p", 1, "rss", "u", 0, None, n, None)], LANDING_SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")

    for n in (1, 2):
        land(n)
        stories_from(spark, f"{tmp_path}/in", src, f"{tmp_path}/out", f"{tmp_path}/cp", NOW).awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.title, r.batch_no) for r in got) == [("Title 1", 0), ("Title 2", 1)]
