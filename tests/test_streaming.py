import datetime as dt

from vacancia.streaming import incremental as inc

DAY = dt.datetime(2025, 1, 1)


def drain(query):
    query.processAllAvailable()
    query.stop()


def test_first_urls_equals_batch(spark, tmp_path):
    rows = [("u", "https://a.b.example/jobs/view/1?x", DAY), ("u", "http://A.B.EXAMPLE/jobs/view/1#t", DAY), ("v", "https://a.b.example/jobs/view/1", DAY), ("u", "https://a.b.example/jobs/view/2", DAY)]
    spark.createDataFrame(rows, "user_id string, url string, seen_at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id string, url string, seen_at timestamp").parquet(str(tmp_path / "in"))
    drain(inc.first_urls(stream).writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    assert spark.table("firsts").count() == 3


def test_each_batch_is_idempotent(spark, tmp_path):
    out = str(tmp_path / "out")
    write = inc.each_batch(out, "id", lambda df: df)
    a, b = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(2,), (3,)], "id int")
    write(a, 0)
    write(b, 1)
    write(b, 1)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_transition_events(spark, tmp_path):
    schema = "source string, status string, started_at timestamp"
    for k, states in enumerate((["healthy", "failed"], ["failed", "healthy", "degraded"])):
        spark.createDataFrame([("s", v, DAY + dt.timedelta(days=k, hours=i)) for i, v in enumerate(states)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drain(inc.transition_events(stream).writeStream.format("memory").queryName("turns").option("checkpointLocation", str(tmp_path / "c")).start())
    assert sorted((r["status"], r["previous"]) for r in spark.table("turns").collect()) == [("degraded", "healthy"), ("failed", "healthy")]
