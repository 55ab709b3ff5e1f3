import datetime as dt

import pytest
from pyspark.sql import functions as F

from vacancia.operators import relational as rel, sinks
from vacancia.operators.providers import HashEmbedder, check_document, classify_pairs, embed_rows, provider, stricter_prompt
from vacancia.operators.rules import Rule, decide


def test_rule_tiers(spark):
    rules = {"pre_deny": [Rule(r"\bintern\b", "regex", "internship")], "deny_company": [Rule("staff")], "allow": [Rule("data", note="core")], "deny": [Rule("clerk")]}
    rows = [("Data Intern", "x"), ("Data Clerk", ""), ("Data Clerk", "Best STAFFing"), ("Clerk", None), (" ", "Staff"), (None, None), ("Cook", "y")]
    df = spark.createDataFrame(rows, "title string, company string").select(decide(rules, F.col("title"), F.col("company")).alias("d")).select("d.*")
    assert [tuple(r) for r in df.collect()] == [("drop", "pre_deny", "internship"), ("pass", "allow", "core"), ("drop", "deny_company", "staff"), ("drop", "deny", "clerk"), ("pass", "blank", "empty title"), ("pass", "blank", "empty title"), ("pass", "none", None)]


def test_insert_forms(spark):
    s = "k string, v int"
    old, new = spark.createDataFrame([("a", 1), (None, 7)], s), spark.createDataFrame([("a", 2), ("b", 3), ("b", 4), (None, 8)], s)
    assert sorted(map(tuple, rel.insert_or_ignore(old, new, ["k"], ["v"]).collect()), key=repr) == sorted([("a", 1), ("b", 3), (None, 7)], key=repr)
    assert sorted(map(tuple, rel.insert_or_replace(old, new, ["k"], ["v"]).collect()), key=repr) == sorted([("a", 2), ("b", 4), (None, 8)], key=repr)
    again = rel.insert_or_ignore(rel.insert_or_ignore(old, new, ["k"], ["v"]), new, ["k"], ["v"])
    assert again.count() == 3
    with pytest.raises(Exception, match="duplicate key"):
        rel.insert_strict(old, new, ["k"]).collect()


def test_updates(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, None, "y")], "id int, t string, s string")
    news = spark.createDataFrame([(1, None, "z"), (2, "b", None)], "id int, t string, s string")
    assert sorted(map(tuple, rel.coalesce_update(df, news, "id", ["t"], ["s"]).collect())) == [(1, "a", "z"), (2, "b", None)]
    stays, gone = rel.delete_where(df, F.col("t") == "a")
    assert [r["id"] for r in stays.collect()] == [2] and gone.first()[0] == 1


def test_health_boundaries(spark):
    def status(failed, n, why="500"):
        rows = [("s", k >= failed, why, k) for k in range(n)]
        return tuple(rel.health(spark.createDataFrame(rows, "s string, ok boolean, why string, seq int"), "s", F.col("ok"), "why", "seq").select("health", "reason").first())

    assert status(2, 10) == ("healthy", None)
    assert status(3, 10) == ("degraded", "partial_failure_rate")
    assert status(4, 4) == ("failed", "500") and status(4, 4, "HTTP 429") == ("failed", "rate_limit")


def test_transitions_and_gaps(spark):
    rows = [("s", k, v) for k, v in enumerate(["failed", "failed", "healthy", "degraded", "failed", "healthy"])]
    df = spark.createDataFrame(rows, "s string, k int, v string")
    assert [r["k"] for r in rel.transitions(df, "s", ["k"], "v", ["degraded", "failed"], ["healthy"]).orderBy("k").collect()] == [0, 3]
    day = lambda n: dt.datetime(2025, 1, 1) + dt.timedelta(days=n)
    df = spark.createDataFrame([("c", day(0)), ("c", day(30)), ("c", day(44)), ("d", day(0))], "c string, at timestamp_ntz")
    assert [r["days"] for r in rel.gaps(df, "c", ["at"], "at", 30).collect()] == [30.0]


def test_confusion_and_recommendation(spark):
    df = spark.createDataFrame([(True, 0.9), (True, 0.8), (False, 0.85), (False, 0.1)], "y boolean, s double")
    sweep = rel.confusion(df, F.col("y"), F.col("s"), [0.5, 0.87, 0.99])
    got = {r["threshold"]: tuple(r)[1:5] for r in sweep.collect()}
    assert got == {0.5: (2, 1, 0, 1), 0.87: (1, 0, 1, 2), 0.99: (0, 0, 2, 2)}
    assert rel.recommend(sweep).first()["threshold"] == 0.87


def test_embedding_cache(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, " "), (4, None), (5, "c")], "id int, t string")
    got, fresh = embed_rows(rows, "id", "t", HashEmbedder(8))
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 5] and fresh.count() == 2
    again, more = embed_rows(rows, "id", "t", HashEmbedder(8), fresh)
    assert more.count() == 0 and again.count() == 3
    with pytest.raises(ValueError, match="unknown provider"):
        provider("nothing")


def test_verdicts_and_documents(spark):
    pairs = spark.createDataFrame([((1,), (2,), 0.8), ((3,), (4,), 0.9)], "a struct<i:int>, b struct<i:int>, score double")

    def verdict(a, b, s):
        if a["i"] == 3:
            raise RuntimeError
        return True

    assert sorted(map(tuple, classify_pairs(pairs, verdict).select("score", "verdict").collect())) == [(0.8, True), (0.9, None)]
    docs = spark.createDataFrame([('{"k": "x"}',), ('{"k": "q"}',), ("{}",), ("nope",)], "raw string")
    assert [r[0] for r in docs.select(check_document("raw", "k string", {"k": ["x", "y"]})).collect()] == [[], ["k: q"], ["k: missing"], ["unreadable"]]
    assert "k: 'q'" in stricter_prompt("p", {"k": ("q", ["x"])}) and stricter_prompt("p", {}) == "p"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("bb", None)], "k string, n int")
    assert sinks.markdown(df).splitlines()[0] == "| k  | n |"
    sinks.write_csv(df.coalesce(1), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    run = sinks.run_record(spark.createDataFrame([(None, "x", 3)], "health string, reason string, n int"), "r1", "s")
    assert run.first()["health"] == "failed" and run.first()["counts"] == '{"n":3}'
    sinks.append_log(run, str(tmp_path / "log"))
    sinks.append_log(run, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    assert sinks.evolve(df, {"k": "string", "z": "double"}).columns == ["k", "z"]
