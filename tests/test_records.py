"""Ledger, extraction, states, fetching, configuration."""

import datetime as dt
import json

import pytest

from vacancia.operators import extraction as ex, ledger as lg, rules, sinks, state as st
from vacancia.sources import fetch, tables

SHAPE = ex.Shape({"level": ex.Field(str, ("low", "high")), "score": ex.Field(int, least=1, most=4), "tags": ex.Field(list, ("a", "b"), items=2, required=False)})


class Scripted:
    name, version = "scripted", "2"

    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def extract(self, prompt):
        self.asked.append(prompt)
        a = self.answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a, (10, 2)


def test_shape():
    assert SHAPE.errors('{"level": "low", "score": 2, "tags": ["a"]}') == {}
    assert SHAPE.errors("{") == {"": "unreadable"} and SHAPE.errors("[1]") == {"": "not an object"}
    assert set(SHAPE.errors('{"level": "mid", "score": 9, "tags": ["c"], "more": 1}')) == {"level", "score", "tags", "more"}
    assert set(SHAPE.errors('{"score": true, "tags": ["a", "b", "a"]}')) == {"level", "score", "tags"}


def test_attempts():
    good, bad = '{"level": "low", "score": 1}', '{"level": "mid", "score": 1}'
    waits = []
    m = Scripted(ex.Transient(), bad, ex.Transient(), ex.Transient(), good)
    assert ex.attempt(m, "p", SHAPE, sleep=waits.append) == (good, [("transient", 0, 0), ("invalid", 10, 2), ("transient", 0, 0), ("transient", 0, 0), ("success", 10, 2)])
    assert waits == [2, 2, 4] and "level" in m.asked[-1] and m.asked[0] == "p"
    assert ex.attempt(Scripted(*[ex.Transient()] * 3), "p", SHAPE, sleep=waits.append)[0] is None
    assert ex.attempt(Scripted(bad, bad, bad), "p", SHAPE, sleep=waits.append) == (None, [("invalid", 10, 2)] * 3)
    assert ex.attempt(Scripted(ValueError()), "p", SHAPE) == (None, [("failed", 0, 0)])
    with pytest.raises(ex.Transient):
        ex.Remote("m", "1", lambda n, p: (_ for _ in ()).throw(TimeoutError())).extract("x")


def test_extraction_asks_once_per_text(spark):
    model = ex.Offline({"level": lambda p: "high" if "senior" in p else "low", "score": lambda p: 9 if "odd" in p else 2})
    rows = spark.createDataFrame([(1, "a senior"), (2, "a senior"), (3, "odd"), (4, " "), (5, None)], "id long, text string")
    done, new = ex.extract_rows(rows, "id", "text", model, SHAPE, waits=(0,))
    got = {r["id"]: (r["status"], r["document"] and json.loads(r["document"])["level"]) for r in done.collect()}
    assert got == {1: ("success", "high"), 2: ("success", "high"), 3: ("failed", None)}
    cache = new.cache()
    assert {len(r["calls"]) for r in cache.collect()} == {1, 3}
    again, more = ex.extract_rows(rows, "id", "text", model, SHAPE, cache=cache, waits=(0,))
    assert again.count() == 3 and [r["status"] for r in more.collect()] == ["failed"]
    model.version = "9"
    assert ex.extract_rows(rows, "id", "text", model, SHAPE, cache=cache, waits=(0,))[1].count() == 2
    left, gone = ex.bust(cache, rows.where("id = 1"), "text")
    assert left.count() == 1 and gone.first()["removed"] == 1
    marked = ex.mark_failed(rows, done.where("status = 'failed'"), "id")
    assert {r["id"] for r in marked.where("extraction_status = 'failed'").collect()} == {3}
    assert ex.extract_rows(rows.limit(0), "id", "text", model, SHAPE)[0].count() == 0


def test_ledger(spark, tmp_path):
    calls = spark.createDataFrame([(dt.datetime(2025, 3, d), i, m, 1000, 500, s) for d, i, m, s in ((1, 1, "m", "success"), (15, 2, "m", "success"), (16, 3, "m", "success"), (2, 4, "m", "failed"), (3, 5, "other", "success"))], "at timestamp_ntz, item long, model string, tokens_in long, tokens_out long, status string")
    rows = lg.entries(calls, "extraction", {"m": (1.0, 2.0)})
    assert [r["cost"] for r in rows.orderBy("item").collect()] == [2.0, 2.0, 2.0, 2.0, 0.0]
    from pyspark.sql import functions as F

    assert tuple(lg.watchdog(rows, F.lit("2025-03-15").cast("date"), 3.0).first()) == (4.0, True)
    assert tuple(lg.watchdog(rows.limit(0), F.lit("2025-03-15").cast("date"), 3.0).first()) == (0.0, False)
    assert lg.append(rows, str(tmp_path / "l")) and not lg.append(rows, "nowhere://x")
    assert spark.read.parquet(str(tmp_path / "l")).count() == 5
    with pytest.raises(ValueError):
        lg.entries(calls, "nobody", {})
    hits = rows.unionByName(lg.entries(calls, "embedding_cache_hit", {"m": (1.0, 2.0)}))
    assert tuple(lg.batch_totals(hits, spark.createDataFrame([(1,), (5,), (5,)], "item long")).first()) == (2.0, 2, 2)


def test_states(spark):
    ev = spark.createDataFrame([(1, 1, "apply"), (1, 2, "view"), (2, 1, "apply"), (2, 2, "undo"), (3, 1, "view")], "k long, at long, kind string")
    assert {tuple(r) for r in st.states(ev, ["k"], "kind", ["at"], {"apply": "applied", "undo": "main"}).collect()} == {(1, "applied"), (2, "main"), (3, "main")}


def test_fetching(spark):
    now, slept = [0.0], []
    lim = fetch.Limiter(30, clock=lambda: now[0], sleep=slept.append)
    lim.wait()
    now[0] = 10.0
    lim.wait()
    assert slept == [20.0]
    pages = {"a": (200, "x"), "b": (429, ""), "c": (404, ""), "d": (503, "")}
    assert fetch.fetch_one("a", pages.get) == ("x", "ok") and fetch.fetch_one("b", pages.get) == (None, "429_rate_limited")
    assert fetch.fetch_one("d", pages.get, lambda u: (200, "y")) == ("y", "ok") and fetch.fetch_one("c", pages.get, lambda u: (200, "y")) == (None, "http_404")
    got = fetch.fetch_pages(spark.createDataFrame([("a",), ("a",), ("c",), (None,), ("z",)], "u string"), "u", lambda u: {"a": (200, "x"), "c": (404, "")}[u])
    assert {tuple(r) for r in got.collect()} == {("a", "x", "ok"), ("c", None, "http_404"), ("z", None, "error_KeyError")}


def test_files(spark, tmp_path):
    (tmp_path / "r.yaml").write_text("deny:\n  - admin\n  - {pattern: '^x', kind: regex, note: ex}\n")
    (tmp_path / "r.json").write_text('{"allow": ["data"]}')
    assert rules.load_rules(str(tmp_path / "r.yaml"))["deny"] == [rules.Rule("admin"), rules.Rule("^x", "regex", "ex")]
    assert rules.load_rules(str(tmp_path / "r.json"))["allow"] == [rules.Rule("data")]
    with pytest.raises(OSError):
        rules.load_rules(str(tmp_path / "none.yaml"))
    (tmp_path / "bad.yaml").write_text("deny: [")
    assert tables.load_settings(str(tmp_path / "bad.yaml")) == tables.Matching()
    (tmp_path / "p.yaml").write_text("extractor: x\ntimeout: 5\n")
    assert tables.load_provider(str(tmp_path / "p.yaml")) == tables.Provider("x", "hashed-words", 5.0) and tables.load_provider(None) == tables.Provider()
    assert tables.alias_map({"l": ["Python"]}, {"Py": "python", "z": "none"}) == {"python": "Python", "py": "Python"}
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("R&amp;D &#39;Admin&#39;", "c")], "t string, c string")
    assert df.select(rules.decide({"deny": [rules.Rule("r&d 'admin'")]}, F.col("t"), F.col("c")).alias("d")).first()["d"]["action"] == "drop"
    text = sinks.report("All", df, rows_of_it=df, none=df.limit(0))
    assert "# All" in text and "## rows of it" in text and text.endswith("None.")
    assert sinks.append_events(df, "seen", str(tmp_path / "e")) and spark.read.json(str(tmp_path / "e")).count() == 1
