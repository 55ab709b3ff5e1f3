"""The distributed resolution against a plain fold over all postings in the order of their ids as text."""

import datetime as dt
import random

from vacancia.operators.resolve import IN, Block, counters, resolve

SCHEMA = "posting_id string, user_id string, company string, team string, location string, title string, seniority string, skills array<string>, vector array<double>, source_kind string, first_seen timestamp_ntz, last_seen timestamp_ntz, full_jd string, source string"


def rows(seed, n=60):
    r = random.Random(seed)
    out = []
    for k in range(n):
        day = dt.datetime(2025, 1, 1) + dt.timedelta(days=r.randint(0, 90))
        out.append((str(k), "u", r.choice(["A", "a", "", None]), r.choice(["t", None]), r.choice(["X", "Y"]), r.choice(["eng", "sci"]), r.choice(["Senior", "senior ", None]), r.choice([["p", "q"], ["p"], [], None]), r.choice([[1.0, 0.0], [0.0, 1.0], [1.0, 0.1], None]), r.choice(["role_summary", "role_summary", "full_jd"]), day, day, "x" * r.randint(0, 40), r.choice(["s1", "s2", None])))
    return out


def plain(data, verdict):
    blocks, out = {}, {}
    for p in sorted(data, key=lambda p: p[0]):
        p = dict(zip(IN, p, strict=True))
        b = blocks.setdefault((p["user_id"], p["company"], p["team"], p["location"]), Block(verdict, 30, 1.1, lambda q: q["first_seen"]))
        row = b.step(p)
        if row:
            out[p["posting_id"]] = row
    return out


def test_equals_plain_fold(spark):
    verdict = lambda a, b, s: None if s > 0.97 else s >= 0.85
    for seed in (1, 2):
        data = rows(seed)
        df = spark.createDataFrame(data, SCHEMA)
        got = {r["posting_id"]: r for r in resolve(df, verdict).collect()}
        want = plain(data, verdict)
        assert set(got) == set(want)
        seeds = {s: k + 1 for k, s in enumerate(sorted(r["seed"] for r in want.values() if r["action"] == "new"))}
        for i, w in want.items():
            assert (got[i]["action"], got[i]["merge_kind"], got[i]["canonical_id"], got[i]["sources"]) == (w["action"], w["merge_kind"], seeds[w["seed"]], w["sources"])
            assert got[i]["first_seen"] == w["first_seen"] and got[i]["full_jd_from"] == w["full_jd_from"]
        c = counters(resolve(df, verdict), df).first()
        assert c["total"] == 60 and c["new"] + c["merged"] + c["pending"] == 60


def test_longer_text_boundary():
    b = Block(None, 30, 1.10, lambda q: q["first_seen"])
    base = dict.fromkeys(IN) | {"posting_id": "1", "company": "c", "location": "l", "title": "t", "seniority": "s", "skills": ["a"], "vector": [1.0], "source_kind": "role_summary", "full_jd": "x" * 100}
    b.step(base)
    assert b.step(base | {"posting_id": "2", "full_jd": "x" * 110})["full_jd_from"] == "1"
    assert b.step(base | {"posting_id": "3", "full_jd": "x" * 111})["full_jd_from"] == "3"


def test_empty(spark):
    assert resolve(spark.createDataFrame([], SCHEMA)).count() == 0
