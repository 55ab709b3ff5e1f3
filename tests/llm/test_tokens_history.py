"""Problems 2, 4, 8 and 9."""

import base64
import datetime as dt
import itertools
import os
import random
import re

import numpy as np
import pytest

from vacancia.llm import history as hs, packing, prints, survivor as sv, tokens as tk

RANKS = tk.rank_file()
needs_files = pytest.mark.skipif(not os.path.exists(RANKS), reason="no tokenizer files")
PIECES = ["a", "b", "the", "'ll", "'", " ", "  ", "\n", "\t", "12", "é", "日本", "!!", "—", "aaaaaaaaaaaaaaaaaaaaaa", "               ", "ing", " x", "<|endoftext|>", "​"]


@needs_files
def test_encoding_equals_the_library():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib, r = tiktoken.Encoding("own", pat_str=tk.PATTERN, mergeable_ranks=ranks, special_tokens={}), random.Random(1)
    encoders = [tk.Encoder(RANKS, w) for w in (6, 17, 65_536)]
    texts = ["".join(r.choices(PIECES, k=r.randint(0, 40))) for _ in range(300)] + ["ab" * 6000, " " * 9000 + "y", "x" * 9000, "\n" * 3000 + "a"]
    for t in texts:
        want = lib.encode_ordinary(t)
        for e in encoders:
            assert list(e.encode(t)) == want
        d = tk.Decoder(encoders[0].vocabulary)
        assert "".join(d.feed(want[k : k + 1]) for k in range(len(want))) + d.finish() == t


@needs_files
def test_encode_table(spark):
    df = spark.createDataFrame([(1, "Hello world", "c"), (2, "", "c"), (3, None, "c"), (1, "Hello world", "c"), (None, "a", "c")], "doc_id long, text string, ids string")
    got = tk.encode(df)
    assert sorted((r["doc_id"] or 0, list(r["ids"])) for r in got.collect()) == [(0, [64]), (1, [15496, 995]), (1, [15496, 995]), (2, []), (3, [])]
    assert sorted((r["doc_id"] or 0, r["text"]) for r in tk.decode(got).collect()) == [(0, "a"), (1, "Hello world"), (1, "Hello world"), (2, ""), (3, "")]
    assert sorted(r["n_tokens"] for r in tk.encode(df, sizes=True).collect()) == [0, 0, 1, 2, 2]
    assert tk.encode(df.limit(0)).count() == 0


def test_best_fit():
    r = np.random.default_rng(3)
    sizes = np.sort(r.integers(1, 100, 500))[::-1]
    bins = packing.best_fit(sizes, r.integers(0, 5, 500), r.integers(0, 300, 500), 100)
    fill = np.bincount(bins, sizes)
    assert fill.max() <= 100 and len(fill) <= np.ceil(sizes.sum() / 100) * 1.05
    apart = packing.best_fit(np.array([50, 50, 50, 50]), np.array([1, 2, 1, 2]), np.array([7, 8, 7, 8]), 100)
    assert apart[0] != apart[2] and apart[1] != apart[3] and len(set(apart)) == 2


def test_best_fit_looks_at_every_bin():
    # twenty bins of one residual hold the source, the one that doesn't lies below them
    sizes = np.array([60] * 22 + [10])
    sources = np.array([2] + [1] * 21 + [1])
    bins = packing.best_fit(sizes, sources, np.arange(23), 100)
    assert bins[22] == bins[0]
    r = np.random.default_rng(5)
    rare = packing.best_fit(np.full(400, 10), r.integers(0, 100, 400), np.arange(400), 100)
    assert len(set(rare.tolist())) == 40


def test_pack(spark):
    rows = [(k, (k * 37) % 900, f"s{k % 3}", k % 50) for k in range(200)] + [(500, 4500, "s", 1), (501, 0, "s", 2), (502, None, "s", 3), (503, 2048, None, None), (504, -5, "s", 4)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "id long, n int, source string, cluster long, shard int")
    got = packing.pack(df, "id", "n", "source", "cluster", 2048).collect()
    held, by = {}, {}
    for r in got:
        held[r["container"]] = held.get(r["container"], 0) + r["n_tokens"]
        by.setdefault(r["id"], []).append((r["start"], r["n_tokens"]))
    assert max(held.values()) <= 2048
    for i, n, *_ in rows:
        parts = sorted(by.get(i, []))
        assert sum(p[1] for p in parts) == max(n or 0, 0) and (len(parts) <= 1 or n > 2048)
        assert [p[0] for p in parts] == list(itertools.accumulate([0] + [p[1] for p in parts]))[:-1]
    assert packing.pack(df.limit(0), "id", "n", "source", "cluster", 2048).count() == 0


def test_branch_and_bound_equals_brute_force():
    r = random.Random(2)
    for _ in range(200):
        cands = [sorted(((float(r.randint(0, 9)), {f"f{k}": r.choice("xyz")}) for _ in range(r.randint(1, 4))), key=lambda c: -c[0]) for k in range(3)]
        allowed = [("f0", "f1", {"x": {"x"}, "y": {"y", "z"}}), ("f1", "f2", {"z": {"x"}})]
        ok = lambda v: all(v[a] not in t or v[b] in t[v[a]] for a, b, t in allowed)
        totals = [sum(c[0] for c in combo) for combo in itertools.product(*cands) if ok({k: v for c in combo for k, v in c[1].items()})]
        got = sv.branch_and_bound(cands, allowed)
        assert (got is None) == (not totals)
        if got:
            assert sum(cands[k][i][0] for k, i in enumerate(got)) == max(totals)


def test_dependencies(spark):
    from pyspark.sql import functions as F

    rows = [("g", 1, "Bern", "3000", 9), ("g", 2, "Basel", "4000", 5), ("h", 3, "Bern", "3000", 1), ("h", 4, None, "3000", 7), (None, 5, "Bern", "1", 1)]
    df = spark.createDataFrame(rows, "g string, id long, town string, code string, trust int")
    town = sv.Bundle("town", ("town",), (-F.col("trust"), F.col("id")), F.col("trust"), F.col("town").isNotNull())
    code = sv.Bundle("code", ("code", "id"), (-(10 - F.col("trust")), F.col("id")), 10 - F.col("trust"))
    table = spark.createDataFrame([("Bern", "3000"), ("Basel", "4000")], "a string, b string")
    got = {r["group"]: (r["town"]["town"], r["code"]["code"], r["code"]["id"]) for r in sv.survivors(df, "g", [town, code], [sv.Dependency("town", "code", table)]).collect()}
    assert got == {"g": ("Bern", "3000", 1), "h": ("Bern", "3000", 3)}
    assert sv.survivors(df.limit(0), "g", [town, code]).count() == 0


def test_job_bundles_branch(spark):
    d = lambda k: dt.datetime(2025, 1, k)
    rows = [(1, "A", "X", d(1), d(9)), (2, "B", "Y", d(2), d(20)), (3, "A", "Z", d(3), d(3)), (4, "C ", "X", d(1), d(1)), (5, "C", "X", d(1), d(1)), (6, " ", None, d(1), d(1)), (7, "D", None, d(1), d(1))]
    p = spark.createDataFrame(rows, "id long, canonical_company string, canonical_location string, first_seen timestamp_ntz, last_seen timestamp_ntz")
    links = spark.createDataFrame([("1", 1), ("1", 1), ("2", 1), ("3", 1), ("4", 2), ("5", 2), ("6", 3), ("7", 3), ("1", 4)], "posting_id string, canonical_id long")
    # Job 1: the newest company is B, the oldest location X, which B never has: B with Y loses one day, A with X eleven.
    assert sorted(map(tuple, sv.job_bundles(p, links).collect())) == [(1, "B", "Y"), (2, "C", "X")]
    assert sv.job_bundles(p, links.limit(0)).count() == 0


def test_job_survivors(spark):
    t = lambda d: dt.datetime(2025, 1, d)
    p = spark.createDataFrame([(1, " a b\t\r\n", t(1), 0), (2, "ab", t(2), 0), (3, None, None, 0), (4, "x", t(1), 0)], "id long, full_jd string, last_seen timestamp_ntz, size int")
    s = spark.createDataFrame([(10, 1, "x_email", t(1)), (11, 2, "X Hydrator", None), (12, 2, "x_HYDRATOR", t(9)), (13, 3, None, t(1)), (14, 9, "hydrator", t(1))], "id long, posting_id long, source string, source_first_seen timestamp_ntz")
    links = spark.createDataFrame([("1", 7), ("1", 7), ("2", 7), ("3", 8), ("4", 9), ("3", 9), (None, 9)], "posting_id string, canonical_id long")
    assert sorted(map(tuple, sv.job_survivors(p, s, links).collect())) == [(7, 2, 12), (9, 4, 13)]
    assert sv.job_survivors(p, s, links.limit(0)).count() == 0


def shingle_set(t):
    w = re.findall(r"[^\W_]+", (t or "").lower())
    return {tuple(w[k : k + 3]) for k in range(len(w) - 2)}


def expected(rows):
    pages, kept, out = set(), [], set()
    for i, _, page, text in sorted(rows, key=lambda r: (r[1] is None, r[1] or dt.datetime.min, r[0])):
        s = shingle_set(text)
        if (page is not None and page in pages) or (s and any(len(s & k) >= 0.6 * len(s | k) - 1e-9 for k in kept)):
            out.add(i)
            continue
        pages.add(page)
        if s:
            kept.append(s)
    return out


def texts(seed, n):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [[r.choice(words) for _ in range(r.randint(2, 120))] for _ in range(n // 3)]
    out = []
    for k in range(n):
        t = list(r.choice(base))
        for _ in range(r.randint(0, max(1, len(t) // 14))):
            t[r.randrange(len(t))] = r.choice(words)
        at = dt.datetime(2025, 1, 1 + r.randint(0, 9), r.randint(0, 3))
        out.append((k, at, r.choice([None, f"p{r.randint(0, n)}"]), r.choice([" ".join(t), " ".join(t).upper() + "!", None, ""]) if k % 9 == 0 else " ".join(t)))
    return out


def test_batches_equal_one_pass(spark):
    rows = texts(4, 160)
    schema = "posting_id long, at timestamp_ntz, page string, text string"
    days = sorted({r[1].date() for r in rows})
    for cuts, lots in (([days[-1]], 3), ([days[2], days[6], days[-1]], 1)):
        store, got, last = hs.History(spark, lots=lots), set(), None
        for end in cuts:
            part = [r for r in rows if r[1].date() <= end and (last is None or r[1].date() > last)]
            store = hs.History(spark, store.folder, lots=lots)  # opened again, it goes on
            got |= {r["posting_id"] for r in store.accept(spark.createDataFrame(part, schema)).where("not accepted").collect()}
            last = end
        assert got == expected(rows)


def test_hot_groups_are_settled_in_parts(spark):
    r = random.Random(8)
    base = [f"w{k}" for k in range(90)]
    rows = texts(6, 40)
    for k in range(100, 170):  # near copies of one text, all different
        t = list(base)
        for _ in range(3):
            t[r.randrange(90)] = f"x{r.randrange(999)}"
        rows.append((k, dt.datetime(2025, 1, 1 + k % 7, r.randint(0, 5)), None, " ".join(t)))
    df = spark.createDataFrame(rows, "posting_id long, at timestamp_ntz, page string, text string")
    store = hs.History(spark, hot=30)
    assert {x["posting_id"] for x in store.accept(df).where("not accepted").collect()} == expected(rows)
    assert store.batches > 1


def test_pages_and_log(spark):
    u = ["https://www.jobquill.example/jobs/view/1000000001", "HTTP://M.JOBQUILL.EXAMPLE/comm/jobs//view/1000000001/?refId=e30ba#top", "https://de.werkpost.example/rc/viewjob?JK=AF3E5AE9575FD178&tk=1", "https://werkpost.example/viewjob/?jk=af3e5ae9575fd178", "nothing"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in u], "url string").select(hs.page_of("url")).collect()]
    assert got == ["jobquill.example/1000000001"] * 2 + ["werkpost.example/af3e5ae9575fd178"] * 2 + [None]
    seen = spark.createDataFrame([(u[0], 1, dt.datetime(2025, 1, 1)), (u[1], 2, dt.datetime(2025, 1, 2)), (u[2], 3, dt.datetime(2025, 1, 2)), (u[2], 3, dt.datetime(2025, 1, 5)), (u[4], None, None)], "url string, posting_id long, seen_at timestamp_ntz")
    posts = spark.createDataFrame([(1, "one two three four"), (2, None), (3, "ONE, two three four!")], "id long, full_jd string")
    assert sorted(r[0] for r in hs.rejected(seen, posts).collect()) == [2, 3]
    assert hs.rejected(seen.limit(0), posts).count() == 0


def test_edits_spread_over_a_text_hide_no_pair(spark):
    r = random.Random(3)
    rows, day = [], dt.datetime(2025, 1, 1)
    for n in (120, 400, 1000):
        for step in range(9, 28):  # every step-th word changed: half to four fifths of the shingles are shared
            base = [f"w{r.randrange(5000)}" for _ in range(n)]
            for k, name in enumerate(("Anna", "Bert", "Carl")):
                rows.append((len(rows), day + dt.timedelta(days=k), None, " ".join(name if at % step == k else w for at, w in enumerate(base))))
    near, store, got = expected(rows), hs.History(spark), set()
    assert len(near) > 50
    for k in range(3):
        part = spark.createDataFrame([x for x in rows if x[1] == day + dt.timedelta(days=k)], "posting_id long, at timestamp_ntz, page string, text string")
        got |= {x["posting_id"] for x in store.accept(part).where("not accepted").collect()}
    assert got == near


def shuffled(spark):
    """Bytes that all stages so far wrote for shuffles."""
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_a_batch_shuffles_no_texts(spark):
    r = random.Random(5)
    rows = [(k, dt.datetime(2025, 1, 1), None, " ".join(f"{r.getrandbits(800):x}" for _ in range(60))) for k in range(150)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as if the tables were large
    try:
        before = shuffled(spark)
        got = hs.History(spark).accept(spark.createDataFrame(rows, "posting_id long, at timestamp_ntz, page string, text string"))
        assert got.where("accepted").count() == 150
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffled(spark) - before < sum(len(x[3]) for x in rows) / 2


def test_the_order_counts_every_text(spark, monkeypatch):
    monkeypatch.setattr(hs, "SAMPLE", 5, raising=False)
    rows = [(k, dt.datetime(2025, 1, 1), None, " ".join(f"w{(k * j) % 97}" for j in range(40))) for k in range(1, 60)]
    store = hs.History(spark)
    store.accept(spark.createDataFrame(rows, "posting_id long, at timestamp_ntz, page string, text string"))
    at, n = prints.slots(prints.shingles([x[3] for x in rows])[0])
    assert (store.order.ranks == prints.Order.of_counts(at, n).ranks).all()


def met(ts, turns=1):
    """Pairs of texts that meet at fingerprints, and how many were looked at for that."""
    at, n = prints.slots(prints.shingles(ts)[0])
    g, of = prints.shingles(ts)
    looked, near, got = [], prints.Rows._near, set()
    with pytest.MonkeyPatch.context() as p:
        p.setattr(prints.Rows, "_near", lambda self, other, i, j: looked.append(len(i)) or near(self, other, i, j))
        for _, b in prints.pack(np.arange(len(ts)), g, of, prints.Order.of_counts(at, n), 0.6):
            for turn in [{"turn": (k, turns)} for k in range(turns)] if turns > 1 else [{}]:
                for x, y, _ in prints.Rows([b], 0.6, **turn).own_pairs():
                    got |= set(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist(), strict=True))
    return got, sum(looked)


def test_common_fingerprints_hide_no_pair(monkeypatch):
    ts = [x[3] for seed in (11, 12) for x in texts(seed, 150)]
    sets = prints.sets(ts)
    near = {(a, b) for a, b in itertools.combinations(range(len(ts)), 2) if len(sets[a]) and len(np.intersect1d(sets[a], sets[b])) >= 0.6 * len(np.union1d(sets[a], sets[b])) - 1e-9}
    for common, turns in (((256, 256), 1), ((0, 256), 3), ((0, 0), 2), ((12, 30), 1)):
        monkeypatch.setattr(prints, "COMMON", common, raising=False)
        assert len(near) > 100 and near <= met(ts, turns)[0]


def test_texts_of_one_template_are_not_all_compared():
    def some(n):
        r = random.Random(n)
        pool = [[f"s{k}w{j}" for j in range(9)] for k in range(300)]
        return [" ".join(w for s in r.sample(pool, 24) for w in s) for _ in range(n)]

    assert met(some(2400))[1] < 700 * 2400  # 1,335 a text by single shingles, 490 where common ones go on


def test_a_part_in_turns_equals_one_pass(spark, monkeypatch):
    monkeypatch.setattr(hs, "HELD", 300)
    rows, day = texts(7, 120), dt.datetime(2025, 1, 5)
    store, got = hs.History(spark), set()
    for part in ([x for x in rows if x[1] < day], [x for x in rows if x[1] >= day]):
        got |= {x["posting_id"] for x in store.accept(spark.createDataFrame(part, "posting_id long, at timestamp_ntz, page string, text string")).where("not accepted").collect()}
    assert got == expected(rows)
