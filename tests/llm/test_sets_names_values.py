"""Problems 1, 5 and 7."""

import random
from itertools import combinations

from hypothesis import given, settings, strategies as st

from vacancia.llm import canonical, names
from vacancia.llm.setjoin import merge_skip, similar_pairs, t_occurrence


def brute(rows, t):
    sets = {i: {x.strip(" ").lower() for x in s if x and x.strip(" ")} for i, s in rows if i is not None and s}
    return {(min(a, b), max(a, b)) for a, b in combinations(sets, 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


def data(seed, n, vocabulary, most):
    r = random.Random(seed)
    w = [f"w{k}" for k in range(vocabulary)]
    return [(k, r.sample(w, min(len(w), r.randint(0, most)))) for k in range(n)]


@given(st.lists(st.sets(st.integers(0, 30), min_size=1), max_size=9), st.integers(1, 6))
@settings(max_examples=200, deadline=None)
def test_t_occurrence(sets, need):
    lists = [sorted(s) for s in sets]
    want = {x: sum(x in s for s in sets) for x in range(31)}
    assert dict(t_occurrence(lists, need)) == {x: n for x, n in want.items() if n >= need}
    assert dict(merge_skip(lists, need)) == {x: n for x, n in want.items() if n >= need}


def test_pairs_equal_brute_force(spark):
    rows = data(1, 300, 14, 8) + [(400, None), (401, []), (402, [" ", None, ""]), (403, ["A ", "a", "b"]), (404, ["b", "A"]), (None, ["a", "b"])]
    df = spark.createDataFrame(rows, "id long, s array<string>")
    for t in (0.6, 0.4, 1.0):
        for kw in ({}, {"single": 2, "double": 1}, {"single": 2, "double": 1, "hot": 5}, {"dictionary": 3}):
            got = [tuple(r) for r in similar_pairs(df, "id", "s", t, **kw).collect()]
            assert len(got) == len(set(got)) and set(got) == brute(rows, t), (t, kw)


def test_two_tables_and_clashing_columns(spark):
    a = spark.createDataFrame([(1, ["x", "y"], "q"), (2, ["z"], "q")], "id long, s array<string>, cid string")
    b = spark.createDataFrame([(1, ["y", "x"], 0), (5, ["x", "y", "w"], 0)], "id long, s array<string>, toks int")
    assert sorted(map(tuple, similar_pairs(a, "id", "s", 0.6, right=b).collect())) == [(1, 1), (1, 5)]
    assert similar_pairs(a.limit(0), "id", "s").count() == 0


def test_long_and_repeated_sets(spark):
    long = [f"v{k}" for k in range(300)]
    rows = [(1, long), (2, long[:200]), (3, long[:179]), (4, long)] + [(k, ["p"]) for k in range(10, 60)]
    df = spark.createDataFrame(rows, "id long, s array<string>")
    assert {tuple(r) for r in similar_pairs(df, "id", "s").collect()} == brute(rows, 0.6)


def test_name_parsing():
    same = ["Terlerfe Kisil Robotics GmbH", "Kisil Terlerfe Rbtcs ", "ROBOTICS, Terlerfe Kisil, G.m.b.H.", "TerlerfeKisil Robotics", "The Térlerfe & Kisil Robotics Company", "Terlerfe_Kisil Robotics (Dunwick)"]
    assert {(tuple(w), line) for w, line in map(names.parse, same)} == {(("kisil", "terlerfe"), "robotics")}
    assert names.parse("Dirtaper-Balbal, Peggy (Staffing)") == names.parse("Margaret Dirtaper-Balbal Staffing Ltd.")
    assert names.parse("Rob Dolminvor-Zorfo Staffing")[1] == "staffing"
    assert names.same_words(["d", "terzorsan"], ["dolgar", "terzorsan"]) and not names.same_words(["abcdef", "kisil"], ["kisil", "terlerfe"])


@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
@settings(max_examples=200, deadline=None)
def test_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert names.lcs(a, b) == best[-1][-1]


def test_name_links(spark):
    firms = [["Terlerfe Kisil Robotics GmbH"] * 3 + ["Terlerfe Kisil Rbtcs", "Telrerfe Kisil Robotics", "Terlerfe K. Robotics", "Terlerfe Kisil"], ["Balbaler Donsun Foods"] * 2 + ["BALBALER DONSUN FDS"], ["Balbaler Donsun Analytics"]]
    a = spark.createDataFrame([(n,) for f in firms for n in f] + [(None,), (" ",), ("Confidential",)], "canonical_company string")
    b = spark.createDataFrame([("Balbaler Donsun",), ("CONFIDENTIAL ",)], "company string")
    got = {tuple(r) for r in names.name_links(a, b).collect()}
    assert got == {tuple(sorted(p)) for f in firms for p in combinations(sorted(set(f)), 2)}
    assert names.name_links(a.limit(0), b.limit(0)).count() == 0
    chain = ["Terlvorsan Robotics", "Tarlvorsan Robotics", "Talrvorsan Robotics"]  # the last equals the second alone
    short = ["Cox Foods", "Cox Foods Ltd."]
    c = spark.createDataFrame([(n,) for n in chain + short], "canonical_company string")
    assert {tuple(r) for r in names.name_links(c, b.limit(0)).collect()} == {tuple(sorted(p)) for f in (chain, short) for p in combinations(f, 2)}


REF = [(1, "location", "Port Halden"), (2, "location", "Hybrid — Port Halden"), (3, "location", "Remote — Global"), (4, "seniority", "Senior"), (5, "skill", "Fraud Modeling"), (6, "skill", "Python"), (7, "skill", "Mozerbase"), (8, "location", "Saint-Évrard")]


def test_values(spark):
    ref = spark.createDataFrame(REF, "ref_id long, field string, name string")
    rows = [(1, "Hybrid/Halden, Port", "Sr.", ["fraud mdlg", "Python", None, " ", "Mozer-Base 2.1", "Juggling"]), (2, "P. Halden / NL", "n/a", ["Modeling of fraud data", "pyhton", "pyhton"]), (3, "WFH anywhere (global)", None, None), (4, "St. Evrard metro", "Seniro", []), (4, "St. Evrard metro", "Seniro", []), (None, "x", "y", ["z"])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id long, canonical_location string, seniority_band string, top_skills array<string>, field string")
    want = sorted([(1, "location", 0, 2), (1, "seniority", 0, 4), (1, "skill", 1, 5), (1, "skill", 5, 7), (1, "skill", 6, -1), (2, "location", 0, 1), (2, "seniority", 0, -1), (2, "skill", 1, 5), (2, "skill", 2, 6), (2, "skill", 3, 6), (3, "location", 0, 3), (4, "location", 0, 8), (4, "seniority", 0, 4)])
    assert sorted(map(tuple, canonical.map_postings(df, ref).collect())) == want
    assert sorted(map(tuple, canonical.map_postings(df, ref, shard=2).collect())) == want
    assert {r["ref_id"] for r in canonical.map_postings(df, ref.limit(0)).collect()} == {-1}
    assert canonical.map_postings(df.limit(0), ref).count() == 0


def test_bk_tree_equals_scan():
    r = random.Random(5)
    words = ["".join(r.choice("abcd") for _ in range(r.randint(1, 9))) for _ in range(200)]
    tree, asked = canonical.BKTree(words), words[:40] + ["", "zzz", "abcdabcdabcdabcd"]
    import numpy as np

    got = tree.within(asked, np.full(len(asked), 2))
    for q, found in zip(asked, got, strict=True):
        assert {tree.entries[k] for _, k in found} == {e for e in tree.entries if canonical.BKTree.metric(q, e) <= 2} if q else True
    assert canonical.slips("ab", "ba") == 1 and canonical.slips("abc", "xyzabc", 2) == 3


def test_long_entries_values_and_swaps(spark):
    r = random.Random(7)
    long = ["".join(r.choice("abcdefgh") for _ in range(n)) for n in (64, 80, 200)]
    ref = spark.createDataFrame([(10 + k, "skill", x) for k, x in enumerate(long)] + [(20, "skill", "machine learning operations"), (1, "location", "Port Halden"), (2, "location", "Pointe Halden"), (3, "location", "Porto Belcastro")], "ref_id long, field string, name string")
    typo = [x[:30] + "z" + x[31:] for x in long]
    df = spark.createDataFrame([(1, "P. Halden", None, [*typo, "mahcine learnign operations", "x" * 3000]), (2, "P. Belcastro", None, [])], "id long, canonical_location string, seniority_band string, top_skills array<string>")
    want = sorted([(1, "skill", 1, 10), (1, "skill", 2, 11), (1, "skill", 3, 12), (1, "skill", 4, 20), (1, "skill", 5, -1), (1, "location", 0, -1), (2, "location", 0, 3)])
    for shard in (1, 2, 3, 20_000):
        assert sorted(map(tuple, canonical.map_postings(df, ref, shard=shard).collect())) == want, shard


@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
@settings(max_examples=150, deadline=None)
def test_levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    assert canonical.levenshtein(a, b) == row[-1]
