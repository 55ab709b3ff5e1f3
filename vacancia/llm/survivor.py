"""Problem 2: the best representative of each group of duplicates.

Method: consistent bundles. Fields that depend on each other form a bundle, taken whole from one record;
a bundle has an order of trust. The choice of one candidate per bundle that has the most trust in all,
under functional dependencies between bundles, is found by branch and bound.

The bound at a group's root is the best candidate of every bundle by itself, all in one partial
aggregation, so a group of any size costs one row a task. Where that choice breaks no dependency it
reaches its own bound, so it is the optimum and the search ends there. For the other groups only undominated candidates
are gathered: among candidates of a bundle that say the same about the dependencies, the most trusted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Bundle:
    """`fields`: the columns taken together (of `records`); `trust`: sort columns, the least is the most
    trusted; `score`: trust as a number for the sum over bundles; `where`: which records may give it."""

    name: str
    fields: tuple[str, ...]
    trust: tuple[Column, ...]
    score: Column = field(default_factory=lambda: F.lit(1.0))
    where: Column | None = None


@dataclass(frozen=True)
class Dependency:
    """Whatever bundle gives `determinant`, that value allows one value of `dependent` (of another bundle):
    the pairs in `table` (two columns of strings); a value that isn't listed allows all."""

    determinant: str
    dependent: str
    table: DataFrame


def _pick(bundle: Bundle):
    """The most trusted candidate of a bundle, as an aggregate."""
    one = F.struct(*[t.alias(f"t{i}") for i, t in enumerate(bundle.trust)], F.struct(*[F.col(f) for f in bundle.fields], bundle.score.alias("__score")).alias("v"))
    return F.min(one if bundle.where is None else F.when(bundle.where, one))["v"].alias(bundle.name)


def branch_and_bound(candidates: list[list[tuple[float, dict]]], allowed: list[tuple[str, str, dict[str, set[str]]]]) -> list[int] | None:
    """The index of one candidate per bundle with the greatest total score; candidates come by falling score.

    `allowed`: (determinant, dependent, what each determinant's value allows). Ties keep the choice found
    first, that is, the earlier bundle's more trusted candidate. None if no choice is consistent.
    """
    n = len(candidates)
    rest = [0.0] * (n + 1)
    for k in range(n - 1, -1, -1):
        rest[k] = rest[k + 1] + (candidates[k][0][0] if candidates[k] else float("-inf"))
    best: tuple[float, list[int] | None] = (float("-inf"), None)

    def consistent(values: dict) -> bool:
        for a, b, table in allowed:
            if a in values and b in values and values[a] is not None and values[b] is not None and values[a] in table and values[b] not in table[values[a]]:
                return False
        return True

    def go(k: int, total: float, chosen: list[int], values: dict) -> None:
        nonlocal best
        if k == n:
            if total > best[0]:
                best = (total, list(chosen))
            return
        for i, (score, own) in enumerate(candidates[k]):
            if total + score + rest[k + 1] <= best[0]:
                return  # the bound: the rest of this level is no better
            merged = values | own
            if consistent(merged):
                chosen.append(i)
                go(k + 1, total + score, chosen, merged)
                chosen.pop()

    go(0, 0.0, [], {})
    return best[1]


def survivors(records: DataFrame, group: str, bundles: list[Bundle], dependencies: list[Dependency] | None = None, strict: bool = False) -> DataFrame:
    """One row per group: `group` and one struct column per bundle (null where no record gives it).

    Null groups give no rows. Repeated records change nothing. Ties are settled by the trust columns;
    what is still equal is equal in all of them, and the least record of the bundle's fields is taken.
    A group with no consistent choice keeps its unbranched one, or, if `strict`, goes without. An empty
    table gives no rows.
    """
    records = records.where(F.col(group).isNotNull())
    root = records.groupBy(F.col(group).alias("group")).agg(*[_pick(b) for b in bundles])
    root = root.where(" or ".join(f"`{b.name}` is not null" for b in bundles))
    if not dependencies:
        return _plain(root, bundles)
    checked = root
    bad = F.lit(False)
    owner = {f: b.name for b in bundles for f in b.fields}
    for k, d in enumerate(dependencies):
        a, b = d.table.columns[:2]
        t = d.table.select(F.col(a).cast("string").alias(f"a{k}"), F.col(b).cast("string").alias("b")).distinct().groupBy(f"a{k}").agg(F.collect_set("b").alias(f"ok{k}"))
        checked = checked.join(t, F.col(f"{owner[d.determinant]}.{d.determinant}").cast("string") == F.col(f"a{k}"), "left")
        value = F.col(f"{owner[d.dependent]}.{d.dependent}").cast("string")
        bad = bad | F.coalesce(F.col(f"ok{k}").isNotNull() & value.isNotNull() & ~F.array_contains(f"ok{k}", value), F.lit(False))
    checked = checked.withColumn("__bad", bad)
    good = _plain(checked.where(~F.col("__bad")), bundles)
    open_ = checked.where("__bad").select("group")
    ties = [{f for d in dependencies for f in (d.determinant, d.dependent) if f in b.fields} for b in bundles]
    rows, rules = None, None
    for k, b in enumerate(bundles):
        own = (records if b.where is None else records.where(b.where)).withColumn("group", F.col(group)).join(open_, "group", "left_semi")
        say = F.to_json(F.struct(*[F.col(f).cast("string").alias(f) for f in sorted(ties[k])], F.lit(0).alias("_")))
        pick = F.min(F.struct(*[t.alias(f"t{i}") for i, t in enumerate(b.trust)], F.to_json(F.struct(*[F.col(f) for f in b.fields]), {"ignoreNullFields": "false"}).alias("v"), b.score.cast("double").alias("score")))
        own = own.groupBy("group", say.alias("say")).agg(pick.alias("p")).select("group", F.lit(k).alias("bundle"), "say", F.col("p.v").alias("v"), F.col("p.score").alias("score"), F.lit("").alias("ok"))
        rows = own if rows is None else rows.unionAll(own)
    said = rows.select("group", "say")
    for k, d in enumerate(dependencies):  # only what the group's own candidates may need
        a, b = d.table.columns[:2]
        t = d.table.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).distinct()
        need = said.select("group", F.get_json_object("say", f"$.{d.determinant}").alias("a")).where("a is not null").distinct().join(t, "a")
        need = need.select("group", F.lit(-1 - k).alias("bundle"), F.col("a").alias("say"), F.lit("").alias("v"), F.lit(0.0).alias("score"), F.col("b").alias("ok"))
        rules = need if rules is None else rules.unionAll(need)
    names = [(d.determinant, d.dependent) for d in dependencies]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        import json

        allowed = []
        for k, (a, b) in enumerate(names):
            own = pdf[pdf["bundle"] == -1 - k]
            table: dict[str, set[str]] = {}
            for x, y in zip(own["say"], own["ok"], strict=True):
                table.setdefault(x, set()).add(y)
            allowed.append((a, b, table))
        cands, texts = [], []
        for k in range(len(bundles_n)):
            own = pdf[pdf["bundle"] == k]
            values = [[(x is None, str(x)) for x in json.loads(v).values()] for v in own["v"]]
            own = own.iloc[sorted(range(len(own)), key=lambda i: (-own["score"].iloc[i], values[i]))]
            if not len(own):
                cands.append([(0.0, {})])
                texts.append([None])
                continue
            cands.append([(s, {f: v for f, v in json.loads(y).items() if f != "_"}) for s, y in zip(own["score"], own["say"], strict=True)])
            texts.append(own["v"].tolist())
        got = branch_and_bound(cands, allowed)
        if got is None:
            return pdf.iloc[:0][["group"]].assign(chosen=pd.Series([], dtype=object))
        return pd.DataFrame({"group": [pdf["group"].iloc[0]], "chosen": [[t[i] for t, i in zip(texts, got, strict=True)]]})

    bundles_n = [b.name for b in bundles]
    kind = records.schema[group].dataType.simpleString()
    solved = rows.unionAll(rules).groupBy("group").applyInPandas(solve, f"group {kind}, chosen array<string>")
    shape = {b.name: "struct<" + ",".join(f"`{f}`:{records.schema[f].dataType.simpleString()}" for f in b.fields) + ">" for b in bundles}
    done = solved.select("group", *[F.from_json(F.col("chosen")[k], shape[b.name]).alias(b.name) for k, b in enumerate(bundles)])
    out = good.unionByName(done)
    if not strict:
        out = out.unionByName(_plain(checked.where("__bad"), bundles).join(done.select("group"), "group", "left_anti"))
    return out


def _plain(df: DataFrame, bundles: list[Bundle]) -> DataFrame:
    return df.select("group", *[F.when(F.col(b.name).isNotNull(), F.struct(*[F.col(f"{b.name}.{f}").alias(f) for f in b.fields])).alias(b.name) for b in bundles])


def visible_length(c: str) -> Column:
    """Characters other than space, tab, CR and LF; a null text has none."""
    return F.coalesce(F.length(F.translate(F.col(c), " \t\r\n", "")), F.lit(0))


def hydrated(source: str) -> Column:
    """Whether a source, however it is spelled, is a page's and not an e-mail's."""
    return F.coalesce(F.lower(F.col(source)).contains("hydrator"), F.lit(False))


def job_survivors(postings: DataFrame, sources: DataFrame, links: DataFrame) -> DataFrame:
    """(canonical_id, best_posting_id, best_source_id) of each job that has several postings.

    Links delivered twice count once. Links to postings that don't exist count as members with the rest
    of their columns null. A job without any source row has a null best_source_id.
    """
    members = links.where("canonical_id is not null and posting_id is not null").select("canonical_id", F.col("posting_id").cast("long").alias("posting_id")).distinct()
    several = members.groupBy("canonical_id").agg(F.count("*").alias("n")).where("n > 1").select("canonical_id")
    members = members.join(several, "canonical_id", "left_semi")
    text = postings.select(F.col("id").alias("posting_id"), visible_length("full_jd").alias("size"), "last_seen")
    rows = sources.select("posting_id", F.col("id").alias("source_id"), hydrated("source").alias("page"), "source_first_seen")
    nothing = {"source_id": "long", "page": "boolean", "source_first_seen": sources.schema["source_first_seen"].dataType.simpleString()}
    a = members.join(text, "posting_id", "left").select("canonical_id", "posting_id", F.coalesce("size", F.lit(0)).alias("size"), "last_seen", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()])
    b = members.join(rows, "posting_id").select("canonical_id", F.lit(None).cast("long").alias("posting_id"), F.lit(None).cast("int").alias("size"), F.lit(None).cast(postings.schema["last_seen"].dataType).alias("last_seen"), *nothing)
    newest = -F.coalesce(F.unix_micros(F.col("last_seen").cast("timestamp")), F.lit(-(1 << 62)))
    posting = Bundle("posting", ("posting_id",), (-F.col("size"), newest, F.col("posting_id")), where=F.col("posting_id").isNotNull())
    source = Bundle("source", ("source_id",), (~F.col("page"), F.col("source_first_seen").isNull(), F.col("source_first_seen"), F.col("source_id")), where=F.col("source_id").isNotNull())
    best = survivors(a.unionAll(b), "canonical_id", [posting, source])
    return best.select(F.col("group").alias("canonical_id"), F.col("posting.posting_id").alias("best_posting_id"), F.col("source.source_id").alias("best_source_id"))


def job_bundles(postings: DataFrame, links: DataFrame) -> DataFrame:
    """(canonical_id, company, location) of each job with several postings: the company as last seen and the
    location as first seen, both whole from a member, where a company stands only with locations it is posted
    with somewhere.

    Blank companies and locations are no candidates; a job that lacks either gives no row. A job without a
    consistent choice keeps the most trusted values. Ties go to the lesser name.
    """
    members = links.where("canonical_id is not null and posting_id is not null").select("canonical_id", F.col("posting_id").cast("long").alias("id")).distinct()
    several = members.groupBy("canonical_id").agg(F.count("*").alias("n")).where("n > 1").select("canonical_id")
    day = lambda c: F.coalesce(F.datediff(F.col(c), F.lit("1970-01-01")), F.lit(-1_000_000))
    known = postings.select("id", F.col("canonical_company").alias("company"), F.col("canonical_location").alias("location"), day("last_seen").alias("seen"), F.coalesce(-F.datediff(F.col("first_seen"), F.lit("1970-01-01")), F.lit(-1_000_000)).alias("early"))
    rows = members.join(several, "canonical_id", "left_semi").join(known, "id")
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    firm = Bundle("firm", ("company",), (-F.col("seen"), F.col("company")), F.col("seen"), filled("company"))
    place = Bundle("place", ("location",), (-F.col("early"), F.col("location")), F.col("early"), filled("location"))
    posted = known.where(filled("company") & filled("location")).select("company", "location").distinct()
    best = survivors(rows, "canonical_id", [firm, place], [Dependency("company", "location", posted)])
    return best.where("firm is not null and place is not null").select(F.col("group").alias("canonical_id"), F.col("firm.company").alias("company"), F.col("place.location").alias("location"))
