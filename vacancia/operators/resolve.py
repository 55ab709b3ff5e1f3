"""Greedy sequential resolution of records to canonical ones, block by block (ER-07..16, WIN-08, 09).

Decisions never cross a block, so blocks are resolved side by side and each in the order of its ids as
text. A block's fold state is one row per canonical record, not per posting: its seed, current vector,
last link and survivorship so far. A block is streamed in order through one task in record batches, so
memory holds its canonical records only; ids of canonicals follow the order of their seeds over all.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.similarity import BORDERLINE, EXACT, WEIGHTS
from ..session import parallelism

IN = ("posting_id", "user_id", "company", "team", "location", "title", "seniority", "skills", "vector", "source_kind", "first_seen", "last_seen", "full_jd", "source")
OUT = "posting_id string, seed string, action string, score double, merge_kind string, repost_days double, full_jd_from string, sources array<string>, first_seen timestamp_ntz, last_seen timestamp_ntz"


def jaccard(a, b) -> float:
    x, y = {str(v).lower() for v in (a if a is not None else []) if v is not None}, {str(v).lower() for v in (b if b is not None else []) if v is not None}
    return len(x & y) / len(x | y) if x and y else 0.0


def cosine(a, b) -> float:
    if a is None or b is None or len(a) == 0 or len(a) != len(b):
        return 0.0
    x, y = np.asarray(a, float), np.asarray(b, float)
    n = np.linalg.norm(x) * np.linalg.norm(y)
    return float(x @ y / n) if n else 0.0


def same(a, b) -> float:
    return float(a is not None and b is not None and a.strip().lower() == b.strip().lower())


class Block:
    """The fold over one block."""

    def __init__(self, verdict: Callable[[dict, dict, float], bool | None] | None, repost_days: float, longer: float, clock: Callable[[dict], object]):
        self.verdict, self.repost_days, self.longer, self.clock = verdict, repost_days, longer, clock
        self.canonicals: list[dict] = []

    def step(self, p: dict) -> dict | None:
        """Decide and apply one posting; None if it is pending, which writes nothing."""
        blank = not (p["company"] or "").strip() or not (p["location"] or "").strip()
        best, top, parts = None, 0.0, ()
        if p["source_kind"] == "role_summary" and not blank:
            for c in self.canonicals:
                own = (cosine(p["vector"], c["vector"]), jaccard(p["skills"], c["skills"]), same(p["title"], c["title"]), same(p["seniority"], c["seniority"]))
                s = sum(w * v for w, v in zip(WEIGHTS.values(), own, strict=True))
                if s > top:
                    best, top, parts = c, s, own
        if best is not None and top >= BORDERLINE:
            kind = "exact" if all(v >= EXACT for v in parts) else None
            if kind is None:
                said = self.verdict(p, best, top) if self.verdict else None
                if said is None:
                    return None
                kind = "approved" if said else None
            if kind:
                return self._merge(p, best, top, kind)
        return self._new(p, top, blank)

    def _new(self, p: dict, score: float, blank: bool) -> dict:
        c = {"seed": p["posting_id"], "vector": p["vector"], "summary": p["source_kind"] == "role_summary", "skills": p["skills"], "title": p["title"], "seniority": p["seniority"], "merged": self.clock(p), "first": p["first_seen"], "last": p["last_seen"], "size": len(p["full_jd"] or ""), "from": p["posting_id"], "sources": [p["source"]] if p["source"] else []}
        if not blank:
            self.canonicals.append(c)
        return self._row(p, c, "new", score, "new_canonical", None)

    def _merge(self, p: dict, c: dict, score: float, kind: str) -> dict:
        now, days = self.clock(p), None
        if p["first_seen"] is not None and c["merged"] is not None:
            gap = (pd.Timestamp(p["first_seen"]) - pd.Timestamp(c["merged"])).total_seconds() / 86400
            if gap >= self.repost_days:
                kind, days = "repost", gap
        if p["first_seen"] is not None:
            c["first"] = min(x for x in (c["first"], p["first_seen"]) if x is not None)
        if p["last_seen"] is not None:
            c["last"] = max(x for x in (c["last"], p["last_seen"]) if x is not None)
        if len(p["full_jd"] or "") > self.longer * c["size"]:
            c["size"], c["from"] = len(p["full_jd"]), p["posting_id"]
        if p["source"] and p["source"] not in c["sources"]:
            c["sources"] = [*c["sources"], p["source"]]
        if p["source_kind"] == "role_summary" or not c["summary"]:
            c["vector"], c["summary"] = p["vector"], p["source_kind"] == "role_summary"
        c["merged"] = max((x for x in (c["merged"], now) if x is not None), default=None)
        return self._row(p, c, "merge", score, kind, days)

    def _row(self, p, c, action, score, kind, days) -> dict:
        return {"posting_id": p["posting_id"], "seed": c["seed"], "action": action, "score": score, "merge_kind": kind, "repost_days": days, "full_jd_from": c["from"], "sources": list(c["sources"]), "first_seen": c["first"], "last_seen": c["last"]}


def resolve(postings: DataFrame, verdict: Callable[[dict, dict, float], bool | None] | None = None, repost_days: float = 30, longer: float = 1.10) -> DataFrame:
    """(posting_id, canonical_id, action, score, merge_kind, repost_days, ...) of the postings that aren't pending.

    `postings` has the columns IN. Company and location match by case, a null team only a null team; a
    blank company or location, or a vector that isn't of a summary, always makes a new record. The
    verdict on borderline pairs is a function; without one they stay pending. Time of a link is the
    posting's first_seen, so that a replay finds reposts. Null ids are left out.
    """

    def run(batches):
        key, block = None, None
        for pdf in batches:
            pdf = pdf.astype(object).where(pdf.notna(), None)
            out = []
            for p in pdf.to_dict("records"):
                if p["__block"] != key:
                    key, block = p["__block"], Block(verdict, repost_days, longer, lambda q: q["first_seen"])
                row = block.step(p)
                if row is not None:
                    out.append(row)
            if out:
                frame = pd.DataFrame(out)
                yield frame.astype({"first_seen": "datetime64[us]", "last_seen": "datetime64[us]", "repost_days": "float64"})

    key = F.to_json(F.struct("user_id", "company", "team", "location"), {"ignoreNullFields": "false"})
    rows = postings.where("posting_id is not null").select(*[F.col(c).cast("string").alias(c) if c == "posting_id" else F.col(c) for c in IN]).withColumn("__block", key)
    rows = rows.repartition(parallelism(postings.sparkSession), "__block").sortWithinPartitions("__block", "posting_id")
    done = rows.mapInPandas(run, OUT)
    seeds = done.where("action = 'new'").select(F.col("posting_id").alias("seed"))
    return done.join(numbered(seeds, "seed", "canonical_id"), "seed").drop("seed")


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """Dense numbers from 1 in `order`, without one task for all: range partitions, their sizes, and an offset each."""
    ranged = df.repartitionByRange(parallelism(df.sparkSession), order).withColumn("__p", F.spark_partition_id())
    at = ranged.withColumn("__k", F.row_number().over(W.partitionBy("__p").orderBy(order)))
    sizes = ranged.groupBy("__p").count().withColumn("__before", F.coalesce(F.sum("count").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    return at.join(F.broadcast(sizes), "__p").withColumn(name, F.col("__k") + F.col("__before")).drop("__p", "__k", "__before")


def counters(decisions: DataFrame, total: DataFrame) -> DataFrame:
    """total, new, merged, reposts, pending of a batch (ER-16)."""
    n = decisions.agg(F.count("*").alias("done"), F.count_if(F.col("action") == "new").alias("new"), F.count_if(F.col("action") == "merge").alias("merged"), F.count_if(F.col("merge_kind") == "repost").alias("reposts"))
    return total.agg(F.count("*").alias("total")).crossJoin(n).withColumn("pending", F.col("total") - F.col("done")).drop("done")
