"""Similarity of sets, vectors and records, and the tiered decision over them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Weights of the fused score and its limits.
WEIGHTS = {"embedding": 0.4, "skills": 0.3, "title": 0.2, "seniority": 0.1}
BORDERLINE, EXACT = 0.75, 1 - 1e-6


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all of two string arrays in lower case; 0 if either is null or empty (ER-01)."""
    low = lambda c: F.array_distinct(F.transform(F.filter(c, lambda x: x.isNotNull()), F.lower))
    x, y = low(a), low(b)
    both = F.size(F.array_intersect(x, y)).cast("double")
    return F.when((F.size(x) > 0) & (F.size(y) > 0), both / (F.size(x) + F.size(y) - both)).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two number arrays in double; 0 if a norm is 0 or an array is null (ER-02)."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(n > 0, dot(a, b) / n), F.lit(0.0))


def same_seniority(a: Column, b: Column) -> Column:
    """1 if both are there and equal after trimming, in lower case, else 0 (ER-03)."""
    return F.coalesce((F.lower(F.trim(a)) == F.lower(F.trim(b))).cast("double"), F.lit(0.0))


def fuse(embedding: Column, skills: Column, title: Column, seniority: Column, weights: dict[str, float] | None = None) -> Column:
    """Weighted sum; a missing term counts 0, without renormalising (ER-05)."""
    w, out = weights or WEIGHTS, F.lit(0.0)
    for name, c in (("embedding", embedding), ("skills", skills), ("title", title), ("seniority", seniority)):
        out = out + F.lit(w[name]) * F.coalesce(c, F.lit(0.0))
    return out


def exact(*parts: Column) -> Column:
    """Whether every component is 1, up to 1e-6 (ER-06)."""
    out = F.lit(True)
    for c in parts:
        out = out & (F.coalesce(c, F.lit(0.0)) >= EXACT)
    return out


def tier(score: Column, is_exact: Column, verdict: Column | None = None) -> Column:
    """merge_exact, new, or by the verdict merge_approved, new, pending (ER-09); no score means no candidate."""
    v = F.lit(None).cast("boolean") if verdict is None else verdict
    return F.when(score.isNull() | (score < BORDERLINE), "new").when(is_exact, "merge_exact").when(v, "merge_approved").when(~v, "new").otherwise("pending")
