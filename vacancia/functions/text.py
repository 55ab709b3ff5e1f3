"""Scalar text, URL and date functions as Column expressions (JVM side, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Trailing words of legal forms.
LEGAL_FORMS = ("Inc", "Incorporated", "Ltd", "Limited", "Corp", "Corporation", "LLC", "LLP", "Co", "Company", "GmbH", "PLC")
#: Substrings of pages that ask for a browser check.
CHALLENGE_MARKERS = ("Just a moment", "Verify you are human", "cf-challenge", "Checking your browser", "Unusual traffic")


def blank_to_null(c: Column) -> Column:
    """NULL for null and for whitespace-only text; other text unchanged, not trimmed (STR-28)."""
    return F.when(F.trim(c) != "", c)


def host(url: Column) -> Column:
    """Lower-case host of an address; NULL if there is none."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(url)), r"^[a-z]+://([^/?#:]+)", 1), F.lit(""))


def job_id(url: Column) -> Column:
    """Job id by a cascade of patterns: a `jk` key, a numbered path segment, else a long last segment (STR-01, 02, 16)."""
    low = F.lower(F.trim(url))
    by = lambda p: F.nullif(F.regexp_extract(low, p, 1), F.lit(""))
    return F.coalesce(by(r"[?&]jk=([0-9a-z]+)"), by(r"/(?:view|o)/([0-9]+)"), by(r"/([0-9a-z]{8,})/*(?:[?#]|$)"))


def canonical_url(url: Column) -> Column:
    """One form for all addresses of a job page: no tracking, fragment, case or path variants (STR-03, 04).

    An address without a job id stays as it is.
    """
    board = F.regexp_extract(host(url), r"([^.]+\.[^.]+)$", 1)
    return F.when(host(url).isNotNull() & job_id(url).isNotNull(), F.concat(F.lit("https://"), board, F.lit("/job/"), job_id(url))).otherwise(url)


def strip_legal_form(name: Column) -> Column:
    """Without trailing legal forms; never empty: a name of nothing else stays (STR-18)."""
    bare = F.regexp_replace(F.trim(name), r"(?i)(?:[\s,]+(?:" + "|".join(LEGAL_FORMS) + r")\.?)+$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), name)


def source_label(source: Column) -> Column:
    """Board of a source however it is spelled; NULL and others are `unknown` (STR-19)."""
    low = F.lower(source)
    return F.when(low.contains("jobquill"), "jobquill").when(low.contains("stellaroles"), "stellaroles").when(low.contains("werkpost"), "werkpost").otherwise("unknown")


def display_name(source: Column) -> Column:
    """Words in title case (STR-20)."""
    return F.initcap(F.regexp_replace(F.trim(source), "[_-]+", " "))


def excerpt(c: Column, n: int = 100) -> Column:
    """The first n characters, with `...` where there are more (STR-21)."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def cluster_key(c: Column) -> Column:
    """Lower case, trimmed, single spaces (STR-24)."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def text_hash(c: Column) -> Column:
    """SHA-256 in hex of the UTF-8 text (STR-25)."""
    return F.sha2(c, 256)


def text_choice(summary: Column, body: Column) -> Column:
    """The trimmed summary, else the trimmed body, else NULL (STR-26)."""
    return F.coalesce(F.nullif(F.trim(summary), F.lit("")), F.nullif(F.trim(body), F.lit("")))


def indent(c: Column, placeholder: str = "(none)") -> Column:
    """Each line two spaces in; a placeholder for empty text (STR-27)."""
    return F.concat(F.lit("  "), F.regexp_replace(F.coalesce(F.nullif(c, F.lit("")), F.lit(placeholder)), "\n", "\n  "))


def challenged(c: Column) -> Column:
    """Whether any marker of a challenge page occurs (STR-29)."""
    out = F.lit(False)
    for m in CHALLENGE_MARKERS:
        out = out | c.contains(m)
    return F.coalesce(out, F.lit(False))


def lenient_timestamp(c: Column) -> Column:
    """ISO text with or without zone; no zone means UTC; NULL if unreadable (DT-02)."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(c), "Z$", "+00:00"))


def days_between(later: Column, earlier: Column) -> Column:
    """Days as a double (DT-03)."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(later) - micros(earlier)) / F.lit(86_400_000_000.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or either is NULL (MTH-02)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
