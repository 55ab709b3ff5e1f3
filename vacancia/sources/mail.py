"""E-mail sources: a folder of .eml files, headers, parts, and the postings an alert names."""

from __future__ import annotations

import email
import email.header
import email.policy
import email.utils
import html
import re
from datetime import UTC
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import canonical_url, job_id

_LINK = re.compile(r"https?://[^\s\"'<>]+", re.I)


def read_folder(spark: SparkSession, folder: str, streaming: bool = False) -> DataFrame:
    """(id, body) of the .eml files of a folder; id is the file's stem (SRC-02)."""
    reader = spark.readStream if streaming else spark.read
    if streaming:
        reader = reader.schema("path string, modificationTime timestamp, length long, content binary")
    files = reader.format("binaryFile").option("pathGlobFilter", "*.eml").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)\.eml$", 1).alias("id"), F.col("content").alias("body"))


def decode_header(raw: str | None) -> str | None:
    """RFC 2047 words decoded; the raw text where that fails (SRC-04)."""
    if raw is None:
        return None
    try:
        return str(email.header.make_header(email.header.decode_header(raw)))
    except (LookupError, UnicodeError, ValueError):
        return raw


def _date(raw: str | None):
    try:
        d = email.utils.parsedate_to_datetime(raw)
    except (TypeError, ValueError):
        try:
            return pd.Timestamp(raw).tz_convert("UTC").tz_localize(None) if raw else None
        except (TypeError, ValueError):
            return None
    return (d if d.tzinfo else d.replace(tzinfo=UTC)).astimezone(UTC).replace(tzinfo=None)


def _part(message, kind: str) -> str | None:
    for p in message.walk():
        if p.get_content_type() == kind and not p.is_multipart():
            body = p.get_payload(decode=True) or b""
            try:
                return body.decode(p.get_content_charset() or "utf-8", "replace")
            except LookupError:
                return body.decode("utf-8", "replace")
    return None


def read_messages(df: DataFrame, id_col: str = "id", body_col: str = "body") -> DataFrame:
    """(id, sender, subject, sent_at, plain, page) of raw messages (SRC-04, 05, STR-08).

    A null or unreadable message gives nulls; sent_at is UTC, null if there is no readable date, so that
    the caller puts one fixed time of the run there.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for raw in pdf[body_col]:
                m = email.message_from_bytes(bytes(raw), policy=email.policy.compat32) if raw is not None else None
                rows.append((None,) * 5 if m is None else (decode_header(m["From"]), decode_header(m["Subject"]), _date(m["Date"]), _part(m, "text/plain"), _part(m, "text/html")))
            yield pd.concat([pdf[[id_col]].reset_index(drop=True), pd.DataFrame(rows, columns=["sender", "subject", "sent_at", "plain", "page"]).astype({"sent_at": "datetime64[us]"})], axis=1)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, body_col).mapInPandas(run, f"`{id_col}` {kind}, sender string, subject string, sent_at timestamp_ntz, plain string, page string")


class _Anchors(HTMLParser):
    """Links with their text, and the texts between one link and the next."""

    def __init__(self):
        super().__init__()
        self.out, self.open = [], False

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.out.append([dict(attrs).get("href") or "", [], []])
            self.open = True

    def handle_endtag(self, tag):
        if tag == "a":
            self.open = False

    def handle_data(self, data):
        if self.out and data.strip():
            self.out[-1][1 if self.open else 2].append(data.strip())


def links(plain: str | None, page: str | None) -> list[tuple[str, str | None, str | None, str | None]]:
    """(address, title, company, location) in order: of the plain part, or of the page if that has none (STR-05, 07, 09)."""
    out = []
    for line in (plain or "").splitlines():
        for m in _LINK.finditer(line):
            head = line[: m.start()].rstrip(" -–|:·").strip()
            parts = [x.strip() for x in re.split(r" · ", head)] if head else []
            out.append((html.unescape(m.group()), *(parts + [None] * 3)[:3]))
    if out or not page:
        return out
    p = _Anchors()
    p.feed(page)
    return [(html.unescape(h), " ".join(t) or None, *(r + [None] * 2)[:2]) for h, t, r in p.out if h.lower().startswith("http")]


def postings_of(messages: DataFrame, id_col: str = "id") -> DataFrame:
    """One row per job a message names: (id, seq, url, raw_url, job_id, title, company, location) (STR-01..09, WIN-07, JN-19).

    The first address of a job in a message counts; its words come from the last link that has any.
    Addresses without a job id are left out.
    """

    def run(batches):
        for pdf in batches:
            out = [(i, k, *x) for i, a, b in zip(pdf[id_col], pdf["plain"], pdf["page"], strict=True) for k, x in enumerate(links(a, b))]
            yield pd.DataFrame(out, columns=[id_col, "seq", "raw_url", "title", "company", "location"])

    kind = messages.schema[id_col].dataType.simpleString()
    rows = messages.select(id_col, "plain", "page").mapInPandas(run, f"`{id_col}` {kind}, seq int, raw_url string, title string, company string, location string")
    rows = rows.withColumn("job_id", job_id(F.col("raw_url"))).where("job_id is not null").withColumn("url", canonical_url(F.col("raw_url")))
    word = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return rows.groupBy(id_col, "url", "job_id").agg(F.min("seq").alias("seq"), F.min_by("raw_url", "seq").alias("raw_url"), word("title"), word("company"), word("location"))


def sender_query(name: Column, days: int, known: dict[str, str]) -> Column:
    """A mailbox query from a short name, or the query as it is, for the last `days` days and one more (SRC-01, 03)."""
    query = F.coalesce(F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[name], name)
    return F.concat(query, F.lit(f" newer_than:{max(1, days + 1)}d"))
