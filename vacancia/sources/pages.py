"""Posting pages: HTML to text, structured data, scraping, and the cascade over them."""

from __future__ import annotations

import html
import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Tags that end a paragraph, tags whose text isn't shown.
PARAGRAPHS = frozenset(("p", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6"))
HIDDEN = frozenset(("script", "style", "head", "title", "noscript", "template"))


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.muted = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.muted += 1
        elif tag == "br":
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.muted = max(0, self.muted - 1)
        elif tag in PARAGRAPHS:
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.muted:
            self.out.append(data)


def html_to_text(page: str | None) -> str | None:
    """Text of a page: breaks kept, paragraphs apart by one blank line, no trailing spaces (STR-11).

    Null and empty stay; text without a tag is only trimmed.
    """
    if not page:
        return page
    if "<" not in page:
        return page.strip()
    p = _Text()
    p.feed(page)
    p.close()
    lines = "\n".join(x.rstrip() for x in "".join(p.out).replace("\xa0", " ").split("\n"))
    return re.sub(r"\n{3,}", "\n\n", lines).strip()


_LD = re.compile(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script>", re.I | re.S)


def structured(page: str | None) -> dict:
    """Fields of the first JobPosting object in a page's structured data; empty if there is none (STR-12)."""
    for raw in _LD.findall(page or ""):
        try:
            found = json.loads(raw)
        except ValueError:
            continue
        todo = found if isinstance(found, list) else [found]
        for x in list(todo):
            if isinstance(x, dict):
                todo += [y for y in x.get("@graph", []) if isinstance(y, dict)]
        for x in todo:
            if not isinstance(x, dict) or x.get("@type") != "JobPosting":
                continue
            org, place, field = x.get("hiringOrganization"), x.get("jobLocation"), x.get("industry")
            place = place[0] if isinstance(place, list) and place else place
            where = (place or {}).get("address", {}) if isinstance(place, dict) else {}
            where = where if isinstance(where, dict) else {}
            return {
                "title": x.get("title"), "company": org.get("name") if isinstance(org, dict) else org, "location": where.get("addressLocality") or where.get("addressRegion") or where.get("addressCountry"),
                "description": html_to_text(x.get("description")), "posted": str(x.get("datePosted") or "")[:10] or None, "industries": [field] if isinstance(field, str) else field if isinstance(field, list) else None,
            }
    return {}


def scraped(page: str | None) -> dict:
    """Title and body by the page's own marks: first heading or title, main or article or named block (STR-13)."""
    page = page or ""
    head = re.search(r"<h1[^>]*>(.*?)</h1>", page, re.I | re.S) or re.search(r"<title[^>]*>(.*?)</title>", page, re.I | re.S)
    body = re.search(r"""<(main|article)\b[^>]*>(.*?)</\1>|<(?:div|section)[^>]*(?:id|class)=["'](?:main|content|jobDescription\w*)["'][^>]*>(.*?)</(?:div|section)>""", page, re.I | re.S)
    text = html_to_text((body.group(2) or body.group(3)) if body else None)
    return {"title": html.unescape(re.sub(r"<[^>]+>", "", head.group(1))).replace("\xa0", " ").strip() or None if head else None, "description": text or None}


def hydrate(df: DataFrame, id_col: str, page_col: str) -> DataFrame:
    """(id, title, company, location, description, posted, method, status) by structured data, else scraping, else nothing (STR-14, 15).

    status: complete with title and description, partial with one, failed with none.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for page in pdf[page_col]:
                page = bytes(page).decode("utf-8", "replace") if isinstance(page, (bytes, bytearray, memoryview)) else page
                a, b = structured(page), scraped(page)
                method = "structured" if a.get("title") or a.get("description") else "scraped" if b["title"] or b["description"] else "none"
                got = {k: a.get(k) or b.get(k) for k in ("title", "company", "location", "description", "posted")}
                n = bool(got["title"]) + bool(got["description"])
                rows.append((*got.values(), method, ("failed", "partial", "complete")[n]))
            yield pd.concat([pdf[[id_col]].reset_index(drop=True), pd.DataFrame(rows, columns=["title", "company", "location", "description", "posted", "method", "status"])], axis=1)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, page_col).mapInPandas(run, f"`{id_col}` {kind}, title string, company string, location string, description string, posted string, method string, status string").withColumn("posted", F.expr("try_cast(posted as date)"))


def to_text(df: DataFrame, id_col: str, page_col: str) -> DataFrame:
    """(id, text) of pages."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf[id_col], "text": [html_to_text(x) for x in pdf[page_col]]})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, page_col).mapInPandas(run, f"`{id_col}` {kind}, text string")


def unescape(df: DataFrame, column: str) -> DataFrame:
    """`column` with HTML entities decoded (STR-17)."""

    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda x: html.unescape(x) if x is not None else None)

    return df.withColumn(column, decode(F.col(column)))


def read_pages(spark: SparkSession, folder: str, ids: DataFrame, id_col: str = "job_id") -> DataFrame:
    """ids with the page stored as `{id}.html`, else `sample-{id}.html`, else failed with a reason (SRC-09)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(folder)
    files = files.select(F.regexp_extract("path", r"([^/]+)\.html$", 1).alias("stem"), "content")
    a, b = files.select(F.col("stem").alias(id_col), F.col("content").alias("c1")), files.select(F.regexp_extract("stem", "^sample-(.*)$", 1).alias(id_col), F.col("content").alias("c2")).where(f"{id_col} != ''")
    out = ids.join(a, id_col, "left").join(b, id_col, "left")
    return out.select(*ids.columns, F.coalesce("c1", "c2").alias("page"), F.when(F.coalesce("c1", "c2").isNull(), "fixture_not_found").alias("failure_reason"))
