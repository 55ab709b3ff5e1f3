"""Problem 3: the lines of web pages and page texts that are not the main content.

Method: maximum-scoring subsequences. Words and tags have weights, words of content positive, tags of
menus, notices and footers negative, learned from pages whose blocks carry telling names. A linear scan
finds the contiguous regions with the best total, where opening a region has a price; with a price above
all gains that is the single best region. On a page the scan goes over the lines of all blocks; where a block begins, a change costs little.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .linear import Model, train
from .residue import weak_label

#: Names of blocks, in tag or class, that tell what a page's author holds the block for.
BOILER_NAMES = ("nav", "footer", "foot", "aside", "side", "cookie", "consent", "prompt", "menu", "sidebar", "banner")
CONTENT_NAMES = ("main", "article", "content")
BLOCKS = r"div|nav|section|article|aside|footer|main|header|form"

_BLOCK = re.compile(rf"<(/?)({BLOCKS})\b([^>]*)>", re.I)
_CLASS = re.compile(r"""class\s*=\s*["']?([^"'>]*)""", re.I)
_TAG = re.compile(r"<!--.*?-->|<[^>]*>", re.S)
_NAMES = re.compile(r"<([a-zA-Z][a-zA-Z0-9]*)")
_MUTE_OPEN, _MUTE_CLOSE = re.compile(r"<(head|script|style)\b", re.I), re.compile(r"</(head|script|style)\s*>", re.I)
#: Rows of each table that the weights are fitted on, about.
SAMPLE = 4_000
#: Price of a change between region and rest, in log odds, at the lines of a text.
PRICE = 1.0
#: The same where a block of a page begins, and inside a block with names.
BORDER, INSIDE = 0.25, 12.0


def page_lines(page: str) -> list[tuple[int, str, int, str, tuple[str, ...]]]:
    """(line number, visible text, block number, block's names, tags) of a page's lines with visible text."""
    out, block, names, mute, comment = [], 0, "", "", False
    for no, line in enumerate(page.split("\n"), 1):
        if comment:
            end = line.find("-->")
            if end < 0:
                continue
            line, comment = line[end + 3 :], False
        if mute:
            m = next((m for m in _MUTE_CLOSE.finditer(line) if m.group(1).lower() == mute), None)
            if m is None:
                continue
            line, mute = line[m.end() :], ""
        if "<" in line:
            if "<!--" in line and "-->" not in line[line.rfind("<!--") :]:
                line, comment = line[: line.rfind("<!--")], True
            while m := _MUTE_OPEN.search(line):
                kind = m.group(1).lower()
                c = next((c for c in _MUTE_CLOSE.finditer(line, m.end()) if c.group(1).lower() == kind), None)
                if c is None:
                    line, mute = line[: m.start()], kind
                    break
                line = line[: m.start()] + line[c.end() :]
            text = html.unescape(_TAG.sub("", line)).replace("\xa0", " ").strip()
            m = _BLOCK.search(line)
            if m and not text:
                block += 1
                names = ""
                if not m.group(1):
                    c = _CLASS.search(m.group(3))
                    names = f"{m.group(2)} {c.group(1) if c else ''}".lower()
            tags = tuple(_NAMES.findall(line)) if text else ()
        else:
            text, tags = html.unescape(line).replace("\xa0", " ").strip(), ()
        if text:
            out.append((no, text, block, names, tags))
    return out


def told(names: str) -> int | None:
    """1 for a block named as content, 0 for one named as boilerplate, else None."""
    parts = names.split()
    if any(p in BOILER_NAMES for p in parts):
        return 0
    return 1 if any(p in CONTENT_NAMES for p in parts) else None


class Scorer:
    def __init__(self, model: Model, tags: dict[str, float]):
        self.model, self.tags = model, tags

    def page(self, rows, scores) -> list[int]:
        """Line numbers outside the best regions of a page: one scan over all its lines.

        A line's tags add to its words. The tag that opens a block stands at its first line with a weight of
        its own, spread over the block; to change between region and rest costs little where a block begins.
        """
        own, price, before = [], [], None
        sizes: dict[int, int] = {}
        for r in rows:
            sizes[r[2]] = sizes.get(r[2], 0) + 1
        for (_, _, block, names, tags), s in zip(rows, scores, strict=True):
            opening = sum(self.tags.get(p, 0.0) for p in dict.fromkeys(names.split())) if names else 0.0
            own.append(s + sum(self.tags.get("<" + t, 0.0) for t in set(tags)) + opening / sizes[block])
            price.append(BORDER if block != before else INSIDE if names else PRICE)
            before = block
        inside = regions(np.array(own), price)
        return [r[0] for r, x in zip(rows, inside.tolist(), strict=True) if not x]


def regions(scores: np.ndarray, price: float | list[float]) -> np.ndarray:
    """Whether each line lies in one of the regions of the best total: a linear scan over the two states.
    A change before a line costs `price`, or the line's own price."""
    n = len(scores)
    out = np.zeros(n, bool)
    if not n:
        return out
    inside, outside = float(scores[0]), 0.0
    back = []
    for s, cost in zip(scores[1:].tolist(), price[1:] if isinstance(price, list) else [price] * (n - 1), strict=True):
        a, b = inside >= outside - cost, outside >= inside - cost
        back.append((a, b))
        inside, outside = (inside if a else outside - cost) + s, outside if b else inside - cost
    state = inside >= outside
    out[-1] = state
    for k in range(n - 2, -1, -1):
        a, b = back[k]
        state = a if state else not b
        out[k] = state
    return out


def _share(df: DataFrame, key: str, sample: int) -> DataFrame:
    n = df.count()
    return df if n <= sample else df.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(1_000_000 * sample / n))


def learn(pages: DataFrame, texts: DataFrame | None = None, sample: int = SAMPLE) -> Scorer:
    """Weights from about `sample` pages (columns key, page) by the names of their blocks, and from the
    texts (key, text) whose every line is an error message or unfilled, which count as no boilerplate."""
    lines: dict[tuple[str, int], int] = {}
    seen: dict[str, list[int]] = {}
    for row in _share(pages, "key", sample).select("page").where("page is not null").toLocalIterator():
        for _, text, _, names, tags in page_lines(row[0]):
            y = told(names)
            if y is None:
                continue
            key = (text, y)
            lines[key] = lines.get(key, 0) + 1
            for t in {"<" + t for t in tags} | set(names.split()):
                seen.setdefault(t, [0, 0])[y] += 1
    if texts is not None:
        for row in _share(texts, "key", sample).select("text").where("text is not null").toLocalIterator():
            bad = [x.strip() for x in re.split(r"\r?\n", row[0]) if x.strip()]
            if bad and weak_label(bad[0]) and len(bad) <= 3:
                for x in bad:
                    lines[(x, 1)] = lines.get((x, 1), 0) + 1
    if not lines:
        return Scorer(Model(np.zeros(1 << 18), 0.0), {})
    texts_, ys = [k[0] for k in lines], np.array([k[1] for k in lines])
    model = train(texts_, ys, np.sqrt(np.array(list(lines.values()))))
    all_ = [1 + sum(v[k] for v in seen.values()) for k in (0, 1)]
    tags = {t: float(np.log((v[1] + 1) / all_[1]) - np.log((v[0] + 1) / all_[0])) for t, v in seen.items() if sum(v) >= 20}
    for t in list(tags):
        if t[0] != "<" and told(t) is None:
            del tags[t]
    return Scorer(model, {t: float(np.clip(w, -4, 4)) * (2.0 if t[0] != "<" else 0.25) for t, w in tags.items()})


def page_boilerplate(df: DataFrame, scorer: Scorer) -> DataFrame:
    """(key, lines): numbers of the lines with visible text outside the main content, of (key, page)."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                rows = [page_lines(p) if p else [] for p in b.column(1).slice(lo, 500).to_pylist()]
                scores, n = scorer.model.lines(["\n".join(r[1].replace("\n", " ") for r in x) if x else "" for x in rows])
                out, at = [], 0
                for x, k in zip(rows, n.tolist(), strict=True):
                    out.append(scorer.page(x, scores[at : at + len(x)].tolist()))
                    at += k
                yield pa.record_batch([b.column(0).slice(lo, 500), pa.array(out, pa.list_(pa.int32()))], names=["key", "lines"])

    return df.select("key", "page").mapInArrow(run, "key string, lines array<int>")


def text_boilerplate(df: DataFrame, scorer: Scorer, price: float = PRICE) -> DataFrame:
    """(key, lines) of (key, text); lines end at \\n."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                texts = [(t or "").split("\n") for t in b.column(1).slice(lo, 500).to_pylist()]
                full = [[k for k, x in enumerate(t) if x.strip()] for t in texts]
                scores, n = scorer.model.lines(["\n".join(t[k].strip().lstrip("-*• \t") for k in ks) for t, ks in zip(texts, full, strict=True)])
                out, at = [], 0
                for ks, m in zip(full, n.tolist(), strict=True):
                    inside = regions(scores[at : at + len(ks)], price)
                    out.append([k + 1 for k, x in zip(ks, inside.tolist(), strict=True) if not x])
                    at += m
                yield pa.record_batch([b.column(0).slice(lo, 500), pa.array(out, pa.list_(pa.int32()))], names=["key", "lines"])

    return df.select("key", "text").mapInArrow(run, "key string, lines array<int>")


def boilerplate_lines(sources: DataFrame, hydrated: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(field, record_key, line_no) of posting_sources.raw_html and hydrated_jds.description.

    Null and empty pages and texts, blank lines, markup, comments and head, script and style give no
    rows. Rows delivered twice count once, and a key with several texts gives the lines of each; a null key gives none. Tables without pages give no weights,
    and no rows.
    """
    pages = sources.select(F.col("id").cast("string").alias("key"), F.col("raw_html").alias("page")).where("key is not null and page is not null")
    texts = hydrated.select(F.col("job_id").alias("key"), F.col("description").alias("text")).where("key is not null and text is not null")
    scorer = learn(pages, texts, sample)
    a = page_boilerplate(pages, scorer).select(F.lit("raw_html").alias("field"), "key", "lines")
    b = text_boilerplate(texts, scorer).select(F.lit("description").alias("field"), "key", F.explode("lines").alias("line_no")).distinct()
    return a.select("field", "key", F.explode("lines").alias("line_no")).unionAll(b).withColumnRenamed("key", "record_key")


def main_text(df: DataFrame, scorer: Scorer, id_col: str, page_col: str) -> DataFrame:
    """(key, text): the content lines of each page, in order; empty where there are none."""
    rows = df.select(F.col(f"`{id_col}`").cast("string").alias("key"), F.col(f"`{page_col}`").alias("page")).where("key is not null")

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                rows = [page_lines(p) if p else [] for p in b.column(1).slice(lo, 500).to_pylist()]
                scores, n = scorer.model.lines(["\n".join(r[1].replace("\n", " ") for r in x) if x else "" for x in rows])
                out, at = [], 0
                for x, k in zip(rows, n.tolist(), strict=True):
                    drop = set(scorer.page(x, scores[at : at + len(x)].tolist()))
                    out.append("\n".join(r[1] for r in x if r[0] not in drop))
                    at += k
                yield pa.record_batch([b.column(0).slice(lo, 500), pa.array(out, pa.string())], names=["key", "text"])

    return rows.mapInArrow(run, "key string, text string")
