"""Problem 6: template residue, filler and error-page text in place of, or inside, real content.

Method: a regularized linear classifier on hashed n-grams, with features of length and title, trained
from weak labels: phrases (below) and the response status. It scores windows of a few tokens, so that one
placeholder in a long text is seen as well as a page that is nothing but an error. Validation is on a
host that the training hasn't seen.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .linear import TOKEN, Model, features, train

#: Phrases of the weak labels, by kind.
PHRASES = {
    "placeholder": r"\{\{[^{}\n]*\}\}|\[\[\w+\]\]|\$?\{[A-Za-z_. ]{2,40}\}|\*\|\w+\|\*|@@\w+@@|<<\w+>>|<%=?[^%\n]*%>|%%?[A-Z][A-Z_]{2,}%%?|\{%[^%\n]*%\}|\[(?i:insert|your|add|enter|company|job|name|city|date|todo|tbd)\b[^\]\n]*\]|\b[Xx]{4,}\b|#[A-Z][A-Z_]{2,}#|__[A-Z][A-Z_]+__|&lt;\w+&gt;|<[a-z]+_[a-z_]+>",
    "filler": r"(?i)lorem ipsum|dolor sit amet|consectetur|eiusmod tempor|veniam quis|\b(?:nostrud|ullamco|laboris|aliquip|incididunt|adipiscing|voluptate|excepteur|occaecat|cupidatat|deserunt|fugiat|pariatur|reprehenderit|exercitation|proident|mollit)\b|^(?:todo|tbd|tba|fixme)\b|description goes here|text goes here|placeholder copy|blah blah|sample text|dummy text|test test|asdf|qwerty|^\s*(?:undefined|null|nan|none|n/a)\s*$|\[object object\]|replace before publishing|to be filled|fill in later|wording to follow",
    "error": r"(?i)^(?:http |error |erreur |fehler |oops|uh.oh)?\W*\d{3}\b\W*(?:error|page|access|bad|internal|too many|service|forbidden|gateway|not found|$)|^(?:http|error|erreur|fehler)\s+\d{3}|^oops\W|^(?:page not found|access denied|bad gateway|internal server error|service (?:temporarily )?unavailable|too many requests|forbidden|gateway time-?out)|page introuvable|accès refusé|seite nicht gefunden|zugriff verweigert|no se encontró la página|acceso denegado|serverfehler ist aufgetreten|erreur est survenue|se produjo un error|zu viele anfragen|trop de requêtes|demasiadas solicitudes|we could not load|could not be loaded|^loading(?:…|\.)|^just a moment|page is gone|page has (?:moved|expired)",
    "script": r"(?i)enable javascript|javascript is (?:disabled|off|turned off|not enabled)|javascript in your browser|activer javascript|active javascript|javascript aktivieren|aktivieren sie javascript|requires scripts|exige les scripts|braucht skripte|requiere scripts|necesita scripts|blocked scripts|scripting is off|cookies must be allowed|verify (?:that )?you are (?:a )?human|unusual traffic|blocked by security|session has expired|log in again|captcha|checking your browser|are you a robot",
}
_ANY = re.compile("|".join(f"(?P<{k}>{v.replace('(?i)', '')})" if not v.startswith("(?i)") else f"(?P<{k}>(?i:{v[4:]}))" for k, v in PHRASES.items()), re.M)
_CODE = re.compile(r"\W*\d{3}\b")
#: In lower case, what a line must hold for any of the phrases to be in it.
ANCHORS = ("{", "[", "*|", "@@", "<", "%", "#", "__", "&lt;", "xxxx", "ipsum", "dolor", "consectetur", "eiusmod", "veniam", "nostrud", "ullamco", "laboris", "aliquip", "incididunt", "adipiscing", "voluptate", "excepteur", "occaecat", "cupidatat", "deserunt", "fugiat", "pariatur", "reprehenderit", "exercitation", "proident", "mollit", "todo", "tbd", "tba", "fixme", "goes here", "placeholder", "blah", "sample text", "dummy text", "test test", "asdf", "qwerty", "undefined", "null", "nan", "none", "n/a", "replace before", "to be filled", "fill in", "wording to", "error", "erreur", "fehler", "oops", "http", "not found", "denied", "gateway", "server", "unavailable", "too many", "forbidden", "introuvable", "refus", "nicht gefunden", "verweigert", "acceso", "no se enc", "anfragen", "requêtes", "solicitudes", "could not", "loading", "just a moment", "gone", "page has", "script", "skripte", "captcha", "human", "traffic", "blocked", "expired", "cookies must", "log in", "robot", "checking")
#: Tokens in a window, rows the classifier is fitted on, about, and the log odds from which a window counts.
WINDOW, SAMPLE, LIMIT = 5, 12_000, 0.0
#: Weight of a window with a phrase against one without.
POSITIVE = 8.0
#: Of the training rows' lines without a phrase, one in so many is taken.
THIN = 5
#: Descriptions from this length are held for real content by their status.
LONG = 400


def weak_label(line: str) -> str | None:
    """The kind of the first phrase in a line, or None."""
    m = _found(line)
    return m[0][1] if m else None


def _found(line: str) -> list[tuple[tuple[int, int], str]]:
    low = line.lower()
    return [(m.span(), m.lastgroup) for m in _ANY.finditer(line)] if any(x in low for x in ANCHORS) or _CODE.match(line) else []


def _pieces(line: str, size: int = WINDOW, step: int = WINDOW // 2):
    spans = [m.span() for m in TOKEN.finditer(line)]
    if len(spans) <= size:
        return [(0, len(line), line)]
    starts = [*range(0, len(spans) - size, step), len(spans) - size]
    return [(spans[i][0], spans[i + size - 1][1], line[spans[i][0] : spans[i + size - 1][1]]) for i in starts]


def _title(description: str, title: str | None) -> str:
    """Feature token: whether the title stands in the text."""
    return "titled" if title and title.strip() and title.strip().lower() in description.lower() else "untitled"


def _length(description: str) -> int:
    return min(9, len(description).bit_length())


def examples(rows) -> tuple[list[str], list[int], list[float]]:
    """Windows with weak labels, from (description, title, status) rows."""
    seen: dict[tuple[str, int], int] = {}

    def add(pieces, y):
        for p in pieces:
            seen[(p, y)] = seen.get((p, y), 0) + 1

    count = 0
    for text, _, status in rows:
        lines = [x for x in re.split(r"\r?\n", text) if x.strip()]
        found = [_found(x) for x in lines]
        marked = any(found)
        failed = (status or "").strip().lower() in ("failed", "partial") and len(text) < 120 and marked
        for line, spans in zip(lines, found, strict=True):
            if any(k in ("placeholder", "filler") for _, k in spans):
                for a, b, piece in _pieces(line, step=1):
                    if any(a <= s and e <= b or s <= a and b <= e for (s, e), _ in spans):
                        add([piece], 1)
                    elif not any(s < b and a < e for (s, e), _ in spans):
                        add([piece], 0)
            elif spans or failed:
                add((p for _, _, p in _pieces(line)), 1)
            elif len(text) >= LONG or not marked:
                count += 1
                if count % THIN == 0:
                    add((p for _, _, p in _pieces(line)), 0)
    return [k[0] for k in seen], [k[1] for k in seen], [float(v) ** 0.5 for v in seen.values()]


class Detector:
    def __init__(self, model: Model, page: dict[tuple[str, int], float]):
        self.model, self.page = model, page

    def scores(self, texts: list[str], titles: list[str | None]) -> np.ndarray:
        """The best window of each text, plus what its length and title add."""
        best = np.full(len(texts), -np.inf)
        full = [i for i, t in enumerate(texts) if t]
        if not full:
            return best
        w, of, stop = self.model.tokens([texts[i].replace("\r", "") for i in full])
        cum = np.zeros(len(w) + 1)
        np.cumsum(w, out=cum[1:])
        breaks = np.nonzero(stop)[0]
        line = np.cumsum(stop) - 1  # the line that a token is in; a break opens its line
        own = np.nonzero(~stop)[0]
        if not len(own):
            return best
        begin, end = breaks[line[own]], breaks[line[own] + 1]
        at = np.maximum(np.minimum(own, end - WINDOW), begin + 1)  # the last windows of a line reach its end
        at = np.where(at == begin + 1, begin, at)  # the break in front belongs to the first token
        z = cum[np.minimum(np.maximum(at, begin + 1) + WINDOW, end)] - cum[at]
        head = np.concatenate([[0], np.nonzero(np.diff(of[own]))[0] + 1])
        out = np.full(len(full), -np.inf)
        out[of[own][head]] = np.maximum.reduceat(z, head) + self.model.bias
        best[full] = out
        return best + np.array([self.page.get((_title(t or "", s), _length(t or "")), 0.0) for t, s in zip(texts, titles, strict=True)])


def fit(df: DataFrame, sample: int = SAMPLE, host: str | None = None) -> Detector:
    """From about `sample` rows of (description, title, hydration_status, url), without those of `host`."""
    df = df.where("description is not null and description != ''")
    if host:
        df = df.where(~F.coalesce(F.col("url"), F.lit("")).contains(host))
    n = df.count()
    if n > sample:
        df = df.where(F.pmod(F.xxhash64("description"), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    rows = [tuple(r) for r in df.select("description", "title", "hydration_status").toLocalIterator()]
    texts, labels, weight = examples(rows)
    if not texts or len(set(labels)) < 2:
        return Detector(Model(np.zeros(1 << 18), -1.0), {})
    y = np.array(labels)
    model = train(texts, y, np.array(weight) * np.where(y > 0, POSITIVE, 1.0), rounds=120)
    odds: dict[tuple[str, int], list[int]] = {}
    for text, title, _ in rows:
        odds.setdefault((_title(text, title), _length(text)), [1, 1])[int(any(map(weak_label, text.split("\n"))))] += 1
    page = {k: float(np.clip(np.log(v[1] / v[0]), -4, 4)) * 0.1 for k, v in odds.items()}
    return Detector(model, page)


def residue(df: DataFrame, detector: Detector, limit: float = LIMIT) -> DataFrame:
    """job_id of the records whose description is or holds residue; once each.

    Null and empty descriptions are no cases; null ids give no rows; equal rows count once; an empty
    table gives none. Descriptions are scored whole.
    """

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                x = b.slice(lo, 1000)
                hit = detector.scores(x.column(1).to_pylist(), x.column(2).to_pylist()) > limit
                yield pa.record_batch([x.column(0).filter(pa.array(hit))], names=["job_id"])

    rows = df.select("job_id", "description", "title").where("job_id is not null and description is not null and description != ''")
    return rows.mapInArrow(run, "job_id string").distinct()
