"""Structured extraction by a model: one call per distinct text, cache by text, model and version, tries, ledger."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.text import text_hash


class Transient(Exception):
    """A failure that may pass, as of a network; the call is made again."""


class Extractor(Protocol):
    """A model: a prompt in, a document and (tokens in, tokens out) out (UDF-01)."""

    name: str
    version: str

    def extract(self, prompt: str) -> tuple[str, tuple[int, int]]: ...


class Offline:
    """A deterministic extractor that needs no network: fields by rules of its own (UDF-05)."""

    name, version = "rules", "1"

    def __init__(self, rules: dict[str, Callable[[str], object]]):
        self.rules = rules

    def extract(self, prompt: str) -> tuple[str, tuple[int, int]]:
        out = json.dumps({k: f(prompt) for k, f in self.rules.items()})
        return out, (len(prompt) // 4, len(out) // 4)


class Remote:
    """An adapter for a service: `call` gets (model, prompt) and gives (text, tokens in, tokens out); timeouts and
    refused connections count as transient, whatever else it raises as final (UDF-04)."""

    def __init__(self, name: str, version: str, call: Callable[[str, str], tuple[str, int, int]]):
        self.name, self.version, self.call = name, version, call

    def extract(self, prompt: str) -> tuple[str, tuple[int, int]]:
        try:
            text, a, b = self.call(self.name, prompt)
        except (TimeoutError, ConnectionError) as e:
            raise Transient(str(e)) from e
        return text, (a, b)


@dataclass(frozen=True)
class Field:
    """What a field may hold: a JSON type, a list of values, a range, a most number of items."""

    kind: type | tuple[type, ...]
    values: tuple = ()
    least: float | None = None
    most: float | None = None
    items: int | None = None
    required: bool = True


@dataclass(frozen=True)
class Shape:
    fields: dict[str, Field] = field(default_factory=dict)

    def errors(self, raw: str) -> dict[str, str]:
        """What is wrong with a document, by field; `` for one that can't be read (JSN-03, 04)."""
        try:
            doc = json.loads(raw)
        except ValueError:
            return {"": "unreadable"}
        if not isinstance(doc, dict):
            return {"": "not an object"}
        bad = {}
        for k, f in self.fields.items():
            v = doc.get(k)
            if v is None:
                if f.required:
                    bad[k] = "missing"
            elif isinstance(v, bool) and f.kind is not bool or not isinstance(v, f.kind):
                bad[k] = f"{v!r} has the wrong type"
            elif isinstance(v, list):
                wrong = [x for x in v if f.values and x not in f.values]
                if wrong:
                    bad[k] = f"{wrong!r} not among {', '.join(map(str, f.values))}"
                elif f.items is not None and len(v) > f.items:
                    bad[k] = f"{len(v)} items, {f.items} at most"
            elif f.values and v not in f.values:
                bad[k] = f"{v!r} is not one of {', '.join(map(str, f.values))}"
            elif f.least is not None and v < f.least or f.most is not None and v > f.most:
                bad[k] = f"{v!r} is not from {f.least} to {f.most}"
        bad |= {k: "unknown field" for k in doc if k not in self.fields}
        return bad


def attempt(model: Extractor, prompt: str, shape: Shape, waits: tuple[float, ...] = (0, 2, 4), tries: int = 3, sleep=time.sleep) -> tuple[str | None, list[tuple[str, int, int]]]:
    """A valid document or None, and (status, tokens in, tokens out) of every call.

    A call that fails for now is made again after the next of `waits`; a document that isn't valid is asked
    for again with its faults named, up to `tries` documents.
    """
    calls, asked = [], prompt
    for _ in range(tries):
        for wait in waits:
            if wait:
                sleep(wait)
            try:
                raw, (a, b) = model.extract(asked)
                break
            except Transient:
                calls.append(("transient", 0, 0))
            except Exception:  # noqa: BLE001 - a model may raise anything; the item then failed
                calls.append(("failed", 0, 0))
                return None, calls
        else:
            return None, calls
        bad = shape.errors(raw)
        calls.append(("invalid" if bad else "success", a, b))
        if not bad:
            return raw, calls
        asked = "\n".join([prompt, "The last answer was not valid:", *(f"- {k or 'document'}: {v}" for k, v in bad.items())])
    return None, calls


def extract_rows(rows: DataFrame, key: str, text: str, model: Extractor, shape: Shape, prompt: str = "{text}", cache: DataFrame | None = None, waits: tuple[float, ...] = (0, 2, 4)) -> tuple[DataFrame, DataFrame]:
    """(key, text_hash, document, status) of every row with text, and what each new text took:
    (text_hash, model, version, document, status, calls), to be cached and put in the ledger (UDF-07, STM-04).

    A text that the cache has under the model's name and version isn't asked for again, whatever other
    versions hold; equal texts are asked for once. A text without a valid document is `failed` and isn't
    served from the cache. Blank texts are left out.
    """
    have = rows.where(F.trim(F.col(text)) != "").select(key, F.col(text).alias("text"), text_hash(F.col(text)).alias("text_hash"))
    todo = have.groupBy("text_hash").agg(F.first("text").alias("text"))
    hits = None
    if cache is not None:
        hits = cache.where((F.col("model") == model.name) & (F.col("version") == model.version) & (F.col("status") == "success")).select("text_hash", "document").dropDuplicates(["text_hash"])
        todo = todo.join(hits, "text_hash", "left_anti")

    def run(batches):
        for pdf in batches:
            got = [attempt(model, prompt.format(text=t), shape, waits) for t in pdf["text"]]
            yield pd.DataFrame({"text_hash": pdf["text_hash"], "model": model.name, "version": model.version, "document": [g[0] for g in got], "status": ["success" if g[0] is not None else "failed" for g in got], "calls": [[{"status": s, "tokens_in": a, "tokens_out": b} for s, a, b in g[1]] for g in got]})

    new = todo.mapInPandas(run, "text_hash string, model string, version string, document string, status string, calls array<struct<status:string,tokens_in:long,tokens_out:long>>")
    done = new.select("text_hash", "document", "status")
    if hits is not None:
        done = done.unionByName(hits.withColumn("status", F.lit("success")))
    return have.select(key, "text_hash").join(done, "text_hash").select(key, "text_hash", "document", "status"), new


def bust(cache: DataFrame, rows: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """The cache without the entries of the texts of some rows, and how many those were (SNK-18)."""
    gone = rows.where(F.col(text).isNotNull()).select(text_hash(F.col(text)).alias("text_hash")).distinct()
    return cache.join(gone, "text_hash", "left_anti"), cache.join(gone, "text_hash", "left_semi").agg(F.count("*").alias("removed"))


def mark_failed(rows: DataFrame, failed: DataFrame, key: str, column: str = "extraction_status") -> DataFrame:
    """Rows whose key is among the failed get that status; the column is added where there is none (SNK-10)."""
    if column not in rows.columns:
        rows = rows.withColumn(column, F.lit(None).cast("string"))
    hit = failed.select(key, F.lit(True).alias("__failed")).distinct()
    return rows.join(hit, key, "left").withColumn(column, F.when(F.col("__failed"), "failed").otherwise(F.col(column))).drop("__failed")
