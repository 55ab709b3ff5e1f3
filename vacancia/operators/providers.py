"""Model providers as pluggable functions, called once per distinct text, with a result cache (UDF-02, 03, 06, 08, 09, ER-20, 21)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.text import text_hash


class Embedder(Protocol):
    name: str
    version: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """A deterministic provider that needs no network: signed hashed words, normalised."""

    name, version = "hashed-words", "1"

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dim)
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.dim] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


REGISTRY: dict[str, Callable[[], Embedder]] = {"hashed-words": HashEmbedder}


def provider(name: str) -> Embedder:
    """The provider of that name; ValueError if there is none (UDF-03)."""
    if name not in REGISTRY:
        raise ValueError(f"unknown provider {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]()


def embed_rows(rows: DataFrame, key: str, text: str, model: Embedder, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, text_hash, embedding) of rows with text, and the new cache rows (text_hash, model, version, embedding).

    Each distinct text that the cache lacks under the model's name and version is embedded once; the
    call sits behind the anti join, so nothing else reaches it. Blank texts are left out.
    """
    have = rows.where(F.trim(F.col(text)) != "").select(key, F.col(text).alias("text"), text_hash(F.col(text)).alias("text_hash"))
    todo = have.select("text_hash", "text").dropDuplicates(["text_hash"])
    hits = None
    if cache is not None:
        hits = cache.where((F.col("model") == model.name) & (F.col("version") == model.version)).select("text_hash", "embedding")
        todo = todo.join(hits, "text_hash", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"text_hash": pdf["text_hash"], "model": model.name, "version": model.version, "embedding": model.embed(pdf["text"].tolist())})

    fresh = todo.mapInPandas(run, "text_hash string, model string, version string, embedding array<float>")
    known = fresh.select("text_hash", "embedding") if hits is None else fresh.select("text_hash", "embedding").unionByName(hits)
    return have.select(key, "text_hash").join(known, "text_hash"), fresh


def classify_pairs(pairs: DataFrame, verdict: Callable[[dict, dict, float], bool | None], retries: int = 1) -> DataFrame:
    """Pairs (a, b structs, score) with a verdict; errors are tried again, then null, which leaves a pair pending (UDF-06)."""

    def run(batches):
        for pdf in batches:
            said = []
            for a, b, s in zip(pdf["a"], pdf["b"], pdf["score"], strict=True):
                v = None
                for _ in range(1 + retries):
                    try:
                        v = verdict(dict(a), dict(b), s)
                        break
                    except Exception:  # noqa: BLE001, S112 - a provider may raise anything; the pair then stays pending
                        continue
                said.append(v)
            yield pdf.assign(verdict=pd.array(said, "boolean"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields) + ", verdict boolean"
    return pairs.mapInPandas(run, schema)


def check_document(raw: str, shape: str, enums: dict[str, list[str]]) -> F.Column:
    """Errors of a JSON document: unreadable, missing fields, values outside their list (JSN-03, 04, ARR-03)."""
    doc = F.from_json(F.col(raw), shape)
    bad = [F.when(doc[k].isNull(), F.lit(f"{k}: missing")).when(~doc[k].isin(v), F.concat(F.lit(f"{k}: "), doc[k])) for k, v in enums.items()]
    return F.when(F.expr(f"try_parse_json(`{raw}`)").isNull(), F.array(F.lit("unreadable"))).otherwise(F.array_compact(F.array(*bad)))


def stricter_prompt(prompt: str, bad: dict[str, tuple[str, list[str]]]) -> str:
    """The prompt with each invalid field and what it may hold (UDF-08)."""
    return "\n".join([prompt, "Correct these fields:", *(f"- {k}: {v!r} is not one of {', '.join(ok)}" for k, (v, ok) in bad.items())]) if bad else prompt
