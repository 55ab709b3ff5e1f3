"""Configuration and tabular sources: rules, taxonomies, labelled pairs, directory listings of results."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Matching:
    """Settings of matching; a missing or unreadable file gives these defaults (SRC-13, 14)."""

    borderline: float = 0.75
    retries: int = 1
    repost_days: int = 30


def read_config(path: str | None):
    """What a JSON or YAML file holds; {} without a path."""
    if not path:
        return {}
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith((".yaml", ".yml")):
        import yaml

        try:
            return yaml.safe_load(text) or {}
        except yaml.YAMLError as e:
            raise ValueError(str(e)) from e
    return json.loads(text)


def load_settings(path: str | None) -> Matching:
    try:
        raw = read_config(path)
        return Matching(**{f.name: type(f.default)(raw[f.name]) for f in fields(Matching) if f.name in raw})
    except (OSError, ValueError, TypeError):
        return Matching()


def load_taxonomy(path: str | None) -> dict[str, list[str]]:
    """Categories with their members in order; empty where the file is missing or bad (SRC-15)."""
    try:
        raw = read_config(path)
        return {k: [str(x) for x in v] for k, v in raw.items() if isinstance(v, list)} if isinstance(raw, dict) else {}
    except (OSError, ValueError):
        return {}


@dataclass(frozen=True)
class Provider:
    """Which providers are used; a missing or bad file gives these defaults (SRC-14)."""

    extractor: str = "rules"
    embedder: str = "hashed-words"
    timeout: float = 30.0


def load_provider(path: str | None) -> Provider:
    try:
        raw = read_config(path)
        got = Provider(**{f.name: type(f.default)(raw[f.name]) for f in fields(Provider) if f.name in raw})
        return got if got.timeout > 0 else Provider()
    except (OSError, ValueError, TypeError):
        return Provider()


def alias_map(taxonomy: dict[str, list[str]], aliases: dict[str, str]) -> dict[str, str]:
    """Every name of a taxonomy, and every alias of one, in lower case, with the name it stands for (SRC-15, STR-22)."""
    names = {x.lower(): x for members in taxonomy.values() for x in members}
    return names | {a.strip().lower(): names[v.strip().lower()] for a, v in aliases.items() if v.strip().lower() in names}


def read_template(path: str, **holes: str) -> str:
    """A template with its named holes filled; a missing file is an error (SRC-19)."""
    return Path(path).read_text().format(**holes)


def read_labelled_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(pair_id, a, b, label) of a CSV with `##` comment lines; labels other than merge and new, and ids that aren't numbers, are left out (SRC-16)."""
    lines = spark.read.text(path).where("not startswith(value, '##') and trim(value) != ''")
    head = lines.first()
    if head is None:
        return spark.createDataFrame([], "pair_id string, a long, b long, label string")
    names = [x.strip() for x in head[0].split(",")]
    rows = lines.where(F.col("value") != head[0]).select(F.from_csv("value", ", ".join(f"`{n}` string" for n in names)).alias("r")).select("r.*")
    return rows.select("pair_id", F.expr("try_cast(canonical_a_id as long)").alias("a"), F.expr("try_cast(canonical_b_id as long)").alias("b"), F.lower(F.trim("user_label")).alias("label")).where("label in ('merge', 'new') and a is not null and b is not null")


def read_nested_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs as nested records, from JSON (SRC-17)."""
    side = "struct<canonical_title:string,canonical_company:string,canonical_seniority:string,top_skills:array<string>,full_jd:string>"
    return spark.read.schema(f"pair_id string, scenario string, ground_truth string, posting_a {side}, posting_b {side}").json(path, multiLine=True)


def resolve_redirects(urls: DataFrame, known: DataFrame, column: str = "url") -> DataFrame:
    """Addresses with what they lead to, from a table (url, resolved); unknown ones lead to themselves (SRC-10)."""
    k = known.select(F.col("url").alias(column), "resolved").dropDuplicates([column])
    return urls.join(k, column, "left").withColumn("resolved", F.coalesce("resolved", column))
