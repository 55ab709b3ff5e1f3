"""States of items by their events: latest wins, sessions, and what drove a group's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def states(events: DataFrame, key: list[str], kind: str, order: list[str], leads_to: dict[str, str], start: str = "main") -> DataFrame:
    """(key, state) by the last event of each key that leads anywhere; an undoing event leads back to the start (STM-07, SNK-16)."""
    to = F.create_map(*[x for k, v in leads_to.items() for x in (F.lit(k), F.lit(v))])
    moves = events.withColumn("__to", F.try_element_at(to, F.col(kind)))
    last = F.max_by("__to", F.struct(F.col("__to").isNotNull(), *order))
    return moves.groupBy(*key).agg(last.alias("state")).withColumn("state", F.coalesce("state", F.lit(start)))


def sessions(events: DataFrame, key: str, at: str, gap: str = "30 minutes") -> DataFrame:
    """(key, start, last, n) of runs of events whose neighbours are less than `gap` apart (STM-08)."""
    return events.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.min(at).alias("start"), F.max(at).alias("last"), F.count("*").alias("n")).drop("w")


def drivers(links: DataFrame, group: str, member: str, **sets: DataFrame) -> DataFrame:
    """Of each group, the least member in each of the sets, null where none is (JN-16)."""
    flagged = links
    for name, df in sets.items():
        flagged = flagged.join(df.select(member, F.lit(True).alias(f"__{name}")).distinct(), member, "left")
    return flagged.groupBy(group).agg(*[F.min(F.when(F.col(f"__{n}"), F.col(member))).alias(n) for n in sets])


def newest_vector(links: DataFrame, vectors: DataFrame, group: str, member: str, preferred: Column, at: str) -> DataFrame:
    """The vector of each group's newest linked member, preferred ones before all others (JN-07)."""
    best = F.max_by("vector", F.struct(preferred.cast("int"), at, -F.col(member)))
    return links.join(vectors, member).groupBy(group).agg(best.alias("vector"), F.max(F.struct(preferred.cast("int").alias("p"), at, (-F.col(member)).alias("m"))).alias("b")).select(group, (-F.col("b.m")).alias(member), "vector")
