"""Small results as text, runs as JSON lines, tables by staged writes (SNK-09, 14, 15, 19, 20, 21, 23)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows a report may have; reports are aggregates, this guards against a table given by mistake.
REPORT_ROWS = 10_000


def markdown(df: DataFrame, title: str | None = None) -> str:
    """A result of at most REPORT_ROWS rows as an aligned table."""
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report of more than {REPORT_ROWS} rows; aggregate first")
    cells = [df.columns, *[["" if v is None else str(v) for v in r] for r in rows]]
    wide = [max(len(r[k]) for r in cells) for k in range(len(df.columns))]
    line = lambda r: "| " + " | ".join(x.ljust(w) for x, w in zip(r, wide, strict=True)) + " |"
    return "\n".join([*([f"# {title}", ""] if title else []), line(cells[0]), "|" + "|".join("-" * (w + 2) for w in wide) + "|", *map(line, cells[1:])])


def report(title: str, summary: DataFrame, **details: DataFrame) -> str:
    """A summary table and a section per detail table, in the order given (SNK-23)."""
    parts = [f"# {title}", "", markdown(summary)]
    for name, df in details.items():
        parts += ["", f"## {name.replace('_', ' ')}", "", markdown(df) if df.take(1) else "None."]
    return "\n".join(parts)


def append_events(events: DataFrame, kind: str, path: str) -> bool:
    """Add events of one kind; best effort: False if the sink fails (SNK-15)."""
    try:
        events.withColumn("kind", F.lit(kind)).write.mode("append").partitionBy("kind").json(path)
        return True
    except Exception:  # noqa: BLE001 - whatever the sink raises
        return False


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(path)


def append_log(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, one folder for all runs, partitioned by run."""
    df.write.mode("append").partitionBy("run_id").json(path)


def run_record(summary: DataFrame, run_id: str, source: str) -> DataFrame:
    """One health row of a run; the counts of the summary as JSON, health never null."""
    counts = [c for c in summary.columns if c not in ("health", "reason")]
    return summary.select(F.lit(run_id).alias("run_id"), F.lit(source).alias("source"), F.coalesce(F.col("health"), F.lit("failed")).alias("health"), F.col("reason"), F.to_json(F.struct(*counts)).alias("counts"))


def evolve(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The wanted columns, those missing as nulls of their type; an additive change of schema."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in wanted.items()])
