"""Costs of model calls: prices, ledger rows of all writers, totals of a period, and the watchdog over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Who writes a ledger row.
WRITERS = ("extraction", "verdict", "provider", "embedding_cache_hit")
LEDGER = "at timestamp_ntz, writer string, item string, model string, tokens_in long, tokens_out long, cost double, status string"


def cost(model: Column, tokens_in: Column, tokens_out: Column, prices: dict[str, tuple[float, float]]) -> Column:
    """Price of a call: thousands of tokens in and out by the model's two prices; 0 for a model without any (MTH-01)."""
    if not prices:
        return F.lit(0.0)
    table = F.create_map(*[x for m, p in prices.items() for x in (F.lit(m), F.struct(F.lit(float(p[0])).alias("i"), F.lit(float(p[1])).alias("o")))])
    p = F.try_element_at(table, model)
    return F.coalesce(tokens_in / 1000 * p["i"] + tokens_out / 1000 * p["o"], F.lit(0.0))


def entries(calls: DataFrame, writer: str, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """Ledger rows of (at, item, model, tokens_in, tokens_out, status); a cache hit costs nothing (SNK-13)."""
    if writer not in WRITERS:
        raise ValueError(f"unknown writer {writer!r}")
    price = F.lit(0.0) if writer == "embedding_cache_hit" else cost(F.col("model"), F.col("tokens_in"), F.col("tokens_out"), prices)
    return calls.select("at", F.lit(writer).alias("writer"), F.col("item").cast("string").alias("item"), "model", F.col("tokens_in").cast("long").alias("tokens_in"), F.col("tokens_out").cast("long").alias("tokens_out"), price.alias("cost"), "status")


def append(rows: DataFrame, path: str) -> bool:
    """Add rows to a ledger folder; False if that fails, as a ledger must not stop the work (SNK-13)."""
    try:
        rows.write.mode("append").parquet(path)
        return True
    except Exception:  # noqa: BLE001 - whatever the sink raises
        return False


def in_month(at: Column, as_of: Column) -> Column:
    """From the first of the month of `as_of` to its end of day (AGG-03, DT-04)."""
    return (at >= F.trunc(as_of, "MM").cast("timestamp_ntz")) & (at < F.date_add(as_of, 1).cast("timestamp_ntz"))


def watchdog(ledger: DataFrame, as_of: Column, limit: float) -> DataFrame:
    """(month_cost, warn) of the successful rows of the month so far; it warns, it never stops anything (AGG-25)."""
    total = F.coalesce(F.sum(F.when(in_month(F.col("at"), as_of) & (F.col("status") == "success"), F.col("cost"))), F.lit(0.0))
    return ledger.agg(total.alias("month_cost")).withColumn("warn", F.col("month_cost") > limit)


def batch_totals(ledger: DataFrame, ids: DataFrame, key: str = "item") -> DataFrame:
    """(cost, calls, hits) of the items of a batch: calls are rows that cost, hits those of the cache (AGG-26)."""
    own = ledger.join(ids.select(F.col(key).cast("string").alias("item")).distinct(), "item", "left_semi")
    hit = F.col("writer") == "embedding_cache_hit"
    return own.agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), F.count_if(~hit).alias("calls"), F.count_if(hit).alias("hits"))


def run_summary(runs: DataFrame) -> DataFrame:
    """(new_rows, not_healthy) of a run's rows (source, added, health): the sum, and the sources that failed or faltered (AGG-23)."""
    bad = F.sort_array(F.collect_set(F.when(F.coalesce(F.col("health"), F.lit("failed")) != "healthy", F.col("source"))))
    return runs.agg(F.coalesce(F.sum("added"), F.lit(0)).alias("new_rows"), bad.alias("not_healthy"))
