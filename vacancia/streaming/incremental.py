"""The incremental forms: first wins, already linked, transitions, watermarks (STM-01, 02, 03, 05, 06)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.text import canonical_url


def first_urls(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """The first arrival of each (user, page); state is dropped after `late` of event time (STM-01, 06)."""
    return stream.withWatermark("seen_at", late).withColumn("page", canonical_url(F.col("url"))).dropDuplicatesWithinWatermark(["user_id", "page"])


def new_only(batch: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of a micro-batch that aren't among the done ones (STM-02, 03, SET-01)."""
    return batch.join(done.select(key), key, "left_anti")


def each_batch(path: str, key: str, work: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: keep off what an earlier batch has written, do the work, write it under its number.

    A batch that is repeated after a failure overwrites its own folder and doesn't see it, so the sink
    holds each row once.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
        if there:
            done = spark.read.option("basePath", path).parquet(path).where(F.col("batch") < number)
            batch = new_only(batch, done, key)
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run


def above(df: DataFrame, mark: int, key: str = "event_id") -> DataFrame:
    """Rows beyond a high-watermark (STM-05)."""
    return df.where(F.col(key) > mark)


def windowed_counts(stream: DataFrame, at: str, size: str, late: str, *by: str) -> DataFrame:
    """Counts per window of event time, late rows up to `late`."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size), *by).agg(F.count("*").alias("n"))


def transition_events(stream: DataFrame, bad: tuple[str, ...] = ("degraded", "failed"), good: tuple[str, ...] = ("healthy", "never_run")) -> DataFrame:
    """(source, status, previous) whenever a source turns from good to bad, across micro-batches (WIN-03)."""

    def step(key, frames, state):
        previous = state.get[0] if state.exists else "never_run"
        out = []
        for pdf in frames:
            for status in pdf.sort_values("started_at")["status"]:
                if status in bad and previous in good:
                    out.append((key[0], status, previous))
                previous = status
        state.update((previous,))
        yield pd.DataFrame(out, columns=["source", "status", "previous"])

    return stream.groupBy("source").applyInPandasWithState(step, "source string, status string, previous string", "status string", "append", "NoTimeout")
