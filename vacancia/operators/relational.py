"""Joins, per-group picks, windows, rollups and keyed updates, each DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def suppress(groups: DataFrame, links: DataFrame, group: str, member: str, *removed: DataFrame) -> DataFrame:
    """Groups without any member in any of `removed` (JN-01, 02): anti joins on the group key."""
    out = groups
    for r in removed:
        out = out.join(links.join(r.select(member), member, "left_semi").select(group), group, "left_anti")
    return out


def flag(df: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
    """A boolean column: whether the row's key is among `keys` (JN-03, 21)."""
    return df.join(keys.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def best_status(df: DataFrame, group: str, status: str, order: list[str]) -> DataFrame:
    """The status that comes first in `order` of each group; groups without any get the last (JN-04)."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.lower(F.trim(F.col(status))))
    return df.groupBy(group).agg(F.min(F.when(rank > 0, rank)).alias("r")).select(group, F.get(F.array(*[F.lit(x) for x in order]), F.coalesce(F.col("r"), F.lit(len(order))).cast("int") - 1).alias(status))


def first_per_key(df: DataFrame, key: str, order: list[Column], values: list[str]) -> DataFrame:
    """The values of the first row of each key (JN-08, 13, WIN-04, 06, 07): partial aggregation, no sort."""
    pick = F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*values).alias("v")))
    return df.groupBy(key).agg(pick.alias("p")).select(key, "p.v.*")


def ordered_distinct(df: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """Distinct values of each key in order of first appearance (WIN-05). Values are first reduced to their
    first appearance, so what is collected is bounded by the distinct values of a key."""
    seen = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("o"))
    return seen.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", value))), lambda x: x[value]).alias(name))


def distinct_concat(df: DataFrame, key: str, value: str, name: str, sep: str = ",") -> DataFrame:
    """Distinct values of each key in one string, sorted (AGG-01)."""
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(value)), sep).alias(name))


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key (WIN-01)."""
    return _one(df, [key], order)


def carry_forward(df: DataFrame, key: str, order: list[str], value: Column, name: str) -> DataFrame:
    """The last value that isn't null, up to and with each row (WIN-02)."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def transitions(df: DataFrame, key: str, order: list[str], status: str, bad: list[str], good: list[str], first: str = "never_run") -> DataFrame:
    """Rows whose status is bad while the one before was good; repeated bad ones give no more (WIN-03)."""
    w = W.partitionBy(key).orderBy(*order)
    return df.withColumn("previous", F.lag(status, 1, first).over(w)).where(F.col(status).isin(bad) & F.col("previous").isin([*good, first]))


def gaps(df: DataFrame, key: str, order: list[str], at: str, days: float) -> DataFrame:
    """Rows that come at least `days` after all earlier ones of their key (WIN-09); exactly `days` counts."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("previous", F.max(at).over(w))
    return df.withColumn("days", (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col("previous").cast("timestamp"))) / F.lit(86_400_000_000.0)).where(F.col("days") >= days)


def health(df: DataFrame, key: str, ok: Column, reason: str, seq: str, throttled: str = "429") -> DataFrame:
    """Share of failures: up to 20 % healthy, below all degraded, all failed; why (AGG-10, 11)."""
    agg = df.groupBy(key).agg(F.count("*").alias("n"), F.count_if(~ok).alias("failed"), F.bool_and(F.when(~ok, F.coalesce(F.col(reason).contains(throttled), F.lit(False)))).alias("throttled"), F.max_by(reason, F.when(~ok, F.col(seq))).alias("last"))
    share = F.col("failed") / F.col("n")
    status = F.when(share <= 0.2, "healthy").when(share < 1, "degraded").otherwise("failed")
    why = F.when(share <= 0.2, F.lit(None).cast("string")).when(share < 1, "partial_failure_rate").when(F.col("throttled"), "rate_limit").otherwise(F.col("last"))
    return agg.select(key, "n", "failed", status.alias("health"), why.alias("reason"))


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of `old`, and of `new` the first of each key that `old` lacks (SNK-01, 02, ER-19, STM-01).
    Null keys are keys like any other."""
    first = _one(new, keys, [F.col(c) for c in order])
    on = None
    for k in keys:
        same = F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}"))
        on = same if on is None else on & same
    return old.unionByName(first.alias("n").join(old.select(*keys).alias("o"), on, "left_anti").select("n.*"), allowMissingColumns=True)


def insert_or_replace(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, `new` after `old`; a replaced row keeps nothing (SNK-03)."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return _one(both, keys, [F.desc("__new"), *[F.desc(c) for c in order]]).drop("__new")


def _one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def insert_strict(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Both together; the query fails if a key comes twice (SNK-04)."""
    both = old.unionByName(new)
    n = F.count("*").over(W.partitionBy(*keys))
    return both.withColumn("__ok", F.assert_true(n == 1, F.lit("duplicate key"))).where("__ok is null").drop("__ok")


def coalesce_update(df: DataFrame, news: DataFrame, key: str, columns: list[str], overwrite: list[str] | None = None) -> DataFrame:
    """New values where there are any, old ones else; `overwrite` columns always, for keys with news (SNK-05, 08, 09)."""
    n = news.select(F.col(key), F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in [*columns, *(overwrite or [])] if c in news.columns])
    out = df.join(n, key, "left")
    for c in columns:
        if c in news.columns and c in df.columns:
            out = out.withColumn(c, F.coalesce(f"__{c}", c))
    for c in overwrite or []:
        out = out.withColumn(c, F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)))
    return out.select(*df.columns)


def increment(df: DataFrame, events: DataFrame, key: str, ok: Column) -> DataFrame:
    """Counters `done` and `failed` raised by the events of each key (SNK-06)."""
    n = events.groupBy(key).agg(F.count_if(ok).alias("__d"), F.count_if(~ok).alias("__f"))
    return df.join(n, key, "left").withColumn("done", F.col("done") + F.coalesce("__d", F.lit(0))).withColumn("failed", F.col("failed") + F.coalesce("__f", F.lit(0))).drop("__d", "__f")


def delete_where(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """What stays, and how many rows went (SNK-16, 17); a condition that is null deletes nothing."""
    gone = F.coalesce(condition, F.lit(False))
    return df.where(~gone), df.agg(F.count_if(gone).alias("removed"))


def optional_filter(df: DataFrame, since: str | None = None, source: str | None = None, at: str = "received_at") -> DataFrame:
    """The clauses that are given, newest first (FLT-08)."""
    if since is not None:
        df = df.where(F.col(at) >= F.lit(since).cast(df.schema[at].dataType))
    if source is not None:
        df = df.where(F.col("source") == source)
    return df.orderBy(F.desc(at))


def confusion(df: DataFrame, truth: Column, score: Column, thresholds: list[float]) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 at each threshold in one pass (AGG-14, 15); nothing over nothing is 0."""
    spine = df.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double")
    n = lambda t, s: F.count_if(t & s)
    per = [F.struct(F.lit(t).alias("threshold"), n(truth, score >= t).alias("tp"), n(~truth, score >= t).alias("fp"), n(truth, score < t).alias("fn"), n(~truth, score < t).alias("tn")) for t in thresholds]
    rows = df.agg(F.array(*per).alias("a")).select(F.inline("a"))
    p, r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    return spine.join(rows, "threshold").withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def recommend(sweep: DataFrame, least_precision: float = 0.9) -> DataFrame:
    """The threshold of the best f1 among those precise enough, else of all; the lowest of equals (AGG-16)."""
    key = F.struct((F.col("precision") >= least_precision).cast("int"), "f1", -F.col("threshold"))
    return sweep.agg(F.max_by("threshold", key).alias("threshold"), F.max_by("f1", key).alias("f1"))


def clusters(df: DataFrame, value: str) -> DataFrame:
    """(key, form, n): spellings of each value under its normal form (AGG-17)."""
    from ..functions.text import cluster_key

    return df.where(F.col(value).isNotNull() & (F.trim(F.col(value)) != "")).groupBy(cluster_key(F.col(value)).alias("key"), F.col(value).alias("form")).agg(F.count("*").alias("n"))


def representatives(forms: DataFrame) -> DataFrame:
    """(key, form, forms, total, displaced): the most frequent form, an upper initial before others (AGG-18, 19, 20)."""
    lead = F.struct("n", F.col("form").rlike("^[A-Z]").cast("int"), F.col("form"))
    return forms.groupBy("key").agg(F.max_by("form", lead).alias("form"), F.count("*").alias("forms"), F.sum("n").alias("total"), (F.sum("n") - F.max("n")).alias("displaced"))
