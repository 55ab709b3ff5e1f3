"""Problem 9: filling fixed-capacity containers with items.

Method: conflict-constrained best-fit. Items go by falling size into bins that are ordered by residual;
each bin carries a bitmap of the sources and one of the duplicate clusters in it. The search starts at
the tightest residual that holds the item and goes on to the successor until a bin has neither conflict.
No bin with room is left out of the search.
If every bin with room conflicts, the tightest one is taken all the same: a conflict never costs a new
container, since room left is what counts.

Items are spread over shards by hash, each of about `SHARD_BINS` full bins, and packed shard by shard;
so a source or cluster of any size is spread too, and what a shard loses is a bin or two of its many.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .tokens import encode

#: Containers' worth of tokens in a shard, and items in a shard at most on average.
SHARD_BINS, SHARD_ITEMS = 3_000, 60_000
#: Sources whose free bins are indexed by residual; bins with a rarer source are few, and are passed one by one.
INDEXED = 16


def best_fit(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item (0 < size <= capacity), in the order given."""
    held: dict[int, dict[int, list[int]]] = {}  # by residual and sources of the bin, as a bitmap
    mask = 0  # bit r: some bin has residual r
    src: list[int] = []
    dup: list[int] = []
    out = np.empty(len(sizes), np.int64)
    names, often = np.unique(sources, return_counts=True)
    s_ids = {s: 1 << k for k, s in enumerate(names[np.argsort(-often, kind="stable")].tolist())}
    d_ids = {d: 1 << k for k, d in enumerate(d for d, n in zip(*np.unique(clusters, return_counts=True), strict=True) if n > 1)}
    indexed = min(INDEXED, len(s_ids))
    free = [0] * indexed  # bit r: some bin of residual r is without the source
    count = [{} for _ in range(indexed)]

    def note(sources_in: int, r: int, by: int) -> None:
        for k in range(indexed):
            if not sources_in >> k & 1:
                n = count[k].get(r, 0) + by
                count[k][r] = n
                if by > 0 and n == 1:
                    free[k] |= 1 << r
                elif n == 0:
                    free[k] &= ~(1 << r)

    for i, (size, s, d) in enumerate(zip(sizes.tolist(), sources.tolist(), clusters.tolist(), strict=True)):
        sb, db = s_ids[s], d_ids.get(d, 0)
        k = sb.bit_length() - 1
        rest, chosen = (free[k] if k < indexed else mask) >> size << size, None
        while rest:
            low = rest & -rest
            r = low.bit_length() - 1
            for own, bins in held[r].items():
                if not own & sb:
                    at = next((at for at in range(len(bins) - 1, -1, -1) if not dup[bins[at]] & db), None)
                    if at is not None:
                        chosen = (r, own, at)
                        break
            if chosen:
                break
            rest ^= low
        if chosen is None and (rest := mask >> size << size):  # every bin with room conflicts: the tightest
            r = (rest & -rest).bit_length() - 1
            own = next(iter(held[r]))
            chosen = (r, own, len(held[r][own]) - 1)
        if chosen is None:
            b, r = len(src), capacity
            src.append(0)
            dup.append(0)
        else:
            r, own, at = chosen
            bins = held[r][own]
            bins[at], bins[-1] = bins[-1], bins[at]
            b = bins.pop()
            note(own, r, -1)
            if not bins:
                del held[r][own]
                if not held[r]:
                    del held[r]
                    mask &= ~(1 << r)
        src[b] |= sb
        dup[b] |= db
        r -= size
        if r:
            held.setdefault(r, {}).setdefault(src[b], []).append(b)
            note(src[b], r, 1)
            mask |= 1 << r
        out[i] = b
    return out


def pack(items: DataFrame, id_col: str, size_col: str, source_col: str, cluster_col: str, capacity: int) -> DataFrame:
    """Rows (container, id, piece, start, n_tokens): where each piece of each item lies.

    Items of up to `capacity` stay whole (piece 0). A larger one is cut into full pieces, each alone in
    its container, and a rest that is packed like an item. Null or non-positive sizes are in no
    container. Repeated ids are items of their own; null sources and clusters conflict with nothing but
    each other (source) or nothing (cluster). Containers are strings, `shard/bin`. No rows give no rows.
    """
    rows = items.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{size_col}`").cast("long").alias("n"), F.xxhash64(F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(""))).alias("s"), F.coalesce(F.col(f"`{cluster_col}`").cast("long"), F.xxhash64(F.lit("alone"), F.col(f"`{id_col}`"))).alias("d")).where("n > 0")
    rest = F.col("n") % capacity
    whole = F.floor(F.col("n") / capacity).cast("int")
    sized = rows.agg(F.sum(rest).alias("t"), F.count("*").alias("c")).first()
    shards = max(1, round((sized["t"] or 0) / (SHARD_BINS * capacity)), round((sized["c"] or 0) / SHARD_ITEMS))
    kind = items.schema[id_col].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "id", "piece"], ascending=[False, True, True], kind="stable")
        bins = best_fit(pdf["n"].to_numpy(), pdf["s"].to_numpy(), pdf["d"].to_numpy(), capacity)
        shard = int(pdf["shard"].iloc[0]) if len(pdf) else 0
        return pd.DataFrame({"container": [f"{shard}/{b}" for b in bins], "id": pdf["id"], "piece": pdf["piece"], "start": pdf["piece"] * capacity, "n_tokens": pdf["n"]})

    small = rows.where(rest > 0).select("id", rest.alias("n"), "s", "d", whole.alias("piece"), F.pmod(F.xxhash64("id", "n", "d"), F.lit(shards)).cast("int").alias("shard"))
    packed = small.groupBy("shard").applyInPandas(run, f"container string, id {kind}, piece int, start long, n_tokens long")
    copy = F.row_number().over(Window.partitionBy("id").orderBy("n", "s", "d"))
    full = rows.where(whole > 0).withColumn("copy", copy).select(F.concat_ws("/", F.lit("full"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("copy").cast("string")).alias("own"), "id", F.posexplode(F.array_repeat(F.lit(capacity), whole)).alias("piece", "n_tokens"))
    full = full.select(F.concat("own", F.lit("/"), F.col("piece").cast("string")).alias("container"), "id", "piece", (F.col("piece").cast("long") * capacity).alias("start"), F.col("n_tokens").cast("long"))
    return packed.unionAll(full)


def pack_texts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", capacity: int = 2048, path: str | None = None) -> DataFrame:
    """Texts into containers of `capacity` tokens; equal texts are one duplicate cluster."""
    from ..session import cut

    keyed = documents.select(F.struct(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), F.xxhash64(f"`{text_col}`").alias("cluster")).alias("k"), F.col(f"`{text_col}`").alias("text"))
    sized = cut(encode(keyed, "k", "text", path, sizes=True).select("k.*", "n_tokens"))
    return pack(sized, "id", "n_tokens", "source", "cluster", capacity).withColumnRenamed("id", id_col)
