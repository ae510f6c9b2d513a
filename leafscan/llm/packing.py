"""Problem 7: documents into containers of fixed capacity, by the sum-of-squares rule."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafscan.llm.tokens import TOKENIZERS, sizes, vocabulary
from leafscan.session import table

#: Items of one shard, about; a shard is packed by one task, and leaves a few part-filled containers.
SHARD_ITEMS = 20_000
#: token_limits is a table of settings, not of data; more rows than this are refused.
MAX_SETTINGS = 1_000

PACKED = "limit_id int, shard int, bin int, doc_id long, part_no int, start_token long, n_tokens long"


def sum_of_squares(items: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item (0 < size <= capacity), in the order given.

    An item goes where the sum over gaps of (open containers with that gap)^2 becomes smallest,
    a new container being one choice; of equal choices the smallest gap is taken. Full containers have no gap
    and don't count.
    """
    count = np.zeros(capacity + 1, np.int64)  # open containers by gap; [0] stays 0
    stacks: dict[int, list[int]] = {}
    out = np.empty(len(items), np.int64)
    made = 0
    for k, s in enumerate(items.tolist()):
        now = count[s:capacity]  # gaps s .. capacity-1
        after = count[: capacity - s]  # the gaps they would become
        change = np.where(now > 0, 2 * (after - now) + 2, np.iinfo(np.int64).max)
        if len(change) and now[0] > 0:
            change[0] = 1 - 2 * now[0]  # filled exactly: one square less, none more
        fresh = 2 * count[capacity - s] + 1 if s < capacity else 0
        best = int(change.argmin()) if len(change) else -1
        if best >= 0 and now[best] > 0 and change[best] <= fresh:
            gap = best + s
            b = stacks[gap].pop()
            count[gap] -= 1
        else:
            gap, b = capacity, made
            made += 1
        out[k] = b
        if gap > s:
            count[gap - s] += 1
            stacks.setdefault(gap - s, []).append(b)
    return out


def pack_shard(ids: np.ndarray, n: np.ndarray, capacity: int) -> pd.DataFrame:
    """One shard's items, largest first (ties by id), packed; larger ones cut into whole containers and a rest."""
    order = np.lexsort((ids, -n))
    ids, n = ids[order], n[order]
    rows_doc, rows_part, rows_start, rows_n = [], [], [], []
    for d, size in zip(ids.tolist(), n.tolist(), strict=True):
        if size <= capacity:
            rows_doc.append(d), rows_part.append(0), rows_start.append(0), rows_n.append(size)
        else:
            for p, start in enumerate(range(0, size, capacity)):
                rows_doc.append(d), rows_part.append(p), rows_start.append(start)
                rows_n.append(min(capacity, size - start))
    sizes_ = np.array(rows_n, np.int64)
    bins = np.zeros(len(sizes_), np.int64)
    order = np.argsort(-sizes_, kind="stable")
    some = order[sizes_[order] > 0]
    bins[some] = sum_of_squares(sizes_[some], capacity)  # items of size 0 take no room: the shard's first container
    return pd.DataFrame(
        {"bin": bins, "doc_id": rows_doc, "part_no": rows_part, "start_token": rows_start, "n_tokens": rows_n}
    )


def pack(
    sized: DataFrame, settings: list[tuple[int, int]], id_col: str = "doc_id", shard_items: int = SHARD_ITEMS, total: int | None = None
) -> DataFrame:
    """Every item of sized (id, n_tokens) in a container, for each setting (limit_id, capacity).

    Items are spread by a hash of their id over shards of about shard_items; each shard is packed alone, so
    a container is known by (limit_id, container_id) and only the last containers of a shard stay part-filled.
    An item larger than the capacity is cut: whole containers, then a rest that is packed as an item.
    A repeated id is one item (its largest size); a null id is left out, as nothing could be assigned; a null or
    negative size counts as 0; items of size 0 sit in the first container of their shard. An empty table gives an empty result.
    """
    if len(settings) > MAX_SETTINGS:
        raise ValueError(f"{len(settings)} settings; at most {MAX_SETTINGS} are meant")
    if any(c is None or c < 1 for _, c in settings):
        raise ValueError("a capacity must be at least 1")
    items = sized.select(F.col(id_col).cast("long").alias("doc_id"), F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).alias("n"))
    items = items.where("doc_id is not null")
    n_shards = max(1, -(-(items.count() if total is None else total) // shard_items))
    items = items.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(n_shards)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        own = pdf.groupby("doc_id")["n"].max()
        ids, n = own.index.to_numpy(np.int64), own.to_numpy(np.int64)
        out = []
        for limit_id, capacity in settings:
            out.append(pack_shard(ids, n, capacity).assign(limit_id=limit_id, shard=shard))
        return pd.concat(out)[["limit_id", "shard", "bin", "doc_id", "part_no", "start_token", "n_tokens"]]

    # An explicit number of partitions: shards are small in bytes, and would else be merged into one task.
    packed = items.repartition(n_shards, "shard").groupBy("shard").applyInPandas(run, PACKED)
    return packed.select(
        "limit_id",
        (F.col("shard").cast("long") * F.lit(1 << 32) + F.col("bin")).alias("container_id"),
        F.col("doc_id").alias(id_col),
        "part_no",
        "start_token",
        "n_tokens",
    )


def settings_of(spark: SparkSession, sf_dir: str) -> list:
    """The rows of token_limits, a fixed table of settings."""
    rows = table(spark, sf_dir, "token_limits").distinct().orderBy("limit_id").limit(MAX_SETTINGS + 1).collect()
    if len(rows) > MAX_SETTINGS:
        raise ValueError("token_limits is meant to be a small table of settings")
    return rows


def p7_packing(spark: SparkSession, sf_dir: str, folder: str = TOKENIZERS) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    total = docs.count()
    by_tokenizer: dict[str, list[tuple[int, int]]] = {}
    for r in settings_of(spark, sf_dir):
        by_tokenizer.setdefault(r.tokenizer, []).append((r.limit_id, r.capacity))
    parts = [
        pack(sizes(docs, path=vocabulary(name, folder)), limits, total=total) for name, limits in sorted(by_tokenizer.items())
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per setting: containers, the fewest that could do, tokens, and the share of room used."""
    limits = F.broadcast(table(spark, sf_dir, "token_limits", "limit_id", "capacity").distinct())
    used = p7_packing(spark, sf_dir).groupBy("limit_id", "container_id").agg(F.sum("n_tokens").alias("used"))
    return (
        used.join(limits, "limit_id")
        .groupBy("limit_id", "capacity")
        .agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
        .withColumn("fewest", F.ceil(F.col("tokens") / F.col("capacity")))
        .withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p7_packing": p7_packing, "p7_fill": p7_fill}
ORACLE: dict[str, str] = {}
