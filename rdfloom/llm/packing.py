"""Documents in containers of fixed capacity by the sum-of-squares rule.

Each item goes where the sum of squares of the numbers of partly filled containers by fill level
grows least: into a container of some level, or into a new one. An array holds the number of open
containers of every level; the step for one item is a vector expression over it.

Items larger than the capacity are the only ones split: into full pieces, which are containers of
their own, and a remainder that is packed like any item. Documents without tokens need no room and
share the container that is filled first. Shards of at most ``SHARD_ITEMS`` documents, by a hash of
the id, are packed each in a task of its own; what a shard leaves partly filled is bounded by the
capacity, not by the number of documents. Items come in hash order; the containers that are still
partly filled at the end, a few hundred at most, are opened and their items packed again, largest
first into the fullest container that has room, and kept so if that takes fewer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARD_ITEMS = 200_000
#: Kinds of containers are a small table; more than this is an error, not cut off.
MOST_KINDS = 1_000
#: The public word-punctuation pattern, Unicode classes included.
TOKEN = "(?U)\\w+|[^\\w\\s]+"


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item (0, 1, ...), sizes in the order given, all between 0 and the capacity."""
    count = np.zeros(capacity + 1, np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), np.int64)
    used = 0
    spare: int | None = None
    for i, size in enumerate(sizes.tolist()):
        if size == 0:
            if spare is None:
                spare = used
                used += 1
                open_[0].append(spare)
            out[i] = spare
            continue
        # change of the sum of squares for each level h: a container leaves level h and joins level h + size
        last = capacity - size
        change = 2 * (count[size : capacity + 1] - count[: last + 1]) + 2
        change[0] = 2 * count[size] + 1  # a new container
        if last > 0:
            change[last] = 1 - 2 * count[last]  # closes a container: full ones do not count
        else:
            change[0] = 0
        change[1:][count[1 : last + 1] == 0] = np.iinfo(np.int64).max
        level = int(change.argmin())
        if level == 0:
            if open_[0]:
                container = open_[0].pop()
            else:
                container = used
                used += 1
        else:
            container = open_[level].pop()
            count[level] -= 1
        if level + size < capacity:
            open_[level + size].append(container)
            count[level + size] += 1
        out[i] = container
    return out


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Largest first, each into the fullest container with room."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = np.zeros(capacity + 1, np.int64)
    out = np.empty(len(sizes), np.int64)
    used = 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        fits = np.flatnonzero(free[size:])
        if len(fits):
            left = size + int(fits[0])
            container = room[left].pop()
            free[left] -= 1
        else:
            left, container = capacity, used
            used += 1
        out[i] = container
        room[left - size].append(container)
        free[left - size] += 1
    return out


def pack_sizes(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Sum of squares in the order given, then the partly filled containers packed again if that saves any."""
    container = sum_of_squares(sizes, capacity)
    if not len(sizes):
        return container
    filled = np.bincount(container, sizes)
    partly = filled < capacity
    mine = np.flatnonzero(partly[container])
    again = best_fit(sizes[mine], capacity)
    if len(mine) and again.max() + 1 < partly.sum():
        names = np.flatnonzero(partly)
        container[mine] = names[again]
        container = np.unique(container, return_inverse=True)[1]
    return container


def pack(documents: DataFrame, containers: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(container_kind, container_id, doc_id, piece, tokens): every document, or piece of one, in one container of each kind.

    documents: (doc_id, text, n_tokens), sizes counted from the text where ``n_tokens`` is NULL or
    negative; containers: (container_kind, capacity_tokens), a few rows. Rows that come twice count once;
    rows without an id, kinds without a positive capacity are left out; ``piece`` counts from 1.
    """
    sized = (
        documents.where(F.col("doc_id").isNotNull())
        .select("doc_id", F.when(F.col("n_tokens") >= 0, F.col("n_tokens")).otherwise(token_count(F.col("text"))).cast("bigint").alias("tokens"))
        .dropDuplicates(["doc_id"])
    )
    shards = max(1, -(-documents.count() // shard_items))
    kinds = containers.where((F.col("capacity_tokens") > 0) & F.col("container_kind").isNotNull()).dropDuplicates(["container_kind"])
    rows = kinds.select("container_kind", "capacity_tokens").orderBy("container_kind").take(MOST_KINDS + 1)
    if len(rows) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    each = F.array(*[F.struct(F.lit(r[0]).alias("container_kind"), F.lit(int(r[1])).alias("capacity")) for r in rows])
    schema = "container_kind string, container_id string, doc_id bigint, piece int, tokens bigint"
    if not rows:
        return documents.sparkSession.createDataFrame([], schema)
    work = sized.withColumn("hash", F.xxhash64("doc_id", F.lit(17))).withColumn("shard", F.pmod("hash", F.lit(shards)).cast("int")).select(
        "doc_id", "tokens", "hash", "shard", F.inline(each)
    )

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        kind, shard = key
        capacity = int(group["capacity"].iloc[0])
        ids, tokens = group["doc_id"].to_numpy(), group["tokens"].to_numpy()
        whole = tokens // capacity
        rest = tokens - whole * capacity
        whole = np.where((rest == 0) & (whole == 1), 0, whole)
        rest = np.where((rest == 0) & (tokens == capacity), capacity, rest)
        # full pieces are containers of their own
        full = np.repeat(np.arange(len(ids)), whole)
        part = np.arange(len(full)) - np.repeat(np.cumsum(whole) - whole, whole) + 1
        left = np.flatnonzero((rest > 0) | (tokens == 0))
        order = left[np.lexsort((ids[left], group["hash"].to_numpy()[left]))]
        container = pack_sizes(rest[order], capacity)
        base = len(full)
        return pd.DataFrame({
            "container_kind": kind,
            "container_id": [f"{kind}-{shard}-{c}" for c in np.concatenate([np.arange(base), container + base])],
            "doc_id": np.concatenate([ids[full], ids[order]]),
            "piece": np.concatenate([part, whole[order] + 1]).astype("int32"),
            "tokens": np.concatenate([np.full(base, capacity), rest[order]]).astype("int64"),
        })

    return work.groupBy("container_kind", "shard").applyInPandas(run, schema)
