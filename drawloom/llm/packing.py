"""Filling containers of fixed capacity with whole items, with as little unused space as possible.

Items above the capacity are cut into full pieces, each of which fills a container, and a rest, which is an item again. Items are
spread at random (by a hash of their id and place) over groups of about ``group_items``; within each group first-fit decreasing runs
on a tournament tree of the containers' free space, so that the first container with room is found in logarithmic time; items of
one size are placed run by run, which gives what first-fit decreasing gives. Groups are alike in their sizes, so what is lost
against one run over all items is at most part of one container per group. A group's memory doesn't grow with the data.

Defined results: sizes that are null count as 0; items of size 0 go to the group's first container. Repeated rows are items of
their own. Ties in size are in the order of the id. An empty table gives no rows. Containers are numbered by group and place,
the same in every run.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_ITEMS = 50_000


class Tournament:
    """Free space of containers, with the first one that has room."""

    def __init__(self, n: int, capacity: int):
        self.size = 1 << max(0, (n - 1).bit_length())
        self.tree = [capacity] * (2 * self.size)

    def first(self, need: int) -> int:
        t, i = self.tree, 1
        while i < self.size:
            i *= 2
            if t[i] < need:
                i += 1
        return i - self.size

    def take(self, i: int, much: int) -> int:
        t = self.tree
        i += self.size
        t[i] -= much
        left = t[i]
        while i > 1:
            i //= 2
            best = t[2 * i] if t[2 * i] >= t[2 * i + 1] else t[2 * i + 1]
            if t[i] == best:
                break
            t[i] = best
        return left


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item; sizes must be in descending order and at most the capacity."""
    out = np.zeros(len(sizes), np.int64)
    n = int(np.count_nonzero(sizes))
    if not n:
        return out
    tree, i = Tournament(n, capacity), 0
    ends = np.append(np.flatnonzero(np.diff(sizes[:n])) + 1, n)
    for end in ends:
        size = int(sizes[i])
        while i < end:
            c = tree.first(size)
            many = min(end - i, tree.tree[c + tree.size] // size)
            tree.take(c, many * size)
            out[i : i + many] = c
            i += many
    return out


def pack(items: DataFrame, ident: str, size: str, capacity: int, group_items: int = GROUP_ITEMS) -> DataFrame:
    """ident, piece_no, n_units, container: every item, cut only if it exceeds the capacity."""
    src = items.select(F.col(ident).alias("_id"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("_n"))
    groups = max(1, -(-src.count() // group_items))
    kind = src.schema["_id"].dataType.simpleString()
    full = F.when(F.col("_n") > capacity, F.floor(F.col("_n") / capacity)).otherwise(0).cast("bigint")
    x = src.withColumn("_full", full).withColumn("_rest", F.col("_n") - F.col("_full") * capacity)
    # equal rows are numbered, so that those of an id that is there very many times don't fill one group, and every run gives the same groups
    x = x.groupBy(*x.columns).agg(F.count(F.lit(1)).alias("_c")).withColumn("_c", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_c"))))
    x = x.withColumn("_g", F.pmod(F.xxhash64("_id", "_n", "_c"), F.lit(groups))).drop("_c")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        g = int(pdf["_g"].iloc[0])
        ids, cut, rest = pdf["_id"].to_numpy(), pdf["_full"].to_numpy(), pdf["_rest"].to_numpy()
        small = np.flatnonzero((rest > 0) | (cut == 0))
        order = small[np.lexsort((ids[small], -rest[small]))]
        bins = first_fit_decreasing(rest[order], capacity)
        used = int(bins.max()) + 1 if len(bins) else 0
        total = int(cut.sum())
        own = np.repeat(np.arange(len(cut)), cut)
        first = np.repeat(np.cumsum(cut) - cut, cut)
        at = np.concatenate([order, own])
        piece = np.concatenate([cut[order], np.arange(total) - first])
        units = np.concatenate([rest[order], np.full(total, capacity)])
        box = np.concatenate([bins, used + np.arange(total)]) + (g << 32)
        return pd.DataFrame({"_id": ids[at], "piece_no": piece.astype("int32"), "n_units": units.astype("int32"), "container": box})

    return x.groupBy("_g").applyInPandas(fill, f"_id {kind}, piece_no int, n_units int, container bigint").withColumnRenamed("_id", ident)
