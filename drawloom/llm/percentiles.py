"""Percentiles per group over very large numeric columns by quantile digests on a bounded, ordered universe.

Values are quantized to ``2^LOG_U`` ordered leaves, logarithmically on both signs (a leaf is 0.2 % wide, so the value given is
within 0.1 % of the one at its rank), with leaves of their own for zero and both infinities. A digest is the compressed set of
dyadic-tree nodes (group..., node, n): node = level * 2^LOG_U + position. Bottom up, two children and their parent become the
parent where together they hold no more than floor(N / k). Digests merge by adding the counts of equal nodes, over partitions,
days or groups, in any order, and are compressed again by the N of all, to about 3 k nodes whatever was merged; the rank of what a query returns is off by at most LOG_U * floor(N / k), that is 0.26 % of N for
k = 8192, however often digests were merged and compressed. Groups of fewer than k values are exact up to quantization.

Counting leaves and adding nodes are Spark aggregates with map-side combining, keyed by group and node, so that a group of any
size is spread. Only the compression, which goes level by level, and the reading of ranks in its result are Python: one sorted
pass over a group's distinct nodes, whole Arrow batches of many groups at once, in NumPy.

Defined results: null and NaN say nothing; all other values count as stored, negative and infinite ones too. A group without
values has no row. The q-percentile is the value of rank ceil(q * N), at least 1. Empty tables give no rows; repeats count each time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_U, K = 21, 8192
_U = 1 << LOG_U
_PER = 512.0
#: ln of the smallest double, in leaves.
_LOW = -382_000
_SPAN = 382_000 + 364_000
_MID = 1 << (LOG_U - 1)


def leaf(v: Column) -> Column:
    """The place of a double in the ordered universe; null for null and NaN. Kept in step with ``value_of``."""
    v = v.cast("double")
    inf = F.lit(float("inf"))
    step = F.floor(F.ln(F.abs(v)) * _PER) - _LOW + 1
    return (
        F.when(v.isNull() | F.isnan(v), None)
        .when(v == inf, _U - 1)
        .when(v == -inf, 0)
        .when(v == 0, _MID)
        .when(v > 0, F.lit(_MID) + step)
        .otherwise(F.lit(_MID) - step)
        .cast("bigint")
    )


def value_of(leaf_no: Column) -> Column:
    """The middle of a leaf."""
    step = F.abs(leaf_no - _MID)
    size = F.exp((step - 1 + _LOW + F.lit(0.5)) / _PER)
    return (
        F.when(leaf_no == _MID, 0.0)
        .when(leaf_no >= _U - 1, float("inf"))
        .when(leaf_no <= 0, float("-inf"))
        .when(leaf_no > _MID, size)
        .otherwise(-size)
    )


def edges(leaf_no: Column) -> tuple[Column, Column]:
    """What a leaf's values lie between, a rounding's breadth wider."""
    step = F.abs(leaf_no - _MID)
    a, b = F.exp((step - 1 + _LOW) / _PER) * (1 - 1e-9), F.exp((step + _LOW) / _PER) * (1 + 1e-9)
    out = lambda pos, neg: F.when((leaf_no == _MID) | (leaf_no >= _U - 1) | (leaf_no <= 0), value_of(leaf_no)).when(leaf_no > _MID, pos).otherwise(neg)
    return out(a, -b), out(b, -a)


def digest(df: DataFrame, value: str, dims: list[str], k: int = K) -> DataFrame:
    """Compressed digests per group: dims..., node, n. Leaves are counted with map-side combining before groups come together."""
    leaves = (
        df.select(*dims, leaf(F.col(value)).alias("node"))
        .where("node IS NOT NULL")
        .groupBy(*dims, "node")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return compress(leaves, dims, k)


def _added(digests: DataFrame, dims: list[str]) -> DataFrame:
    """Node addition."""
    return digests.groupBy(*dims, "node").agg(F.sum("n").alias("n"))


def merge(digests: DataFrame, dims: list[str], k: int = K) -> DataFrame:
    """Digests of the coarser groups ``dims``: node addition, then compression by the merged N."""
    return compress(_added(digests, dims), dims, k)


def compress(digests: DataFrame, dims: list[str], k: int = K) -> DataFrame:
    """Each group's digest compressed to about 3 k nodes at most. A task sees a group's nodes sorted, at most as many as the universe has."""
    schema = digests.select(*dims, "node", "n").schema

    def fn(t: pa.Table, start: np.ndarray) -> pa.Table:
        g, node, n = _compressed(t, start, k)
        return pa.Table.from_arrays([*_heads(t, start[g]), pa.array(node, pa.int64()), pa.array(n, pa.int64())], names=schema.names)

    return _by_group(digests, dims, fn, schema)


def _by_group(digests: DataFrame, dims: list[str], fn: Callable[[pa.Table, np.ndarray], pa.Table], schema) -> DataFrame:  # noqa: ANN001
    """``fn`` over tables of whole groups, sorted by group and node, with the places where groups begin."""
    cols = [*dims, "node", "n"]
    src = digests.select(*cols).repartition(*[F.col(d) for d in dims]).sortWithinPartitions(*cols[:-1])
    nd = len(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            rest.append(b)
            # a group that runs over many batches is put together once, when the next one begins
            if len(rest) > 1 and _starts(pa.Table.from_batches([rest[0].slice(rest[0].num_rows - 1), b.slice(b.num_rows - 1)]), nd).size < 2:
                continue
            t = pa.Table.from_batches(rest).combine_chunks()
            start = _starts(t, nd)
            if len(start) > 1:
                yield from fn(t.slice(0, start[-1]).combine_chunks(), start[:-1]).to_batches(max_chunksize=50_000)
            rest = t.slice(start[-1]).combine_chunks().to_batches()
        if rest:
            t = pa.Table.from_batches(rest).combine_chunks()
            yield from fn(t, _starts(t, nd)).to_batches(max_chunksize=50_000)

    return src.mapInArrow(run, schema)


def _starts(t: pa.Table, nd: int) -> np.ndarray:
    """Where groups begin in a sorted table; nulls are equal."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for c in t.columns[:nd]:
        a = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        codes = a.dictionary_encode(null_encoding="encode")
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        ix = codes.indices.to_numpy(zero_copy_only=False)
        new[1:] |= ix[1:] != ix[:-1]
    return np.flatnonzero(new)


def _heads(t: pa.Table, at: np.ndarray) -> list[pa.ChunkedArray]:
    """The group columns of the rows ``at``."""
    return t.select(range(t.num_columns - 2)).take(pa.array(at)).columns


def _compressed(t: pa.Table, start: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group number, node, n) of compressed groups."""
    node, n = (t.column(t.num_columns - 2 + i).to_numpy().astype(np.int64) for i in (0, 1))
    group = np.repeat(np.arange(len(start)), np.diff(np.append(start, t.num_rows)))
    return compress_nodes(group, node, n, np.add.reduceat(n, start) // k)


def compress_nodes(group: np.ndarray, node: np.ndarray, n: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All groups bottom up, a level at a time: siblings and parent go to the parent where they hold at most the group's limit."""
    done = [[], [], []]
    busy = limit[group] > 0
    for a, x in zip(done, (group[~busy], node[~busy], n[~busy])):
        a.append(x)
    group, node, n = group[busy], node[busy], n[busy]
    level, pos = node >> LOG_U, node & (_U - 1)
    cur = [x[level == 0] for x in (group, pos, n)]
    for lv in range(LOG_U):
        up = [x[level == lv + 1] for x in (group, pos, n)]
        if not len(cur[0]):
            cur = up
            continue
        own = np.concatenate([np.zeros(len(cur[0]), bool), np.ones(len(up[0]), bool)])
        g = np.concatenate([cur[0], up[0]])
        p = np.concatenate([cur[1] >> 1, up[1]])
        c = np.concatenate([cur[2], up[2]])
        low = np.concatenate([cur[1], up[1]])
        key = (g << (LOG_U + 1)) | p
        order = np.argsort(key, kind="stable")
        key, g, p, c, low, own = key[order], g[order], p[order], c[order], low[order], own[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        total = np.add.reduceat(c, first)
        fits = total <= limit[g[first]]
        each = np.repeat(fits, np.diff(np.append(first, len(key))))
        stay = ~each & ~own
        done[0].append(g[stay]), done[1].append((lv << LOG_U) | low[stay]), done[2].append(c[stay])
        keep = ~each & own
        cur = [np.concatenate([g[first][fits], g[keep]]), np.concatenate([p[first][fits], p[keep]]), np.concatenate([total[fits], c[keep]])]
    done[0].append(cur[0]), done[1].append((LOG_U << LOG_U) | cur[1]), done[2].append(cur[2])
    return tuple(np.concatenate(x) for x in done)


def leaf_name(q: float) -> str:
    """The column of a probability: leaf_50, leaf_99, leaf_99_9."""
    whole, _, part = f"{q * 100:.10g}".partition(".")
    return f"leaf_{int(whole):02d}" + (f"_{part}" if part else "")


def quantiles(digests: DataFrame, dims: list[str], probs: list[float], k: int = K) -> DataFrame:
    """dims..., n, rank_error (in ranks, guaranteed), nodes (of the compressed digest), inner (those above the leaves), then
    ``leaf_name(q)`` per probability: the leaf at the end of the node that holds the rank.

    Digests of finer groups than ``dims`` are merged and compressed first, in the same pass.
    """
    names = [leaf_name(q) for q in probs]
    schema = digests.select(*dims).schema
    for c in ("n", "rank_error", "nodes", "inner", *names):
        schema = schema.add(c, T.LongType())

    def fn(t: pa.Table, start: np.ndarray) -> pa.Table:
        g, node, n = _compressed(t, start, k)
        total, nodes, inner, leaves = read_ranks(g, node, n, len(start), probs)
        cols = [total, total // k * LOG_U, nodes, inner, *leaves]
        return pa.Table.from_arrays([*_heads(t, start), *(pa.array(c, pa.int64()) for c in cols)], names=schema.names)

    return _by_group(_added(digests, dims), dims, fn, schema)


def read_ranks(g: np.ndarray, node: np.ndarray, n: np.ndarray, groups: int, probs: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Per group: N, nodes, nodes above the leaves, and for each probability the end of the node that holds the rank, nodes in the order of their ends."""
    lv = node >> LOG_U
    hi = (((node & (_U - 1)) + 1) << lv) - 1
    order = np.lexsort((lv, hi, g))
    g, hi, cum = g[order], hi[order], np.cumsum(n[order])
    nodes = np.bincount(g, minlength=groups)
    last = np.cumsum(nodes) - 1
    before = np.append(0, cum[last][:-1])
    total = cum[last] - before
    rank = lambda q: np.maximum(np.ceil(np.round(total * q, 9)), 1).astype(np.int64)
    return total, nodes, np.bincount(g, weights=lv[order] > 0, minlength=groups).astype(np.int64), [hi[np.searchsorted(cum, before + rank(q))] for q in probs]
