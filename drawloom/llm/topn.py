"""The N best items of every group, by statistics-guided skipping over files clustered by group.

Items are range-partitioned and sorted by (group, score descending, id) and written with small row groups to the shared folder.
A file then holds whole runs of groups; a group of millions of items runs over many row groups, of which the first holds its best
items, and over several files, which different tasks read: a hot group never comes into one task. A reading task takes the row
groups of its file in descending maximum score, as the footers tell, and skips a row group whose maximum is strictly below the
current N-th score of every group that it contains. (Which groups a row group contains is known from the footer where minimum
and maximum agree, that is for row groups inside a large group; row groups of many small groups are read, as each group in them
still wants items.)

Only a file's first and last group can go on in other files. All others are settled where they are read, without any shuffle; the
winners of the first and last groups, at most 2 N a file, are found by a second look at just the row groups that hold them, and
settled by a last ranking. With ``same`` the items are partitioned by (group, same), so that one shuffle serves for finding the
equal ones and for clustering.

Ties: equal scores rank by the lower id. Null and NaN scores and null group columns are no candidates. Items with the same
``same`` columns are one, known by the lowest id. Groups with fewer than N items give what they have; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawloom.storage import scratch_path

ROW_GROUP_BYTES = 16 * 1024
#: Schemes of the shared folder that can be read, with their names in pyarrow.
SCHEMES = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "gcs": "gs"}


@dataclass(frozen=True)
class RowGroup:
    """What a footer says of a row group: the only group in it, if that is known, and its highest score."""

    no: int
    group: tuple | None
    top: float


def unique_items(df: DataFrame, group: list[str], score: str, ident: str, same: list[str]) -> DataFrame:
    """Candidates, each set of equal ``same`` columns once under its lowest id: group..., score, id. The shuffle is on all of ``same``, so no hot group stays together."""
    return _unique(candidates(df, group, score, ident), group, score, ident, same)


def candidates(df: DataFrame, group: list[str], score: str, ident: str) -> DataFrame:
    """Rows with a score, an id and a group."""
    ok = F.col(score).isNotNull() & ~F.isnan(F.col(score)) & F.col(ident).isNotNull()
    for g in group:
        ok &= F.col(g).isNotNull()
    return df.where(ok)


def _unique(df: DataFrame, group: list[str], score: str, ident: str, same: list[str]) -> DataFrame:
    keys = list(dict.fromkeys([*group, *same]))
    return df.groupBy(*keys).agg(F.min(F.struct(F.col(ident), F.col(score))).alias("_i")).select(*group, F.col(f"_i.{score}").alias(score), F.col(f"_i.{ident}").alias(ident))


def cluster(items: DataFrame, group: list[str], score: str, ident: str, row_group_bytes: int = ROW_GROUP_BYTES, same: list[str] | None = None) -> str:
    """Write the items clustered by group, best first; gives the path. With ``same`` equal items are made one after the same shuffle."""
    path = scratch_path(items.sparkSession, "topn")
    scheme = path.partition(":")[0] if ":/" in path else "file"
    if scheme not in SCHEMES:
        raise ValueError(f"the shared folder must be one of {', '.join(SCHEMES)}, not {scheme}")
    order = [*(F.col(g) for g in group), F.col(score).desc(), F.col(ident)]
    if same is None:
        parted = items.select(*group, score, ident).repartitionByRange(*order)
    else:
        # the order within a group only has to spread a hot one: a hash of ``same`` keeps what is sampled for the ranges small
        keys = list(dict.fromkeys([*group, *same]))
        x = items.select(*dict.fromkeys([*keys, score, ident])).withColumn("_h", F.xxhash64(*same))
        parted = _unique(x.repartitionByRange(*group, "_h"), group, score, ident, ["_h", *same])
    (
        parted.sortWithinPartitions(*order)
        .write.option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", max(4096, row_group_bytes // 8))
        .parquet(path)
    )
    return path


def plan(meta: pq.FileMetaData, group: list[str], score: str) -> list[RowGroup]:
    """The row groups of a file in descending maximum score."""
    at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
    out = []
    for r in range(meta.num_row_groups):
        s = {c: meta.row_group(r).column(at[c]).statistics for c in [*group, score]}
        known = all(s[g] is not None and s[g].has_min_max and s[g].min == s[g].max for g in group)
        top = s[score].max if s[score] is not None and s[score].has_min_max else float("inf")
        out.append(RowGroup(r, tuple(s[g].min for g in group) if known else None, top))
    return sorted(out, key=lambda x: (-x.top, x.no))


def group_starts(t: pa.Table, group: list[str]) -> np.ndarray:
    """Whether a row of a sorted table begins another group."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for g in group:
        ix = t.column(g).combine_chunks().dictionary_encode()
        ix = ix.indices.to_numpy() if isinstance(ix, pa.DictionaryArray) else ix.combine_chunks().indices.to_numpy()
        new[1:] |= ix[1:] != ix[:-1]
    return new


def best_of(t: pa.Table, group: list[str], n: int) -> pa.Table:
    """The first n rows of each run of equal groups of a sorted table."""
    t = t.combine_chunks()
    first = np.flatnonzero(group_starts(t, group))
    rank = np.arange(t.num_rows) - np.repeat(first, np.diff(np.append(first, t.num_rows)))
    return t.filter(pa.array(rank < n))


def read_best(f: pq.ParquetFile, group: list[str], score: str, n: int, edge: bool | None = None) -> Iterator[tuple[int, pa.Table]]:
    """(row group, its winners) for each row group that has to be read.

    ``edge``: only for the file's first and last group (True), for all others (False), or for all (None).
    """
    ends = edge_groups(f, group) if edge is not None and f.metadata.num_rows else ()
    held: dict[tuple, np.ndarray] = {}
    for rg in plan(f.metadata, group, score):
        if edge is False and rg.group is not None and rg.group in ends:
            continue
        if edge and not _may_hold(f.metadata, rg.no, group, ends):
            continue
        if rg.group is not None:
            now = held.get(rg.group)
            if now is not None and len(now) >= n and rg.top < now[n - 1]:
                continue
        t = best_of(f.read_row_group(rg.no), group, n)
        if rg.group is not None:
            both = np.concatenate([held.get(rg.group, np.zeros(0)), t.column(score).to_numpy()])
            held[rg.group] = -np.sort(-both)[:n]
        if edge is not None:
            at_end = _is_one_of(t, group, ends)
            t = t.filter(at_end if edge else pc.invert(at_end))
        yield rg.no, t


def edge_groups(f: pq.ParquetFile, group: list[str]) -> tuple[tuple, tuple]:
    """The first and the last group of a sorted file."""
    first, last = (f.read_row_group(r, columns=group).select(group) for r in (0, f.metadata.num_row_groups - 1))
    return tuple(c[0].as_py() for c in first.columns), tuple(c[-1].as_py() for c in last.columns)


def _may_hold(meta: pq.FileMetaData, rg: int, group: list[str], ends: tuple) -> bool:
    """Whether a row group may hold one of the groups, as its statistics tell."""
    at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
    stats = [meta.row_group(rg).column(at[g]).statistics for g in group]
    return any(all(s is None or not s.has_min_max or s.min <= v <= s.max for s, v in zip(stats, e)) for e in ends)


def _is_one_of(t: pa.Table, group: list[str], ends: tuple) -> pa.Array:
    out = pa.array(np.zeros(t.num_rows, bool))
    for e in set(ends):
        one = pa.array(np.ones(t.num_rows, bool))
        for g, v in zip(group, e):
            one = pc.and_(one, pc.equal(t.column(g), pa.scalar(v, t.schema.field(g).type)).combine_chunks())
        out = pc.or_(out, one)
    return out


def winners(f: pq.ParquetFile, group: list[str], score: str, n: int, edge: bool) -> pa.Table:
    """The best n of each group in a file, sorted, with rank_no."""
    read = sorted(read_best(f, group, score, n, edge), key=lambda x: x[0])
    tables = [t for _, t in read] or [f.schema_arrow.empty_table()]
    t = best_of(pa.concat_tables(tables), group, n)
    new = group_starts(t, group)
    rank = np.arange(t.num_rows) - np.maximum.accumulate(np.where(new, np.arange(t.num_rows), 0)) + 1
    return t.append_column("rank_no", pa.array(rank, pa.int32()))


def _over_files(spark: SparkSession, path: str, fn: Callable[[pq.ParquetFile], pa.Table], schema) -> DataFrame:  # noqa: ANN001
    """``fn`` of every file in a folder, each file in one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for p in b.column(0).to_pylist():
                scheme, _, rest = p.partition(":")
                rest = "//" + rest if scheme == "file" and not rest.startswith("//") else rest
                where, inner = fs.FileSystem.from_uri(f"{SCHEMES[scheme]}:{rest}")
                with where.open_input_file(inner) as src:
                    yield from fn(pq.ParquetFile(src)).to_batches()

    return files.repartition(parts, F.xxhash64("path")).mapInArrow(read, schema)


def top_n(items: DataFrame, group: list[str], score: str, ident: str, n: int, row_group_bytes: int = ROW_GROUP_BYTES, same: list[str] | None = None) -> DataFrame:
    """group..., rank_no, id of the n best items of each group. With ``same`` items with equal columns are one, see ``unique_items``."""
    spark = items.sparkSession
    if same is not None:
        items = candidates(items, group, score, ident)
    path = cluster(items, group, score, ident, row_group_bytes, same)
    schema = items.select(*group, score, ident).schema.add("rank_no", T.IntegerType())
    part = lambda edge: _over_files(spark, path, lambda f: winners(f, group, score, n, edge).select(schema.names), schema)
    w = Window.partitionBy(*group).orderBy(F.col(score).desc(), F.col(ident))
    edge = part(True).withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= n)
    cols = [*group, "rank_no", ident]
    return part(False).select(*cols).unionByName(edge.select(*cols))


def skipping(items: DataFrame, group: list[str], score: str, ident: str, n: int, row_group_bytes: int = ROW_GROUP_BYTES, same: list[str] | None = None) -> DataFrame:
    """One row per file: its row groups, rows, and how many row groups and rows had to be read for the winners."""
    if same is not None:
        items = candidates(items, group, score, ident)
    path = cluster(items, group, score, ident, row_group_bytes, same)

    def count(f: pq.ParquetFile) -> pa.Table:
        m = f.metadata
        used = {no for edge in (True, False) for no, _ in read_best(f, group, score, n, edge)}
        vals = (m.num_row_groups, m.num_rows, len(used), sum(m.row_group(r).num_rows for r in used))
        return pa.table({c: pa.array([v], pa.int64()) for c, v in zip(("row_groups", "n_rows", "groups_read", "rows_read"), vals)})

    return _over_files(items.sparkSession, path, count, "row_groups bigint, n_rows bigint, groups_read bigint, rows_read bigint")
