"""References to records that do not exist at the time of the reference.

A record of a key exists from its start, inclusive, until its end, exclusive, or without end if that is null; a key may have
several records. References are first aggregated per key and period, with map-side combining, to cells of (count, first time,
last time). Most cells are decided by the key's life spans alone; only the rows of cells that a life span cuts in two are judged
by themselves.

The split for skew: the keys with the most references, as the cells tell (from ``HEAVY_TIMES`` the mean of all keys, at most
``HEAVY_KEYS`` of them, so that any key with more than 1 / HEAVY_KEYS of all rows is among them), are joined apart from all others,
both where cells meet life spans and where rows meet cells: by broadcast if what they meet is small, as a count checks, else
dealt over ``SALTS`` parts of each key. All other keys take a shuffled join, after an anti-join with the heavy ones, and the two
parts are united. So no key's rows ever come into one task; only the distinct life spans of a key do.

Defined results: a null or blank key is no reference. A null time of a reference is a case only if its key has no record at all;
its period is then null. A null start of a record means that it was there from the beginning. Rows that repeat an id count once.
Empty tables give empty results, or all references where there are no records. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawloom.storage import written

#: At most so many keys are joined apart. They go to the driver and into broadcasts.
HEAVY_KEYS = 1024
#: A key is joined apart from so many times the mean number of references of a key.
HEAVY_TIMES = 4
#: At most so many rows of the other side are broadcast for the heavy keys; beyond that they are salted.
HEAVY_ROWS = 20_000
SALTS = 32


def life_spans(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by..., key, start, end`` to one row per key: its distinct spans."""
    return records.where("key IS NOT NULL").groupBy(*by, "key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def _covers(t: Column) -> Column:
    """Some span holds the time."""
    return F.exists("spans", lambda s: (s["start"].isNull() | (s["start"] <= t)) & (s["end"].isNull() | (s["end"] > t)))


def _why(t: Column) -> Column:
    """Null where the record exists at the time."""
    return (
        F.when(F.col("spans").isNull(), "missing")
        .when(t.isNull() | _covers(t), None)
        .when(F.forall("spans", lambda s: s["start"] > t), "late")
        .otherwise("deleted")
    )


def cells(refs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """References per key and period: how many, the first and the last time."""
    return (
        refs.where("key IS NOT NULL")
        .groupBy(*by, "key", "period")
        .agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    )


def heavy_keys(cell: DataFrame, by: Sequence[str] = (), most: int = HEAVY_KEYS, least: float | None = None) -> DataFrame:
    """by..., key, n of the keys with the most references, from ``least`` (by default HEAVY_TIMES the mean): at most ``most`` rows."""
    per = cell.groupBy(*by, "key").agg(F.sum("n").alias("n"))
    if least is None:
        per = per.crossJoin(F.broadcast(per.agg(F.avg("n").alias("_mean")))).where(F.col("n") >= HEAVY_TIMES * F.col("_mean")).drop("_mean")
    else:
        per = per.where(F.col("n") >= least)
    return per.orderBy(F.desc("n"), *by, "key").limit(most)


def split_join(left: DataFrame, right: DataFrame, on: list[str], heavy: DataFrame | None, keys: list[str], how: str, most: int = HEAVY_ROWS) -> DataFrame:
    """``left`` with the columns of ``right``, which has one row per ``on``; nulls are equal. Rows of the ``heavy`` values of ``keys`` are joined apart."""
    other = [c for c in right.columns if c not in on]

    def join(l: DataFrame, r: DataFrame, cast: bool = False, salts: int = 0) -> DataFrame:
        r = r.select(*(F.col(c).alias(f"_r_{c}") for c in on), *other)
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on))
        if salts:
            l = l.withColumn("_salt", F.pmod(F.xxhash64(*l.columns), F.lit(salts)))
            r = r.withColumn("_r_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
            same &= F.col("_salt") == F.col("_r_salt")
        return l.join(F.broadcast(r) if cast else r, same, how).select(*(c for c in l.columns if c != "_salt"), *other)

    if heavy is None:
        return join(left, right)
    h = F.broadcast(heavy.select(*keys))
    hot, met = left.join(h, keys, "left_semi"), right.join(h, keys, "left_semi")
    small = met.limit(most + 1).count() <= most
    return join(left.join(h, keys, "left_anti"), right.join(h, keys, "left_anti")).unionByName(join(hot, met, small, 0 if small else SALTS))


@dataclass(frozen=True)
class Judged:
    """References with the cells that hold orphans. ``open``: by..., key, period, n, why (null where spans cut the cell), spans (only there)."""

    refs: DataFrame
    cells: DataFrame
    open: DataFrame
    heavy: DataFrame | None
    by: list[str]
    most: int

    def rows(self) -> DataFrame:
        """by..., ref_id, key, period, why of the orphan references."""
        on = [*self.by, "key", "period"]
        j = split_join(self.refs, self.open.select(*on, "why", "spans"), on, self.heavy, [*self.by, "key"], "inner", self.most)
        why = F.coalesce("why", F.when(F.col("spans").isNotNull(), _why(F.col("at"))))
        return j.select(*self.by, "ref_id", "key", "period", why.alias("why")).where("why IS NOT NULL")

    def counts(self) -> DataFrame:
        """by..., period, why, n: from the cells where these decide, and from the rows of the cells that are cut."""
        on, per = [*self.by, "key", "period"], [*self.by, "period", "why"]
        cut = split_join(self.refs, self.open.where("why IS NULL").select(*on, "spans"), on, self.heavy, [*self.by, "key"], "inner", self.most)
        cut = cut.withColumn("why", _why(F.col("at"))).where("why IS NOT NULL").select(*per, F.lit(1).cast("bigint").alias("n"))
        return self.open.where("why IS NOT NULL").select(*per, "n").unionByName(cut).groupBy(*per).agg(F.sum("n").alias("n"))


def judge(refs: DataFrame, records: DataFrame, by: Sequence[str] = (), least: float | None = None, unique: bool = False, most: int = HEAVY_ROWS) -> Judged:
    """``refs``: by..., ref_id, key, at, period; ``records``: by..., key, start, end. References, cells and the cells that hold orphans
    are written once. ``unique`` says that no reference is there twice."""
    by, spark = list(by), refs.sparkSession
    keys = [*by, "key"]
    refs = refs.select(*by, "ref_id", "key", "at", "period").where("key IS NOT NULL")
    refs = written(refs if unique else refs.distinct(), "refs")
    cell = written(cells(refs, by), "cells")
    top = heavy_keys(cell, by, least=least)
    taken = top.collect()  # at most HEAVY_KEYS short rows
    heavy = spark.createDataFrame(taken, top.schema) if taken else None
    over = lambda s: (s["start"].isNull() | (s["start"] <= F.col("lo"))) & (s["end"].isNull() | (s["end"] > F.col("hi")))
    apart = lambda s: (s["start"].isNull() | (s["start"] <= F.col("lo")) | (s["start"] > F.col("hi"))) & (s["end"].isNull() | (s["end"] <= F.col("lo")) | (s["end"] > F.col("hi")))
    judged = split_join(cell, life_spans(records, by), keys, heavy, keys, "left", most).select(
        *keys, "period", "n", "spans", _why(F.col("lo")).alias("why"),
        # one span over the whole cell: every reference in it is fine
        F.coalesce(F.exists("spans", over), F.lit(False)).alias("whole"),
        # no span begins or ends within the cell: all its references fare alike
        F.coalesce(F.forall("spans", apart), F.lit(True)).alias("alike"),
    )
    open_cells = judged.where("NOT whole AND NOT (alike AND why IS NULL)")
    open_cells = open_cells.select(*keys, "period", "n", F.when(F.col("alike"), F.col("why")).alias("why"), F.when(~F.col("alike"), F.col("spans")).alias("spans"))
    return Judged(refs, cell, written(open_cells, "open"), heavy, by, most)


def orphans(refs: DataFrame, records: DataFrame, by: Sequence[str] = (), least: float | None = None, most: int = HEAVY_ROWS) -> tuple[DataFrame, DataFrame]:
    """Orphan references as (rows, counts), see ``Judged``."""
    j = judge(refs, records, by, least, most=most)
    return j.rows().drop("key"), j.counts()


def never_referred(records: DataFrame, refs: DataFrame) -> DataFrame:
    """Records (key, start, ...) whose key occurs in no reference (or cell of references) of any time. Keys are made distinct before the shuffle."""
    return records.where("key IS NOT NULL").join(refs.where("key IS NOT NULL").select("key").distinct(), "key", "left_anti")
