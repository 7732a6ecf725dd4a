"""Tables written to cut lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
_own: list[str] = []
#: Paths given out and not deleted yet.
_used: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only where that is unset (tests, local runs) one of our own."""
    base = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{_CONF} must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="drawloom-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder. What is written there stays until ``sweep``, at the latest until the program ends."""
    if not _used:
        atexit.register(sweep)
    _used.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _used[-1]


def sweep() -> None:
    """Delete all written tables. Only when no DataFrame made so far will be used again: a plan doesn't tell who still reads its files."""
    spark = SparkSession.getActiveSession()
    for path in _used:
        try:
            if path.startswith(("/", "file:")):
                shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
            elif spark is not None:
                p = spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001, S110  a file that can't be deleted any more must not hide the program's own end
            pass
    _used.clear()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet to the shared folder and read it back: the lineage ends here, and lost executors cost nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan with fewer partitions than cores (few, or small files) to all cores, before costly work on each row; larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df
