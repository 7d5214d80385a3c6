"""Shared folder, staging tables and sizing used by the operators of this package."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as a URI without a trailing slash.

    The session's ``spark.checkpoint.dir`` is used as it is. Only where it is unset and the master is local (tests
    on one machine) a temporary folder is made and remembered in the session.
    """
    there = spark.conf.get(SETTING, None)
    if not there:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"{SETTING} must name a folder that driver and executors share")
        there = "file://" + tempfile.mkdtemp(prefix="docweave-")
        spark.conf.set(SETTING, there)
    if ":" not in there.split("/")[0]:  # no scheme: the cluster's default file system
        path = spark._jvm.org.apache.hadoop.fs.Path(there)
        there = str(path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path))
    # pyarrow wants file:///x where Hadoop says file:/x
    return re.sub(r"^file:/(?!/)", "file:///", there).rstrip("/")


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new, unused folder below the shared one."""
    made = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _MADE.append(made)
    return made


_MADE: list[str] = []


def remove(path: str) -> None:
    """Delete a folder whose rows are no longer needed."""
    fs, at = filesystem(path)
    try:
        fs.delete_dir(at)
    except FileNotFoundError:
        pass
    if path in _MADE:
        _MADE.remove(path)


def clear() -> None:
    """Delete every folder made so far in this process. Results that still read them must have been written before."""
    for path in list(_MADE):
        remove(path)


def staged(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage is cut, lost executors cost nothing.

    ``what`` is a name, or a folder made before."""
    spark = df.sparkSession
    path = what if what in _MADE else fresh_dir(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of ``df``, from file statistics."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else 0


def parts_for(df: DataFrame, target: int = 128 << 20) -> int:
    """Partitions for a shuffle of ``df``: the session's number, or more where the input asks for it."""
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(conf, -(-plan_bytes(df) // target))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if a scan would leave some without a task, whatever its size."""
    execution, cores = df._jdf.queryExecution(), df.sparkSession.sparkContext.defaultParallelism
    if execution.executedPlan().getClass().getSimpleName() == "AdaptiveSparkPlanExec":  # it comes from an exchange
        return df
    return df.repartition(cores) if execution.toRdd().getNumPartitions() < cores else df


def filesystem(uri: str):
    """A pyarrow file system for ``uri`` and the path in it: local, HDFS, S3 and others alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def slices(batches: Iterator, rows: int = 512) -> Iterator:
    """Smaller record batches, so that Python objects of only a few texts live at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
