"""Session helpers: table loading, lineage cuts and small shared expressions."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Read one parquet table; ``columns`` prunes the scan."""
    frame = spark.read.parquet(f"{root}/{name}.parquet")
    return frame.select(*columns) if columns is not None else frame


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the setting is absent, a local run (tests, a laptop) uses a folder of
    its own that goes when the run ends; on a cluster that is an error, as its
    machines share no temporary folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if context.getCheckpointDir() is None:
        if named is None:
            if not _is_local(context.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="docweave-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def _is_local(master: str) -> bool:
    """One process, as opposed to ``local-cluster`` and the masters of clusters."""
    return master == "local" or master.startswith("local[")


def cut(frame: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage through reliable storage, so a lost executor costs no recomputation."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager)


def blank(column: Column) -> Column:
    """True for null and for the empty string."""
    return column.isNull() | (column == F.lit(""))


# Operators of a plan that is no plain scan any more; such plans have the partitions of a shuffle already.
_BEYOND_SCAN = re.compile(r"(?m)^[ :+|-]*(?:\w*Join|Aggregate|Window|Sort|Repartition|Generate|Union|Distinct|LocalLimit|LogicalRDD|Intersect|Except)\b")


def spread(frame: DataFrame) -> DataFrame:
    """Give every core a part of a scan that has fewer parts than there are cores.

    A file of one row group is one task, however long Python works on it.  How
    many parts a scan has is up to Spark's file settings, so an input with more
    parts than cores, of whatever size, stays as it is; no list of files is
    made here.  The rows are the same either way.
    """
    if frame.isStreaming:
        return frame
    cores = frame.sparkSession.sparkContext.defaultParallelism
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    if "Relation" not in plan or _BEYOND_SCAN.search(plan):
        return frame
    return frame.repartition(cores) if frame._jdf.rdd().getNumPartitions() < cores else frame
