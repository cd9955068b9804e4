"""Materialised results of steps, and a trace of what ran."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SCHEMA_VERSION = "1.0.0"


def exists(spark: SparkSession, path: str) -> bool:
    """A file or folder of that name is there, in whichever file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


class Store:
    """Parquet copies of step results below ``<debug_dir>/<run>``; a step whose copy exists can be skipped.

    The location must be shared by all executors of a cluster.
    """

    def __init__(self, spark: SparkSession, root: str, run: str, write: bool, reuse: bool):
        self.spark, self.root, self.write, self.reuse = spark, f"{root.rstrip('/')}/{run}", write, reuse
        self.run = run

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return exists(self.spark, f"{self.path(name)}/_SUCCESS")

    def through(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The stored result if it may be reused; else the new one, stored if asked to."""
        if self.reuse and self.exists(name):
            return self.spark.read.parquet(self.path(name))
        made = make()
        if not self.write:
            return made
        made.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.parquet(self.path(name))


class Trace:
    """Events of a run as rows: sequence, name, tags, start, duration, error.

    A step only declares what Spark will do, which takes next to no time; the
    work is done, and its time counted, in the events that write results.
    """

    def __init__(self) -> None:
        self.events: list[tuple] = []
        self.run_id = str(uuid.uuid4())

    def step(self, name: str, make: Callable[[], object], tags: tuple[str, ...] = ()) -> object:
        began, error = time.time(), None
        try:
            return make()
        except Exception as e:
            error = str(e)
            raise
        finally:
            self.events.append((len(self.events) + 1, self.run_id, name, list(tags), began, round(time.time() - began, 3), error))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.events, "seq int, run_id string, chain_name string, tags array<string>, started_at double, duration_sec double, error string")
