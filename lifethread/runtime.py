"""Session helpers: the shared scratch folder and lineage cuts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python workers can import it from any working directory."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lifethread-package-"), "lifethread.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(path)


def scratch_root(spark: SparkSession) -> str:
    """Folder shared by all executors, from ``spark.checkpoint.dir``.

    Only where the session names none and the master is local (tests on one machine) a folder of our own is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lifethread-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A path under the shared folder that nobody else uses."""
    return f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"


#: Spark removes the shuffle files of an execution when it ends, not when the driver happens to collect its plan.
_REMOVED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is executed in here leaves no shuffle files; a plan that is executed again shuffles again."""
    before = spark.conf.get(_REMOVED, "false")
    spark.conf.set(_REMOVED, "true")
    try:
        yield
    finally:
        spark.conf.set(_REMOVED, before)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage like ``checkpoint()`` does, survives executor loss, and gives the following plan
    real file sizes, so that join strategies are chosen on facts. The shuffle files behind the table go once it is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    with shuffles_removed(spark):
        df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(table: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` gave and nothing reads any more."""
    jvm, conf = table.sparkSession._jvm, table.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
        if re.search("-[0-9a-f]{32}$", folder):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def materialize_seen(df: DataFrame, tag: str, seen: Column) -> tuple[DataFrame, int]:
    """``materialize`` and the value of an aggregate over the rows, taken while they are written; 0 if there are none."""
    watch = Observation()
    out = materialize(df.observe(watch, seen.alias("seen")), tag)
    return out, int(watch.get["seen"] or 0)


def spread(df: DataFrame) -> DataFrame:
    """Rows of few large files over all cores, for work that costs more than moving the rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
