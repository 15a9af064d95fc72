"""Session helpers: executor imports, Arrow batch bounds and tables that cut lineage."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ROOT = str(Path(__file__).resolve().parent.parent)

#: Bounds of one Arrow batch sent to a Python worker, whatever a row's length.
ARROW_ROWS, ARROW_BYTES = 2000, 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package and bound their Arrow batches.

    Clusters that ship code with ``--py-files`` need the second half only; the first is harmless there.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


#: Bytes of input, by Spark's estimate, up to which it is dealt over all cores before a Python stage.
SMALL_INPUT = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table over all cores: files of one row group come as one partition, however many cores are idle."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL_INPUT else df


def unused(name: str, taken: list[str]) -> str:
    """A column name that is not taken, in either case."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


def extended(schema: T.StructType, ddl: str) -> T.StructType:
    """A schema with further columns, given as DDL."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only in local mode, where all tasks share the machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        global _own
        if _own is None:
            _own = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        where = _own
    return where.rstrip("/")


_own: str | None = None
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables written inside each running ``settled``.
_scopes: list[list[DataFrame]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which is removed when the application ends."""
    path = f"{shared_dir(spark)}/corpusloom-{uuid.uuid4().hex}/{name}"
    atexit.register(_remove_at_exit, spark, path)
    return path


def stash(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the reread table.

    Unlike ``checkpoint()`` the rows are computed a single time, and columns are pruned on reading. The files survive
    lost executors and are removed by ``discard``, by the ``settled`` around, or when the application ends. The shuffle
    files of the write are removed with its end, so a job of many steps needs the disk of its largest step only. Options
    go to the writer.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.mode("overwrite").options(**options).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    written = spark.read.schema(df.schema).parquet(path)
    written.stash_path = path
    if _scopes:
        _scopes[-1].append(written)
    return written


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``stash`` the table that ``make`` gives, then remove the tables that were written on the way to it."""
    _scopes.append([])
    try:
        result = stash(make(), name)
    finally:
        inner = _scopes.pop()
    for table in inner:
        if table is not result:
            discard(table)
    if _scopes:
        _scopes[-1].append(result)
    return result


def discard(table: DataFrame) -> None:
    """Remove a table that ``stash`` wrote; nothing that reads it may run any more. Others are left alone."""
    if getattr(table, "stash_path", None) is not None:
        _remove(table.sparkSession, table.stash_path)
        table.stash_path = None


def _remove(spark: SparkSession, path: str) -> None:
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    target = jvm.org.apache.hadoop.fs.Path(path).getParent()
    target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        _remove(spark, path)
    except Exception:  # the context is gone already: the cluster's own clean-up of the folder applies
        pass
