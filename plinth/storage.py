"""Tables and files in the folder all executors share; lineage cuts that survive the loss of one."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder of this machine, but only under a
    local master: executors elsewhere would each write to their own disk.
    """
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not is_local(spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    _own = _own or tempfile.mkdtemp(prefix="plinth-shared-")
    return f"file://{_own}"


def is_local(master: str) -> bool:
    """Whether driver and executors are one process, or on one machine."""
    return master.startswith("local")


def materialised(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read on from there.

    All executors reach the table, so nothing upstream runs again when one is
    lost.  Unlike a checkpoint it forgets how its rows were dealt, so a later
    join deals both sides anew and Spark can split a hot key.  The tables go
    by :func:`drop`, by :func:`release`, or when the process ends.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._plinth_path = path
    return out


def scratch(spark: SparkSession) -> str:
    """A new folder's path in the shared folder; it goes as the tables do."""
    path = f"{shared_folder(spark)}/plinth-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def drop(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialised` that nothing reads any more."""
    paths = {table._plinth_path for table in tables}
    for spark, path in [x for x in _written if x[1] in paths]:
        _written.remove((spark, path))
        _delete(spark, path)


def release() -> None:
    """Delete the tables written so far; call it when no result of theirs is needed."""
    while _written:
        _delete(*_written.pop())


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc
        if jvm is None or context is None:
            return
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; its folder goes with it
        return


atexit.register(release)
