"""Tables that cut lineage: written once to the shared folder, read back, deleted when their readers are done."""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines see: ``spark.checkpoint.dir``.

    A local session (tests), where driver and executors are one machine, gets a temporary
    one if the setting is unset; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        path = "file://" + tempfile.mkdtemp(prefix="footing-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def durable(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here.

    Unlike a cached or locally checkpointed frame, it survives the loss of any executor.  tidy: the
    driver collects its garbage, upon which Spark removes from all executors what was shuffled for it, now and not some time later.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for _ in range(2 if tidy else 0):  # the write's last events may still hold its plan the first time
        spark._jvm.System.gc()
        time.sleep(0.3)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`durable` wrote and that nobody reads any more."""
    for table in tables:
        k = next((k for k, (_, path) in enumerate(_WRITTEN) if path == table.durable_path), None)
        if k is not None:
            release(k, k + 1)


def written() -> int:
    """How many tables :func:`durable` has written that still exist."""
    return len(_WRITTEN)


def release(first: int = 0, last: int | None = None) -> None:
    """Delete the tables that :func:`durable` wrote, the first-th to the last-th; call when their readers are done."""
    gone = _WRITTEN[first:last]
    del _WRITTEN[first:last]
    for spark, path in gone:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone; its folder is temporary then
            continue


atexit.register(release)
