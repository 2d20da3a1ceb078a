"""Incremental runs over a folder of documents with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from footing.functions.money import AMOUNT
from footing.operators.sinks import append
from footing.operators.state import settle
from footing.tables import durable


def _judgeable(found: DataFrame) -> DataFrame:
    """Adds what triage needs where it is missing: bytes' digest (of all columns), no total, and the digest as order."""
    out = found
    if "sha256" not in out.columns:
        out = out.withColumn("sha256", F.sha2(F.to_json(F.struct(*found.columns)).cast("binary"), 256))
    if "printed_total" not in out.columns:
        out = out.withColumn("printed_total", F.lit(None).cast(AMOUNT))
    return out if "seq" in out.columns else out.withColumn("seq", F.col("sha256"))


def run_new(spark: SparkSession, source: str, schema: str, extract: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, exceptions: str | None = None) -> StreamingQuery:
    """Extract documents that arrived since the last run; record the new ones, report all others.

    ``extract`` turns a batch of documents into records with an identity; sha256, printed_total
    and seq (the order within a batch) are used if there.  Records that are not new (the same
    bytes again, another issue of an identity, no identity) go to ``exceptions`` (by default
    target + "-exceptions") with verdict and reason, so that recorded and reported are all that came.
    The batch's id names its output, so a batch that is run again after a failure adds nothing twice.
    """
    aside = exceptions or f"{target}-exceptions"

    def each(batch: DataFrame, batch_id: int) -> None:
        found = durable(_judgeable(extract(batch)), "batch")
        p = spark._jvm.org.apache.hadoop.fs.Path(target)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            done = spark.read.parquet(target).where(F.col("batch") != f"b{batch_id}")
            order = F.struct(F.regexp_replace("batch", "b", "").cast("long").alias("batch"), "seq")
            done = done.select("identity", "sha256", "printed_total", order.alias("seq"))
        else:
            done = found.limit(0).select("identity", "sha256", "printed_total", "seq")
        new, rest = settle(found, done)
        append(new, target, f"b{batch_id}")
        append(rest, aside, f"b{batch_id}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
