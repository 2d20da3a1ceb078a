"""Batches of several tables that become visible together, and a history in the order it was written.

A batch writes each of its tables into a folder of its own and then one small file into the log, whose
name is the batch's number.  Readers take what the log names, so a batch that fails between two
tables shows nothing, and one that is written again after it was committed adds nothing.  The log's
numbers order batches; within one, rows are numbered as they are written.

A history can also be kept by buckets of its identities' hashes: a batch then opens the buckets that its own
identities fall into and no others, however long the history has become.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "_log"
#: Buckets of a history by identity.
BUCKETS = 64


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def commits(spark: SparkSession, path: str) -> list[dict]:
    """The committed batches in order: number, batch and the folder of each table.  One small file a batch."""
    fs, log = _fs(spark, f"{path}/{LOG}")
    if not fs.exists(log) or not fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{LOG}/*.json")):
        return []
    lines = spark.read.text(f"{path}/{LOG}/*.json").collect()
    return sorted((json.loads(r["value"]) for r in lines), key=lambda c: c["number"])


def _commit(spark: SparkSession, path: str, entry: dict) -> bool:
    """Put an entry into the log under its number; False if another writer has taken it."""
    fs, final = _fs(spark, f"{path}/{LOG}/{entry['number']:020d}.json")
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{LOG}/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray((json.dumps(entry) + "\n").encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        return False
    return True


def write_batch(spark: SparkSession, path: str, batch: str, tables: dict[str, DataFrame], buckets: dict[str, str] | None = None) -> int:
    """Write the tables and commit them as one; the batch's number.  A batch that is committed already is left as it is.

    Rows get the column ``_row``, their number in the batch.  ``buckets``: table -> its identity's column, for tables
    that are laid out by identity (:func:`unseen`).
    """
    done = commits(spark, path)
    known = [c for c in done if c["batch"] == batch]
    if known:
        return known[0]["number"]
    folders = {}
    for name, df in tables.items():
        folders[name] = f"{name}/of_batch={uuid.uuid4().hex}"
        rows = df.withColumn("_row", F.monotonically_increasing_id())
        if name in (buckets or {}):
            rows = rows.withColumn("of_bucket", bucket_of(F.col(buckets[name])))
            rows.repartition("of_bucket").sortWithinPartitions("of_bucket", buckets[name]).write.partitionBy("of_bucket").parquet(f"{path}/{folders[name]}")
        else:
            rows.write.parquet(f"{path}/{folders[name]}")
    number = done[-1]["number"] + 1 if done else 1
    schemas = {n: tables[n].withColumn("_row", F.lit(0).cast("long")).schema.json() for n in tables}
    while not _commit(spark, path, {"number": number, "batch": batch, "tables": folders, "schemas": schemas}):
        number += 1
    return number


def read_committed(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """All committed rows of a table with ``seq``, a struct of batch number and row, which orders them as written; None if there are none."""
    from pyspark.sql.types import StructType

    found = [c for c in commits(spark, path) if name in c["tables"]]
    if not found:
        return None
    schema = StructType.fromJson(json.loads(found[-1]["schemas"][name]))
    numbers = spark.createDataFrame([(c["tables"][name].rsplit("=", 1)[1], c["number"]) for c in found], "of_batch string, _number long")
    rows = spark.read.schema(schema.add("of_batch", "string")).option("basePath", f"{path}/{name}").parquet(*[f"{path}/{c['tables'][name]}" for c in found])
    out = rows.join(F.broadcast(numbers), "of_batch")  # a row a batch
    return out.withColumn("seq", F.struct(F.col("_number").alias("batch"), F.col("_row").alias("row"))).drop("of_batch", "of_bucket", "_number", "_row")


def bucket_of(identity: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(identity), F.lit(buckets)).cast("int")


def seen_buckets(spark: SparkSession, path: str, name: str, batch: DataFrame, identity: str) -> DataFrame | None:
    """The rows of a bucketed history that share a bucket with the batch: files of other buckets are not listed among what is read."""
    found = [c["tables"][name] for c in commits(spark, path) if name in c["tables"]]
    if not found:
        return None
    wanted = [r["b"] for r in batch.select(bucket_of(F.col(identity)).alias("b")).distinct().collect()]  # at most BUCKETS
    rows = spark.read.option("basePath", f"{path}/{name}").parquet(*[f"{path}/{folder}" for folder in found])
    return rows.where(F.col("of_bucket").isin(wanted)).drop("_row", "of_bucket", "of_batch")


def unseen(spark: SparkSession, path: str, name: str, batch: DataFrame, identity: str = "identity") -> DataFrame:
    """Rows of the batch whose identity the history does not hold; only buckets that the batch falls into are opened."""
    history = seen_buckets(spark, path, name, batch, identity)
    if history is None:
        return batch
    return batch.join(history.select(identity).distinct(), identity, "left_anti")

