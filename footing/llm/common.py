"""Helpers shared by the corpus operators: reading tables, durable tables (:mod:`footing.tables`), text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footing.shipping import ship
from footing.tables import discard, durable, release, shared_dir, written

__all__ = ["discard", "durable", "fold", "release", "shared_dir", "table", "text_bytes", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, by any path that Spark can read."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_bytes(col: str | Column) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col, F.lit("")).cast("binary")


def fold(col: str | Column, mod: int = 5) -> Column:
    """crc32 of the id's decimal text, modulo mod; a null id counts as empty text."""
    col = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)
