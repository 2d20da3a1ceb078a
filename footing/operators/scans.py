"""Scans over ordered lines: the last value, a count, whether something was seen, before each line.

The plain form is a window for each document.  Where one document is too long for a task, the
two-level form cuts documents into blocks: each block is summed up in a row (its last value, its
count, whether it has seen something), the rows are scanned for each document, and every block adds
what came before it to its own windows.  All these combine associatively, so both forms give the same
columns; which one runs is a matter of size alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footing.tables import durable

#: Lines of a document from which it is cut into blocks, and lines of a block.
GIANT, BLOCK = 1_000_000, 1 << 16


@dataclass(frozen=True)
class Scan:
    """``how``: last, next (values that are not null), sum (of numbers) or seen (whether a condition held).

    ``value`` is an expression of the lines' columns.  Rows before this one count (after it for next), with ``upto`` this
    one too; with ``page`` those of its page only.
    """

    how: str
    value: Column
    upto: bool = False
    page: bool = False


def _number(scan: Scan) -> Column:
    return F.coalesce(scan.value.cast("int"), F.lit(0)) if scan.how == "seen" else scan.value


def _windowed(scan: Scan, own: tuple[str, ...], order: tuple[str, ...]) -> Column:
    """The scan within the partitions of ``own``; null (0 for sum and seen) where nothing came before."""
    w = Window.partitionBy(*own).orderBy(*order)
    rows = w.rowsBetween(Window.unboundedPreceding, Window.currentRow if scan.upto else -1)
    if scan.how == "last":
        return F.last(_number(scan), ignorenulls=True).over(rows)
    if scan.how == "sum":
        return F.coalesce(F.sum(_number(scan)).over(rows), F.lit(0))
    return F.coalesce(F.max(_number(scan)).over(rows), F.lit(0))


def _following(df: DataFrame, scans: dict[str, Scan], own: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The next value that is not null, as a look ahead: a frame to a partition's end would be read anew for every row."""
    if not scans:
        return df
    held = df.withColumns({f"_v_{n}": s.value for n, s in scans.items()})
    over = f"OVER (PARTITION BY {', '.join(own)} ORDER BY {', '.join(order)})"
    ahead = {n: F.expr(f"lead(_v_{n}) IGNORE NULLS {over}") for n in scans}
    upto = {n: F.coalesce(F.col(f"_v_{n}"), ahead[n]) if s.upto else ahead[n] for n, s in scans.items()}
    return held.withColumns(upto).drop(*[f"_v_{n}" for n in scans])


def _passed(df: DataFrame, scans: dict[str, Scan], own: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    back = {n: s for n, s in scans.items() if s.how != "next"}
    out = df.withColumns({n: _windowed(s, own, order) for n, s in back.items()}) if back else df
    return _following(out, {n: s for n, s in scans.items() if s.how == "next"}, own, order)


def _finished(df: DataFrame, scans: dict[str, Scan]) -> DataFrame:
    return df.withColumns({n: F.col(n) == 1 for n, s in scans.items() if s.how == "seen"})


def scan(lines: DataFrame, scans: dict[str, Scan], block: int | None = None) -> DataFrame:
    """``lines`` (doc_id, page, line_no and others) with a column for each scan.

    ``block``: documents are cut at pages and every so many lines, see the module's text; None scans whole
    documents.  Null doc_ids are one document.  Places must differ within a document; among lines of one place
    the order is arbitrary.
    """
    if not scans:
        return lines
    if block is None:
        whole = {n: s for n, s in scans.items() if not s.page}
        paged = {n: s for n, s in scans.items() if s.page}
        out = _passed(lines, whole, ("doc_id",), ("page", "line_no"))
        # pages lie within documents and are sorted already
        return _finished(_passed(out, paged, ("doc_id", "page"), ("line_no",)).select(*lines.columns, *scans), scans)
    cut = durable(lines.withColumn("_block", F.floor(F.col("line_no") / block).cast("int")), "scan-blocks")
    keys = ("doc_id", "page", "_block")
    sums = {n: _summary(s) for n, s in scans.items()}
    blocks = cut.groupBy(*keys).agg(*[c.alias(n) for n, c in sums.items()])
    before = blocks
    for page in (False, True):
        mine = {n: Scan(s.how, F.col(n)) for n, s in scans.items() if s.page == page}
        if mine:
            before = _passed(before.withColumnsRenamed({n: f"_s_{n}" for n in mine}), {n: Scan(s.how, F.col(f"_s_{n}")) for n, s in mine.items()}, ("doc_id", "page") if page else ("doc_id",), ("_block",) if page else ("page", "_block"))
            before = before.drop(*[f"_s_{n}" for n in mine])
    above = before.select(*[F.col(k).alias(f"_b_{k}") for k in keys], *[F.col(n).alias(f"_b_{n}") for n in scans])
    own = _passed(cut, scans, keys, ("line_no",))
    both = own.join(above, F.col("doc_id").eqNullSafe(F.col("_b_doc_id")) & (F.col("page") == F.col("_b_page")) & (F.col("_block") == F.col("_b__block")), "left")
    joined = both.withColumns({n: _together(s.how, F.col(n), F.col(f"_b_{n}")) for n, s in scans.items()})
    return _finished(joined.select(*lines.columns, *scans), scans)


def _summary(s: Scan) -> Column:
    """A block in one value."""
    if s.how == "sum":
        return F.sum(_number(s))
    if s.how == "seen":
        return F.max(_number(s))
    pick = F.max_by if s.how == "last" else F.min_by
    return pick(s.value, F.when(s.value.isNotNull(), F.col("line_no")))


def _together(how: str, own: Column, beyond: Column) -> Column:
    """What a block's own windows found with what lies beyond the block."""
    if how == "sum":
        return own + F.coalesce(beyond, F.lit(0))
    if how == "seen":
        return F.greatest(own, F.coalesce(beyond, F.lit(0)))
    return F.coalesce(own, beyond)


def block_for(lines: DataFrame, giant: int = GIANT, block: int = BLOCK) -> int | None:
    """The block length to scan with: None unless some document has more than ``giant`` lines."""
    largest = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    return block if largest > giant else None


def carried(value: Column, upto: bool = True, page: bool = False) -> Scan:
    return Scan("last", value, upto, page)


def counted(condition: Column, upto: bool = True) -> Scan:
    return Scan("sum", F.coalesce(condition.cast("int"), F.lit(0)), upto)
