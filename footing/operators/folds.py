"""Windows over ordered lines: carrying, counting, folding wrapped text, pairing and refusing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(keys: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def before(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def upto(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def carry(value: Column, w: Window, inclusive: bool = True) -> Column:
    """The last value that is not null, of this row too if inclusive."""
    return F.last(value, ignorenulls=True).over(upto(w) if inclusive else before(w))


def last_of(kinds: Sequence[str], value: Column, w: Window, kind: str = "kind") -> Column:
    """value of the most recent earlier row of these kinds."""
    return F.last(F.when(F.col(kind).isin(*kinds), value), ignorenulls=True).over(before(w))


def last_but(skip: Sequence[str], value: Column, w: Window, kind: str = "kind") -> Column:
    """value of the most recent earlier row, stepping over these kinds."""
    return F.last(F.when(~F.col(kind).isin(*skip), value), ignorenulls=True).over(before(w))


def last_of_on_page(kinds: Sequence[str], value: Column, w: Window, kind: str = "kind") -> Column:
    """The same, NULL if that row stands on another page."""
    found = last_of(kinds, F.struct(F.col("page").alias("page"), value.alias("value")), w, kind)
    return F.when(found["page"] == F.col("page"), found["value"])


def filled(line: Column, keys: Sequence[str] = ("doc_id", "page"), order: Sequence[str] = ("page", "line_no"), steps: int = 1) -> Column:
    """The line ``steps`` non-blank lines further down the page (up, if negative), NULL beyond its edge.

    For non-blank rows: blank ones must be filtered out before.
    """
    w = ordered(keys, order)
    return F.lead(line, steps).over(w) if steps > 0 else F.lag(line, -steps).over(w)


def raw_line(line: Column, keys: Sequence[str] = ("doc_id", "page"), order: Sequence[str] = ("page", "line_no"), steps: int = 1) -> Column:
    """The line ``steps`` lines further down the page as it stands, blank ones included."""
    return filled(line, keys, order, steps)


def sections(closed: Column, w: Window) -> Column:
    """Section number: goes up after each row that closes one."""
    return F.coalesce(F.sum(closed.cast("int")).over(before(w)), F.lit(0))


def groups(opened: Column, w: Window, start: int = 0) -> Column:
    """Group number: goes up on each row that opens one."""
    return F.sum(opened.cast("int")).over(upto(w)) + F.lit(start)


def closed_sections(df: DataFrame, keys: Sequence[str], order: Sequence[str], closed: Column, name: str = "section") -> DataFrame:
    """Adds the section number; NULL for rows of a section that nothing closes."""
    numbered = df.withColumn("_closed", closed).withColumn("_n", sections(F.col("_closed"), ordered(keys, order)))
    ends = F.max(F.col("_closed").cast("int")).over(Window.partitionBy(*keys, "_n"))
    return numbered.withColumn(name, F.when(ends == 1, F.col("_n"))).drop("_closed", "_n")


def fold_wrapped(df: DataFrame, keys: Sequence[str], order: Sequence[str], is_head: Column, text: str, first_only: bool = False, separator: str = " ") -> DataFrame:
    """One row for each head with its text and the texts of the rows that follow it, in order.

    Rows before any head are left out.  ``first_only`` takes only the first that follows.
    """
    w = ordered(keys, order)
    numbered = df.withColumn("_head", groups(is_head, w)).where("_head > 0")
    nth = F.row_number().over(Window.partitionBy(*keys, "_head").orderBy(*order))
    if first_only:
        numbered = numbered.withColumn("_nth", nth).where("_nth <= 2").drop("_nth")
    item = F.struct(*order, F.col(text).alias("_text"))
    parts = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["_text"])
    return numbered.groupBy(*keys, "_head").agg(F.min(F.struct(*order)).alias("at"), F.array_join(parts, separator).alias(text), F.count(F.lit(1)).alias("n_lines")).drop("_head")


def glued(text: Column, piece: Column) -> Column:
    """A text with the next piece of a wrapped cell: up to two characters without a blank, longer ones with one."""
    return F.when(text == "", piece).when(F.length(piece) <= 2, F.concat(text, piece)).otherwise(F.concat(text, F.lit(" "), piece))


def glue(parts: Column) -> Column:
    """Joins wrapped cells piece by piece, see :func:`glued`."""
    return F.aggregate(parts, F.lit(""), glued)


def pair_by_place(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str], same: str) -> DataFrame:
    """Left rows with the right row of the same rank, if both sides are as many and agree in ``same``.

    Where they do not, left rows stay and ``paired`` is false.
    """
    rank = lambda d: d.withColumn("_rank", F.row_number().over(ordered(keys, order)))
    r = rank(right).select(*keys, "_rank", F.col(same).alias("_same"), *[F.col(c).alias(f"right_{c}") for c in right.columns if c not in (*keys, *order, same)])
    both = rank(left).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).join(r, [*keys, "_rank"], "left")
    sizes = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    both = both.join(sizes, list(keys), "left")
    agree = F.min(F.col(same).eqNullSafe(F.col("_same")).cast("int")).over(Window.partitionBy(*keys)) == 1
    paired = agree & (F.col("_n") == F.coalesce("_m", F.lit(0)))
    out = both.withColumn("paired", paired)
    shown = [F.when(F.col("paired"), F.col(c)).alias(c) if c.startswith("right_") else F.col(c) for c in out.columns if not c.startswith("_")]
    return out.select(*shown)


def net_credits(df: DataFrame, keys: Sequence[str], value: str, credit: str) -> DataFrame:
    """Adds net: the value less all credits of its key."""
    return df.withColumn("net", F.col(value) - F.coalesce(F.sum(credit).over(Window.partitionBy(*keys)), F.lit(0)))


def refuse_containers(rows: DataFrame, is_total: Column) -> DataFrame:
    """Adds container: the document prints more than one grand total, so none can be checked."""
    return rows.withColumn("container", F.count(F.when(is_total, 1)).over(Window.partitionBy("doc_id")) > 1)


def cut_at(df: DataFrame, keys: Sequence[str], order: Sequence[str], marker: Column) -> DataFrame:
    """Rows before the first marker; all rows of a key that has none."""
    at = F.struct(*order)
    first = F.min(F.when(marker, at)).over(Window.partitionBy(*keys))
    return df.withColumn("_until", first).where(F.col("_until").isNull() | (at < F.col("_until"))).drop("_until")


def fields_with(forced: dict[str, Column], absent: dict[str, Column] | None = None, fields: str = "fields") -> Column:
    """A row's fields with some set: ``forced`` ones always, ``absent`` ones where there is none; NULL sets nothing.

    Which names may be set is known beforehand, so every value is computed once.
    """
    names = dict.fromkeys([*forced, *(absent or {})])
    value = lambda n: F.coalesce(*[c.cast("string") for c in (forced.get(n), F.try_element_at(fields, F.lit(n)), (absent or {}).get(n)) if c is not None])
    new = F.create_map(*[x for n in names for x in (F.lit(n), value(n))])
    return F.map_filter(F.map_concat(F.map_filter(fields, lambda k, v: ~k.isin(*names)), new), lambda k, v: v.isNotNull())
