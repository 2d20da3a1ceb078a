"""Reconciliation: declared checks of computed sums and counts against printed figures.

All checks of a rule set run in one pass: every row is dealt to the sides of the checks that
it concerns, and one grouping by document, check and group replaces a full outer join a check.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footing.functions.money import AMOUNT

OK = ("pass", "not_applicable", "advisory_mismatch")


def _zero() -> Column:
    return F.lit("0.00").cast(AMOUNT)


@dataclass(frozen=True)
class Check:
    """One rung: rows of ``computed_from`` against rows of ``printed``.

    mode sum adds ``computed_field``; count counts rows and compares with the first printed
    number.  where and where_printed get no argument and use the columns of rows; without
    where_printed the first serves both.  group_by names a text field.
    """

    name: str
    computed_from: tuple[str, ...]
    printed: str
    computed_field: str = "amount"
    printed_field: str = "amount"
    mode: str = "sum"
    group_by: str | None = None
    where: Callable[[], Column] | None = None
    where_printed: Callable[[], Column] | None = None
    tolerance: Decimal = Decimal("0.00")
    required: bool = True
    advisory: bool = False


def _sides(c: Check) -> tuple[Column, Column, Column, Column]:
    """Whether a row is computed, whether it is printed, and its numbers as either."""
    when = c.where() if c.where else F.lit(True)
    printed_when = (c.where_printed or c.where or (lambda: F.lit(True)))()
    number = F.try_element_at("nums", F.lit(c.computed_field)) if c.mode == "sum" else F.lit("1.00").cast(AMOUNT)
    is_c, is_p = F.col("kind").isin(*c.computed_from) & F.coalesce(when, F.lit(False)), (F.col("kind") == c.printed) & F.coalesce(printed_when, F.lit(False))
    return is_c, is_p, number.cast(AMOUNT), F.try_element_at("nums", F.lit(c.printed_field)).cast(AMOUNT)


def _place() -> Column:
    """page and line_no as one number, by which an aggregate stays one over fixed-width values."""
    return F.col("page").cast("decimal(18,0)") * F.lit("1" + "0" * 19).cast("decimal(20,0)") + F.col("line_no").cast("decimal(19,0)")


def _totals(is_c: Column, is_p: Column, c: Column, p: Column, counts: Column | bool) -> dict[str, Column]:
    """Aggregates of a check's sides; the first printed number where it is one that counts."""
    first = F.min_by(F.when(counts & is_p, p), F.when(counts & is_p & p.isNotNull(), _place())) if counts is not False else F.lit(None)
    zero = lambda v: F.coalesce(v, _zero()).cast(AMOUNT)
    return {"n_c": F.count_if(is_c), "n_p": F.count_if(is_p), "sum_c": zero(F.sum(F.when(is_c, c))), "sum_p": zero(F.sum(F.when(is_p, p))), "first_p": zero(first)}


def _whole(rows: DataFrame, checks: Sequence[Check], numbers: Sequence[int]) -> DataFrame:
    """Checks without groups: one aggregation by document for all of them, a row a check."""
    sums, structs = {}, []
    for k in numbers:
        is_c, is_p, c, p = _sides(checks[k])
        # a constant where nothing is counted is no aggregate
        own = _totals(is_c, is_p, c, p, F.lit(True) if checks[k].mode == "count" else False)
        if checks[k].mode != "count":
            own.pop("first_p")
        sums |= {f"{n}{k}": v for n, v in own.items()}
        structs.append(F.struct(F.lit(k).alias("check_no"), *[(F.col(f"{n}{k}") if n in own else _zero()).alias(n) for n in ("n_c", "n_p", "sum_c", "sum_p", "first_p")]))
    by = rows.groupBy("doc_id").agg(*[v.alias(n) for n, v in sums.items()])
    out = by.select("doc_id", F.explode(F.array(*structs)).alias("x")).select("doc_id", "x.*")
    return out.withColumns({"grp": F.lit(None).cast("string"), "any_p": F.col("n_p") > 0, "any_c": F.col("n_c") > 0, "whole": F.col("sum_c")})


def _grouped(rows: DataFrame, checks: Sequence[Check], numbers: Sequence[int]) -> DataFrame:
    """Checks by group: rows are dealt to their sides and added up by (document, check, group)."""
    sides = []
    for k in numbers:
        is_c, is_p, c, p = _sides(checks[k])
        key = F.coalesce(F.try_element_at("fields", F.lit(checks[k].group_by)), F.lit(""))
        side = lambda hit, is_printed, number: F.when(hit, F.struct(F.lit(k).alias("check_no"), F.lit(is_printed).alias("printed"), key.alias("grp"), number.alias("value")))  # noqa: B023, E731
        sides += [side(is_c, False, c), side(is_p, True, p)]
    hits = F.array_compact(F.array(*sides))
    dealt = rows.select("doc_id", "page", "line_no", F.explode(hits).alias("x")).select("doc_id", "page", "line_no", "x.*")
    counting = F.col("check_no").isin([k for k in numbers if checks[k].mode == "count"])
    value, printed = F.col("value"), F.col("printed")
    sums = dealt.groupBy("doc_id", "check_no", "grp").agg(*[v.alias(n) for n, v in _totals(~printed, printed, value, value, counting).items()])
    # every document gets a result: a row that stands for a check without rows
    every = rows.select("doc_id").distinct().select("doc_id", F.explode(F.array(*[F.lit(k) for k in numbers])).alias("check_no"))
    none = {"grp": F.lit(None).cast("string"), "n_c": F.lit(0).cast("long"), "n_p": F.lit(0).cast("long"), "sum_c": _zero(), "sum_p": _zero(), "first_p": _zero()}
    all_ = sums.withColumn("dealt", F.lit(True)).unionByName(every.withColumns(none | {"dealt": F.lit(False)}))
    check = Window.partitionBy("doc_id", "check_no")
    first = F.row_number().over(check.orderBy(F.col("dealt").desc(), F.col("grp").asc_nulls_first()))
    found = all_.withColumns({"any_p": F.sum("n_p").over(check) > 0, "any_c": F.sum("n_c").over(check) > 0, "whole": F.sum("sum_c").over(check).cast(AMOUNT), "nth": first})
    return found.where((F.col("any_p") & F.col("dealt")) | (~F.col("any_p") & (F.col("nth") == 1))).drop("nth", "dealt")


def reconcile(rows: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """doc_id, check_no, check, grp, status, computed, printed, delta of every check and group.

    ``rows``: doc_id, page, line_no, kind, zone, fields, nums.  Every document gets a result
    for every check.  Nothing is assumed to be zero: a side without rows has NULL.
    """
    loose = [k for k, c in enumerate(checks) if c.group_by is None]
    both = _whole(rows, checks, loose) if loose else None
    if len(loose) < len(checks):
        grouped = _grouped(rows, checks, [k for k in range(len(checks)) if k not in loose])
        both = grouped if both is None else both.unionByName(grouped)
    table = F.array(*[F.struct(F.lit(c.name).alias("check"), F.lit(c.mode).alias("mode"), F.lit(c.required).alias("required"), F.lit(c.advisory).alias("advisory"), F.lit(str(c.tolerance)).cast(AMOUNT).alias("tolerance")) for c in checks])
    both = both.withColumn("_t", F.get(table, F.col("check_no"))).select("*", "_t.*")
    has_c, has_p, none = F.col("n_c") > 0, F.col("n_p") > 0, F.lit(None).cast(AMOUNT)
    shown = F.when(F.col("mode") == "count", F.col("first_p")).otherwise(F.col("sum_p"))
    alone = ~F.col("any_p")
    missing = F.col("any_c") & F.col("required")
    close = F.abs(F.col("sum_c") - shown) <= F.col("tolerance")
    status = (
        F.when(alone, F.when(missing, "missing_printed").otherwise("not_applicable"))
        .when(has_c & ~has_p, F.when(F.col("required"), "missing_printed").otherwise("not_applicable"))
        .when(has_p & ~has_c, "orphan_printed")
        .when(close, "pass")
        .when(F.col("advisory"), "advisory_mismatch")
        .otherwise("fail")
    )
    computed = F.when(alone, F.when(missing, F.col("whole"))).otherwise(F.col("sum_c"))
    printed = F.when(~alone & has_p, shown)
    out = both.select("doc_id", "check_no", "check", F.when(~alone, F.col("grp")).alias("grp"), status.alias("status"), computed.alias("computed"), F.coalesce(printed, none).alias("printed"))
    return out.withColumn("delta", (F.col("computed") - F.col("printed")).cast(AMOUNT))


def verdicts(rows: DataFrame, results: DataFrame) -> DataFrame:
    """One row a document: depth, checks_ok, checks_total, unclassified, items, errors, verified, status, worst_delta, reasons.

    Verified means: a line item, a passed check at least, no failure and no unclassified line.
    """
    # texts are gathered of the few rows that have any to tell; numbers of all rows
    lines = rows.groupBy("doc_id").agg(
        F.count_if(F.col("kind") == "unclassified").alias("unclassified"),
        F.count_if(F.col("kind") == "charge").alias("items"),
        F.count_if(F.col("row_error")).alias("errors"),
        F.coalesce(F.sum(F.when(F.col("kind") == "charge", F.try_element_at("nums", F.lit("amount")))), _zero()).cast(AMOUNT).alias("computed_total"),
    )
    strange = rows.where("kind = 'unclassified'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "line_no", F.substring("raw", 1, 400).alias("raw")))).alias("unknown"))
    lines = lines.join(strange, "doc_id", "left")
    bad = ~F.col("status").isin(*OK)
    size = F.when(F.col("delta").isNotNull(), F.struct(F.abs("delta").alias("size"), (-F.col("check_no")).alias("early"), F.col("delta").alias("signed")))
    checks = results.groupBy("doc_id").agg(
        F.size(F.collect_set(F.when(F.col("status") == "pass", F.col("check")))).cast("long").alias("depth"),
        F.count_if(F.col("status").isin(*OK)).alias("checks_ok"),
        F.count(F.lit(1)).alias("checks_total"),
        F.count_if(bad).alias("failures"),
        F.max(size)["signed"].alias("worst_delta"),
        F.array_sort(F.collect_list(F.when(bad, F.struct("check_no", F.coalesce("grp", F.lit("")).alias("grp"), F.concat_ws(" ", "check", "status").alias("what"))))).alias("failed"),
    )
    both = lines.join(checks, "doc_id", "left").fillna(0, ["depth", "checks_ok", "checks_total", "failures"])
    passed = (F.col("depth") >= 1) & (F.col("failures") == 0) & (F.col("unclassified") == 0)
    verified = passed & (F.col("items") > 0) & (F.col("errors") == 0)
    status = (
        F.when(F.col("errors") > 0, "parse error")
        .when(verified, "verified")
        .when(F.col("items") == 0, "no line items found")
        .when(F.col("depth") == 0, "nothing could be verified")
        .when(F.col("failures") == 0, "unclassified rows")
        .otherwise("reconciliation failed")
    )
    reasons = F.concat(
        F.when(F.col("items") == 0, F.array(F.lit("no line items found"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("depth") == 0, F.array(F.lit("nothing could be verified"))).otherwise(F.array().cast("array<string>")),
        F.coalesce(F.transform("failed", lambda x: x["what"]), F.array().cast("array<string>")),
        F.coalesce(F.transform("unknown", lambda x: F.concat(F.lit("unclassified: "), x["raw"])), F.array().cast("array<string>")),
    )
    return both.select("doc_id", "depth", "checks_ok", "checks_total", "unclassified", "items", "errors", "computed_total", "worst_delta", verified.alias("verified"), status.alias("status"), F.when(verified, F.array().cast("array<string>")).otherwise(reasons).alias("reasons"))


def diagnose(results: DataFrame, rows: DataFrame) -> DataFrame:
    """Failed checks with the first row whose amount is exactly the difference, if any."""
    failed = results.where(F.col("status").isin("fail", "advisory_mismatch")).withColumn("size", F.abs("delta"))
    amounts = rows.where(F.col("kind").isin("tax", "restatement", "group_subtotal", "section_subtotal", "charge"))
    amounts = amounts.select(F.col("doc_id"), F.abs(F.try_element_at("nums", F.lit("amount"))).alias("size"), F.struct((F.col("kind") == "charge").alias("late"), "page", "line_no", "kind", "raw").alias("row"))
    first = amounts.groupBy("doc_id", "size").agg(F.min("row").alias("row"))
    hint = F.when(F.col("delta") < 0, "computed is short").otherwise("computed is over")
    return failed.join(first, ["doc_id", "size"], "left").select("doc_id", "check", "grp", "delta", hint.alias("hint"), F.col("row.kind").alias("match_kind"), F.col("row.raw").alias("match_raw"))
