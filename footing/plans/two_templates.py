"""A layout of two templates told apart by zones: samples with charges beneath, and a grid.

Template A prints samples under accounts and locations, restates them in a summary, and bills
products in a stream of their own; template B is one table.  A document with more than one
invoice total is a container of invoices and is refused.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footing.functions import text as T
from footing.functions.money import AMOUNT
from footing.operators import folds
from footing.operators.ladder import Check
from footing.operators.rules import BODY, Anchor, Context, Rule, Zone
from footing.plans.layouts import MONEY, Layout

SUMMARY, DETAIL, PRODUCTS, STATEMENT, PRIOR, CURRENT = "summ", "detail", "prod", "stmt", "prior", "current"
STUB = BODY

# The layout's patterns and labels.
CODE = r"[0-9A-Z][0-9A-Z\-]*"
DATE = r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}"
ON_LINE = r"[0-9][0-9,]*\.[0-9]{2}"
PAID = rf"\$\s?({MONEY})\s*$"
ZONES = (
    Zone("page_current_period_summary", r"^\s{2,}Current Period Summary\b", SUMMARY),
    Zone("page_sample_detail", r"^\s{2,}Sample Detail\b", DETAIL),
    Zone("page_charges_for_products", r"^\s{2,}Charges for Products\b", PRODUCTS),
    Zone("page_statement", r"^\s+STATEMENT\s*$", STATEMENT),
    Zone("banner_prior_periods", r"\*\s*\*\s*\*\s+PRIOR\s+PERIODS?\s+SUMMARY\s+\*", PRIOR),
    Zone("banner_current_period", r"\*\s*\*\s*\*\s+CURRENT\s+PERIOD\s+ACTIVITY\s+\*", CURRENT),
)
HEADERS = {
    "detail_column_header": r"^\s+SS#\s+SAMPLE ID/ACCESSION #\s+REFERENCE",
    "summ_column_header": r"^\s+TEST\s+DESCRIPTION\s+TESTS\s+SAMPLES\s+AMOUNT\s*$",
    "prod_column_header": r"^\s+ITEM\s+DESCRIPTION\s+QUANTITY\s+UNIT PRICE\s+AMOUNT\s*$",
    "grid_column_header": r"^\s+DATE\s+ITEM/PATIENT\s+NUMBER\s+DESCRIPTION\s+CODES\s+AMOUNT\s*$",
}
DONOR_LABEL = "DONOR / DESCRIPTION"
GRID_LABELS = ("DATE", "ITEM/PATIENT", "NUMBER", "DESCRIPTION", "CODES", "AMOUNT")
PAGE_FIELDS = (
    r"^\s*ACCOUNT NUMBER\s+INVOICE\s*$",
    r"^\s*ACCOUNT NUMBER\s+INVOICE NUMBER\s+DATE",
    r"^\s*NUMBER\s+DATE\s+PURCHASE ORDER NO\.\s+PAGE\s*$",
    rf"^\s*[0-9]{{6,9}}\s+(?:[0-9]{{6,9}}|SUMMARY)\s+{DATE}(\s+[0-9]+)?\s*$",
    r"^\s*Account Number:?\s+[0-9]+\s*$",
    r"^\s*ACCOUNT #\s+[0-9]+\s*$",
    r"^\s*STATEMENT AS OF\s+[0-9]",
    r"^\s*PAYING ACCOUNT\b",
)
NOISE = (
    r"^\s*Occupational Testing Services\s*$",
    r"^\s*Burlington, North Carolina\s*$",
    r"^\s*FORM otsinv_\w+\s*$",
    r"^\s*PO BOX [0-9]+ BURLINGTON, NC .*TAX ID#",
    r"^\s*[0-9]+\s+PO BOX(\s+[0-9])+\s+BURL\s?I\s?NGTON",
    r"^\s*PO BOX(\s+[0-9])+\s+BURL\s?I\s?NGTON",
    r"^\s*R[0-9]{2}-[A-Z]{2,4}(\s+[0-9,]+)?\s*$",
    r"^\s*Performing Lab Index\s*$",
    r"^\s*[A-Z]\s*$",
    r"^\s*[A-Z]\s{2,}\S",
    r"^\s*_{3,}\s*$",
    r"^\s*[-=]{3,}\s*$",
    r"^\s*,\s*$",
    r"^\s*\(\s*[0-9]{3}\s*\)\s*[0-9]",
    r"^\s*\([0-9]{3}\)\s*[0-9]{3}\s*-?\s*[0-9]{4}\s*$",
    r"^\s*INVOICE\s*$",
    r"^\s*\*[0-9]+\*\s*$",
    r"^\s*SHIPPED:\s+[0-9]",
    r"^\s*NOTE:\s",
    r"TAX\s?I\s?D",
    r"MAKE CHECK PAYABLE",
    r"DETACH HERE AND RETURN",
)
DONOR = rf"^\s*([0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}})\s{{2,}}(\S.*?)\s{{2,}}({DATE})(?:\s+(\S.*?))?\s*$"
ACCESSION, REFERENCE = r"^[0-9]{10}$", r"^[0-9A-Z]{12}$"
CHARGE = rf"^\s{{10,}}({CODE})\s+(\S.*?)\s{{2,}}{PAID}"
CELL_WRAP = r"^\s{2,}([A-Z0-9][A-Z0-9'\-,.& ]*?)\s*$"
LOCATION_TOTAL = rf"^\s*LOCATION TOTAL:\s+(\S+)\s+SAMPLES:\s+([0-9]+)\s+{PAID}"
ACCOUNT_TOTAL = rf"^\s*ACCOUNT TOTAL:\s+(\S+)\s+SAMPLES:\s+([0-9]+)\s+{PAID}"
TOTAL_BILLED = rf"^\s+TOTAL SAMPLES BILLED:\s+([0-9]+)\s+{PAID}"
ACCOUNT = r"^\s*ACCOUNT:\s+(\S+)\s*(\S.*?)?\s*$"
LOCATION = r"^\s*LOCATION:\s+(\S+)\s*$"
SUMM_ITEM = rf"^\s{{20,}}({CODE})\s+(\S.*?)\s{{2,}}([0-9]+)\s*$"
SUMM_LOCATION_ITEM = rf"^\s*LOCATION:\s+(\S+)\s+({CODE})\s+(\S.*?)\s{{2,}}([0-9]+)\s*$"
SUMM_LOCATION_TOTAL = rf"^\s*LOCATION TOTAL:\s+(\S+)\s+([0-9]+)\s+{PAID}"
SUMM_ACCOUNT_TOTAL = rf"^\s*ACCOUNT TOTAL:\s+(\S+)\s+TOTAL SAMPLES:\s+([0-9]+)\s+{PAID}"
SUMM_PRODUCTS = rf"^\s*ACCOUNT:\s+(\S+)\s+TOTAL PRODUCT CHARGES\s+{PAID}"
SUMM_GRAND = rf"^\s{{20,}}TOTAL SAMPLES:\s+([0-9]+)\s+{PAID}"
INVOICE_TOTAL = rf"^\s+INVOICE TOTAL\s+{PAID}"
SHIPPED = r"^\s*SHIPPED TO:\s+(\S+)\s*(\S.*?)?\s*$"
PRODUCT = rf"^\s*({CODE})\s+(\S.*?)\s{{2,}}([0-9]+)\s+\$\s?({MONEY})\s+{PAID}"
ORDER_TOTAL = rf"^\s+ORDER TOTAL:\s+{PAID}"
PRODUCTS_TOTAL = rf"^\s+TOTAL PRODUCT CHARGES:\s+{PAID}"
LAB = r"(\*?[0-9A-Z]{1,4})"
GRID_PARENT = rf"^\s*({DATE})\s+(\S.*?)\s{{2,}}(\S+)\s{{2,}}({CODE})\s+(\S.*?)\s{{2,}}{LAB}\s{{2,}}({MONEY})\s*$"
GRID_CHILD = rf"^\s{{2,}}(?:(\S+)\s{{2,}})?({CODE})\s+(\S.*?)\s{{2,}}{LAB}\s{{2,}}({MONEY})\s*$"
GRID_SUBTOTAL = rf"^\s+Current Period Subtotal\s+({MONEY})\s*$"
GRID_TOTAL = rf"^\s+CURRENT PERIOD TOTAL\s+({MONEY})\s*$"
GRID_WRAP = r"^\s{2,}([0-9A-Z][0-9A-Z\-]*)\s*$"
STUB_ROW = rf"^\s{{2,}}([0-9]{{7,9}})\s+\$?\s?({MONEY})(?:\s{{0,2}}(CR))?(?:\s+(\S.*?))?\s*$"
BUCKET = r"(?:\$\s?)?[0-9,]*\.[0-9]{2}(?:CR)?"
AGING = rf"^\s*{BUCKET}\s+{BUCKET}\s+{BUCKET}\s+{BUCKET}(?:\s+DUE)?(?:\s+{BUCKET})?\s*$"
AMOUNT_DUE = rf"^.*?\bAMOUNT\s+\$\s?{MONEY}(?:CR)?\s*$|^[\s_]*DUE\s+(?:\$\s?)?{MONEY}(?:CR)?\s*$"
LONE_AMOUNT = rf"^\s*\$\s?{MONEY}(?:\s?CR)?(?:\s+_+)?\s*$"
LEDGER = rf"^\s*(?:[0-9]{{6,9}}\s+)?{DATE}\s+\S.*?\$\s?{MONEY}(?:CR)?(?:\s+(?:\$\s?{MONEY}(?:CR)?|_+))?\s*$"
BALANCE = rf"^\s+ACCOUNT BALANCE:\s+\$\s?{MONEY}(?:CR)?\s*$"
PRIOR_ENTRY = rf"^\s*{DATE}\s+\S.*?(?:\s+{MONEY}(?:CR)?)?\s*$"
PRIOR_BALANCE = rf"^\s+(?:INVOICE BALANCE|PRIOR PERIOD BALANCE|PRIOR PERIODS? SUBTOTAL)\s+{MONEY}(?:CR)?\s*$"
LAB_INDEX = r"^[0-9A-Z]{1,4}\s{2,}\S"
INVOICE_LINE = rf"^\s*[0-9]{{6,9}}\s+([0-9]{{6,9}})\s+{DATE}\b"

BETWEEN = frozenset({"ignorable", "header_field", "column_header"})
SAMPLE = frozenset({"detail_donor_row"})
GRID = frozenset({"grid_charge_child", "grid_patient_id_continuation"})
SAMPLE_CELLS = ("ssn", "sample_id", "accession", "reference", "service_date", "donor")


def cells_from_right(run: Column) -> dict[str, Column]:
    """sample_id, accession and reference of a run of cells whose leftmost may be missing.

    Three cells or more are full; two are accession and reference if both have their shape,
    else sample and accession; one is an accession if it has the shape, else a sample.
    """
    parts = F.filter(F.split(T.strip(run), r"\s{2,}"), lambda x: x != "")
    n, first, second = F.size(parts), F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    is_accession = F.coalesce(first.rlike(ACCESSION), F.lit(False))
    no_sample = is_accession & F.coalesce(second.rlike(REFERENCE), n == 1)
    from_end = lambda k: F.get(parts, n - k)
    full = n >= 3
    return {
        "sample_id": F.when(full, F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 2, F.lit(0))), " ")).when(no_sample, "").otherwise(first),
        "accession": F.when(full, from_end(2)).when(no_sample, first).otherwise(F.coalesce(second, F.lit(""))),
        "reference": F.when(full, from_end(1)).when(no_sample, F.coalesce(second, F.lit(""))).otherwise(""),
    }


def _moneyless(ctx: Context) -> Column:
    return ~ctx.line.rlike(ON_LINE)


def _donor_cell(name: str) -> Callable[[Context], Column]:
    return lambda ctx: cells_from_right(ctx.group(2))[name]


def _wrap_target(ctx: Context) -> Column:
    """Values stand left of their own labels here, so a wrap belongs to the donor from ten places before the label on."""
    at = F.position(F.lit(DONOR_LABEL), F.coalesce(ctx.header_line, F.lit(""))) - 1
    indent = F.length(ctx.line) - F.length(F.regexp_replace(ctx.line, r"^\s+", ""))
    return F.when((at >= 0) & (indent >= at - 10), "donor").otherwise("sample_id")


def _grid_cells(code: int, more: dict) -> dict:
    lab = lambda ctx: F.regexp_replace(ctx.group(code + 2), r"^\*+", "")
    return {"code": code, "description": code + 1, "lab_code": lab} | more


def _patient_part(ctx: Context) -> Column:
    cell = F.try_element_at(T.slice_columns(ctx.line, T.column_offsets(ctx.header_line, GRID_LABELS)), F.lit("ITEM/PATIENT"))
    own = F.nullif(ctx.group(1), F.lit(""))
    return F.when(own.isNotNull(), F.coalesce(F.nullif(cell, F.lit("")), own))


def _stub_amount(ctx: Context) -> Column:
    v = ctx.amount(2)
    return F.when(ctx.group(3) == "CR", (-v).cast(AMOUNT)).otherwise(v)


RULES = (
    *[Rule(name, "column_header", pattern) for name, pattern in HEADERS.items()],
    Rule("page_header_field", "header_field", "|".join(PAGE_FIELDS)),
    Rule("boilerplate", "ignorable", "|".join(NOISE)),
    # samples
    Rule("detail_location_total", "section_subtotal", LOCATION_TOTAL, zones=(DETAIL,), nums={"amount": 3, "samples": 2}, fields={"location": 1}),
    Rule("detail_account_total", "group_subtotal", ACCOUNT_TOTAL, zones=(DETAIL,), nums={"amount": 3, "samples": 2}, fields={"account": 1}),
    Rule("detail_total_samples_billed", "invoice_subtotal", TOTAL_BILLED, zones=(DETAIL,), nums={"amount": 2, "samples": 1}),
    Rule("location_header", "section_header", LOCATION, zones=(DETAIL, SUMMARY), fields={"location": 1}),
    Rule("detail_donor_row", "section_header", DONOR, zones=(DETAIL,), fields={"ssn": 1, "service_date": 3, "donor": 4} | {n: _donor_cell(n) for n in ("sample_id", "accession", "reference")}),
    # wrapped cells first: charges look past them, and no line is both
    Rule("detail_cell_continuation", "continuation", CELL_WRAP, zones=(DETAIL,), guard=_moneyless, fields={"text": 1, "target": _wrap_target}, anchor=Anchor(frozenset(), BETWEEN, first_only=True, rules=SAMPLE)),
    Rule("detail_charge", "charge", CHARGE, zones=(DETAIL,), nums={"amount": 3}, fields={"code": 1, "description": 2}, anchor=Anchor(frozenset({"charge"}), BETWEEN | {"continuation"}, rules=SAMPLE)),
    # the summary: every amount is printed again
    Rule("summ_account_product_total", "restatement", SUMM_PRODUCTS, zones=(SUMMARY,), nums={"amount": 2}, fields={"account": 1}),
    Rule("summ_location_total", "restatement", SUMM_LOCATION_TOTAL, zones=(SUMMARY,), nums={"amount": 3, "samples": 2}, fields={"location": 1}),
    Rule("summ_account_total", "restatement", SUMM_ACCOUNT_TOTAL, zones=(SUMMARY,), nums={"amount": 3, "samples": 2}, fields={"account": 1}),
    Rule("summ_grand_samples", "restatement", SUMM_GRAND, zones=(SUMMARY,), nums={"amount": 2, "samples": 1}),
    Rule("invoice_total", "grand_total", INVOICE_TOTAL, zones=(SUMMARY,), nums={"amount": 1}),
    Rule("summ_location_item", "row_count", SUMM_LOCATION_ITEM, zones=(SUMMARY,), nums={"tests": 4}, fields={"location": 1, "code": 2, "description": 3}),
    Rule("summ_item", "row_count", SUMM_ITEM, zones=(SUMMARY,), nums={"tests": 3}, fields={"code": 1, "description": 2}),
    # products
    Rule("prod_shipped_to", "section_header", SHIPPED, zones=(PRODUCTS,), fields={"order_account": 1, "purchase_order": 2}),
    Rule("prod_order_total", "section_subtotal", ORDER_TOTAL, zones=(PRODUCTS,), nums={"amount": 1}),
    Rule("prod_total_product_charges", "group_subtotal", PRODUCTS_TOTAL, zones=(PRODUCTS,), nums={"amount": 1}),
    Rule("prod_charge", "charge", PRODUCT, zones=(PRODUCTS,), nums={"amount": 5}, fields={"code": 1, "description": 2, "quantity": 3, "unit_price": 4}),
    Rule("account_header", "section_header", ACCOUNT, zones=(DETAIL, SUMMARY), fields={"account": 1, "account_name": 2}),
    # the grid; lines of a container's roll-up stay unclassified on purpose
    Rule("grid_current_period_subtotal", "invoice_subtotal", GRID_SUBTOTAL, zones=(CURRENT,), nums={"amount": 1}),
    Rule("grid_current_period_total", "grand_total", GRID_TOTAL, zones=(CURRENT,), nums={"amount": 1}),
    Rule("grid_charge_parent", "charge", GRID_PARENT, zones=(CURRENT,), nums={"amount": 7}, fields=_grid_cells(4, {"service_date": 1, "donor": 2, "accession": 3})),
    Rule("grid_charge_child", "charge", GRID_CHILD, zones=(CURRENT,), nums={"amount": 5}, fields=_grid_cells(2, {"patient_id_part": _patient_part}), anchor=Anchor(frozenset({"charge"}), BETWEEN | {"continuation"}, through=GRID)),
    Rule("grid_patient_id_continuation", "continuation", GRID_WRAP, zones=(CURRENT,), guard=_moneyless, fields={"text": 1}, anchor=Anchor(frozenset({"charge"}), BETWEEN | {"continuation"}, through=GRID)),
    Rule("performing_lab_index_row", "ignorable", LAB_INDEX, zones=(CURRENT, PRIOR)),
    # the payment stub and other pages without charges
    Rule("remit_stub_row", "restatement", STUB_ROW, zones=(STUB,), nums={"amount": _stub_amount}, fields={"stub_invoice": 1, "ap_note": lambda ctx: F.regexp_replace(ctx.group(4), r"^[ _]+|[ _]+$", "")}),
    Rule("total_amount_due_decoy", "ignorable", AMOUNT_DUE, zones=(STUB,)),
    Rule("aging_buckets_decoy", "ignorable", AGING, zones=(STUB,)),
    Rule("orphan_amount_column_value", "ignorable", LONE_AMOUNT, zones=(STUB, STATEMENT)),
    Rule("statement_account_balance", "ignorable", BALANCE, zones=(STATEMENT,)),
    Rule("statement_ledger_entry", "ignorable", LEDGER, zones=(STATEMENT,)),
    Rule("prior_period_balance", "ignorable", PRIOR_BALANCE, zones=(PRIOR,)),
    Rule("prior_period_entry", "ignorable", PRIOR_ENTRY, zones=(PRIOR,)),
    Rule("page_letterhead", "ignorable", r"^.+$", guard=lambda ctx: _moneyless(ctx) & ~ctx.seen_header_on_page),
    Rule("prod_ship_to_block", "ignorable", r"^.+$", zones=(PRODUCTS,), guard=_moneyless),
    Rule("non_charge_page", "ignorable", r"^.+$", zones=(STUB, STATEMENT, PRIOR)),
)


def _text(key: str) -> Column:
    return F.coalesce(F.try_element_at("fields", F.lit(key)), F.lit(""))


def _with_fields(rows: DataFrame, forced: dict[str, Column], absent: dict[str, Column]) -> DataFrame:
    return rows.withColumn("fields", folds.fields_with(forced, absent))


def _zone_keys(rows: DataFrame) -> DataFrame:
    """Numbers accounts, locations and orders within their zone, and carries their names onto the rows below.

    Numbered keys serve checks within a zone, as a printed number may recur; the printed
    names join the two independent streams of detail and summary.
    """
    upto = Window.partitionBy("doc_id", "zone").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.col("kind") == "section_header"
    is_account = head & (_text("account") != "")
    is_location = head & ~is_account & (_text("location") != "")
    is_order = F.coalesce(F.col("rule") == "prod_shipped_to", F.lit(False))
    latest = lambda when, value: F.coalesce(F.last(F.when(when, value), ignorenulls=True).over(upto), F.lit(""))
    number = lambda letter, when: F.concat(F.lit(letter), F.sum(when.cast("int")).over(upto))
    detail, summary, products = (F.col("zone") == z for z in (DETAIL, SUMMARY, PRODUCTS))
    account, location = latest(is_account, _text("account")), latest(F.when(detail, is_location).otherwise(_text("location") != ""), _text("location"))
    both = detail | summary
    out = rows.withColumns({"_account": account, "_location": location, "_name": latest(is_account, _text("account_name")), "_a": number("a", is_account), "_l": number("l", is_location), "_o": number("o", is_order), "_buyer": latest(is_order, _text("order_account")), "_po": latest(is_order, _text("purchase_order"))})
    natural = F.concat_ws("/", "_account", "_location")
    forced = {
        "account_key": F.when(detail, F.col("_a")), "location_key": F.when(detail, F.col("_l")), "account_nat": F.when(both, F.col("_account")), "location_nat": F.when(both, natural),
        "order_key": F.when(products, F.col("_o")), "code_key": F.when(both & (_text("code") != ""), F.concat_ws("|", natural, _text("code"))),
    }
    absent = {
        "account_number": F.when(both, F.col("_account")).when(products, F.col("_buyer")), "account_name": F.when(detail, F.col("_name")), "location": F.when(detail, F.col("_location")),
        "purchase_order": F.when(products, F.col("_po")), "order_account": F.when(products, F.col("_buyer")),
    }
    return _with_fields(out, forced, absent).select(*rows.columns)


def _carry_samples(rows: DataFrame) -> DataFrame:
    """A sample's cells onto its charges, its wrapped cell folded in; any other heading ends the sample."""
    order = Window.partitionBy("doc_id").orderBy("page", "line_no")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.col("kind") == "section_header"
    is_sample = F.coalesce(F.col("rule") == "detail_donor_row", F.lit(False))
    wraps = (F.col("kind") == "continuation") & (F.col("zone") == DETAIL)
    mark = F.when(head | wraps, F.struct(wraps.alias("wraps"), _text("text").alias("text"), _text("target").alias("target")))
    out = rows.withColumn("_mark", mark).withColumn("_next", F.expr("lead(_mark) IGNORE NULLS OVER (PARTITION BY doc_id ORDER BY page, line_no)"))
    # the first wrap before the next heading, found at the heading and carried down with the sample
    own = F.struct(F.when(is_sample, F.col("fields")).alias("sample"), F.when(F.col("_next.wraps"), F.col("_next")).alias("wrap"))
    out = out.withColumn("_held", F.last(F.when(head, own), ignorenulls=True).over(upto)).withColumns({"_sample": F.col("_held.sample"), "_wrap": F.col("_held.wrap")})

    def cell(name: str) -> Column:
        own = F.coalesce(F.try_element_at("_sample", F.lit(name)), F.lit(""))
        return F.when(F.col("_wrap.target") == name, F.trim(F.concat(own, F.lit(" "), F.col("_wrap.text")))).otherwise(own)

    mine = F.col("_sample").isNotNull() & (F.col("zone") == DETAIL)
    charge = mine & (F.col("kind") == "charge")
    forced = {n: F.when(is_sample, cell(n)) for n in ("sample_id", "donor")}
    return _with_fields(out, forced, {n: F.when(charge, cell(n)) for n in SAMPLE_CELLS}).select(*rows.columns)


def _carry_patients(rows: DataFrame) -> DataFrame:
    """The grid: a patient's cells onto further charges; pieces of the patient's number, blank between, onto the first."""
    upto = Window.partitionBy("doc_id").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_parent = F.coalesce(F.col("rule") == "grid_charge_parent", F.lit(False))
    grid = (F.col("kind") == "charge") & (F.col("zone") == CURRENT)
    out = rows.withColumn("_p", F.sum(is_parent.cast("int")).over(upto))
    piece = F.when(grid, _text("patient_id_part")).when(F.col("kind") == "continuation", _text("text"))
    listed = Window.partitionBy("doc_id", "_p").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    above = {n: F.when(grid & ~is_parent & (F.col("_p") > 0), F.coalesce(F.last(F.when(is_parent, _text(n)), ignorenulls=True).over(upto), F.lit(""))) for n in ("donor", "service_date", "accession")}
    out = out.withColumns({f"_{n}": c for n, c in above.items()}).withColumn("_pieces", F.collect_list(F.nullif(piece, F.lit(""))).over(listed))
    detail = F.when(grid, F.when(is_parent, F.array_join("_pieces", " ")).otherwise(""))
    return _with_fields(out, {"patient_detail": detail}, {n: F.col(f"_{n}") for n in above}).select(*rows.columns)


def _own_stub(rows: DataFrame) -> DataFrame:
    """The payment stub names every open invoice: the line with this document's own number is the one to check."""
    whole = Window.partitionBy("doc_id")
    number = F.nullif(F.regexp_extract("raw", INVOICE_LINE, 1), F.lit(""))
    out = rows.withColumn("_own", F.min(F.when(number.isNotNull(), F.struct("page", "line_no", number.alias("n")))).over(whole)["n"])
    own = F.coalesce(F.col("rule") == "remit_stub_row", F.lit(False)) & (_text("stub_invoice") == F.col("_own"))
    return _with_fields(out, {"stub_key": F.when(own, "self")}, {}).select(*rows.columns)


def _refuse_containers(rows: DataFrame) -> DataFrame:
    """Marks every row of a document with several invoice totals and adds one unclassified row that says so.

    Checks leave marked rows out, so none applies and the document cannot be verified.
    """
    order = Window.partitionBy("doc_id").orderBy("page", "line_no")
    whole, upto = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.col("kind") == "grand_total"
    out = rows.withColumns({"_n": F.count_if(total).over(whole), "_nth": F.count_if(total).over(upto), "_sum": F.sum(F.when(total, F.try_element_at("nums", F.lit("amount")))).over(whole).cast(AMOUNT)})
    out = _with_fields(out, {"container": F.when(F.col("_n") > 1, "true")}, {})
    # the row that says so stands where the second total does
    twice = F.when((F.col("_n") > 1) & total & (F.col("_nth") == 2), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    out = out.withColumn("_added", F.explode(twice))
    note = F.format_string("container of %d invoices whose totals add up to %s: split it before it is extracted", F.col("_n"), F.col("_sum").cast("string"))
    values = {
        "raw": note, "kind": F.lit("unclassified"), "rule": F.lit("container_document"), "fields": F.create_map(F.lit("container"), F.lit("true")),
        "nums": F.expr(f"cast(map() as map<string,{AMOUNT}>)"), "row_error": F.lit(False),
    }
    return out.select(*[F.when(F.col("_added"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns])


def _keys(rows: DataFrame) -> DataFrame:
    return reduce(lambda df, step: step(df), (_zone_keys, _carry_samples, _carry_patients, _own_stub, _refuse_containers), rows)


def _where(condition: Callable[[], Column] = lambda: F.lit(True)) -> Callable[[], Column]:
    """The condition, outside of containers."""
    return lambda: (_text("container") == "") & condition()


def _in(zone: str) -> Column:
    return F.col("zone") == zone


def _rule(name: str) -> Column:
    return F.coalesce(F.col("rule") == name, F.lit(False))


def _samples_or(kind: str) -> Callable[[], Column]:
    return _where(lambda: _in(DETAIL) & (_rule("detail_donor_row") | (F.col("kind") == kind)))


def _detail_or(other: Callable[[], Column], kinds: str = "charge") -> Callable[[], Column]:
    return _where(lambda: ((F.col("kind") == kinds) & _in(DETAIL)) | other())


def _summary_total(name: str) -> Callable[[], Column]:
    return lambda: _rule(name)


CHECKS = (
    Check("detail_location_total", ("charge",), "section_subtotal", group_by="location_key", where=_where(lambda: _in(DETAIL))),
    Check("detail_account_total", ("charge",), "group_subtotal", group_by="account_key", where=_where(lambda: _in(DETAIL))),
    Check("detail_total_samples_billed", ("charge",), "invoice_subtotal", where=_where(lambda: _in(DETAIL)), required=False),
    Check("samples_per_location", ("section_header",), "section_subtotal", mode="count", printed_field="samples", group_by="location_key", where=_samples_or("section_subtotal")),
    Check("samples_per_account", ("section_header",), "group_subtotal", mode="count", printed_field="samples", group_by="account_key", where=_samples_or("group_subtotal")),
    Check("samples_billed_count", ("section_header",), "invoice_subtotal", mode="count", printed_field="samples", where=_samples_or("invoice_subtotal"), required=False),
    Check("product_order_total", ("charge",), "section_subtotal", group_by="order_key", where=_where(lambda: _in(PRODUCTS))),
    Check("product_charges_total", ("charge",), "group_subtotal", group_by="order_key", where=_where(lambda: _in(PRODUCTS))),
    Check("summary_restates_location", ("charge",), "restatement", group_by="location_nat", where=_detail_or(_summary_total("summ_location_total"))),
    Check("summary_restates_account", ("charge",), "restatement", group_by="account_nat", where=_detail_or(_summary_total("summ_account_total"))),
    Check("summary_grand_samples", ("charge",), "restatement", where=_detail_or(_summary_total("summ_grand_samples")), required=False),
    Check("summary_grand_sample_count", ("section_header",), "restatement", mode="count", printed_field="samples", where=_where(lambda: _rule("detail_donor_row") | _rule("summ_grand_samples")), required=False),
    Check("summary_tests_per_code", ("charge",), "row_count", mode="count", printed_field="tests", group_by="code_key", where=_detail_or(lambda: F.col("kind") == "row_count")),
    Check("summary_product_total", ("charge",), "restatement", where=_where(lambda: ((F.col("kind") == "charge") & _in(PRODUCTS)) | _rule("summ_account_product_total"))),
    Check("current_period_subtotal", ("charge",), "invoice_subtotal", where=_where(lambda: _in(CURRENT))),
    Check("grand_total", ("charge",), "grand_total", where=_where()),
    Check("remit_stub_balance", ("charge",), "restatement", where=_where(lambda: (F.col("kind") == "charge") | (_text("stub_key") == "self"))),
)

TWO_TEMPLATES = Layout(
    name="two_templates",
    header="|".join(HEADERS.values()),
    zones=ZONES,
    rules=RULES,
    checks=CHECKS,
    header_fields={
        "invoice_number": rf"^\s*[0-9]{{6,9}}\s+([0-9]{{6,9}})\s+{DATE}\b",
        "account_number": rf"^\s*([0-9]{{6,9}})\s+(?:[0-9]{{6,9}}|SUMMARY)\s+{DATE}\b",
        "invoice_date": rf"^\s*[0-9]{{6,9}}\s+(?:[0-9]{{6,9}}|SUMMARY)\s+({DATE})\b",
        "bill_to_account": r"^\s*Account Number:?\s+([0-9]+)\b",
    },
    line_item_fields=(
        "account_number", "account_name", "location", "purchase_order", "order_account", "code", "description", "quantity", "unit_price",
        "ssn", "sample_id", "accession", "reference", "service_date", "donor", "patient_detail", "lab_code",
    ),
    identity_fields=("invoice_number", "account_number"),
    postprocess=_keys,
)
