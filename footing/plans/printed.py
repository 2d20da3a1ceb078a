"""Invoices of every layout printed from order tables, so that what is read back can be checked by SQL.

Each function gives the lines (doc_id, page, line_no, line) of one invoice an order.  Orders
whose number ends in 3 print a total that is off by a cent.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footing.functions.money import AMOUNT
from footing.plans import layouts
from footing.plans.registry import layout
from footing.tables import discard, durable

L = F.lit


def _amount(text: str) -> Column:
    return L(text).cast(AMOUNT)


def shown(value: Column | str) -> Column:
    return F.format_number(value, 2)


class Orders:
    """Items (k, n, f, p, q, v) numbered by flag and part, their sums by order (k, s, c, off) and by flag."""

    def __init__(self, lineitem: DataFrame) -> None:
        item = lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("f"), F.col("l_partkey").alias("p"), F.col("l_quantity").cast("long").alias("q"), F.col("l_extendedprice").cast(AMOUNT).alias("v"))
        # every kind of line reads them
        self.items = durable(item.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("f", "p", "v", "q"))), "items")
        off = F.when(F.col("k") % 10 == 3, _amount("0.01")).otherwise(_amount("0.00"))
        sums = lambda *by: self.items.groupBy(*by).agg(F.sum("v").cast(AMOUNT).alias("s"), F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
        self.sums = sums("k").withColumn("off", off)
        self.flags = sums("k", "f")


def line(df: DataFrame, page: int, at: Column | int, *texts: Column | str) -> DataFrame:
    place = L(at) if isinstance(at, int) else at
    parts = [L(t) if isinstance(t, str) else t for t in texts]
    return df.select(F.col("k").alias("doc_id"), L(page).alias("page"), place.cast("int").alias("line_no"), F.concat(*[p.cast("string") for p in parts]).alias("line"))


def page_of(df: DataFrame, page: int, *lines: tuple) -> list[DataFrame]:
    """Lines one below the other, each a tuple of texts."""
    return [line(df, page, k, *texts) for k, texts in enumerate(lines)]


def together(rows: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rows)


def rate_table(o: Orders) -> DataFrame:
    total = F.col("s") + F.col("off") + _amount("1.25")
    rows = page_of(o.sums, 1, ("Some Vendor   PAY HERE",), ("Bill To   1/31/2024   ", F.col("k") + 100_000), ("Net 30 3/1/2024",), (" Quantity Description                 Rate      Amount",))
    rows.append(line(o.items, 1, F.col("n") + 10, "  ", F.col("q"), " Part ", F.col("p"), "      0.11    ", shown("v")))
    rows += page_of(
        o.sums, 2, ("PLEASE NOTE OUR REMITTANCE ADDRESS:   Total   $", shown(total)), ("                 $1.25",), ("        Sales Tax (6.25%)",),
        ("Po Box 77    Payments/Credits Applied   -$1.00",), ("     Balance Due      $", shown(total - _amount("1.00"))),
    )
    return together(rows)


def two_fees(o: Orders) -> DataFrame:
    fees = F.col("c") * _amount("4.50")
    court = F.col("s") + F.col("off")
    rows = page_of(
        o.sums, 1, ("Letterhead of someone",), ("Invoice: ", F.col("k")), ("     Names: 2     Search Fees    $", shown(fees)), ("     AKAs: 1      Court Fees    $", shown(court)),
        ("     Total Searches: ", F.col("c"), "    TOTAL DUE   $", shown(court + fees)), ("County       Type  Reference       LAST      FIRST     Middle    Request  Code  Result",),
    )
    cells = [F.rpad(x, n, " ") for x, n in ((L("Kings"), 13), (L("FC"), 6), (F.col("p").cast("string"), 16), (L("DOE"), 10), (L("ANN"), 10), (L("M"), 10), (L("1/2/24"), 9), (L("A"), 6), (L("Clear"), 8))]
    rows.append(line(o.items, 1, F.col("n") * 3 + 10, *cells, "$", shown("v"), "   $4.50"))
    rows.append(line(o.items, 1, F.col("n") * 3 + 11, " " * 19, "7"))
    rows.append(line(o.items, 1, F.col("n") * 3 + 12, "       Court Search Fee: $3.00"))
    return together(rows)


def unit_rates(o: Orders) -> DataFrame:
    s, tax = F.col("s") + F.col("off"), _amount("1.00")
    head = (("INVOICE",), ("Any Street     INVOICE: ", F.col("k")), (" ACCOUNT: 99",), ("   DESCRIPTIONS      Price/Rate   Quantity   Amount",))
    rows = page_of(o.sums, 1, *head)
    rows.append(line(o.items, 1, F.col("n") * 2 + 10, "Part ", F.col("p"), "| Ref #:       5.00/EA    ", F.col("q"), "    ", shown("v")))
    rows.append(line(o.items, 1, F.col("n") * 2 + 11, "      ", F.col("p")))
    rows += page_of(
        o.sums, 2, *head, ("  Someone, A Total $", F.col("s")), ("   Summary of Taxes",), ("      Ohio:   $1.00",), ("      Total:   $1.00",), (" x   Subtotal   $", shown(s)), (" x   Sales Tax   $1.00",),
        (" x   TOTAL   $", shown(s + tax)), (" REMITTANCE STUB",), (" free words of the stub",), ("x  AMOUNT:  $", shown(s + tax)),
    )
    return together(rows)


def sections(o: Orders) -> DataFrame:
    header = "EMP#/LOCK#  MATERIAL  DESCRIPTION             FREQ EXCH QTY UNIT PRICE LINE TOTAL TAX"
    rows = page_of(o.sums, 1, ("Some Laundry",), ("INVOICE # ", F.col("k"), "    INVOICE DATE 01/02/2024"), (header,))
    at = F.ascii("f") * 100
    rows.append(line(o.flags, 1, at, "DEPT: FLAG ", F.col("f")))
    rows.append(line(o.items, 1, at + F.col("n") * 2, "0001        X100      ", F.rpad(F.concat(L("PART "), F.col("p").cast("string")), 24, " "), "01   F   ", F.col("q"), "    1.25       ", shown("v"), " Y"))
    rows.append(line(o.items, 1, at + F.col("n") * 2 + 1, " " * 22, "WRAP/", F.col("p")))
    rows.append(line(o.flags, 1, at + 98, "0001   DOE, ANN   SUBTOTAL - ", shown("s")))
    rows.append(line(o.flags, 1, at + 99, "FLAG ", F.col("f"), " SUBTOTAL    ", shown("s")))
    s = F.col("s") + F.col("off")
    rows += page_of(o.sums, 2, (header,), ("SUBTOTAL    ", shown(s)), ("SALES TAX   1.00",), ("TOTAL USD   ", shown(s + _amount("1.00"))))
    return together(rows)


def summary_and_detail(o: Orders) -> DataFrame:
    search = lambda c: F.col(c) * _amount("3.00")
    whole = F.col("s") + search("c")
    rows = page_of(o.sums, 1, ("INVOICE SUMMARY",), ("Invoice Number: ", F.col("k")), ("COUNTY CRIMINAL SEARCH",), ("  OHIO         QTY   Unit Price   Tot. Fees   Total",))
    rows.append(line(o.flags, 1, F.ascii("f") + 10, "  County ", F.col("f"), "      ", F.col("c"), "    $3.00    $", shown("s"), "    $", shown(whole)))
    rows += page_of(o.sums, 2, ("Sub Total: ", F.col("c"), "   $", shown(whole)), ("Grand Total: ", F.col("c"), "   $", shown(whole)))
    rows += page_of(o.sums, 3, ("Date     Search ID   Description    Fees   Price",))
    rows.append(line(o.items, 3, F.col("n") * 3 + 1, "01/23/25   ", F.col("p"), "   Part ", F.col("p"), "  $", shown("v"), "   $3.00"))
    rows.append(line(o.items, 3, F.col("n") * 3 + 2, "      Court Fee:  $", shown("v")))
    rows.append(line(o.items, 3, F.col("n") * 3 + 3, "    LOS ANGELES, CA"))
    total = whole + F.col("off")
    rows += page_of(
        o.sums, 4, ("50130-1500-125001    Total Search Fees:   $", shown(search("c"))), ("   Total Court Fees:   $", shown("s")), ("   Credit/Payments:   (-$1.00)",),
        ("   Balance Due:   $", shown(total - _amount("1.00"))), ("   Grand Total:   $", shown(total)),
    )
    return together(rows)


def regrouped(o: Orders) -> DataFrame:
    s, tax = F.col("s") + F.col("off"), _amount("1.00")
    rows = page_of(
        o.sums, 1, ("Letterhead",), ("Customer Number: 77   Invoice Number: ", F.col("k")), ("  Account Summary",), ("  Previous Account Balance   $5.00",), ("  Current Invoice Subtotal   $", shown(s)),
        ("  Current Tax Subtotal   $1.00",), ("  Current Invoice Total   $", shown(s + tax)), ("  Total Account Balance:   $", shown(s + tax + _amount("5.00"))),
    )
    head = ("      Description    Quantity   Unit Amount     Amount",)
    rows += page_of(o.sums, 2, ("SERVICE SUMMARY",), head, ("ALL LOCATIONS 50130-1500",), ("        113000-004",))
    row = lambda code: ("118  Part ", F.col("p"), code, "    ", F.format_number("q", 0), "  0.09000   $", shown("v"))
    rows.append(line(o.items, 2, F.col("n") * 2 + 10, *row(" 50130-004")))
    rows += page_of(o.sums, 3, head, ("Service Summary Total",), ("         $", shown("s")))
    rows.append(line(o.flags, 3, F.ascii("f") * 100, "County ", F.col("f"), " from 01/01/2025-01/31/2025"))
    rows.append(line(o.items, 3, F.ascii("f") * 100 + F.col("n") * 2, *row("")))
    rows += page_of(o.sums, 4, ("Location:000.  Total   $", shown("s")), ("Service Summary Total   $", shown("s")), ("Service Subtotal   $", shown("s")))
    rows += page_of(
        o.sums, 5, ("TAX SUMMARY",), ("Jurisdiction   Product    Rate   Non-Taxable Amount  Taxable Amount  Total",), ("PUBLIC TRANSPORTATION   1 - Search   0.065   $", shown("s"), "  $0.00  $1.00"),
        ("BENEFIT AREA",), ("Tax Subtotal   $1.00",), ("CURRENT INVOICE TOTAL   $", shown(s + tax)), ("**** Intentionally left blank****",),
    )
    return together(rows)


def two_templates(o: Orders) -> DataFrame:
    """Orders whose number ends in 7 print a second invoice total: containers."""
    number, two = F.col("k") + 1_000_000, _amount("2.00")
    wide = " " * 25
    rows = page_of(o.sums, 1, ("ACCOUNT NUMBER   INVOICE",), ("  123456  SUMMARY  01/31/26",), ("   ", number, "   $", shown(F.col("s") + two), "   ____"), ("   9999999   $7.00   Need invoice",), ("  $1.00  $2.00  $3.00  $4.00",))
    rows += page_of(o.sums, 2, ("   Sample Detail",), ("  123456  ", number, "  01/31/26  2",), ("     SS#    SAMPLE ID/ACCESSION #    REFERENCE # / DATE       DONOR / DESCRIPTION     AMOUNT",), ("ACCOUNT: 55 Some Account",))
    at = F.ascii("f") * 100
    rows.append(line(o.flags, 2, at, "LOCATION: L", F.col("f")))
    item = at + F.col("n") * 3
    rows.append(line(o.items, 2, item, "123-45-6789   ID", F.col("p"), "   ", F.col("p") + 1_000_000_000, "   ABCDEFGHIJKL   01/02/24   DOE JOHN"))
    rows.append(line(o.items, 2, item + 1, "          MCEL"))
    rows.append(line(o.items, 2, item + 2, wide, "D", F.col("p"), " Part ", F.col("p"), "    $", shown("v")))
    rows.append(line(o.flags, 2, at + 99, "LOCATION TOTAL: L", F.col("f"), "   SAMPLES: ", F.col("c"), "   $", shown("s")))
    rows += page_of(o.sums, 3, ("ACCOUNT TOTAL: 55   SAMPLES: ", F.col("c"), "   $", shown("s")), ("      TOTAL SAMPLES BILLED: ", F.col("c"), "   $", shown("s")))
    rows += page_of(o.sums, 4, ("   Charges for Products",), ("   ITEM   DESCRIPTION   QUANTITY   UNIT PRICE   AMOUNT",), ("SHIPPED TO: 55  PO9",), ("Some Street",), ("P1 Cup    2    $1.00    $2.00",), ("    ORDER TOTAL:   $2.00",), ("    TOTAL PRODUCT CHARGES:   $2.00",))
    rows += page_of(o.sums, 5, ("   Current Period Summary",), ("    TEST   DESCRIPTION   TESTS   SAMPLES   AMOUNT",), ("ACCOUNT: 55 Some Account",))
    rows.append(line(o.flags, 5, at, "LOCATION: L", F.col("f")))
    codes = o.items.groupBy("k", "f", "p").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n"))
    rows.append(line(codes, 5, at + F.col("n"), wide, "D", F.col("p"), " Part ", F.col("p"), "    ", F.col("c")))
    rows.append(line(o.flags, 5, at + 99, "LOCATION TOTAL: L", F.col("f"), "   ", F.col("c"), "   $", shown("s")))
    rows += page_of(
        o.sums, 6, ("ACCOUNT TOTAL: 55   TOTAL SAMPLES: ", F.col("c"), "   $", shown("s")), ("ACCOUNT: 55   TOTAL PRODUCT CHARGES   $2.00",), (wide, "TOTAL SAMPLES: ", F.col("c"), "   $", shown("s")),
        ("    INVOICE TOTAL   $", shown(F.col("s") + F.col("off") + two)),
    )
    rows.append(line(o.sums.where("k % 10 = 7"), 6, 9, "    INVOICE TOTAL   $1.00"))
    return together(rows)


def statement_grid(o: Orders) -> DataFrame:
    """The second template of two: a patient's first charge bears its cells, further ones a piece of its number, which wraps."""
    number = F.col("k") + 1_000_000
    rows = page_of(o.sums, 1, ("ACCOUNT NUMBER   INVOICE NUMBER   DATE",), ("  123456  ", number, "  01/31/26  1",), ("   9999999   $7.00   Need invoice",), ("   ", number, "   $", shown("s"), "   ____"))
    rows += page_of(o.sums, 2, ("   *  *  *   CURRENT PERIOD ACTIVITY   *  *  *",), ("  DATE     ITEM/PATIENT      NUMBER     DESCRIPTION      CODES    AMOUNT",))
    items = o.items.withColumn("r", F.row_number().over(Window.partitionBy("k", "f").orderBy("n")))
    at = F.ascii("f") * 100 + F.col("n") * 2
    charge = ("D", F.col("p"), " Part ", F.col("p"))
    rows.append(line(items.where("r = 1"), 2, at, "  01/02/24 DOE JOHN   ACC", F.col("f"), "   ", *charge, "    *MB    ", shown("v")))
    rows.append(line(items.where("r > 1"), 2, at, " " * 11, F.rpad(F.concat(L("X"), F.col("p").cast("string")), 18, " "), *charge, "    MB    ", shown("v")))
    rows.append(line(items.where("r > 1"), 2, at + 1, " " * 11, "Y", F.col("p")))
    rows += page_of(o.sums, 3, ("     Current Period Subtotal    ", shown("s")), ("     CURRENT PERIOD TOTAL    ", shown(F.col("s") + F.col("off"))))
    return together(rows)


#: Layout -> how it is printed.
PRINTED: dict[str, Callable[[Orders], DataFrame]] = {f.__name__: f for f in (rate_table, two_fees, unit_rates, sections, summary_and_detail, regrouped, two_templates)}


def on_paper(lineitem: DataFrame, how: Callable[[Orders], DataFrame]) -> DataFrame:
    """The printed lines as a table; those that they are made from are deleted."""
    orders = Orders(lineitem)
    lines = durable(how(orders), "printed", tidy=True)
    discard(orders.items)
    return lines


def read_back(lineitem: DataFrame, name: str, texts: tuple[str, ...], how: Callable[[Orders], DataFrame] | None = None) -> DataFrame:
    """doc_id, identity, verified, depth, items, computed_total, size (characters of the items' ``texts``) of printed invoices."""
    lines = on_paper(lineitem, how or PRINTED[name])
    out = layouts.run(lines, layout(name))
    discard(lines)
    size = sum((F.length(F.coalesce(t, L(""))) for t in texts), L(0))
    items = out["items"].groupBy("doc_id").agg(F.sum(size).alias("size"))
    verdict = out["verdicts"].select("doc_id", "verified", "depth", "items", "computed_total")
    return verdict.join(items, "doc_id").join(out["heads"].select("doc_id", "identity"), "doc_id")
