from footing.plans import layouts as L
from footing.plans.two_templates import TWO_TEMPLATES, cells_from_right
from footing.sources.documents import to_lines, to_pages

RATE = """Some Vendor                         PAY HERE
Bill To                 1/31/2024   12345
Net 30 3/1/2024
 Quantity Description                              Rate      Amount
    9,890 Multistate Search                        0.11    1,087.90
        1 Sales Tax row                           12.50       12.50
          Flat fee                                 5.00        5.00
PLEASE NOTE OUR REMITTANCE ADDRESS:   Total          $1,125.40
                                       $20.00
                          Sales Tax (6.25%)
Po Box 77            Payments/Credits Applied   -$25.40
                         Balance Due      $1,100.00"""

FEES = """Letterhead of someone
Invoice: 889-B
            Names: 2     Search Fees    $9.00
            AKAs: 1      Court Fees    $18.00
            Total Searches: 2    TOTAL DUE   $27.00
County       Type  Reference       LAST      FIRST     Middle    Request  Code  Result
                                                                   Date            Fees  Fee
Kings        FC    39291945.115    DOE       ANN       MARIE     1/2/24   A     Clear   $18.00   $4.50
                   7                                   LUISE
       Court Search Fee: $3.00
       File Pull Fee: $15.00
Queens       FC    cbc 7178537     ROE       BOB                 1/3/24   A     Clear   $0.00   $4.50
                   8812345
Page 1 of 1"""

UNITS = """INVOICE
Any Street     INVOICE: 0126-77
 ACCOUNT: 99
   DESCRIPTIONS      Price/Rate   Quantity   Amount
VOE for SOMEONE| Ref #:       10.00/FL    1    10.00
      12905023
B
Long name at The               5.00/EA    2    10.00
\fINVOICE
Any Street     INVOICE: 0126-77
   DESCRIPTIONS      Price/Rate   Quantity   Amount
      Stop Market | Ref
      #: 7
Last one                       1.25/EA    2    2.50
  Someone, A Total $22.5
   ------
   Summary of Taxes
      Ohio:   $1.00
      Total:   $1.00
 x   Subtotal   $22.50
 x   Sales Tax   $1.00
 x   TOTAL   $23.50
 REMITTANCE STUB
 free words of the stub
x  AMOUNT:  $23.50"""


SECTIONS = """Some Laundry
INVOICE # 4711    INVOICE DATE 01/02/2024
EMP#/LOCK#  MATERIAL  DESCRIPTION             FREQ EXCH QTY UNIT PRICE LINE TOTAL TAX
DEPT: FRONT
0001        X100      SHIRT BLUE        L       01   F   2    1.250      2.50 Y
0001        X200      PANTS                     01       1    3.00       3.00 Y
                      LONG/NAVY
0001   DOE, ANN   SUBTOTAL - 5.50
            M300      SHOP TOWEL                D        10   0.10       1.00 N
            PREP ADVANTAGE      0.50 Y
FRONT SUBTOTAL    7.00
EMPLOYEE 0001 OWES 20.00 REPLACEMENT CHARGE
DEPT: BACK
0001        X100      SHIRT BLUE                01       1    1.25       1.25 Y
0001   DOE, ANN   SUBTOTAL - 1.25
\fother letterhead
EMP#/LOCK#  MATERIAL  DESCRIPTION             FREQ EXCH QTY UNIT PRICE LINE TOTAL TAX
0002        X100      SHIRT RED                 01       2    1.25       2.50 Y
0002   ROE, BOB   SUBTOTAL - 2.50
SUBTOTAL    3.75
            SERVICE CHARGE      4.00 N
SUBTOTAL    14.75
SALES TAX   1.00
TOTAL USD   15.75
SPECIAL PROGRAMS BREAKDOWN
PREP ADVANTAGE   2  0.25  0.50 Y"""


DETAIL = """INVOICE SUMMARY
Invoice Number: 5075
COUNTY CRIMINAL SEARCH
  OHIO         QTY   Unit Price   Tot. Fees   Total
  Franklin      2    $3.00    $2.00    $8.00
    County
  Hamilton      1    $3.00    $0.00    $3.00
Sub Total: 3   $11.00
TEST
Page 1 of 3
\f  QTY   Unit Price   Tot. Fees   Total
  1  $0.00  $0.00  $0.00
Sub Total: 1  $0.00
Grand Total: 4   $11.00
\fDate     Search ID   Description    Fees   Price
01/23/25   4939259   One county  $2.00   $3.00
      Court Fee:  $2.00
    LOS ANGELES, CA
01/24/25   4939260        $0.00   $3.00
Page 3 of 3
      Late   Name
01/24/25   4939261   Two  $0.00   $3.00
01/24/25   4939262   Free  $0.00   $0.00
50130-1500-125001    Total Search Fees:   $9.00
   Total Court Fees:   $1.50
   All Other Fees:   $0.50
   Credit/Payments:   (-$1.00)
   Balance Due:   $10.00
   Grand Total:   $11.00"""


def run(spark, text, layout):
    lines = to_lines(to_pages(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    out = L.run(lines, layout)
    v = out["verdicts"].first()
    assert v["verified"], (v, out["rows"].where("kind = 'unclassified'").collect(), out["results"].collect())
    return v, out["items"].orderBy("page", "line_no").collect(), out["heads"].first()


def test_rate_table(spark):
    v, items, head = run(spark, RATE, L.RATE_TABLE)
    assert v["depth"] == 2
    assert [(i["quantity"], i["description"], i["rate"], str(i["amount"]), i["is_tax_row"]) for i in items] == [
        ("9,890", "Multistate Search", "0.11", "1087.90", "false"),
        ("1", "Sales Tax row", "12.50", "12.50", "true"),
        ("", "Flat fee", "5.00", "5.00", "false"),
    ]
    assert (head["identity"], head["terms"], head["sales_tax_rate"]) == ("12345", "Net 30", "6.25")


def test_two_fees(spark):
    v, items, head = run(spark, FEES, L.TWO_FEES)
    assert v["depth"] == 4 and head["identity"] == "889-B"
    assert [(i["county"], i["reference"], i["last_name"], i["middle_name"], str(i["amount"])) for i in items] == [
        ("Kings", "39291945.1157", "DOE", "MARIE LUISE", "22.50"),
        ("Queens", "cbc 7178537 8812345", "ROE", "", "4.50"),
    ]


def test_unit_rates(spark):
    v, items, head = run(spark, UNITS, L.UNIT_RATES)
    assert v["depth"] == 6 and head["identity"] == "0126-77"
    assert [i["description"] for i in items] == ["VOE for SOMEONE| Ref #: 12905023", "Long name at The Stop Market | Ref #: 7", "Last one"]


def test_sections(spark):
    v, items, head = run(spark, SECTIONS, L.SECTIONS)
    assert v["depth"] == 5 and head["identity"] == "4711"
    assert [(i["dept"], i["employee"], i["material"], i["description"], i["variant"], str(i["amount"])) for i in items] == [
        ("FRONT", "0001", "X100", "SHIRT BLUE", "L", "2.50"),
        ("FRONT", "0001", "X200", "PANTS LONG/NAVY", "", "3.00"),
        ("FRONT", "", "M300", "SHOP TOWEL", "", "1.00"),
        ("FRONT", "", "", "PREP ADVANTAGE", "", "0.50"),
        ("BACK", "0001", "X100", "SHIRT BLUE", "", "1.25"),
        ("BACK", "0002", "X100", "SHIRT RED", "", "2.50"),
        ("BACK", "", "", "SERVICE CHARGE", "", "4.00"),
    ]


def test_summary_and_detail(spark):
    v, items, head = run(spark, DETAIL, L.SUMMARY_AND_DETAIL)
    assert v["depth"] == 14 and head["identity"] == "5075"
    assert [(i["search_id"], i["description"], str(i["amount"])) for i in items] == [
        ("4939259", "One county LOS ANGELES, CA", "5.00"),
        ("4939260", "Late Name", "3.00"),
        ("4939261", "Two", "3.00"),
        ("4939262", "Free", "0.00"),
    ]


def test_a_changed_figure_is_caught(spark):
    lines = to_lines(to_pages(spark.createDataFrame([(1, UNITS.replace("5.00/EA    2    10.00", "5.00/EA    2    10.01"))], "doc_id long, text string")))
    v = L.run(lines, L.UNIT_RATES)["verdicts"].first()
    assert not v["verified"] and v["reasons"] == ["requester_subtotal fail", "invoice_subtotal fail"]


GRID = """   ACCOUNT NUMBER   INVOICE
  04110000  82574192  01/31/26
   82574192   $105.50   ______
  $1.00CR  $2.00  $3.00  $4.00  DUE  $9.00
   * * *  PRIOR PERIODS SUMMARY  *
  01/02/26  PAYMENT   50.00CR
   PRIOR PERIOD BALANCE   7.00
   * * *  CURRENT PERIOD ACTIVITY  *
   DATE      ITEM/PATIENT      NUMBER        DESCRIPTION        CODES   AMOUNT
  01/05/26   DOE, ANN          K123456789    708008  Panel one       *1A    50.00
             0
                               D13480  Panel two       1A    25.50
             0590616994        D13481  Panel three       1A    10.00
  01/06/26   ROE, BOB          K99    708008  Panel one       2B    20.00
   Current Period Subtotal   105.50
   CURRENT PERIOD TOTAL   105.50"""


def test_two_templates_grid(spark):
    v, items, head = run(spark, GRID, TWO_TEMPLATES)
    assert v["depth"] == 3 and head["identity"] == "82574192|04110000"
    assert [(i["donor"], i["accession"], i["code"], i["lab_code"], i["patient_detail"], str(i["amount"])) for i in items] == [
        ("DOE, ANN", "K123456789", "708008", "1A", "0 0590616994", "50.00"),
        ("DOE, ANN", "K123456789", "D13480", "1A", "", "25.50"),
        ("DOE, ANN", "K123456789", "D13481", "1A", "", "10.00"),
        ("ROE, BOB", "K99", "708008", "2B", "", "20.00"),
    ]


def test_a_container_is_refused(spark):
    lines = to_lines(to_pages(spark.createDataFrame([(1, GRID + GRID[GRID.index("\n  01/06/26") :])], "doc_id long, text string")))
    out = L.run(lines, TWO_TEMPLATES)
    v = out["verdicts"].first()
    assert not v["verified"] and v["depth"] == 0 and {r["status"] for r in out["results"].collect()} == {"not_applicable"}
    assert [r["rule"] for r in out["rows"].where("kind = 'unclassified'").collect()] == ["container_document"]


def test_cells_from_right(spark):
    cases = {
        "A MARTINEZ C  1234567890  ABCDEFGHIJ12": ("A MARTINEZ C", "1234567890", "ABCDEFGHIJ12"),
        "1234567890  ABCDEFGHIJ12": ("", "1234567890", "ABCDEFGHIJ12"),
        "ID1  1234567890": ("ID1", "1234567890", ""),
        "1234567890": ("", "1234567890", ""),
        "SOMEONE": ("SOMEONE", "", ""),
        "X  Y  1234567890  ABCDEFGHIJ12": ("X Y", "1234567890", "ABCDEFGHIJ12"),
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: (r["sample_id"], r["accession"], r["reference"]) for r in df.select("t", *[c.alias(n) for n, c in cells_from_right(df["t"]).items()]).collect()}
    assert got == cases
