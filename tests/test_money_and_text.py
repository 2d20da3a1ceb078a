from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from footing.functions import money as M
from footing.functions import text as T

CASES = [
    ("123.45", 2, "123.45"),
    ("$1,234.56", 2, "1234.56"),
    ("-$1,032.35", 2, "-1032.35"),
    ("$-1,032.35", 2, "-1032.35"),
    ("(45.00)", 2, "-45.00"),
    ("45.00-", 2, "-45.00"),
    ("1.234,56", 2, "1234.56"),
    ("$45335.1", 1, "45335.10"),
    ("$45335.1", 2, None),
    ("0.12345", 2, None),
    ("518", 2, None),
    ("(45.00", 2, "45.00"),
    ("12,5", 1, "125.00"),
    ("12,50", 2, "12.50"),
    ("1,234,567.89", 2, "1234567.89"),
    ("USD 5.00", 2, "5.00"),
    ("", 2, None),
    (None, 2, None),
    ("5.000", 2, None),
    ("a1.00", 2, None),
]


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("token", "places", "want"), CASES)
def test_parse_money(spark, token, places, want):
    got = one(spark, M.parse_money(F.col("t").cast("string"), min_decimals=places), t=token)
    assert got == (Decimal(want) if want else None)


def test_lenient_reads_ones(spark):
    assert one(spark, M.parse_money(F.col("t"), lenient=True), t="$1l.I0") == Decimal("11.10")


def test_money_tokens_have_places(spark):
    line = "  Fee 2 10.00  $1,000.50 (3.25) Y"
    hits = one(spark, M.money_tokens(F.col("t")), t=line)
    assert [(h["raw"], h["value"], h["idx"], line[h["start"] : h["end"]]) for h in hits] == [
        ("10.00", Decimal("10.00"), 2, "10.00"),
        ("$1,000.50", Decimal("1000.50"), 3, "$1,000.50"),
        ("(3.25)", Decimal("-3.25"), 4, "(3.25)"),
    ]
    assert one(spark, M.last_money(F.col("t")), t=line) == Decimal("-3.25")
    assert one(spark, M.last_money(F.col("t")), t="none") is None
    assert one(spark, M.sum_money(F.col("t")), t="none") == Decimal("0.00")


def test_shape(spark):
    assert one(spark, T.shape_of(F.col("t")), t="  Part 12   3 $1,000.50  Y ") == "W | W $ | W"  # numbers count as words once they are an N
    assert one(spark, T.shape_of(F.col("t")), t="   ") == ""


def test_columns(spark):
    header = "Item      Qty   Price"
    columns = T.column_offsets(F.lit(header), ["Price", "Item", "Qty"])
    cells = one(spark, T.slice_columns(F.col("t"), columns), t="Bolt M8   12    3.50")
    assert cells == {"Item": "Bolt M8", "Qty": "12", "Price": "3.50"}
    assert one(spark, T.field_at(columns, F.lit(11))) == "Qty"
    short = one(spark, T.slice_columns(F.col("t"), columns), t="Bolt")
    assert short == {"Item": "Bolt", "Qty": "", "Price": ""}


def test_annotation_only(spark):
    assert one(spark, T.annotation_only(F.col("t"), F.lit(900.0)), t="Paid ACH 50130-1500-125001")
    assert not one(spark, T.annotation_only(F.col("t"), F.lit(100.0)), t="INVOICE TOTAL 5.00")
    assert one(spark, T.annotation_only(F.col("t"), F.lit(100.0)), t="see notes")
    assert not one(spark, T.annotation_only(F.col("t"), F.lit(100.0)), t=" ")


@pytest.mark.parametrize("unit", ["word ", "12 ", "1,000.00  ", "(", "a1,", "\t", "x  ", "W", ",000"])
def test_very_long_lines(spark, unit):
    """No pattern may recurse with the line's length."""
    line = unit * (100_000 // len(unit))
    df = spark.createDataFrame([(line,)], "t string")
    c = F.col("t")
    got = df.select(T.shape_of(c), T.header_score(c), T.squeeze(c), M.last_money(c), M.decimal_field(c), M.parse_money(c), T.density(c)).collect()
    assert len(got) == 1 and len(got[0][0]) <= 90
