import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from footing.functions import literals
from footing.functions import text as T
from footing.operators import scans
from footing.operators.rules import classify
from footing.plans import invoices, printed
from footing.plans.registry import LAYOUTS

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("pattern", "wanted"),
    [
        (r"^\s*Invoice Total\s+\$", ("Invoice Total",)), (r"a+b?c{2}", ("a",)), (r"(?:ab|cde)x", ("ab", "cde")), (r"(?:ab|[0-9])", ()), (r"(?i)total", ()), (r"x(?i:total)", ("x",)),
        (r"^.+$", ()), (r"[$]", ("$",)), (r"\$(\d+)", ("$",)), (r"(?U)\s+x", ()), (r"(ab)?cd", ("cd",)), (r"(?=never)abc", ("abc",)), (r"a|b|c|d|e|f|g", ()), (r"(?>abc)d", ("abc",)),
    ],
)
def test_required(pattern, wanted):
    assert literals.required(pattern) == wanted


PATTERNS = sorted({p for layout in LAYOUTS.values() for p in [r.pattern for r in layout.rules if r.pattern] + [z.pattern for z in layout.zones]})


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(PATTERNS), st.data())
def test_what_matches_holds_what_is_required(pattern, data):
    needs = literals.required(pattern)
    line = data.draw(st.from_regex(pattern.replace("(?m)", ""), alphabet=st.characters(max_codepoint=127)))
    assert not needs or any(x in line for x in needs)


def test_most_patterns_of_the_layouts_require_something():
    assert sum(bool(literals.required(p)) for p in PATTERNS) > 0.6 * len(PATTERNS)


def test_more_strings_than_bits(spark):
    patterns = [f"^word{k}x" for k in range(150)]
    pre = literals.Prefilter(patterns)
    lines = spark.createDataFrame([(f"word{k}x and more",) for k in range(0, 150, 7)] + [("nothing",), (None,)], "line string")
    rows = lines.withColumns(pre.columns(F.col("line")))
    assert len(pre.columns(F.col("line"))) == 3
    for k in (0, 7, 70, 147, 3):
        assert rows.where(pre.match(F.col("line"), patterns[k])).count() == lines.where(F.col("line").rlike(patterns[k])).count()


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_neither_prefilter_nor_blocks_change_a_row(spark, name):
    """The same rows with and without the prefilter, in one window a document and in blocks of three lines."""
    layout = LAYOUTS[name]
    items = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_orderkey < 60")
    lines = printed.PRINTED[name](printed.Orders(items))
    run = lambda **kw: sorted(map(str, classify(lines, layout.rules, layout.zones, layout.header, flags=layout.flags, labels=layout.labels, **kw).collect()))
    assert run(prefilter=False) == run(block=3)


def ways():
    return {
    "last": scans.Scan("last", F.col("v")), "last_upto": scans.Scan("last", F.col("v"), upto=True), "next": scans.Scan("next", F.col("v")), "sum": scans.Scan("sum", F.col("n")),
    "sum_upto": scans.Scan("sum", F.col("n"), upto=True), "seen": scans.Scan("seen", F.col("v") == "b"), "page_last": scans.Scan("last", F.col("v"), page=True),
    "page_next": scans.Scan("next", F.col("v"), page=True), "page_seen": scans.Scan("seen", F.col("v") == "b", page=True), "page_sum": scans.Scan("sum", F.col("n"), page=True),
    "struct": scans.Scan("last", F.when(F.col("v") == "a", F.struct("page", "line_no"))),
    }


@pytest.mark.parametrize("block", [1, 2, 7, 1000])
def test_blocks_equal_windows(spark, block):
    """Against windows, over pages of unlike length, null ids and values, and pages that are left out."""
    value = F.when(F.col("id") % 5 == 0, F.lit(None)).when(F.col("id") % 7 == 0, "b").otherwise(F.when(F.col("id") % 3 == 0, "a"))
    doc = F.when(F.col("id") % 11 < 6, 1).when(F.col("id") % 11 < 9, F.lit(None)).otherwise(3)
    lines = spark.range(400).select(doc.alias("doc_id"), (F.floor(F.col("id") / 37) * 2 + 1).cast("int").alias("page"), (F.col("id") % 37).cast("int").alias("line_no"), value.alias("v"), (F.col("id") % 4).alias("n"))
    key = ["doc_id", "page", "line_no"]
    plain, cut = scans.scan(lines, ways()), scans.scan(lines, ways(), block)
    assert plain.columns == cut.columns
    assert sorted(map(str, plain.collect())) == sorted(map(str, cut.collect()))
    w = Window.partitionBy("doc_id").orderBy("page", "line_no")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    want = lines.select(*key, F.last("v", ignorenulls=True).over(before).alias("last"), F.first("v", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("next"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("sum"))
    assert sorted(map(str, want.collect())) == sorted(map(str, plain.select(*want.columns).collect()))


def test_giant_document_runs_in_many_tasks(spark):
    """Five million lines of one document: results that arithmetic tells, no task with more than a few of them."""
    n = 5_000_000
    lines = spark.range(0, n, 1, 64).select(F.lit(1).alias("doc_id"), (F.floor(F.col("id") / 1_000_000) + 1).cast("int").alias("page"), (F.col("id") % 1_000_000).cast("int").alias("line_no"), F.col("id"))
    three = {"c": scans.counted(F.col("id") % 1000 == 0), "z": scans.carried(F.when(F.col("id") % 100_000 == 0, F.col("id"))), "k": scans.Scan("next", F.when(F.col("id") % 1000 == 999, F.col("id")), page=True)}
    assert scans.block_for(lines) == scans.BLOCK
    out = scans.scan(lines, three, scans.BLOCK).withColumn("task", F.spark_partition_id())
    last = F.floor(F.col("id") / 1000) * 1000 + 999
    follows = F.when(last > F.col("id"), last).when((last + 1) % 1_000_000 != 0, last + 1000)
    bad = (F.col("c") != F.floor(F.col("id") / 1000) + 1) | (F.col("z") != F.floor(F.col("id") / 100_000) * 100_000) | ~F.col("k").eqNullSafe(follows)
    tasks = out.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad")).collect()
    assert sum(t["n"] for t in tasks) == n and sum(t["bad"] for t in tasks) == 0
    assert len(tasks) > 4 and max(t["n"] for t in tasks) < n / 2


def test_no_lines(spark):
    none = spark.createDataFrame([], "doc_id long, page int, line_no int, v string, n long")
    assert scans.scan(none, ways()).collect() == scans.scan(none, ways(), 4).collect() == []
    assert scans.block_for(none) is None


def test_cells_by_cuts_equal_sliced_cells(spark):
    labels = ("Name", "Brand", "Type", "Missing", "Na")
    rows = [("Name     Brand   Type", " ab cd   x  y   z  "), ("Type Brand      Name", "t b  bb        nnn"), ("nothing", "abc"), ("  Name", ""), (None, "x")]
    df = spark.createDataFrame(rows, "header string, line string").withColumn("cuts", T.column_cuts(F.col("header"), labels))
    old = T.slice_columns(F.col("line"), T.column_offsets(F.col("header"), labels))
    for label in labels:
        got = df.select(T.cell_of(F.col("line"), F.col("cuts"), labels, label).alias("new"), F.try_element_at(old, F.lit(label)).alias("old")).collect()
        assert [r["new"] for r in got] == [r["old"] for r in got]
    places = df.select("header", F.posexplode(F.array(*[F.lit(k) for k in range(30)])).alias("at", "x"), "cuts")
    got = places.select(T.label_at(F.col("cuts"), labels, F.col("at")).alias("new"), T.field_at(T.column_offsets(F.col("header"), labels), F.col("at")).alias("old")).collect()
    assert [r["new"] for r in got] == [r["old"] for r in got]


def test_invoices_in_blocks(spark):
    lines = invoices.printed(spark.read.parquet(f"{SF}/lineitem.parquet"))
    run = lambda block: classify(lines, invoices.RULES, invoices.ZONES, header=r"^ITEM\s+QTY", block=block)
    assert sorted(map(str, run(None).collect())) == sorted(map(str, run(4).collect()))
