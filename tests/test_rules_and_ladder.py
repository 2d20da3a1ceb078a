import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from footing.operators import folds, ladder, profiles, rules, state
from footing.operators.rules import Anchor, Rule, Zone
from footing.plans import invoices

LINES = "doc_id long, page int, line_no int, line string"
SMALL = ["Bolt 10.00", "Nut 15.50", "Subtotal 25.50", "Tax 2.04", "Total 27.54"]
SMALL_RULES = [
    Rule("subtotal", "invoice_subtotal", r"^Subtotal"),
    Rule("tax", "tax", r"^Tax"),
    Rule("total", "grand_total", r"^Total"),
    Rule("item", "charge", r"^[A-Z][a-z]+ [0-9.]+$"),
]
SMALL_CHECKS = [ladder.Check("subtotal", ("charge",), "invoice_subtotal"), ladder.Check("total", ("invoice_subtotal", "tax"), "grand_total")]


def verdict(spark, texts, the_rules=SMALL_RULES, checks=SMALL_CHECKS):
    rows = rules.classify(spark.createDataFrame([(1, 1, k, t) for k, t in enumerate(texts)], LINES), the_rules)
    return ladder.verdicts(rows, ladder.reconcile(rows, checks)).first()


def test_small_document(spark):
    v = verdict(spark, SMALL)
    assert (v["unclassified"], v["depth"], v["verified"], v["status"], v["reasons"]) == (0, 2, True, "verified", [])


def test_nothing_never_passes(spark):
    v = verdict(spark, ["Tax 1.00"])
    assert not v["verified"] and v["status"] == "no line items found"
    assert not verdict(spark, ["Bolt 10.00"])["verified"]


def test_unknown_line_blocks(spark):
    v = verdict(spark, [*SMALL, "??"])
    assert v["status"] == "unclassified rows" and v["reasons"] == ["unclassified: ??"]


def test_changed_amount_fails_its_rung(spark):
    v = verdict(spark, ["Bolt 10.01", *SMALL[1:]])
    assert v["status"] == "reconciliation failed" and v["worst_delta"] == Decimal("0.01") and v["depth"] == 1


def test_money_kind_without_amount_is_an_error(spark):
    assert verdict(spark, [*SMALL, "Tax unknown"])["status"] == "parse error"


def test_dropped_zero_row_fails_only_the_count(spark):
    checks = [ladder.Check("sum", ("charge",), "grand_total"), ladder.Check("rows", ("charge",), "row_count", printed_field="n", mode="count")]
    the_rules = [Rule("n", "row_count", r"^Rows ([0-9]+)$", nums={"n": 1}), *SMALL_RULES]
    assert verdict(spark, ["Bolt 10.00", "Nut 0.00", "Total 10.00", "Rows 2"], the_rules, checks)["verified"]
    v = verdict(spark, ["Bolt 10.00", "Total 10.00", "Rows 2"], the_rules, checks)
    assert v["reasons"] == ["rows fail"]


def test_printed_kind_without_the_field_is_zero(spark):
    checks = [ladder.Check("x", ("charge",), "column_total", printed_field="other", required=False)]
    the_rules = [Rule("c", "column_total", r"^Col"), *SMALL_RULES]
    assert verdict(spark, ["Bolt 10.00", "Col 10.00"], the_rules, checks)["reasons"][-1] == "x fail"


def test_advisory_and_tolerance(spark):
    near = [ladder.Check("t", ("charge",), "grand_total", tolerance=Decimal("0.05")), ladder.Check("a", ("charge",), "invoice_subtotal", advisory=True)]
    v = verdict(spark, ["Bolt 10.00", "Subtotal 9.00", "Total 10.04"], checks=near)
    assert v["verified"] and v["checks_ok"] == 2 and v["depth"] == 1


def test_diagnose_names_the_row(spark):
    rows = rules.classify(spark.createDataFrame([(1, 1, k, t) for k, t in enumerate(["Bolt 10.00", "Tax 2.00", "Total 12.00"])], LINES), SMALL_RULES)
    d = ladder.diagnose(ladder.reconcile(rows, [ladder.Check("t", ("charge",), "grand_total")]), rows).first()
    assert (d["hint"], d["match_kind"], d["match_raw"]) == ("computed is short", "tax", "Tax 2.00")


@pytest.mark.parametrize("first_only", [False, True])
def test_native_and_sequential_agree(spark, first_only):
    """Random documents over rules whose acceptance depends on earlier lines."""
    rng = random.Random(11)
    the_rules = [
        Rule("item", "charge", r"^I [0-9.]+$"),
        Rule("head", "section_header", r"^H$", zones=("body",)),
        Rule("wrap", "continuation", r"^w", anchor=Anchor(frozenset({"charge"}), frozenset() if first_only else frozenset({"continuation"}), first_only)),
        Rule("note", "ignorable", r"^wn", anchor=Anchor(frozenset({"section_header"}), frozenset({"ignorable"}))),
        Rule("tail", "ignorable", r"^z"),
    ]
    zones = [Zone("m", r"^=== ", "late")]
    texts = ["I 1.00", "H", "w", "wn", "z", "?", "", "=== x"]
    lines = [(d, 1 + k // 9, k % 9, rng.choice(texts)) for d in range(40) for k in range(27)]
    frame = spark.createDataFrame(lines, LINES)
    native = rules.classify(frame, the_rules, zones).select("doc_id", "page", "line_no", "kind", "rule")
    folded = rules.classify_in_order(frame, the_rules, zones)
    assert sorted(map(tuple, native.collect()), key=str) == sorted(map(tuple, folded.collect()), key=str)


def test_invoices_agree_with_the_sequential_fold(spark):
    lines = invoices.printed(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_orderkey < 100"))
    native = invoices.classified(lines).select("doc_id", "page", "line_no", "kind", "rule")
    assert sorted(map(tuple, native.collect()), key=str) == sorted(map(tuple, rules.classify_in_order(lines, invoices.RULES, invoices.ZONES).collect()), key=str)


def test_wrapped_text_folds_over_pages(spark):
    df = spark.createDataFrame([(1, 1, 0, "head a"), (1, 1, 1, "more"), (1, 2, 0, "and more"), (1, 2, 1, "head b")], LINES)
    out = folds.fold_wrapped(df, ["doc_id"], ["page", "line_no"], F.col("line").startswith("head"), "line")
    assert sorted(r["line"] for r in out.collect()) == ["head a more and more", "head b"]
    assert spark.range(1).select(folds.glue(F.array(F.lit("abc"), F.lit("de"), F.lit("fgh"))).alias("x")).first()["x"] == "abcde fgh"


def test_triage_within_and_between_batches(spark):
    schema = "identity string, sha256 string, printed_total string, seq long"
    history = spark.createDataFrame([("a", "1", "5.00", 1), ("a", "2", "6.00", 2), ("c", "9", None, 3)], schema)
    batch = spark.createDataFrame([("a", "2", "6.00", 10), ("a", "3", "6.00", 11), ("b", "4", "1.00", 12), ("b", "5", "2.00", 13), ("", "6", "1.00", 14), (None, "7", "1.00", 15), ("c", "8", "0.00", 16)], schema)
    got = {r["seq"]: (r["verdict"], r["reason"]) for r in state.triage(batch, history).collect()}
    assert got == {10: ("duplicate", None), 11: ("changed", "same total, other bytes"), 12: ("new", None), 13: ("changed", "totals differ"), 14: ("changed", "no identity"), 15: ("changed", "no identity"), 16: ("changed", "totals differ")}


def test_bindings_keep_what_is_bound(spark):
    old = spark.createDataFrame([("s1", "x", "t", "")], "signature string, spec string, bound_at string, notes string")
    new = spark.createDataFrame([("s1", "y", "t", ""), ("s2", "y", "t", "")], old.schema)
    assert sorted((r["signature"], r["spec"]) for r in state.bind(old, new).collect()) == [("s1", "x"), ("s2", "y")]


def test_profile(spark):
    body = "INVOICE 7\nItem description      Qty   Unit price   Amount\n" + "Bolt 1 2.00 TOTAL\n" * 30
    pages = spark.createDataFrame([("d", 1, body), ("d", 2, ""), ("e", 1, "Paid ACH")], "doc_id string, page int, text string")
    got = {r["doc_id"]: r for r in profiles.profile(pages).collect()}
    assert got["d"]["usable_text"] and got["d"]["column_row"].startswith("Item description") and got["d"]["sparse_pages"] == [2]
    assert got["d"]["column_positions"] == [0, 5, 20, 25, 30, 40] or len(got["d"]["column_positions"]) >= 4
    assert got["e"]["annotation_only"] and got["e"]["needs_ocr"] and len(got["e"]["signature"]) == 16
