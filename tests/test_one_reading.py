"""What layouts do costs one reading of their lines, and one run of a pattern a line."""

import pytest
from pyspark.sql import functions as F

from footing import tables
from footing.operators import ladder
from footing.operators.rules import Rule, classify
from footing.plans import layouts
from footing.plans.registry import LAYOUTS
from footing.tables import release, written


def _lines(spark, *texts):
    return spark.createDataFrame([(1, 1, n, t) for n, t in enumerate(texts)], "doc_id long, page int, line_no int, line string")


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_rows_come_of_one_reading(spark, name):
    layout = LAYOUTS[name]
    rows = layout.postprocess(classify(_lines(spark, "x"), layout.rules, layout.zones, layout.header, flags=layout.flags, labels=layout.labels))
    plan = rows._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().size() == 1


def test_a_run_writes_rows_and_heads_only(spark):
    before = written()
    layouts.run(_lines(spark, "x"), layouts.SECTIONS)
    assert {path.rsplit("/", 1)[1].split("-")[0] for _, path in tables._WRITTEN[before:]} == {"rows", "heads"}
    release()


def test_checks_without_groups_are_one_aggregation(spark):
    rows = classify(_lines(spark, "x"), layouts.RATE_TABLE.rules, header=layouts.RATE_TABLE.header)
    plan = ladder.reconcile(rows, layouts.RATE_TABLE.checks)._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().size() == 1


def test_groups_of_odd_lines(spark):
    """The parting character in a line, groups that take no part, blanks of any kind around a value."""
    rule = Rule("r", "charge", r"^(a+)(b)?\|([^|]*)\|([0-9.]*)", fields={"a": 1, "b": 2, "x": 3}, nums={"amount": 4}, cells=lambda ctx: F.create_map(F.lit("raw"), ctx.group(3)))
    rows = classify(_lines(spark, "ab|  v \t|1.25|tail", "a|x\x01y |2.50", "a||", "ab| |7"), [rule]).orderBy("line_no").collect()
    assert [(r["fields"], str(r["nums"].get("amount")), r["row_error"]) for r in rows] == [
        ({"a": "a", "b": "b", "x": "v", "raw": "  v \t"}, "1.25", False),
        ({"a": "a", "x": "x\x01y", "raw": "x\x01y "}, "2.50", False),
        ({"a": "a", "raw": ""}, "None", True),
        ({"a": "a", "b": "b", "raw": " "}, "7.00", False),
    ]
