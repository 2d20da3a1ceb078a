import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from footing.operators import folds, ladder, sinks, state
from footing.plans import invoices
from footing.plans.registry import LAYOUTS, layout
from footing.sources import documents as D
from footing.streaming.incremental import run_new


def test_pages_and_lines(spark):
    docs = spark.createDataFrame([("a", "x\ny\fz\r\nw\f \n"), ("b", None), ("c", "\f")], "doc_id string, text string")
    lines = D.to_lines(D.to_pages(docs)).orderBy("doc_id", "page", "line_no").collect()
    assert [(r["doc_id"], r["page"], r["line_no"], r["line"]) for r in lines] == [("a", 1, 0, "x"), ("a", 1, 1, "y"), ("a", 2, 0, "z"), ("a", 2, 1, "w"), ("b", 1, 0, ""), ("c", 1, 0, "")]


def test_scan_and_extract(spark, tmp_path):
    for name in ("b.pdf", "a.PDF", "c.txt", "bad.pdf"):
        (tmp_path / name).write_bytes(name.encode())

    def extractor(content):
        if content.startswith(b"bad"):
            raise ValueError("broken")
        return content.decode() + "\f"

    files = D.scan_folder(spark, str(tmp_path))
    got = {r["doc_id"]: (r["text"], r["error"]) for r in D.extract_text(files, extractor).collect()}
    assert got == {"a.PDF": ("a.PDF\f", None), "b.pdf": ("b.pdf\f", None), "bad.pdf": (None, "ValueError: broken")}
    cache = files.where("doc_id = 'a.PDF'").selectExpr("substring(sha256, 1, 32) sha_prefix", "300 dpi")
    assert sorted(r["doc_id"] for r in D.not_cached(files, cache).collect()) == ["b.pdf", "bad.pdf"]


def test_metadata(spark):
    df = spark.createDataFrame([("Producer: x: y\nno\nA:1\nA: 2",)], "t string")
    assert df.select(D.parse_metadata(df["t"]).alias("m")).first()["m"] == {"Producer": "x: y", "A": "2"}


def test_state_files_may_be_missing(spark, tmp_path):
    assert D.read_records(spark, str(tmp_path / "none")).count() == 0
    assert D.read_bindings(spark, str(tmp_path / "none")).count() == 0


def test_records_and_summary(spark, tmp_path):
    lines = invoices.printed(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_orderkey < 40"))
    rows = invoices.classified(lines)
    results = ladder.reconcile(rows, invoices.CHECKS)
    verdicts = ladder.verdicts(rows, results)
    identities = verdicts.selectExpr("doc_id", "concat('no-', doc_id) identity", "sha2(cast(doc_id as string), 256) sha256")
    facts = sinks.document_facts(rows, results)
    records = sinks.records(verdicts, identities, sinks.line_items(rows, ("description", "quantity")), facts, "made")
    assert [f"{f.name} {f.dataType.simpleString()}" for f in records.schema] == [x.strip() for x in re.split(r",(?= )", D.RECORDS)]
    n, bad = verdicts.count(), verdicts.where("not verified").count()
    assert records.count() == n and sinks.invoices(records, facts, verdicts).where("flagged").count() == bad
    assert len(sinks.invoices(records, facts, verdicts).columns) == 27 and len(sinks.invoice_items(records).columns) == 14
    # a record that is read back is the same, and its total is known to triage
    path = str(tmp_path / "history")
    records.write.json(path)
    back = D.read_records(spark, path)
    assert sorted(map(str, back.drop("extracted_at").collect())) == sorted(map(str, records.drop("extracted_at").collect()))
    again = state.triage(back.withColumn("seq", F.lit(1)), back.withColumn("seq", F.lit(0)))
    assert {r["verdict"] for r in again.collect()} == {"duplicate"}
    other = state.triage(back.withColumns({"seq": F.lit(1), "sha256": F.lit("x")}), back.withColumn("seq", F.lit(0)))
    assert {r["reason"] for r in other.collect()} == {"same total, other bytes"}
    assert all(r["line_items"][0]["description"].startswith("Part ") for r in records.collect())
    summary = sinks.run_summary(verdicts).first()
    assert (summary["n"], summary["verified"], summary["shallow"]) == (n, n - bad, 0)
    assert sinks.exception_rows(records).count() >= bad
    states = {r["state"] for r in sinks.sample_report(results).collect()}
    assert states <= {"PASS", "FAIL", "n/a", "ADVS"}


def test_incremental_runs_add_only_what_is_new(spark, tmp_path):
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "doc_id string, text string"
    extract = lambda d: d.selectExpr("doc_id as identity", "length(text) as size")
    spark.createDataFrame([("a", "x"), ("b", "yy")], schema).write.parquet(source)
    for _ in range(2):  # the second run finds nothing new
        run_new(spark, source, schema, extract, target, check).awaitTermination()
    assert spark.read.parquet(target).count() == 2
    spark.createDataFrame([("b", "yy"), ("c", "zzz")], schema).write.mode("append").parquet(source)
    run_new(spark, source, schema, extract, target, check).awaitTermination()
    assert sorted(r["identity"] for r in spark.read.parquet(target).collect()) == ["a", "b", "c"]


def test_incremental_runs_lose_nothing(spark, tmp_path):
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "identity string, sha256 string, printed_total decimal(18,2), seq long"
    one = Decimal("1.00")
    spark.createDataFrame([("", "a", None, 1), (" ", "b", None, 2), ("X", "c", one, 3), ("X", "d", one, 4), ("Y", "e", Decimal("0.00"), 5)], schema).write.parquet(source)
    run_new(spark, source, schema, lambda d: d, target, check).awaitTermination()
    spark.createDataFrame([("", "f", None, 1), ("Y", "g", None, 2), ("Y", "e", Decimal("0.00"), 0), ("Z", "h", one, 4)], schema).write.mode("append").parquet(source)
    run_new(spark, source, schema, lambda d: d, target, check).awaitTermination()
    assert sorted((r["identity"], r["sha256"]) for r in spark.read.parquet(target).collect()) == [("X", "c"), ("Y", "e"), ("Z", "h")]
    aside = sorted((r["sha256"], r["verdict"], r["reason"]) for r in spark.read.parquet(target + "-exceptions").collect())
    assert aside == [
        ("a", "changed", "no identity"), ("b", "changed", "no identity"), ("d", "changed", "same total, other bytes"),
        ("e", "duplicate", None), ("f", "changed", "no identity"), ("g", "changed", "totals differ"),
    ]


def test_pages_are_checked_against_their_number(spark):
    docs = spark.createDataFrame([(1, "a\fb\f"), (2, "one\ftwo"), (3, "x")], "doc_id long, text string")
    counts = spark.createDataFrame([(1, 2), (2, 1)], "doc_id long, page_count int")
    single = spark.createDataFrame([(2, 1, "one two"), (1, 1, "no")], "doc_id long, page int, text string")
    got = sorted(map(tuple, D.checked_pages(docs, counts, single).collect()))
    assert got == [(1, 1, "a"), (1, 2, "b"), (2, 1, "one two"), (3, 1, "x")]


def test_words_in_a_band_and_files_by_name(spark, tmp_path):
    df = spark.createDataFrame([([("a", 0.0, 0.0, 2.0, 1.0), ("b", 2.0, 0.0, 4.0, 1.0), ("c", 4.0, 0.0, 6.0, 1.0)],)], f"w {D.WORDS}")
    assert [x["text"] for x in df.select(D.words_in_band(df["w"], 1.0, 3.0).alias("x")).first()["x"]] == ["a"]
    for name in ("b.pdf", "a.PDF", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert [r["doc_id"] for r in D.by_name(D.scan_folder(spark, str(tmp_path))).collect()] == ["a.PDF", "b.pdf"]


def test_escalation(spark):
    good = "INVOICE TOTAL " * 30
    first = spark.createDataFrame([(1, good, 500.0), (2, "", 0.0), (3, "", 0.0), (4, "", 0.0)], "doc_id long, text string, chars_per_page double")
    second = spark.createDataFrame([(2, good, 500.0, None), (3, None, None, "too many pages"), (4, "words " * 99, 500.0, None)], "doc_id long, text string, chars_per_page double, error string")
    got = {r["doc_id"]: (r["text"], r["reason"]) for r in D.escalate(first, second).collect()}
    assert got[1] == (good, None) and got[2] == (good, None)
    assert got[3][1] == "no usable text layer; recognition failed: too many pages"
    assert got[4][1] == "no usable text layer; recognition gave no usable text either"
    assert {r["doc_id"] for r in D.escalate(first).where("reason is not null").collect()} == {2, 3, 4}


def test_bindings_as_lines_or_one_document(spark, tmp_path):
    one, lines = str(tmp_path / "one.json"), str(tmp_path / "lines")
    (tmp_path / "one.json").write_text('{\n "specs": {\n  "ab": {"spec": "x", "bound_at": "t", "notes": ""},\n  "cd": {"spec": "y", "bound_at": "t", "notes": "n"}\n }\n}\n')
    read = lambda path: sorted((r["signature"], r["spec"]) for r in D.read_bindings(spark, path).collect())
    assert read(one) == [("ab", "x"), ("cd", "y")]
    D.write_bindings(D.read_bindings(spark, one), lines)
    assert read(lines) == [("ab", "x"), ("cd", "y")]
    seen = spark.createDataFrame([("ab", "z", "t2", ""), ("ef", "z", "t2", ""), ("ef", "w", "t1", "")], D.BINDINGS)
    bound = state.bind(D.read_bindings(spark, lines), seen)
    assert sorted((r["signature"], r["spec"]) for r in bound.collect()) == [("ab", "x"), ("cd", "y"), ("ef", "w")]


def test_looks_along_a_page(spark):
    rows = [(1, 1, 0, "head", "h"), (1, 1, 1, "row", "a"), (1, 2, 0, "row", "b"), (1, 2, 1, "row", "c"), (1, 2, 2, "row", "d")]
    df = spark.createDataFrame(rows, "doc_id long, page int, line_no int, kind string, line string")
    w = folds.ordered(["doc_id"], ["page", "line_no"])
    out = df.select("line", folds.last_of_on_page(["head"], F.col("line"), w).alias("on_page"), folds.filled(F.col("line"), steps=2).alias("second"), folds.filled(F.col("line"), steps=-1).alias("up"))
    assert [tuple(r) for r in out.orderBy("line").collect()] == [("a", "h", None, "h"), ("b", None, "d", None), ("c", None, None, "b"), ("d", None, None, "c"), ("h", None, None, None)]


def test_unknown_layouts_are_an_error():
    assert len(LAYOUTS) == 7 and layout("sections").name == "sections"
    with pytest.raises(LookupError, match="no layout 'none'"):
        layout("none")
