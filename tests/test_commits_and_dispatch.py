from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from footing.operators import commits, profiles, rules, state
from footing.operators.rules import Anchor, Rule, Zone
from footing.plans import dispatch, printed
from footing.sources import documents as D
from footing.tables import durable

ROWS = "identity string, sha256 string"


def test_a_batch_that_fails_between_tables_shows_nothing(spark, tmp_path):
    path = str(tmp_path / "h")
    good = spark.createDataFrame([("a", "1")], ROWS)
    commits.write_batch(spark, path, "b1", {"invoices": good, "items": good, "exceptions": good})
    bad = good.select("identity", F.assert_true(F.col("sha256") == "x").cast("string").alias("sha256"))
    with pytest.raises(Exception, match="is not true"):
        commits.write_batch(spark, path, "b2", {"invoices": good, "items": bad, "exceptions": good})
    assert (tmp_path / "h" / "invoices").exists() and len(list((tmp_path / "h" / "invoices").iterdir())) == 2  # it was written
    for name in ("invoices", "items", "exceptions"):
        assert commits.read_committed(spark, path, name).count() == 1
    # the batch is run again and then once more after it was committed
    assert [commits.write_batch(spark, path, "b2", {"invoices": good, "items": good}) for _ in range(2)] == [2, 2]
    assert commits.read_committed(spark, path, "items").count() == 2 and commits.read_committed(spark, path, "exceptions").count() == 1
    assert commits.read_committed(spark, path, "none") is None and commits.commits(spark, str(tmp_path / "no")) == []


def test_two_writers_take_different_numbers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "h")
    df = spark.createDataFrame([("a", "1")], ROWS)
    commits.write_batch(spark, path, "b1", {"t": df})
    seen = commits.commits(spark, path)
    commits.write_batch(spark, path, "b2", {"t": df})
    monkeypatch.setattr(commits, "commits", lambda *_: seen)  # a writer that has not heard of b2
    assert commits.write_batch(spark, path, "b3", {"t": df}) == 3


def test_the_last_record_written_wins(spark, tmp_path):
    """By the order of writing, not by any value: later batches have smaller digests."""
    path = str(tmp_path / "h")
    commits.write_batch(spark, path, "b1", {"r": spark.createDataFrame([("a", "9"), ("b", "9"), ("a", "8")], ROWS).coalesce(1)})
    commits.write_batch(spark, path, "b2", {"r": spark.createDataFrame([("b", "1")], ROWS)})
    got = state.latest(commits.read_committed(spark, path, "r")).select("identity", "sha256").collect()
    assert sorted(map(tuple, got)) == [("a", "8"), ("b", "1")]


def files_read(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value()


def test_a_batch_opens_its_own_buckets_only(spark, tmp_path):
    path = str(tmp_path / "h")
    for k in range(4):
        commits.write_batch(spark, path, f"b{k}", {"r": spark.range(500).select(F.concat(F.lit(f"{k}-"), "id").alias("identity"), F.lit("x").alias("sha256"))}, {"r": "identity"})
    batch = spark.createDataFrame([("1-7", "n"), ("new", "n"), ("1-7", "m"), (None, "n")], ROWS)
    opened = commits.seen_buckets(spark, path, "r", batch, "identity")
    files, every = files_read(opened), len(commits.read_committed(spark, path, "r").inputFiles())
    assert every > 4 * 50 and files <= 4 * 3  # three hashes, four batches
    got = sorted((str(r["identity"]), r["sha256"]) for r in commits.unseen(spark, path, "r", batch).collect())
    assert got == [("None", "n"), ("new", "n")]
    assert sorted(map(str, commits.unseen(spark, str(tmp_path / "no"), "r", batch).collect())) == sorted(map(str, batch.collect()))


@pytest.mark.parametrize("spread", [1, 7, 10_000, 10**15])
def test_order_statistics(spark, spread):
    values = [(k * 7919 % 1009 - 500) * spread for k in range(1001)] + [0] * 50
    df = spark.createDataFrame([(Decimal(v).scaleb(-2),) for v in values] + [(None,)], "v decimal(18,2)").repartition(5)
    ordered = sorted(values)
    for place in (0, 1, 500, 525, 1050):
        assert profiles.order_statistic(df, "v", lambda n, p=place: p) == Decimal(ordered[place]).scaleb(-2)
    assert profiles.upper_median(df, "v").first()["median"] == Decimal(ordered[len(ordered) // 2]).scaleb(-2)


def test_order_statistics_of_the_widest_and_of_none(spark):
    most = 2**63 - 1
    df = spark.createDataFrame([(most,), (-most - 1,), (0,)], "v long")
    assert [profiles.order_statistic(df, "v", lambda n, p=p: p) for p in range(3)] == [-most - 1, 0, most]
    assert profiles.order_statistic(df.limit(0), "v", lambda n: 0) is None and profiles.upper_median(df.limit(0), "v").collect() == []
    with pytest.raises(ValueError, match="no place"):
        profiles.order_statistic(df, "v", lambda n: 3)


def test_no_stage_of_an_order_statistic_is_one_task(spark):
    df = spark.range(0, 100_000, 1, 8).select((F.col("id") * 7 % 100_003).alias("v"))
    plan = df.groupBy("v").count()._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert profiles.order_statistic(df, "v", lambda n: n // 2) == sorted(k * 7 % 100_003 for k in range(100_000))[50_000]


def test_routes(spark):
    docs = spark.createDataFrame([(1, "s1", True), (2, "s2", True), (3, "s9", True), (4, "s1", False), (5, None, True)], "doc_id long, signature string, usable_text boolean")
    bindings = spark.createDataFrame([("s1", "one", "t", ""), ("s2", "two", "t", "")], D.BINDINGS)
    routes, refused = dispatch.route(docs, bindings, ("one",))
    assert [tuple(r) for r in routes.collect()] == [(1, "one")]
    assert sorted((r["doc_id"], r["cause"]) for r in refused.collect()) == [("2", "bound to another layout"), ("3", "no layout is bound"), ("4", "no usable text"), ("5", "no layout is bound")]
    assert {r["spec"] for r in dispatch.route(docs, bindings)[0].collect()} == {"one", "two"}


def test_words_in_columns(spark):
    lines = spark.createDataFrame([(1, 1, 0, "ab  cd   ef"), (1, 1, 1, "    gh ij"), (1, 2, 0, ""), (2, 1, 0, "x")], "doc_id long, page int, line_no int, line string")
    columns = spark.createDataFrame([(1, "left", 0.0, 24.0), (1, "right", 24.0, 48.0), (1, "both", 0.0, 100.0)], "doc_id long, label string, low double, high double")
    pages = D.placed_words(lines)
    assert {(r["doc_id"], r["page"], r["width"]) for r in pages.collect()} == {(1, 1, 66.0), (1, 2, 0.0), (2, 1, 6.0)}
    got = sorted(map(tuple, D.words_in_columns(pages, columns).select("page", "label", "y0", "text").collect()))
    assert got == [(1, "both", 0.0, "ab cd ef"), (1, "both", 12.0, "gh ij"), (1, "left", 0.0, "ab"), (1, "right", 0.0, "cd"), (1, "right", 12.0, "gh")]


def test_guards_that_look_at_all_kinds_so_far(spark):
    """A rule that only state can decide: every third charge closes a group."""
    lines = spark.createDataFrame([(d, 1, k, "x" if k % 4 else "") for d in (1, 2) for k in range(13)], "doc_id long, page int, line_no int, line string")
    its = [Rule("third", "group_subtotal", "x", nums={"amount": 0}), Rule("row", "charge", "x", nums={"amount": 0})]
    guards = {"third": lambda s: len(s["kinds"]) % 3 == 2}
    got = rules.classify_in_order(lines, its, guards=guards).where("doc_id = 2").orderBy("line_no").collect()
    assert [r["rule"] for r in got] == ["row", "row", "third"] * 3
    assert {r["line_no"] % 4 for r in got} == {1, 2, 3}


def test_the_fold_is_linear_and_equals_windows(spark):
    """Twenty thousand lines of one page: the former form compared each line with its whole page."""
    import time

    its = [Rule("item", "charge", "^i", nums={"amount": 0}), Rule("note", "header_field", "^n"), Rule("wrap", "continuation", "^ ", anchor=Anchor(frozenset({"charge"}), frozenset({"continuation", "header_field"})))]
    zones = [Zone("z", "^ZZ", "second")]
    text = F.when(F.col("id") % 9 == 0, "i").when(F.col("id") % 7 == 0, "n").when(F.col("id") % 5 == 0, "other").when(F.col("id") % 4001 == 0, "ZZ").when(F.col("id") % 11 == 0, "").otherwise("  w")
    lines = spark.range(20_000).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page"), F.col("id").cast("int").alias("line_no"), text.alias("line"))
    began = time.time()
    folded = sorted(map(str, rules.classify_in_order(lines, its, zones).collect()))
    assert time.time() - began < 30
    assert folded == sorted(map(str, rules.classify(lines, its, zones).select("doc_id", "page", "line_no", "kind", "rule").collect()))


def test_a_whole_run_over_a_folder(spark, tmp_path):
    """Documents of two bound layouts, one that is bound elsewhere, one unknown and one unusable; then the same again, and a re-issue."""
    path = str(tmp_path / "out")
    items = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_orderkey < 130")
    kinds = ("sections", "unit_rates", "two_templates", "regrouped")
    part = lambda k, name: printed.PRINTED[name](printed.Orders(items.where(F.col("l_orderkey") % 4 == k)))
    lines = printed.together([part(k, name) for k, name in enumerate(kinds)])
    # what is printed on the margin of every page makes it as dense as paper
    margin = F.lit("\nINVOICE BALANCE " + "x" * 220)
    pages = lines.groupBy("doc_id", "page").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), "\n"), margin).alias("text"))
    texts = pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda r: r["text"]), "\f").alias("text"))
    texts = texts.select(F.format_string("%06d", "doc_id").alias("doc_id"), "text").unionByName(spark.createDataFrame([("x", "INVOICE TOTAL")], "doc_id string, text string"))
    texts = durable(texts.withColumn("sha256", F.sha2(F.col("text").cast("binary"), 256)), "texts")
    own = profiles.profile(D.to_pages(texts)).where("usable_text").withColumn("k", F.col("doc_id").try_cast("int") % 4)
    first = own.groupBy("k").agg(F.min_by("signature", "doc_id").alias("signature")).where("k < 3")
    bindings = first.select("signature", F.get(F.array(*[F.lit(n) for n in kinds]), F.col("k")).alias("spec"))
    assert dispatch.run_folder(texts, bindings, kinds[:2], path, "one") == 1
    read = lambda name: commits.read_committed(spark, path, name)
    records, aside = read("records").collect(), read("exceptions").collect()
    n = {k: len([r for r in texts.collect() if r["doc_id"] != "x" and int(r["doc_id"]) % 4 == k]) for k in range(4)}
    assert {r["spec"] for r in records} == set(kinds[:2]) and len(records) == n[0] + n[1]
    causes = lambda rows: {c: len({r["doc_id"] for r in rows if r["cause"] == c}) for c in {r["cause"] for r in rows}}
    assert {k: v for k, v in causes(aside).items() if k != "not verified"} == {"unusable text": 1, "bound to another layout": n[2], "no layout is bound": n[3]}
    assert {r["doc_id"] for r in aside} | {r["source"] for r in records} == {r["doc_id"] for r in texts.collect()}
    assert read("items").count() == items.where("l_orderkey % 4 < 2").count()
    # the batch again adds nothing; another batch of the same bytes reports duplicates, and one of other bytes re-issues
    assert dispatch.run_folder(texts, bindings, kinds[:2], path, "one") == 1
    again = texts.where("doc_id <= '000010'").withColumn("sha256", F.when(F.col("doc_id") == "000004", "other").otherwise(F.col("sha256")))
    assert dispatch.run_folder(again, bindings, kinds[:2], path, "two") == 2
    later = [r for r in read("exceptions").collect() if r["seq"]["batch"] == 2 and r["cause"] == "not recorded"]
    assert read("records").count() == len(records)
    assert {r["detail"] for r in later if r["doc_id"] == "000004"} == {"changed: same total, other bytes"}
    assert {r["detail"] for r in later if r["doc_id"] != "000004"} == {"duplicate"}
