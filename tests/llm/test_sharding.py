import zlib
from collections import defaultdict

from conftest import SF
from pyspark.sql import functions as F

from footing.llm import sharding
from footing.llm.queries import op4_sharding


def check(docs, rows, shards, most):
    want = sorted((d["doc_id"] is not None, d["doc_id"] or 0, len((d["text"] or "").encode()) + 8, zlib.crc32((d["text"] or "").encode())) for d in docs)
    assert want == sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows)
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in rows:
        assert 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    mean = sum(sizes.values()) / shards
    assert all(abs(sizes[k] - mean) <= most for k in range(shards))


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = op4_sharding(spark, SF).collect()
    check(docs, rows, 24, 2 * max(r["size"] for r in rows) * 0.55)


def test_one_group_of_equal_texts_is_cut(spark):
    docs = spark.createDataFrame([(k, "same text") for k in range(1000)] + [(k, "other") for k in range(1000, 1010)], "doc_id long, text string")
    check(docs.collect(), sharding.assign_shards(docs, 8).collect(), 8, 20)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = sharding.assign_shards(odd_docs, 3).collect()
    check(odd_docs.collect(), rows, 3, 10**9)
    assert sharding.assign_shards(no_docs, 3).count() == 0


def test_groups_stay_whole_where_they_can(spark):
    docs = spark.createDataFrame([(k, f"text {k // 4}") for k in range(8000)], "doc_id long, text string")
    rows = sharding.assign_shards(docs, 5, tolerance=0.02).collect()
    shards = defaultdict(set)
    for r in rows:
        shards[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in shards.values())


def test_repeated_rows_are_spread(spark, monkeypatch):
    """Equal rows have equal hashes; only a third key tells them apart."""
    monkeypatch.setattr(sharding, "SLICE_ROWS", 20)  # slices in parts
    docs = spark.createDataFrame([(1, "the same row " * 15)] * 2400, "doc_id long, text string")
    rows = sharding.assign_shards(docs, 24).collect()
    check(docs.collect(), rows, 24, rows[0]["size"])


def test_write_shards(spark, tmp_path, odd_docs, no_docs):
    docs = odd_docs.withColumn("shard", F.lit("x")).withColumn("hi", F.lit(1)).withColumn("tie", F.lit("t"))
    docs = docs.unionByName(spark.createDataFrame([(9, "again " * 20, "en", "s", 1, "x", 1, "t")] * 400, docs.schema))
    cuts = sharding.write_shards(docs, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    rows = lambda df: sorted(map(str, df.drop("shard").select(*[c for c in docs.columns if c != "shard"]).collect()))
    assert len(cuts) == 3 and rows(back) == rows(docs)
    assert back.groupBy("shard").count().count() >= 3
    sharding.write_shards(no_docs, str(tmp_path / "none"), 4)
    assert not list((tmp_path / "none").glob("shard=*"))
