import random
import re

import numpy as np
from conftest import DOCS, SF
from pyspark.sql import functions as F

from footing.llm import jaccard
from footing.llm.queries import op10_jaccard_join

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(docs, num=80, den=100):
    sets = []
    for d in docs:
        w = WORD.findall((d["text"] or "").encode().lower())
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    n = len(docs)
    up = list(range(n))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    holders = {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    for k, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j < k}:
            if top(j) != top(k):
                both = len(s & sets[j])
                if den * both >= num * (len(s) + len(sets[j]) - both):
                    up[top(j)] = top(k)
    least = {}
    for k, d in enumerate(docs):
        if d["doc_id"] is not None:
            least[top(k)] = min(least.get(top(k), d["doc_id"]), d["doc_id"])
    return sorted(((d["doc_id"], len(sets[k]), least.get(top(k))) for k, d in enumerate(docs)), key=str)


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert rows(op10_jaccard_join(spark, SF)) == brute(docs)


def test_edges_of_the_threshold(spark):
    """Chains of copies with a few words changed, at many lengths, around the threshold."""
    rng = random.Random(5)
    texts = []
    for n in [*range(1, 40), 60, 63, 64, 65, 80, 100, 128, 200, 255, 256, 300]:
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        texts.append(" ".join(words))
        for _ in range(7):
            other = list(words)
            for _ in range(rng.randrange(0, max(2, n // 30 + 2))):
                how, at = rng.randrange(3), rng.randrange(len(other) + 1)
                if how == 0:
                    other[at : at + 1] = [f"x{rng.randrange(10**6)}"]
                elif how == 1:
                    other.insert(at, "extra")
                else:
                    other = other[: max(1, len(other) - rng.randrange(n // 8 + 2))]
            texts.append(" ".join(other).upper() if rng.random() < 0.3 else " ".join(other))
            if rng.random() < 0.5:
                words = other
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], DOCS)
    assert rows(jaccard.jaccard_components(docs)) == brute(docs.collect())


def test_shared_passage_alone_does_not_link(spark):
    rng = random.Random(7)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 60))) + " " + passage for _ in range(150)]
    texts += [passage + f" {k}" for k in range(30)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], DOCS)
    assert rows(jaccard.jaccard_components(docs)) == brute(docs.collect())


def test_dense_group_just_below_the_threshold(spark):
    """Copies too far from their source to link, of which a few link with each other."""
    rng = random.Random(9)
    source = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for _ in range(200):
        words = list(source)
        for at in rng.sample(range(120), rng.choice((2, 3, 5, 6))):
            words[at] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], DOCS)
    was, jaccard.BLOCK = jaccard.BLOCK, 40
    try:
        assert rows(jaccard.jaccard_components(docs)) == brute(docs.collect())
    finally:
        jaccard.BLOCK = was


def test_bit_sketch_bounds_the_difference():
    rng = np.random.default_rng(3)
    for n in (1, 5, 30, 64, 200, 1000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        for k in (0, 1, n // 5, n):
            b = np.concatenate([a[k:], rng.integers(0, 2**63, k // 2).astype(np.uint64)])
            x, y = jaccard.bit_sketch(a), jaccard.bit_sketch(b) if len(b) else jaccard.bit_sketch(b)
            while len(x) > len(y):
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            assert np.bitwise_count(x ^ y).sum() <= k + k // 2


def test_odd_rows(spark, odd_docs, no_docs):
    assert rows(jaccard.jaccard_components(odd_docs)) == brute(odd_docs.collect())
    assert jaccard.jaccard_components(no_docs).count() == 0


def test_hot_keys_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = rows(jaccard.jaccard_components(docs))
    monkeypatch.setattr(jaccard, "HOT", 1e-5)
    monkeypatch.setattr(jaccard, "SAMPLED", 2)
    monkeypatch.setattr(jaccard, "HOT_LEAST", 2)
    seen = []
    inner = jaccard._hot_keys
    monkeypatch.setattr(jaccard, "_hot_keys", lambda keys: seen.append(inner(keys)) or seen[-1])
    assert rows(jaccard.jaccard_components(docs)) == plain and seen[0].count() > 20


def test_rows_without_ids_take_no_longer(spark):
    """Near copies whose ids are null or shared: the same links, and each text read as often as with ids of its own."""
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join([*words[:57], f"x{k}", *words[58:]]) for k in range(300)]
    whole = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for ids in (F.lit(None).cast("long"), F.lit(7).cast("long"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id"))):
        docs = whole.withColumn("doc_id", ids)
        got = jaccard.jaccard_components(docs).collect()
        assert len(got) == 300 and len({r["component_id"] for r in got}) == 1
        assert got[0]["component_id"] == min((r["doc_id"] for r in docs.collect() if r["doc_id"] is not None), default=None)


def test_a_text_is_read_once_for_each_set(spark, monkeypatch):
    """Whichever ids rows have, as many rows reach the sets' reader as there are texts that stand for one."""
    docs = spark.createDataFrame([(None, f"a b c d e f g h i j k l m n o p q r s t u v w x y{k % 5}") for k in range(200)], "doc_id long, text string")
    source = docs.select("doc_id", F.col("text").cast("binary").alias("body"), F.xxhash64(F.col("text").cast("binary")).alias("text_key"))
    sketches = source.mapInArrow(jaccard._sketch(5, jaccard.Bounds()), jaccard.SKETCH)
    nodes = sketches.select("node").distinct()
    read = source.join(sketches.groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("r")), F.col("r.text_key") == F.col("text_key")).count()
    assert nodes.count() == 5 and read == 200 and jaccard._candidate_sets(sketches, nodes, source, 5).count() == 5


def test_absolute_bound_of_hot_keys(spark, monkeypatch):
    """However large the input, a key of more rows than the bound is told apart."""
    keys = spark.range(200_000).select(F.when(F.col("id") % 100 == 0, 1).otherwise(F.col("id") + 2).alias("key"), F.col("id").alias("node"))
    monkeypatch.setattr(jaccard, "HOT", 0.9)
    monkeypatch.setattr(jaccard, "HOT_LEAST", 5)
    assert jaccard._hot_keys(keys) is None
    monkeypatch.setattr(jaccard, "HOT_ROWS", 640)
    assert [r["key"] for r in jaccard._hot_keys(keys).collect()] == [1]
