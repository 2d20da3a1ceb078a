import hashlib

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from footing.llm import queries, yinyang


def lloyd(v, start, rounds):
    """Every distance of every round, plainly."""
    centroids = [list(c) for c in start]
    for nth in range(rounds + 1):
        d = [[sum((a - b) ** 2 for a, b in zip(x, c)) for c in centroids] for x in v]
        own = [min(range(len(centroids)), key=lambda c, r=row: (r[c], c)) for row in d]
        if nth < rounds:
            for c in range(len(centroids)):
                mine = [x for x, k in zip(v, own) if k == c]
                if mine:
                    centroids[c] = [sum(s) // len(mine) for s in zip(*mine)]
    return own, [row[c] for row, c in zip(d, own)], centroids


def run(spark, v, start, rounds, groups=None):
    df = spark.createDataFrame([(k, [int(x) for x in row]) for k, row in enumerate(v)], "vec_id long, v array<int>").repartition(3)
    found = yinyang.cluster_vectors(df, start, rounds, groups)
    rows = sorted(found.vectors.collect())
    return [r["cluster"] for r in rows], [r["distance"] for r in rows], found


@pytest.mark.parametrize(("spread", "groups"), [(3, 1), (3, 4), (60, 3), (60, None), (1 << 25, 2)])
def test_equals_a_full_scan(spark, spread, groups):
    """Small spreads are full of ties; the largest needs whole numbers beyond what floats hold."""
    rng = np.random.default_rng(spread)
    v = rng.integers(-spread, spread + 1, (400, 5)).tolist()
    start = v[:12] + [v[0]]  # a centroid twice: the second stays empty
    own, distance, found = run(spark, v, start, 4, groups)
    assert (own, distance, found.centroids) == lloyd(v, start, 4)


def test_filters_spare_distances(spark):
    rng = np.random.default_rng(1)
    middle = rng.integers(-3000, 3000, (30, 8))
    v = (middle[rng.integers(0, 30, 3000)] + rng.integers(-40, 40, (3000, 8))).tolist()
    _, _, found = run(spark, v, middle.tolist(), 4)
    assert found.scanned[0] == 30 * 3000 and sum(found.scanned[2:]) < 0.1 * 3 * 30 * 3000


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "vec_id long, v array<int>")
    assert yinyang.with_totals(yinyang.cluster_vectors(none, yinyang.first_by_hash(none))).collect() == []
    own, distance, _ = run(spark, [[1, 2]], [[1, 2]], 3)
    assert (own, distance) == ([0], [0])


def test_vectors_that_are_kept(spark):
    rows = [(1, [0.5] * 64), (2, [0.5] * 63), (3, None), (4, [float("nan")] + [0.0] * 63), (5, [None] + [0.0] * 63), (6, [float("inf")] + [0.0] * 63), (7, [-1e30] * 64), (None, [-0.001] * 64), (1, [0.5] * 64), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash"))
    got = {(r["vec_id"], r["v"][0], len(r["v"])) for r in yinyang.integer_vectors(df).collect()}
    assert got == {(1, 32, 64), (7, -yinyang.MOST, 64), (None, -1, 64)}
    df = yinyang.integer_vectors(df)
    found = yinyang.with_totals(yinyang.cluster_vectors(df, yinyang.first_by_hash(df))).collect()
    assert len(found) == 4 and sum(r["distance"] for r in found) == found[0]["inertia"]


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    v = {r["vec_id"]: [int(np.floor(64 * float(x))) for x in r["embedding"]] for r in rows}
    ids = sorted(v)
    start = [v[k] for k in sorted(ids, key=lambda k: hashlib.sha256(f"1:{k}".encode()).hexdigest())[:16]]
    own, distance, centroids = lloyd([v[k] for k in ids], start, 3)
    got = sorted(queries.op12_yinyang_clustering(spark, SF).collect())
    assert [(r["vec_id"], r["cluster"], r["distance"]) for r in got] == list(zip(ids, own, distance))
    for r in got:
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()
        assert r["cluster_inertia"] == sum(d for d, c in zip(distance, own) if c == r["cluster"]) and r["inertia"] == sum(distance)
