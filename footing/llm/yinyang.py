"""Exact k-means on integer vectors with Yinyang's filters.

Centroids are clustered into groups once.  Every vector keeps an upper bound of the distance to
its centroid and one lower bound for each group; when centroids move, bounds move by the drifts.  A vector
whose upper bound is below all its lower bounds keeps its centroid unseen (global filter); else
groups whose bound is not beaten are looked into (group filter), and of those the centroids that
the group's former bound and their own drift do not rule out (local filter) are measured exactly.

Distances are whole numbers.  Bounds are floats, widened at every step by more than their rounding,
and only a strictly smaller bound filters, so ties are always measured and results equal a full scan's.

Vectors lie in one table that each round rewrites by map tasks alone; nothing is shuffled but sums
of the vectors that changed their centroid, a row for each batch and centroid.  The driver holds centroids: k rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footing.llm.common import durable, release, written

#: Components lie within this bound, so that squared distances fit 64 bits; larger ones are set to it.
MOST = 1 << 26
#: Below this bound products are exact in floats too.
FLOAT_EXACT = 1 << 20
#: Bounds are widened by this share of their terms.
SLACK = 1e-12

STATE = "vec_id long, v array<int>, cluster int, was int, upper double, lower array<double>, scanned int"


@dataclass
class Model:
    """What tasks need to know of a round: centroids, their groups, and how far they have moved."""

    centroids: np.ndarray
    group: np.ndarray
    drift: np.ndarray
    groups: int = field(init=False)

    def __post_init__(self) -> None:
        self.groups = int(self.group.max()) + 1 if len(self.group) else 0


@dataclass(frozen=True)
class Clustering:
    """``vectors``: vec_id, cluster, distance; ``centroids``: the last ones, number by number; ``scanned``: distances measured in each round."""

    vectors: DataFrame
    centroids: list[list[int]]
    scanned: list[int]


def integer_vectors(table: DataFrame, dims: int = 64, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, v: floor(scale * x) of every vector with exactly ``dims`` finite components; all others are left out.

    Components beyond ``MOST`` either way are set to it.  Null ids stay; other columns are not looked at.
    """
    e = F.col(f"`{embedding}`")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(e, lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(x.cast("double") * scale))).cast("int"))
    return table.where((F.size(e) == dims) & finite).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), whole.alias("v"))


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, vectors by centroids."""
    if not vectors.size or max(np.abs(vectors).max(), np.abs(centroids).max()) < FLOAT_EXACT:
        a, b = vectors.astype(float), centroids.astype(float)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([_to(vectors, c) for c in centroids], axis=1)


def _to(vectors: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to a centroid, or each to its own."""
    away = vectors - to
    return np.einsum("ij,ij->i", away, away)


def nearest(d: np.ndarray) -> np.ndarray:
    return d.argmin(axis=1)  # of equal ones the first


def _above(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d) * (1 + SLACK)


def _below(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d) * (1 - SLACK)


def _group_minima(e: np.ndarray, best: np.ndarray, model: Model) -> np.ndarray:
    """Of every row and group the least entry, the row's own centroid not counted."""
    e = e.copy()
    e[np.arange(len(e)), best] = np.inf
    return np.stack([e[:, model.group == g].min(axis=1) for g in range(model.groups)], axis=1)


def first_assignment(v: np.ndarray, model: Model) -> tuple:
    d = squared(v, model.centroids)
    best = nearest(d)
    return best, _above(d[np.arange(len(d)), best]), _group_minima(_below(d), best, model), np.full(len(v), len(model.centroids))


def next_assignment(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, model: Model) -> tuple:
    """cluster, upper, lower and distances measured, after centroids moved by ``drift``."""
    drift, k = model.drift, len(model.centroids)
    most = np.array([drift[model.group == g].max() for g in range(model.groups)])
    former = lower
    upper = (upper + drift[cluster]) * (1 + SLACK)
    lower = former - most - SLACK * (np.where(np.isfinite(former), former, 0) + most)
    cluster, scanned = cluster.copy(), np.zeros(len(v), dtype=np.int64)
    rows = np.flatnonzero(~(upper < lower.min(axis=1)))
    own = _to(v[rows], model.centroids[cluster[rows]])
    scanned[rows] += 1
    upper[rows] = _above(own)
    still = ~(upper[rows] < lower[rows].min(axis=1))
    rows, own = rows[still], own[still]
    if len(rows):
        at = np.arange(len(rows))
        bound = former[rows][:, model.group] - drift - SLACK * (np.where(np.isfinite(former[rows]), former[rows], 0)[:, model.group] + drift)
        bound[at, cluster[rows]] = _below(own)
        best, least, top, old = cluster[rows].copy(), own.copy(), upper[rows].copy(), cluster[rows]
        vectors = v[rows]
        for g in range(model.groups):
            open_ = ~(top < lower[rows, g])
            for c in np.flatnonzero(model.group == g):
                some = np.flatnonzero(open_ & (old != c) & ~(top < bound[:, c]))
                if not len(some):
                    continue
                d = _to(vectors[some], model.centroids[c])
                scanned[rows[some]] += 1
                bound[some, c] = _below(d)
                nearer = (d < least[some]) | ((d == least[some]) & (c < best[some]))
                best[some[nearer]], least[some[nearer]] = c, d[nearer]
                top[some[nearer]] = _above(d[nearer])
        cluster[rows], upper[rows], lower[rows] = best, top, _group_minima(bound, best, model)
    return cluster, upper, lower, scanned


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def _listed(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(rows.reshape(-1)))


def _round(model: Model, first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    dims = model.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = _vectors(b.column(1), dims)
            if first:
                was = np.full(len(v), -1)
                out = first_assignment(v, model)
            else:
                was = b.column(2).to_numpy().astype(np.int64)
                lower = b.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
                out = next_assignment(v, was, b.column(3).to_numpy(), lower, model)
            cluster, upper, lower, scanned = out
            columns = [b.column(0), b.column(1), pa.array(cluster, pa.int32()), pa.array(was, pa.int32()), pa.array(upper), _listed(lower), pa.array(scanned, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "cluster", "was", "upper", "lower", "scanned"])

    return run


def _moved(k: int, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each batch and centroid: vectors and component sums that came, less those that went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v, to, was = _vectors(b.column(0), dims), b.column(1).to_numpy(), b.column(2).to_numpy()
            n, sums = np.bincount(to, minlength=k), np.zeros((k, dims), dtype=np.int64)
            np.add.at(sums, to, v)
            gone = was >= 0
            n = n - np.bincount(was[gone], minlength=k)
            np.subtract.at(sums, was[gone], v[gone])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(n, pa.int64()), _listed(sums)], names=["cluster", "n", "sums"])

    return run


def group_centroids(centroids: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """Number of each centroid's group: a few plain rounds among the centroids alone, all on the driver."""
    middle = centroids[:groups].astype(float)
    group = np.zeros(len(centroids), dtype=np.int64)
    for _ in range(rounds):
        group = ((centroids[:, None, :] - middle[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(groups):
            if (group == g).any():
                middle[g] = centroids[group == g].mean(axis=0)
    return np.unique(group, return_inverse=True)[1]


def cluster_vectors(vectors: DataFrame, start: list[list[int]], rounds: int = 3, groups: int | None = None) -> Clustering:
    """Lloyd's rounds from ``start``, then one more assignment; see the module's text.

    ``vectors`` (vec_id, v) is read once and should be durable; ids may be null or repeated.  A centroid moves to
    floor(sum / count) of its vectors by component, an empty one stays.  No vectors, or no centroids: no rows.
    ``groups``: by default one for each ten centroids.
    """
    spark = vectors.sparkSession
    dims, k = len(start[0]) if start else 0, len(start)
    if not k:
        none = spark.createDataFrame([], "vec_id long, cluster int, distance long")
        return Clustering(none, [], [])
    now = np.asarray(start, dtype=np.int64)
    group = group_centroids(now, groups or -(-k // 10))
    counts, sums = [0] * k, [[0] * dims for _ in range(k)]
    state, model, scanned = vectors, Model(now, group, np.zeros(k)), []
    for nth in range(rounds + 1):
        before = written()
        mine = state.select("vec_id", "v") if nth == 0 else state.select("vec_id", "v", "cluster", "upper", "lower")
        new = durable(mine.mapInArrow(_round(model, nth == 0), STATE), f"yinyang{nth}")
        if nth:
            release(before - 1, before)
        state = new
        scanned.append(state.agg(F.sum("scanned")).first()[0] or 0)
        if nth == rounds:
            break
        deltas = state.where("cluster <> was").select("v", "cluster", "was").mapInArrow(_moved(k, dims), "cluster int, n long, sums array<long>")
        added = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
        for r in deltas.groupBy("cluster").agg(F.sum("n").alias("n"), *added).collect():  # k rows
            counts[r["cluster"]] += r["n"]
            sums[r["cluster"]] = [a + int(r[f"s{i}"]) for i, a in enumerate(sums[r["cluster"]])]
        moved = np.asarray([[s // n for s in own] if n else old.tolist() for own, n, old in zip(sums, counts, now)], dtype=np.int64)
        drift = np.sqrt(((moved - now) ** 2).sum(axis=1)) * (1 + SLACK)
        now, model = moved, Model(moved, group, drift)
    return Clustering(state.select("vec_id", "cluster", _distance(now)), now.tolist(), scanned)


def _distance(centroids: np.ndarray):
    """Exact squared distance of v to its cluster's centroid."""
    own = F.get(F.array(*[F.array(*[F.lit(int(x)) for x in c]) for c in centroids]), F.col("cluster"))
    square = F.zip_with("v", own, lambda a, b: (a.cast("long") - b.cast("long")) * (a.cast("long") - b.cast("long")))
    return F.aggregate(square, F.lit(0).cast("long"), lambda s, x: s + x).alias("distance")


def first_by_hash(vectors: DataFrame, k: int = 16, salt: str = "1:") -> list[list[int]]:
    """The k vectors with the smallest sha256 of salt and id (null: no digits), ties by components: k rows for the driver."""
    by = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [list(r["v"]) for r in vectors.orderBy(by, "v").limit(k).collect()]


def with_totals(found: Clustering) -> DataFrame:
    """The clustering's vectors with cluster_inertia, inertia and centroid_sha256."""
    import hashlib

    vectors = durable(found.vectors, "yinyang-result")
    sums = {r["cluster"]: int(r["s"]) for r in vectors.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    whole = sum(sums.values())
    rows = [(c, sums[c], whole, hashlib.sha256(",".join(map(str, found.centroids[c])).encode()).hexdigest()) for c in sums]
    totals = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return vectors.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
