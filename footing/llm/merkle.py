"""Merkle manifest of a dataset by parent preimages.

A leaf is the digest of a row's fields.  A group's leaves, in order, are hashed in runs of
``fan_out`` until one node, the group's root, remains; group roots are hashed likewise into the
dataset's root.  Every parent is stored with its *preimage*, the digests of its children one after
the other.  A leaf's path is the list of its ancestors' preimages with its slot in each: cutting
the slot out gives the siblings that prove it, and writing another digest over the slot, hashing,
and going on with the next preimage folds a changed leaf up to the root it would have.

Places within a group come from one range exchange of the leaves (digests, not texts) by group
and order: a hot group is as many tasks as it fills, and a node never has more than ``fan_out`` children
that meet its path.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footing.llm.common import durable

#: Characters of a digest.
DIGEST = 64
#: Rows of counts up to which they are broadcast; beyond it they are joined by exchange.
BROADCAST_ROWS = 100_000
PATH = "array<struct<preimage:string,slot:int>>"


def digest(text: Column) -> Column:
    """Lowercase hex sha256 of a text's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Digest of fields one after the other: ``-`` for null, else UTF-8 byte count, ``:`` and the value."""
    each = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return digest(F.concat(*each))


@dataclass(frozen=True)
class Manifest:
    """``leaves``: key, pos (place in its group), n (rows of the group), hash and row (a struct of what was kept).

    ``levels``: the groups' parents level by level from the leaves up (key, pos, n, preimage, hash); ``top`` the
    same for the tree over group roots, whose leaves are ``subroots``.  ``root`` is None for an empty table.
    """

    leaves: DataFrame
    levels: tuple[DataFrame, ...]
    subroots: DataFrame
    top: tuple[DataFrame, ...]
    root: str | None
    fan_out: int


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Adds pos (from 0, by order within the group, null groups one of them) and n (rows of the group).

    Rows are sorted by one range exchange; where a range ends within a group, numbers go on
    with the counts of the ranges before.  Rows that are equal in all of ``order`` are told apart by an
    arbitrary number, so that no value is one task's.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    by = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], F.col("_tie").asc()]
    at = tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    placed = durable(at.withColumn("_part", F.shiftright("_at", 33).cast("int")), "merkle-order")
    runs = placed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    own = Window.partitionBy(group)
    before = F.coalesce(F.sum("_rows").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = durable(runs.select(F.col(group).alias("_group"), F.col("_part").alias("_of"), "_first", before.alias("_before"), F.sum("_rows").over(own).alias("n")), "merkle-runs")
    small = starts.count() <= BROADCAST_ROWS
    both = placed.join(F.broadcast(starts) if small else starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of")))
    return both.withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_group", "_of", "_first", "_before")


def _parents(nodes: DataFrame, fan_out: int) -> DataFrame:
    """The level above: runs of fan_out nodes of every group that has more than one."""
    run = F.floor(F.col("pos") / fan_out).alias("pos")
    child = F.struct((F.col("pos") % fan_out).alias("slot"), F.col("hash"))
    runs = nodes.where("n > 1").groupBy("key", run, F.ceil(F.col("n") / fan_out).alias("n")).agg(F.array_sort(F.collect_list(child)).alias("children"))
    preimage = F.array_join(F.transform("children", lambda c: c["hash"]), "")
    return runs.select("key", "pos", "n", preimage.alias("preimage")).withColumn("hash", digest(F.col("preimage")))


def _levels(leaves: DataFrame, most: int, fan_out: int) -> tuple[DataFrame, ...]:
    """All levels above leaves of which the largest group has ``most``."""
    out, nodes = [], leaves
    while most > 1:
        nodes = durable(_parents(nodes, fan_out), f"merkle-level{len(out) + 1}")
        out.append(nodes)
        most = -(-most // fan_out)
    return tuple(out)


def build_manifest(rows: DataFrame, key: str, order: Sequence[str], leaf: Column, keep: Sequence[Column], fan_out: int = 16) -> Manifest:
    """The trees over ``rows``: a group for each value of ``key`` (null is one), leaves in ascending ``order``.

    ``leaf`` is the digest of a row (:func:`leaf_digest`); the columns ``keep`` stay with the leaves in the struct row,
    so that no name clashes; others are not looked at.  Nulls in ``order`` come first, ties are ordered by their leaf, repeated rows are leaves of their own.
    Groups are ordered by key, null first, bytewise.  An empty table has no root.
    """
    by = [f"_by{k}" for k in range(len(order))]
    own = rows.select(F.col(f"`{key}`").cast("string").alias("key"), *[F.col(f"`{c}`").alias(b) for b, c in zip(by, order)], leaf.alias("hash"), F.struct(*keep).alias("row"))
    leaves = durable(numbered(durable(own, "merkle-leaves"), "key", [*by, "hash"]).drop(*by), "merkle-numbered")
    levels = _levels(leaves, leaves.agg(F.max("n")).first()[0] or 0, fan_out)
    ends = [level.where("n = 1").select("key", "hash") for level in (leaves, *levels)]
    roots = ends[0]
    for more in ends[1:]:
        roots = roots.unionByName(more)
    roots = durable(roots.withColumnRenamed("key", "of").withColumn("key", F.lit("")), "merkle-roots")
    subroots = durable(numbered(roots, "key", ["of"]), "merkle-subroots")
    top = _levels(subroots, subroots.agg(F.max("n")).first()[0] or 0, fan_out)
    last = (top[-1] if top else subroots).select("hash").first()  # one row
    return Manifest(leaves, levels, subroots, top, last["hash"] if last else None, fan_out)


def _down(nodes: DataFrame, levels: Sequence[DataFrame], ends: DataFrame, fan_out: int) -> DataFrame:
    """``nodes`` with the path and other columns that ``ends`` (key, path, ...) gives the last node of their tree.

    From the top level down each node takes its parent's path, with the parent's preimage and its own
    slot before it; at most fan_out nodes share a parent.
    """
    more = [c for c in ends.columns if c not in ("key", "path")]
    above = None
    for k in reversed(range(len(levels) + 1)):
        here = nodes if k == 0 else levels[k - 1]
        single = here.where("n = 1").alias("x").join(ends.alias("e"), F.col("x.key").eqNullSafe(F.col("e.key"))).select("x.*", "e.path", *[f"e.{c}" for c in more])
        out = single
        if above is not None:
            up = above.select(F.col("key").alias("_key"), F.col("pos").alias("_pos"), F.col("preimage").alias("_preimage"), F.col("path").alias("_path"), *more)
            own = here.where("n > 1").withColumn("_up", F.floor(F.col("pos") / fan_out))
            met = own.join(up, F.col("key").eqNullSafe(F.col("_key")) & (F.col("_up") == F.col("_pos")))
            step = F.array(F.struct(F.col("_preimage").alias("preimage"), (F.col("pos") % fan_out).cast("int").alias("slot")))
            out = out.unionByName(met.withColumn("path", F.concat(step, F.col("_path"))).select(*out.columns))
        above = out if k == 0 else durable(out.select("key", "pos", "preimage", "path", *more), f"merkle-path{k}")
    return above


def with_paths(manifest: Manifest) -> DataFrame:
    """The manifest's leaves with path (own group's preimages, then those above group roots), subroot and root."""
    if manifest.root is None:
        return manifest.leaves.withColumns({"path": F.lit(None).cast(PATH), "subroot": F.lit(None).cast("string"), "root": F.lit(None).cast("string")})
    start = manifest.leaves.sparkSession.createDataFrame([("", [])], f"key string, path {PATH}")
    groups = _down(manifest.subroots, manifest.top, start, manifest.fan_out)
    ends = durable(groups.select(F.col("of").alias("key"), "path", F.col("hash").alias("subroot")), "merkle-ends")
    return _down(manifest.leaves, manifest.levels, ends, manifest.fan_out).withColumn("root", F.lit(manifest.root))


def siblings(path: Column) -> Column:
    """All siblings' digests, level by level up to the root, left to right: every slot cut out of its preimage."""
    return F.array_join(F.transform(path, lambda p: F.overlay(p["preimage"], F.lit(""), p["slot"] * DIGEST + 1, F.lit(DIGEST))), "")


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf leads to: written over its slot, hashed, and so on up its path."""
    return F.aggregate(path, leaf, lambda h, p: digest(F.overlay(p["preimage"], h, p["slot"] * DIGEST + 1, F.lit(DIGEST))))
