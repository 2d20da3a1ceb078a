"""Shards of near equal bytes by histogram sort, in DataFrame operations only.

Rows are ordered by (hash of the text, hash of the id, number among equal rows): equal texts
lie together, and every row has a key of its own, however often it is repeated.  Shard boundaries (splitters) are places in that order.
Each round counts exact bytes below evenly spaced candidate boundaries within every
splitter's open interval, in one map-side combined aggregation; an interval shrinks 4096
fold a round, so a splitter settles after a few.  All rows move once, at the end.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footing.llm.common import durable

#: Bits that one round of probes resolves, and bits of the two hashes.
ROUND_BITS = 12
KEY_BITS = 60
#: Slices of a shard within which slots are numbered, so that no shard is one task, and parts of a slice that
#: has more rows than SLICE_ROWS (repeated rows all lie in one).
SLICES, PARTS = 256, 32
SLICE_ROWS = 1_000_000
KEYS = ("hi", "lo", "tie")

#: Rows at or above (hi, lo, tie) in key order belong to a later shard.
Splitter = tuple[int, int, int]


def _keys(df: DataFrame, text: str, doc_id: str) -> list:
    """hi, lo and tie of a row.  tie tells repeated rows apart; which of them gets which makes no difference."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    top = lambda c: F.shiftrightunsigned(c, 64 - KEY_BITS)
    return [top(F.xxhash64(body)).alias("hi"), top(F.xxhash64(F.col(doc_id), body)).alias("lo"), top(F.xxhash64(F.monotonically_increasing_id())).alias("tie")]


def _sized(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return df.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body).cast("long") + F.lit(8)).alias("size"), F.crc32(body).alias("text_crc32"), *_keys(df, text, doc_id))


def _at_or_above(cut: Splitter) -> Column:
    hi, lo, tie = (F.col(k) for k in KEYS)
    a, b, c = (F.lit(x) for x in cut)
    return (hi > a) | ((hi == a) & ((lo > b) | ((lo == b) & (tie >= c))))


def _shard(cuts: list[Splitter]) -> Column:
    return reduce(lambda n, cut: n + _at_or_above(cut).cast("int"), cuts, F.lit(0))


def _cells(rows: DataFrame, part: int, shift: int, step: int, wanted: list[tuple]) -> dict[tuple, list[tuple[int, int]]]:
    """Exact bytes of the cells in each wanted interval (prefix, cell): interval -> [(cell, bytes)]."""
    column = F.col(KEYS[part])
    prefix = F.array(*[F.col(k) for k in KEYS[:part]]).cast("array<long>")
    if part or shift != KEY_BITS:
        test = lambda w: reduce(and_, [F.col(k) == F.lit(x) for k, x in zip(KEYS, w[0])], F.shiftright(column, shift) == F.lit(w[1]))
        rows = rows.where(reduce(or_, map(test, wanted)))
    found = rows.groupBy(prefix.alias("p"), F.shiftright(column, shift - step).alias("cell")).agg(F.sum("size").alias("b"))
    out: dict[tuple, list[tuple[int, int]]] = {}
    for r in found.collect():  # at most 2 ** step cells an interval
        out.setdefault((tuple(r["p"]), r["cell"] >> step), []).append((r["cell"], r["b"]))
    return out


def find_splitters(rows: DataFrame, shards: int, tolerance: float) -> list[Splitter]:
    """Splitters whose exact bytes below are within tolerance (a share of a shard) of even.

    ``rows`` has size, hi, lo, tie.  The driver sees at most (shards - 1) * 4096 cells a round.
    A splitter prefers the edge between two texts; it cuts a group of equal texts only
    when no such edge is near enough.  A single row longer than the tolerance bounds what
    can be met: the nearer of its two sides is taken then.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / shards
    targets = [total * k / shards for k in range(1, shards)]
    found: list[Splitter] = [(1 << KEY_BITS, 0, 0)] * len(targets)
    # open intervals: values of the keys settled so far, cell of the next, exact bytes below
    open_: dict[int, tuple[tuple, int, int]] = {k: ((), 0, 0) for k in range(len(targets))}
    for part in range(len(KEYS)):
        shift = KEY_BITS
        while shift and open_:
            step = min(ROUND_BITS, shift)
            inside = _cells(rows, part, shift, step, sorted({(p, c) for p, c, _ in open_.values()}))
            shift -= step
            still: dict[int, tuple[tuple, int, int]] = {}
            for k, (prefix, cell, below) in open_.items():
                cut = lambda bound: (*prefix, bound << shift, *(0,) * (len(KEYS) - part - 1))  # noqa: B023, E731
                for c, size in sorted(inside.get((prefix, cell), [])):
                    near = [bound for bound, at in ((c, below), (c + 1, below + size)) if abs(at - targets[k]) <= slack and bound << shift < 1 << KEY_BITS]
                    if near:
                        found[k] = cut(near[0])
                        break
                    if below <= targets[k] <= below + size:
                        if part == len(KEYS) - 1 and not shift:  # a single row is larger than the tolerance
                            found[k] = cut(c if targets[k] - below <= below + size - targets[k] else c + 1)
                        else:
                            still[k] = (prefix, c, below)
                        break
                    below += size
            open_ = still
        # what is still open is one text's group, then one row's copies: go on within it
        open_ = {k: ((*prefix, cell), 0, below) for k, (prefix, cell, below) in open_.items()}
    return sorted(found)


def assign_shards(docs: DataFrame, shards: int = 24, tolerance: float = 0.002, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Shard and slot of every row; see the module's text for the method.

    Returns doc_id, size, text_crc32, hi, lo, shard, slot.  size is the text's UTF-8 bytes
    plus 8.  Null texts count as empty, null ids as an id of their own; repeated rows each
    get a slot, and are spread like any others; an empty table gives no rows; other columns are
    not looked at.
    """
    rows = durable(_sized(docs, text, doc_id), "shard-keys")
    placed = rows.withColumn("shard", _shard(find_splitters(rows, shards, tolerance))).withColumn("slice", F.shiftright("lo", KEY_BITS - 8).cast("int"))
    # slots: exact counts of what lies below, then numbers within a part of a slice
    counted = placed.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SLICE_ROWS)
    large = [r["at"] for r in counted.select((F.col("shard") * SLICES + F.col("slice")).alias("at")).collect()]  # at most shards * SLICES
    part = F.when((F.col("shard") * SLICES + F.col("slice")).isin(large), F.pmod("tie", F.lit(PARTS))).otherwise(0) if large else F.lit(0)
    placed = placed.withColumn("part", part.cast("int"))
    counts = placed.groupBy("shard", "slice", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("slice", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "slice", "part", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "slice", "part").orderBy("hi", "lo", "doc_id", "tie")) - 1
    # at most shards * SLICES * PARTS rows, whatever the input
    return placed.withColumn("within", within).join(F.broadcast(starts), ["shard", "slice", "part"]).select(
        "doc_id", "size", "text_crc32", "hi", "lo", "shard", (F.col("before") + F.col("within")).cast("long").alias("slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, tolerance: float = 0.002, text: str = "text", doc_id: str = "doc_id", files: int = 8) -> list[Splitter]:
    """Write every row below ``path`` as shard=N folders, moving each row once, from a durable copy.

    Each shard is cut in ``files`` parts so that its writing is shared by as many tasks.
    A column named shard is replaced, all others stay as they are.  Null texts and ids are
    written like any other; repeated rows are each written, parted by number when a splitter lies
    among them; an empty table writes no row.  Returns the splitters.
    """
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c != "shard"]
    size = (F.octet_length(F.coalesce(F.col(text), F.lit("")).cast("binary")).cast("long") + F.lit(8)).alias("size")
    # written once: numbers that tell repeated rows apart must be those that the splitters were found by
    rows = durable(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), size, *_keys(docs, text, doc_id)), "shard-rows")
    cuts = find_splitters(rows.select("size", *KEYS), shards, tolerance)
    keyed = rows.withColumn("shard", _shard(cuts))
    moved = keyed.repartition(shards * files, F.col("shard"), F.pmod(F.col("tie"), F.lit(files))).sortWithinPartitions("shard", *KEYS)
    moved.select(*kept, "shard").write.partitionBy("shard").parquet(path)
    return cuts
