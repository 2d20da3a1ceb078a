"""Exact Jaccard join on word shingles by parity sketches.

A set's tokens (shingle hashes) are dealt by hash into m parts; the XOR of a part's tokens
is its parity word.  A token that only one of two sets holds changes at most one word, so
the number of unequal words never exceeds the symmetric difference.  Sets that link differ
in at most (|A| + |B|) / 9 tokens at a threshold of 0.8; with m above that bound for the
size band, some non-empty word must be equal: the pigeonhole join.  Three exact filters
keep it small:

* sets are joined once, however many documents hold them;
* a set none of whose words are shared often enough to leave only the allowed difference
  cannot link to anything;
* of the shared words a set needs only its rarest (the prefix of a global order by rarity).

What is left is verified on the whole token sets.  Within a group of equal words each set is
first compared with one leader; only groups that the verified links leave in several
components are compared further, by bit sketches (parities of the tokens dealt to bits),
whose Hamming distance bounds the symmetric difference from below: first each set with its
nearest ones of other components, and at the end all that may still link across components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footing.llm.common import durable, text_bytes
from footing.llm.components import components
from footing.llm.words import WordIndex, mix, resting, shingles

#: Parts beyond the pigeonhole bound, so that empty parts do not use it up.
SPARE = 1.15
#: Candidate sets up to which their ids are broadcast (24 bytes each); beyond, a shuffle join.
BROADCAST_IDS = 500_000
#: A key is hot when more than this share of all rows hold it, or this many whatever their share; found on the rows of every
#: SAMPLED-th node by hash, with so many rows of it there at least.  The hottest BROADCAST_IDS are told apart at most.
HOT, HOT_ROWS, SAMPLED, HOT_LEAST = 1 / 2000, 2_000_000, 64, 100
#: Members of a group that one task compares with each other by their bit sketches.
BLOCK = 2048
#: Nearest neighbours of each set that a round verifies, before all that are left are.
ROUNDS = (1, 8, None)
#: Members that one copy of a leader's set is compared with in a task.
MEMBERS = 256


@dataclass(frozen=True)
class Bounds:
    """Of a threshold of num / den: sets link when den * both >= num * either."""

    num: int = 80
    den: int = 100

    def largest(self, n: int) -> int:
        """Largest set that one of n tokens can link to."""
        return n * self.den // self.num

    def differ(self, a: int, b: int) -> int:
        """Most tokens in which linked sets of a and b tokens differ."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)


def _level(n: int) -> int:
    return n.bit_length() - 1


def _plan(n: int, level: int, bounds: Bounds) -> tuple[int, int]:
    """Parts at a level, and the most tokens in which a set of n may differ there."""
    top = (2 << level) - 1
    parts = int(SPARE * (bounds.differ(top, top) + 1)) + 1
    return parts, bounds.differ(n, min(bounds.largest(n), top))


def words_of(tokens: np.ndarray, level: int, bounds: Bounds) -> tuple[np.ndarray, int, int]:
    """Keys of a set's non-empty parity words at a level, their number, and the allowed difference.

    ``tokens``: distinct and sorted.  Where too few parts are filled for the pigeonhole,
    every token is a key as well.
    """
    parts, allowed = _plan(len(tokens), level, bounds)
    part = ((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    word = np.bitwise_xor.reduceat(tokens, first)
    tag = (part[first] + np.uint64(1)) * np.uint64(64) + np.uint64(level)
    keys = mix(word + mix(tag))
    if len(keys) <= allowed:
        keys = np.concatenate([keys, mix(tokens + mix(np.array([level], dtype=np.uint64)))])
        return keys, len(first), len(keys)  # nothing to be left out
    return keys, len(first), allowed


SKETCH = "doc_id long, text_key long, n long, node long, levels array<int>, filled array<int>, allowed array<int>, keys array<array<long>>"


def _tokens(body: bytes, index: WordIndex, width: int) -> np.ndarray:
    return np.unique(shingles(index.hashed(body.lower().split()), width))


def _sketch(width: int, bounds: Bounds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, seen = WordIndex(), set()
        for batch in batches:
            ids, sizes, nodes, levels, filled, allowed = [], [], [], [], [], []
            flat, ends, outer = [], [0], [0]
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = _tokens(body.as_py(), index, width)
                n = len(tokens)
                node = _node(tokens)
                ids.append(doc)
                sizes.append(n)
                nodes.append(node)
                own: tuple[list, list, list] = ([], [], [])
                # a set that this task has met before has its keys there
                if n and node not in seen:
                    seen.add(node)
                    base = _level(n)
                    for level in range(base, _level(bounds.largest(n)) + 1):
                        if bounds.differ(n, bounds.largest(n)) == 0:
                            break  # links only to its equals
                        keys, full, most = words_of(tokens, level, bounds)
                        for column, x in zip(own, (level, full if most != len(keys) else len(keys), most)):
                            column.append(x)
                        flat.append(keys)
                        ends.append(ends[-1] + len(keys))
                outer.append(len(ends) - 1)
                levels.append(own[0])
                filled.append(own[1])
                allowed.append(own[2])
            values = pa.array(np.concatenate(flat).view(np.int64) if flat else np.empty(0, np.int64), pa.int64())
            inner = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            lists = pa.ListArray.from_arrays(pa.array(outer, pa.int32()), inner)
            small = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(levels, small), pa.array(filled, small), pa.array(allowed, small), lists],
                names=["doc_id", "text_key", "n", "node", "levels", "filled", "allowed", "keys"],
            )

    return run


def _node(tokens: np.ndarray) -> int:
    """A set's 64-bit name, signed; 0 for the empty set."""
    if not len(tokens):
        return 0
    return int((np.bitwise_xor.reduce(mix(tokens)) + np.uint64(len(tokens))).astype(np.int64))


def _sets(width: int):
    """Token sets of rows (node, body), of those whose text has that set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = WordIndex()
        for batch in batches:
            nodes, sets = [], []
            for node, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = _tokens(body.as_py(), index, width)
                if _node(tokens) == node:
                    nodes.append(node)
                    sets.append(tokens.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "tokens"])

    return run


def _compare(bounds: Bounds):
    """Rows sorted by (a, salt, leader first): links between a's set and those that follow it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            out_a, out_b = [], []
            for a, b, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                mine = np.frombuffer(tokens.as_buffer(), dtype=np.uint64)
                if b is None:
                    at, held = a, mine.copy()
                    continue
                assert at == a
                both = len(np.intersect1d(held, mine, assume_unique=True))
                if bounds.den * both >= bounds.num * (len(held) + len(mine) - both):
                    out_a.append(a)
                    out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return run


def _verify(pairs: DataFrame, sets: DataFrame, bounds: Bounds) -> DataFrame:
    """The pairs (a, b) whose sets link.  A leader with many members stands in many tasks."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.greatest(F.lit(1), F.ceil(F.col("degree") / F.lit(MEMBERS)).cast("int"))))
    salted = durable(salted.select("a", "b", "salt"), "pairs")
    members = salted.join(sets.withColumnRenamed("node", "b"), "b").select("a", "b", "tokens", "salt")
    leaders = salted.select("a", "salt").distinct().join(sets.withColumnRenamed("node", "a"), "a").select("a", F.lit(None).cast("long").alias("b"), "tokens", "salt")
    rows = leaders.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return durable(rows.mapInArrow(_compare(bounds), "a long, b long"), "links")


def _degrees(pairs: DataFrame) -> DataFrame:
    """Adds how many pairs a leader has; durable, so that a hot leader's join can be split."""
    return pairs.join(durable(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("degree")), "degrees"), "a")


def jaccard_components(docs: DataFrame, width: int = 5, bounds: Bounds = Bounds(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every row's set size and component: doc_id, n_shingles, component_id.

    A set holds the distinct runs of ``width`` words (A-Z in lower case); with fewer words,
    the whole sequence.  Null, empty and blank texts have the empty set, which links with
    nothing: component_id is the own id.  Equal sets always link.  component_id is the least
    id that links reach; null ids are passed over, and a component of null ids alone has
    null.  Repeated rows each have a row; no rows give none; other columns are not looked at.
    """
    body = text_bytes(text)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("body"), F.xxhash64(body).alias("text_key"))
    sketches = durable(source.mapInArrow(resting(_sketch(width, bounds)), SKETCH), "sketches")
    members = sketches.select("doc_id", "n", "node")
    classes = durable(members.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")), "classes")
    linked = _linked(sketches, source, width, bounds).withColumnRenamed("label", "to")
    named = durable(classes.join(linked, "node", "left").select("node", "least", F.coalesce("to", "node").alias("label")), "named")
    lowest = durable(named.groupBy("label").agg(F.min("least").alias("component_id")), "component-ids")
    ids = durable(named.join(lowest, "label").select("node", "component_id"), "class-components")
    filled = members.where("n > 0").join(ids, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return filled.unionByName(empty)


def _hot_keys(keys: DataFrame) -> DataFrame | None:
    """Keys that more than HOT of the rows, or HOT_ROWS rows, hold, as the rows of one node in SAMPLED tell; None if there are none.

    How rows are dealt depends on it, no result does.
    """
    some = keys.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLED)) == 0).select("key")
    counts = durable(some.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "sampled-keys")
    size = counts.agg(F.sum("n")).first()[0] or 0
    least = max(HOT_LEAST, min(HOT * size, HOT_ROWS / SAMPLED))
    hot = durable(counts.where(F.col("n") > least).orderBy(F.desc("n"), "key").limit(BROADCAST_IDS).select("key"), "hot-keys")
    return hot if hot.take(1) else None


def _linked(sketches: DataFrame, source: DataFrame, width: int, bounds: Bounds) -> DataFrame:
    """node, label: the components of all links between sets, of nodes that have links."""
    each = sketches.select("node", F.posexplode("keys").alias("k", "own"), "filled", "allowed")
    keys = each.select("node", F.get("filled", F.col("k")).alias("filled"), F.get("allowed", F.col("k")).alias("allowed"), F.explode("own").alias("key"))
    hot = _hot_keys(keys)
    cold = keys if hot is None else keys.join(F.broadcast(hot), "key", "left_anti")
    # a key's rows meet in one task; those of a hot key do not: it is counted with map-side combining, and its rows stay where they are
    by_key = Window.partitionBy("key")
    met = cold.withColumns({"low": F.min("node").over(by_key), "high": F.max("node").over(by_key), "seen": F.count(F.lit(1)).over(by_key)}).where("low <> high")
    met = met.drop("low", "high")
    if hot is not None:
        of_hot = keys.join(F.broadcast(hot), "key")
        counts = of_hot.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("seen")).where("low <> high")
        met = met.unionByName(keys.join(F.broadcast(counts.select("key", "seen")), "key").select(*met.columns))  # at most BROADCAST_IDS keys
    shared = durable(met.groupBy("key", "node", "filled", "allowed").agg(F.first("seen").alias("seen")), "shared")
    # exact filters: enough shared words, and of them the rarest
    plan = Window.partitionBy("node", "filled", "allowed")
    ranked = shared.withColumn("n_shared", F.count(F.lit(1)).over(plan)).where(F.col("n_shared") >= F.col("filled") - F.col("allowed"))
    ranked = ranked.withColumn("rank", F.row_number().over(plan.orderBy("seen", "key")))
    kept = ranked.where(F.col("rank") <= F.col("allowed") + 1 - (F.col("filled") - F.col("n_shared"))).select("key", "node")
    kept = durable(kept, "kept")
    leads = durable(kept.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high"), "leads")
    joined = durable(kept.join(leads, "key").select("key", "node", "low"), "groups")
    sets = _candidate_sets(sketches, joined.select("node").distinct(), source, width)
    # first each set with the least leader of its groups
    first = joined.groupBy(F.col("node").alias("b")).agg(F.min("low").alias("a")).where("a < b")
    links = _verify(_degrees(first), sets, bounds)
    found = durable(components(links), "components")
    # then the groups that these links leave apart, across the components only
    sketched = None
    for most in ROUNDS:
        labelled = durable(joined.join(found, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")), "labelled")
        apart = labelled.groupBy("key").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count(F.lit(1)).alias("size")).where("l0 <> l1").select("key", "size")
        rest = durable(labelled.join(durable(apart, "apart"), "key"), "rest")
        if not rest.take(1):
            break
        if sketched is None:
            sketched = _bit_sketches(sets.join(rest.select("node").distinct(), "node", "left_semi"))
        pairs = durable(_across(rest, sketched, bounds, most), "cross-pairs")
        fresh = _verify(_degrees(pairs), sets, bounds)
        if fresh.take(1):
            links = links.unionByName(fresh)
            found = durable(components(links), "components")
        joined = rest.select("key", "node")
    return found


def bit_sketch(tokens: np.ndarray) -> np.ndarray:
    """Parities of the tokens dealt to 2 to 4 bits a token (a power of two), as 64-bit words.

    Every token that only one of two sets holds flips one bit, so the Hamming distance never
    exceeds the symmetric difference.  XOR of a sketch's halves is the sketch of half the bits.
    """
    width = 64 << max(0, _level(max(1, len(tokens))) + 2 - 6)
    at = (mix(tokens ^ np.uint64(0x5DEECE66D)) & np.uint64(width - 1)).astype(np.int64)
    odd = np.bincount(at, minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def near(sketches: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, blocks: np.ndarray, bounds: Bounds, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of different labels whose sizes and sketches allow a link.

    For each i its ``most`` nearest, or all.  Members of several blocks: pairs across them only.
    """
    width = min(map(len, sketches))
    rows = np.empty((len(sketches), width), dtype=np.uint64)
    for k, x in enumerate(sketches):
        while len(x) > width:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        rows[k] = x
    across = blocks.min() != blocks.max()
    left, right = [], []
    step = max(1, 1_000_000 // (width * len(rows)))
    for k in range(0, len(rows), step):
        some = slice(k, k + step)
        far = np.bitwise_count(rows[some, None, :] ^ rows[None, :, :]).sum(axis=2, dtype=np.int64)
        a, b = sizes[some, None], sizes[None, :]
        fits = (far <= (a + b) * (bounds.den - bounds.num) // (bounds.den + bounds.num)) & (labels[some, None] != labels[None, :])
        fits &= (a * bounds.den >= b * bounds.num) & (b * bounds.den >= a * bounds.num)
        if across:
            fits &= blocks[some, None] != blocks[None, :]
        if most is not None and most < len(rows):
            far = np.where(fits, far, np.iinfo(np.int64).max)
            best = np.argpartition(far, most - 1, axis=1)[:, :most]
            chosen = np.zeros_like(fits)
            np.put_along_axis(chosen, best, True, axis=1)
            fits &= chosen
        i, j = np.nonzero(fits)
        left.append(i + k)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def _bit_sketches(sets: DataFrame) -> DataFrame:
    """node, n, bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in own], pa.int64()), pa.array([bit_sketch(x).tobytes() for x in own], pa.binary())], names=["node", "n", "bits"])

    return durable(sets.select("node", "tokens").mapInArrow(run, "node long, n long, bits binary"), "bit-sketches")


def _across(rest: DataFrame, sketched: DataFrame, bounds: Bounds, most: int | None) -> DataFrame:
    """Pairs (a, b) that share a group, not a label, and whose bit sketches allow a link.

    Sketches are compared in blocks within a task; of each set its ``most`` nearest go on.
    A group of more than BLOCK members is dealt to blocks, and each pair of blocks is a
    task's work.
    """
    rows = rest.join(sketched, "node").withColumn("blocks", F.ceil(F.col("size") / F.lit(BLOCK)).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label", "n", "bits")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at, done = None, set()

        def found() -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                return
            numbers = [np.array([x[k] for x in held]) for k in (4, 6, 5, 3)]
            i, j = near([np.frombuffer(x[7], dtype=np.uint64) for x in held], *numbers[1:], bounds, most)
            nodes = numbers[0]
            pairs = {*zip(np.minimum(nodes[i], nodes[j]).tolist(), np.maximum(nodes[i], nodes[j]).tolist())} - done
            if len(done) < 1_000_000:  # sets that share one group share others; a pair is passed on once a task
                done.update(pairs)
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != at:
                    yield from found()
                    held, at = [], row[:3]
                held.append(row)
        yield from found()

    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def _candidate_sets(sketches: DataFrame, nodes: DataFrame, source: DataFrame, width: int) -> DataFrame:
    """node, tokens: the whole sets of the nodes, each from one document that has it."""
    own = sketches.select("node", F.struct("doc_id", "text_key").alias("row")).join(nodes, "node", "left_semi")
    chosen = durable(own.groupBy("node").agg(F.min("row").alias("row")).select("node", F.col("row.doc_id").alias("chosen"), F.col("row.text_key").alias("chosen_key")), "chosen")
    # ids and text hashes alone are broadcast, and only if few; else texts are shuffled once.  A row without an id, or with another's, is
    # told by its text, so that rows that share an id do not meet each other's sets
    small = F.broadcast if chosen.count() <= BROADCAST_IDS else (lambda x: x)
    rows = source.join(small(chosen), (source["text_key"] == chosen["chosen_key"]) & source["doc_id"].eqNullSafe(chosen["chosen"])).select("node", "body")
    return durable(rows.mapInArrow(resting(_sets(width)), "node long, tokens binary").groupBy("node").agg(F.first("tokens").alias("tokens")), "sets")


def one_of_each(docs: DataFrame, width: int = 5, bounds: Bounds = Bounds(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs, all columns, that stand for their component: those with its least id.

    Repeated rows of an id stay once for each distinct text.  Rows without an id give way to
    one with an id in their component; else they stay once for each distinct text.
    """
    found = durable(jaccard_components(docs, width, bounds, text, doc_id), "components-by-id")
    gone = durable(found.where("component_id is not null and not (doc_id <=> component_id)").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    # ids alone are broadcast, and only if few; beyond that the texts are shuffled
    small = F.broadcast if gone.count() <= BROADCAST_IDS else (lambda x: x)
    rest = docs.join(small(gone), docs[doc_id].cast("long").eqNullSafe(gone["gone"]), "left_anti")
    again = durable(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("again")), "repeated-ids")
    n_again = again.count()
    if not n_again:
        return rest
    few = F.broadcast(again) if n_again <= BROADCAST_IDS else again
    same = docs[doc_id].cast("long").eqNullSafe(again["again"])
    return rest.join(few, same, "left_anti").unionByName(rest.join(few, same, "left_semi").dropDuplicates([doc_id, text]))
