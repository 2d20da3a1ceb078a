"""A hierarchical Pitman-Yor language model trained and applied over the whole corpus.

Every word is predicted in the restaurant of its context, the word before it: every previous
word has one of its own.  Those of the OWN most frequent words are children of 16 coarse
restaurants, by ending; those of all others are leaves, children of 128 shared
ones by ending, which are children of the coarse ones too.  All share one root whose base
gives an unseen word its share.  Words are dishes.  In a leaf every dish has one table, so a shared
restaurant's customers are the distinct previous words; all other levels are sampled.

A word's customers in all its restaurants depend on other words only through the restaurants'
totals (a few hundred numbers), so Gibbs sweeps run word by word, in parallel: a dish's customers
in one restaurant are removed together and seated again given all others (a block: the
conditional of its number of tables by generalised Stirling numbers, exact up to BLOCK customers and
by their saddle point beyond).  After each round the totals are summed anew.  Seatings carry on from
round to round: every random number is a hash of word, restaurant and sweep, so a pass replays
the earlier rounds instead of storing them, and no partitioning or retry changes a score.
Predictive probabilities are averaged over the last sweeps.

Scoring adds up frequent words (a list of fixed length, broadcast) where the text is: after OWN words, and in leaves those
of the most frequent pairs (another such list).  Other tokens meet the model in one join: rare words by word, with what they have
in leaves as a list, frequent ones in leaves by the pair of words.  Texts are scored in ROUNDS jobs, dealt by
a hash, so that only a share of their tokens is on its way at a time; what a job has shuffled goes with its end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from footing.llm.common import discard, durable, text_bytes
from footing.llm.words import CACHE_WORDS, WordIndex, mix

FINE, COARSE = 256, 16
#: Previous words that have a restaurant of their own, and restaurants that the others share.
OWN, SHARED = 128, 128
#: Columns of the table of words, in the order that all passes read them.
_WORDS = ("hash", "total", "ctx", "n")
#: Words whose probabilities are broadcast (4 * FINE bytes each); the others are joined.
HEAD_WORDS = 32_768
#: Pairs of a frequent word and a leaf that are broadcast at most (12 bytes each); the others are joined.
TOP_PAIRS = 1_000_000
#: Jobs that score the texts one after the other.
ROUNDS = 3
#: Tokens that a task counts before it passes the counts on.
CHUNK_TOKENS = 3_000_000
#: A word of more than this share of all tokens is counted in HOT_PARTS parts; at most 1 / HOT are such.
HOT, HOT_PARTS = 1e-4, 64
#: Customers of a dish up to which the table of Stirling numbers goes.
BLOCK = 32
#: Bits after the point of a rare word's log-probability.
FIXED = 40
END = b""
#: Stands before a text's first word.
START = b"\x00"


def ending(word: bytes) -> int:
    """One of SHARED classes: by the last byte (the upper four bits, the coarse class), then by the last three."""
    return (xxhash.xxh3_64_intdigest(word[-1:]) & 15) << 3 | (xxhash.xxh3_64_intdigest(word[-3:]) & 7)


@dataclass(frozen=True)
class Contexts:
    """Which restaurant a previous word leads to; ``own``: hash -> restaurant; ``hot``: hashes counted in parts."""

    own: dict
    hot: np.ndarray
    parents: np.ndarray  # coarse class of each of the FINE restaurants

    def of(self, word: bytes, hashed: int) -> int:
        found = self.own.get(hashed)
        return OWN + ending(word) if found is None else found


class ClassedIndex(WordIndex):
    """Also keeps each word's context."""

    def __init__(self, contexts: Contexts) -> None:
        super().__init__()
        self.contexts = contexts
        self.classes = np.empty(1 << 16, dtype=np.uint8)

    def codes(self) -> np.ndarray:
        """Each word as a context: its hash with the class in the last byte."""
        return (self.hashes()[: len(self)] & ~np.uint64(255)) | self.classes[: len(self)]

    def __missing__(self, word: bytes) -> int:
        n = super().__missing__(word)
        if n >= len(self.classes):
            self.classes = np.concatenate([self.classes, np.empty(len(self.classes), dtype=np.uint8)])
        self.classes[n] = self.contexts.of(word, int(self.hashes()[n]))
        return n


def _tokens(bodies: list[bytes], index: ClassedIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, word index and previous word's index of all tokens, each text closed by END."""
    parts, sizes = [], []
    for body in bodies:
        words = body.lower().split()
        words.append(END)
        parts.append(index.indexes(words))
        sizes.append(len(words))
    word = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    before = np.empty(len(word), dtype=np.int64)
    before[1:] = word[:-1]
    ends = np.cumsum(sizes)
    before[np.concatenate([[0], ends[:-1]]).astype(np.int64)] = index[START]
    return np.repeat(np.arange(len(bodies)), sizes), word, before


def find_contexts(texts: DataFrame) -> Contexts:
    """The OWN most frequent words, ties by hash, and the hot ones; exact counts over all of ``texts`` (body).

    The end of a text is no context.  The driver sees OWN + 1 / HOT rows at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = WordIndex()
        total = np.zeros(0, dtype=np.int64)

        def flush() -> pa.RecordBatch:
            hashes = index.hashes()[: len(index)].view(np.int64)
            kinds = np.fromiter((ending(w) >> 3 for w in index), dtype=np.int32, count=len(index))
            return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(kinds), pa.array(total)], names=["hash", "coarse", "n"])

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                words: list[bytes] = []
                for body in batch.column(0)[k : k + 256]:
                    words += body.as_py().lower().split()
                    words.append(END)
                found = np.bincount(index.indexes(words), minlength=len(index))
                found[: len(total)] += total
                total = found
                if len(index) > CACHE_WORDS:
                    yield flush()
                    index.clear()
                    total = total[:0]
        if len(index):
            yield flush()

    counts = texts.select("body").mapInArrow(run, "hash long, coarse int, n long").groupBy("hash", "coarse").agg(F.sum("n").alias("n"))
    counts = durable(counts, "word-totals", tidy=True)
    size = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") > HOT * size).select("hash").collect()
    end = int(np.uint64(xxhash.xxh3_64_intdigest(END)).view(np.int64))
    top = counts.where(F.col("hash") != end).orderBy(F.desc("n"), "hash").limit(OWN).collect()
    shared = np.arange(FINE) - OWN >> 3
    parents = np.array([*(r["coarse"] for r in top), *shared[len(top) :]], dtype=np.int64) & 15
    own = {int(np.int64(r["hash"]).view(np.uint64)): k for k, r in enumerate(top)}
    discard(counts)
    return Contexts(own, np.sort(np.array([r["hash"] for r in hot], dtype=np.int64)), parents)


def pair_counts(texts: DataFrame, contexts: Contexts) -> DataFrame:
    """hash, before, n: how often each word follows each context (``ClassedIndex.codes``).  ``texts`` has body.

    With each pair of a leaf go the leaf's customers and dishes; one of its pairs leads.  Contexts that are no leaves, the
    most frequent ones, are dealt in parts by word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, held, size = ClassedIndex(contexts), [], 0

        def flush() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(held), return_counts=True)
            hashes, before = index.hashes()[code & 0xFFFFFFFF], index.codes()[code >> 32]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(before.view(np.int64)), pa.array(n.astype(np.int64))], names=["hash", "before", "n"])

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                _, word, before = _tokens([x.as_py() for x in batch.column(0)[k : k + 256]], index)
                held.append(before << 32 | word)
                size += len(word)
                if size >= CHUNK_TOKENS or len(index) > CACHE_WORDS:
                    yield flush()
                    size = 0
                    if len(index) > CACHE_WORDS:
                        index.clear()
        if held:
            yield flush()

    cells = texts.select("body").mapInArrow(run, "hash long, before long, n long")
    part = F.when(_class() < OWN, F.pmod("hash", F.lit(HOT_PARTS))).otherwise(0)
    # one exchange for the counts and what is summed up by leaf; a file's rows of one leaf lie together
    sums = cells.withColumn("part", part).repartition("before", "part").groupBy("before", "part", "hash").agg(F.sum("n").alias("n"))
    leaf = Window.partitionBy("before", "part")
    leads = F.col("hash") == F.min("hash").over(leaf)
    whole = sums.select("hash", "before", "n", F.sum("n").over(leaf).alias("customers"), F.count(F.lit(1)).over(leaf).alias("dishes"), leads.alias("leads"))
    return durable(whole, "pairs", tidy=True)


def _class(before: str = "before") -> Column:
    return F.col(before).bitwiseAND(F.lit(255)).cast("int")


def word_counts(texts: DataFrame, contexts: Contexts, pairs: DataFrame | None = None) -> DataFrame:
    """hash, total, ctx, n: every word's customers by restaurant above the leaves.  ``texts`` has body.

    A hot word's counts meet in HOT_PARTS tasks by context, then once more as one short list a part.
    """
    pairs = pair_counts(texts, contexts) if pairs is None else pairs
    part = F.when(F.col("hash").isin(contexts.hot.tolist()), _class() % HOT_PARTS).otherwise(-1)
    # a leaf sends its parent one customer a dish
    customers = F.when(_class() < OWN, F.col("n")).otherwise(1)
    cells = pairs.select("hash", part.alias("part"), _class().alias("ctx"), "n", customers.alias("customers"))
    sums = cells.groupBy("hash", "part", "ctx").agg(F.sum("n").alias("tokens"), F.sum("customers").alias("n"))
    # at most FINE contexts a word
    lists = sums.groupBy("hash", "part").agg(F.sum("tokens").alias("total"), F.collect_list(F.struct("ctx", "n")).alias("own"))
    lists = durable(lists, "word-parts", tidy=True)
    whole = lists.where("part < 0").select("hash", "total", "own")
    joined = lists.where("part >= 0").groupBy("hash").agg(F.sum("total").alias("total"), F.flatten(F.collect_list("own")).alias("own"))
    own = F.array_sort("own")
    return whole.unionByName(joined).select("hash", "total", F.transform(own, lambda x: x["ctx"]).alias("ctx"), F.transform(own, lambda x: x["n"]).alias("n"))


def leaves(pairs: DataFrame, strength: float) -> tuple[DataFrame, DataFrame]:
    """Of every previous word but the OWN: (before, fresh), the chance of its parent; and of its dishes (hash, before, n, rho).

    P(word) in a leaf is fresh * (P(word) in its parent + rho).  The discount comes from the pairs' ones and twos.
    """
    own = pairs.where(_class() >= OWN)
    a, b = own.agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    d = float(min(0.95, max(0.05, a / (a + 2 * b)))) if a + b else 0.5
    room = F.lit(strength) + d * F.col("dishes")
    seated = own.select("hash", "before", "n", ((F.col("n") - d) / room).alias("rho"))
    return own.where("leads").select("before", (room / (strength + F.col("customers"))).alias("fresh")), seated


@dataclass
class Totals:
    """Customers and tables of all restaurants, discounts and strengths by level, and the vocabulary."""

    customers: list  # of arrays: root (1), coarse, fine
    tables: list
    discount: tuple[float, float, float]
    strength: tuple[float, float, float]
    vocabulary: int
    tokens: int
    unseen: float  # share of the base that is for words not in the vocabulary
    parents: np.ndarray  # coarse restaurant of each fine one

    def fresh(self, level: int) -> np.ndarray:
        """Chance that a customer of each restaurant goes to the parent."""
        d, s = self.discount[level], self.strength[level]
        return (s + d * self.tables[level]) / (s + self.customers[level])

    @property
    def base(self) -> float:
        return (1 - self.unseen) / max(1, self.vocabulary)


def uniform(keys: np.ndarray, draw: int) -> np.ndarray:
    """Numbers in (0, 1): the same for the same key and draw."""
    step = np.uint64((2 * draw + 1) * 0x9E3779B97F4A7C15 % 2**64)
    mixed = mix(mix(keys + step))
    return ((mixed >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


@lru_cache(maxsize=8)
def stirling(discount: float) -> np.ndarray:
    """log S(n, t) of the seatings of n customers at t tables, n and t up to BLOCK: weights (1 - d), (2 - d), ... multiply."""
    out = np.full((BLOCK + 1, BLOCK + 1), -np.inf)
    out[1, 1] = 0.0
    for n in range(1, BLOCK):
        t = np.arange(1, n + 1)
        out[n + 1, t] = out[n, t] + np.log(n - t * discount)
        out[n + 1, 2 : n + 2] = np.logaddexp(out[n + 1, 2 : n + 2], out[n, 1 : n + 1])
    return out


def seat(customers: np.ndarray, others: np.ndarray, parent: np.ndarray, strength: float, discount: float, keys: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of dishes whose customers are all seated anew, given everybody else.

    ``others``: tables of the restaurant's other dishes; ``parent``: the parent's probability of
    the dish.  t tables have weight S(n, t) * parent ** t * product of strength + discount *
    (others + j), j < t; S comes from a table up to BLOCK customers and from its saddle point beyond.
    """
    tables = np.ones(len(customers), dtype=np.int64)
    live = np.flatnonzero(customers > 1)  # one customer has one table
    drawn, draws = tables[live], uniform(keys[live], sweep)
    customers, others, parent = customers[live], others[live], parent[live]
    first = np.minimum(customers, BLOCK + 1)
    order = np.argsort(first, kind="stable")
    bounds = np.searchsorted(first[order], np.arange(2, BLOCK + 3))
    weights = stirling(discount)
    for n, (lo, hi) in enumerate(zip(bounds, bounds[1:]), 2):
        at = order[lo:hi]
        if not len(at):
            continue
        if n > BLOCK:
            drawn[at] = _many(customers[at], strength / discount + others[at], parent[at], discount, draws[at])
            continue
        more = np.log(strength + discount * (others[at][:, None] + np.arange(1, n)))
        more += np.log(parent[at])[:, None]
        logs = np.zeros((len(at), n))
        np.cumsum(more, axis=1, out=logs[:, 1:])
        logs += weights[n, 1 : n + 1]
        logs -= logs.max(axis=1, keepdims=True)
        share = np.cumsum(np.exp(logs, out=logs), axis=1)
        drawn[at] = 1 + (share < (draws[at] * share[:, -1])[:, None]).sum(axis=1)
    tables[live] = drawn
    return tables


def _many(customers: np.ndarray, a: np.ndarray, parent: np.ndarray, discount: float, u: np.ndarray) -> np.ndarray:
    """Tables of dishes with many customers: S(n, t) by its saddle point leaves a negative binomial.

    S(n, t) is n! / (t! d^t) times the n-th coefficient of (1 - (1 - x)^d)^t.  At the saddle
    point, with g = 1 - (1 - x)^d, tables beyond the first weigh (a + t) / t * parent * g each.
    """
    low, high = np.full(len(a), -700.0), np.zeros(len(a))  # of log(1 - x)
    for _ in range(48):
        y = (low + high) / 2
        g = -np.expm1(discount * y)
        seated = np.log(a * parent * discount) + np.log(-np.expm1(y)) + (discount - 1) * y - np.log1p(-parent * g)
        more = seated < np.log(customers)
        high, low = np.where(more, y, high), np.where(more, low, y)
    r = parent * -np.expm1(discount * (low + high) / 2)
    mean = (a + 1) * r / (1 - r)
    # inverse of the distribution function: summed up where it is short, normal where long
    out = mean + np.sqrt(mean / (1 - r)) * ndtri(u)
    short = np.flatnonzero(mean < 30)
    mass = np.exp((a[short] + 1) * np.log1p(-r[short]))
    done, k = mass.copy(), np.zeros(len(short))
    for step in range(400):
        go = done < u[short]
        if not go.any():
            break
        mass = mass * (a[short] + 1 + step) / (step + 1) * r[short]
        done += np.where(go, mass, 0)
        k += go
    out[short] = k
    return np.clip(np.rint(out).astype(np.int64) + 1, 1, customers)


def ndtri(p: np.ndarray) -> np.ndarray:
    """Quantile of the normal distribution, good to three digits (rational approximation by Hastings)."""
    t = np.sqrt(-2 * np.log(np.minimum(p, 1 - p)))
    # The approximation's coefficients.
    x = t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308)))
    return np.where(p < 0.5, -x, x)


class Words:
    """A batch of words with all their restaurants, laid out flat."""

    def __init__(self, batch: pa.RecordBatch, parents: np.ndarray) -> None:
        hashes, total, ctx, n = (batch.column(k) for k in range(4))
        self.tokens = int(total.to_numpy().sum())
        self.size = len(ctx)
        lengths = np.diff(ctx.offsets.to_numpy())
        self.row = np.repeat(np.arange(self.size), lengths)
        self.fine = ctx.flatten().to_numpy().astype(np.int64)
        self.n = n.flatten().to_numpy().astype(np.int64)
        pair = self.row * COARSE + parents[self.fine]
        self.pairs, self.up = np.unique(pair, return_inverse=True)  # (word, coarse) of each (word, fine)
        self.coarse, self.row1 = self.pairs % COARSE, self.pairs // COARSE
        key = hashes.to_numpy().view(np.uint64)
        step = np.uint64(0xD1342543DE82EF95)
        self.keys = [mix(key + step), mix(key[self.row1] + (self.coarse + 2).astype(np.uint64) * step), mix(key[self.row] + (self.fine + 2 + COARSE).astype(np.uint64) * step)]
        # one table for every dish
        self.t2 = np.ones(len(self.n), dtype=np.int64)
        self.c1 = np.bincount(self.up, minlength=len(self.pairs))
        self.t1 = np.ones(len(self.pairs), dtype=np.int64)
        self.c0 = np.bincount(self.row1, minlength=self.size)
        self.t0 = np.ones(self.size, dtype=np.int64)

    def predict(self, totals: Totals) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(word) at the root, in its coarse and in its fine restaurants."""
        (d0, d1, d2), s, c = totals.discount, totals.strength, totals.customers
        p0 = (self.c0 - d0 * self.t0) / (s[0] + c[0][0]) + totals.fresh(0)[0] * totals.base
        p1 = (self.c1 - d1 * self.t1) / (s[1] + c[1][self.coarse]) + totals.fresh(1)[self.coarse] * p0[self.row1]
        p2 = (self.n - d2 * self.t2) / (s[2] + c[2][self.fine]) + totals.fresh(2)[self.fine] * p1[self.up]
        return p0, p1, p2

    def sweep(self, totals: Totals, nth: int) -> None:
        """Seat all customers anew, a dish of a restaurant at a time, from the fine restaurants to the root."""
        p0, p1, _ = self.predict(totals)
        d, s, t = totals.discount, totals.strength, totals.tables
        rest = lambda level, at, own: np.maximum(t[level][at] - own, 0)
        self.t2 = seat(self.n, rest(2, self.fine, self.t2), p1[self.up], s[2], d[2], self.keys[2], nth)
        self.c1 = np.bincount(self.up, weights=self.t2, minlength=len(self.pairs)).astype(np.int64)
        self.t1 = seat(self.c1, rest(1, self.coarse, self.t1), p0[self.row1], s[1], d[1], self.keys[1], nth)
        self.c0 = np.bincount(self.row1, weights=self.t1, minlength=self.size).astype(np.int64)
        self.t0 = seat(self.c0, rest(0, np.zeros(self.size, dtype=np.int64), self.t0), np.full(self.size, totals.base), s[0], d[0], self.keys[0], nth)

    def sums(self) -> dict[str, np.ndarray]:
        """Whole numbers, so that they add up alike in any order."""
        by = lambda at, x, size: np.bincount(at, weights=x, minlength=size).astype(np.int64)
        ones = (by(self.row, self.n, self.size), by(self.up, self.n, len(self.pairs)), self.n)
        return {
            "c0": np.array([self.c0.sum()]),
            "t0": np.array([self.t0.sum()]),
            "c1": by(self.coarse, self.c1, COARSE),
            "t1": by(self.coarse, self.t1, COARSE),
            "c2": by(self.fine, self.n, FINE),
            "t2": by(self.fine, self.t2, FINE),
            # words, tokens, and dishes of one and of two customers by level
            "stats": np.array([self.size, self.tokens, *[(x == k).sum() for x in ones for k in (1, 2)]]),
        }


@dataclass(frozen=True)
class Sampling:
    """rounds: Gibbs rounds of ``sweeps`` sweeps; the totals that follow from the last ``samples`` of them go into
    the next.  Predictions are averaged over the last ``samples`` of one more round.  unseen: the base's share for unseen words."""

    rounds: int = 2
    sweeps: int = 3
    samples: int = 2
    strength: float = 5.0
    unseen: float = 0.95


def _samples(batch: pa.RecordBatch, history: list[Totals], sampling: Sampling) -> Iterator[Words]:
    """The batch's words after each sampled sweep of the last round; earlier rounds are replayed with their totals."""
    own, nth = Words(batch, history[0].parents), 0
    for k, totals in enumerate(history):
        for sweep in range(sampling.sweeps):
            own.sweep(totals, nth)
            nth += 1
            if k == len(history) - 1 and sweep >= sampling.sweeps - sampling.samples:
                yield own


def _gather(words: DataFrame, history: list[Totals], parents: np.ndarray, sampling: Sampling) -> dict[str, np.ndarray]:
    """Mean sums over all words and samples; without history, of one table a dish.  A task sends a few hundred numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for own in _samples(batch, history, sampling) if history else [Words(batch, parents)]:
                    for k, v in own.sums().items():
                        found[k] = found.get(k, 0) + v
        keys = [(k, i, int(x)) for k, v in found.items() for i, x in enumerate(v)]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in keys], t) for j, t in enumerate((pa.string(), pa.int32(), pa.int64()))], names=["k", "i", "x"])

    out = {"c0": np.zeros(1), "t0": np.zeros(1), "c1": np.zeros(COARSE), "t1": np.zeros(COARSE), "c2": np.zeros(FINE), "t2": np.zeros(FINE), "stats": np.zeros(8)}
    for r in words.select(*_WORDS).mapInArrow(run, "k string, i int, x long").groupBy("k", "i").agg(F.sum("x").alias("x")).collect():
        out[r["k"]][r["i"]] = r["x"] / (sampling.samples if history else 1)
    return out


def _with(totals: Totals, sums: dict[str, np.ndarray]) -> Totals:
    return replace(totals, customers=[sums["c0"], sums["c1"], sums["c2"]], tables=[sums["t0"], sums["t1"], sums["t2"]])


def fit_totals(words: DataFrame, parents: np.ndarray, sampling: Sampling = Sampling()) -> tuple[list[Totals], Totals]:
    """Totals of every round, and the mean totals of the seatings sampled in the last.

    Discounts come from the counts of ones and twos of each level.  The model divides by
    the second, so that it sums to one in every restaurant.
    """
    first = _gather(words, [], parents, sampling)
    v, n, *ones = first["stats"]
    discount = tuple(float(min(0.95, max(0.05, a / (a + 2 * b)))) if a + b else 0.5 for a, b in zip(ones[::2], ones[1::2]))
    history = [_with(Totals([], [], discount, (sampling.strength,) * 3, round(v), round(n), sampling.unseen, parents), first)]
    if not history[0].vocabulary:
        return history, history[0]
    for _ in range(sampling.rounds):
        history.append(_with(history[0], _gather(words, history, parents, sampling)))
    return history, _with(history[0], _gather(words, history, parents, sampling))


MODEL = "hash long, total long, p0 float, coarse array<int>, p1 array<float>, ctx array<int>, p2 array<float>"


def word_probabilities(words: DataFrame, history: list[Totals], mean: Totals, sampling: Sampling = Sampling()) -> DataFrame:
    """Per word: mean predictive probability over the samples, at the root and in its restaurants; further columns of ``words`` stay."""
    more = [c for c in words.columns if c not in _WORDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sums = [0.0, 0.0, 0.0]
            for own in _samples(batch, history, sampling):
                sums = [a + b for a, b in zip(sums, own.predict(mean))]
            p0, p1, p2 = (pa.array((x / sampling.samples).astype(np.float32)) for x in sums)
            at = pa.array(np.searchsorted(own.row1, np.arange(own.size + 1)).astype(np.int32))
            coarse = pa.ListArray.from_arrays(at, pa.array(own.coarse.astype(np.int32)))
            by_coarse = pa.ListArray.from_arrays(at, p1)
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(own.row, minlength=own.size))]).astype(np.int32))
            fine = pa.ListArray.from_arrays(offsets, pa.array(own.fine.astype(np.int32)))
            columns = [batch.column(0), batch.column(1), p0, coarse, by_coarse, fine, pa.ListArray.from_arrays(offsets, p2)]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[len(_WORDS) :]], names=[*(c.split()[0] for c in MODEL.split(", ")), *more])

    schema = ", ".join([MODEL, *(f"{c} {words.schema[c].dataType.simpleString()}" for c in more)])
    return words.select(*_WORDS, *more).mapInArrow(run, schema)


def _head(model: DataFrame, totals: Totals, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes, counts and log10 P(word | class) of the ``most`` most frequent words."""
    top = model.select("hash", "total").orderBy(F.desc("total"), "hash").limit(most).select("hash")
    rows = model.join(F.broadcast(top), "hash", "left_semi").toArrow().combine_chunks()
    hashes = rows["hash"].to_numpy()
    order = np.argsort(hashes, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    fresh1, fresh2 = totals.fresh(1), totals.fresh(2)
    p1 = (rows["p0"].to_numpy()[order][:, None] * fresh1).astype(np.float32)

    def flat(name: str) -> tuple[np.ndarray, np.ndarray]:
        column = rows[name].combine_chunks() if isinstance(rows[name], pa.ChunkedArray) else rows[name]
        return np.repeat(place, np.diff(column.offsets.to_numpy())), column.flatten().to_numpy()

    at, coarse = flat("coarse")
    p1[at, coarse] = flat("p1")[1]
    p2 = p1[:, totals.parents] * fresh2.astype(np.float32)
    at, fine = flat("ctx")
    p2[at, fine] = flat("p2")[1]
    return hashes[order], rows["total"].to_numpy()[order], np.log10(p2)


TEXT = "doc_id long, n_tokens long, n_known long, base double, score double"
TOKENS = f"row long, key long, before long, p2 float, text struct<{TEXT}>"


def _pair_key(hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
    return hashes ^ (before << np.uint64(1) | before >> np.uint64(63))


def _top(frequent: DataFrame, most: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The least count from which pairs (key, n, rho) are at most ``most``, their keys, ascending, and their rho."""
    counts = frequent.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).count().orderBy(F.desc("n")).collect()
    least, size = (1 << 16) + 1, 0
    for r in counts:
        size += r["count"]
        if size > most or r["n"] < 2:  # pairs seen once are the most and spare the least
            break
        least = r["n"]
    rows = frequent.where(F.col("n") >= least).select("key", "rho").toArrow()
    keys = rows["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return least, keys[order], rows["rho"].to_numpy()[order]


@dataclass(frozen=True)
class Lookup:
    """What scoring reads: frequent words and pairs (bounded, to broadcast); all other words and pairs, a row a key."""

    #: Of frequent words hashes, log10 of their base, of P(word | class) and of fresh (the last: a text's start); of frequent pairs keys and rho.
    shared: Broadcast
    words: DataFrame
    pairs: DataFrame


def _stem(code: str) -> Column:
    """What a word's hash and its context (``ClassedIndex.codes``) have in common."""
    return F.shiftright(code, 8)


def find_lookup(model: DataFrame, room: DataFrame, seated: DataFrame, totals: Totals, head_words: int) -> Lookup:
    """``model`` also has fresh; it is discarded as soon as it has been read."""
    v, spark = totals.vocabulary, model.sparkSession
    hashes, counts, logs = _head(model, totals, head_words) if v else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, FINE), np.float32))
    top = F.broadcast(spark.createDataFrame(pa.table({"hash": hashes})))
    found = dict(model.where("fresh is not null").join(top, "hash", "left_semi").select("hash", "fresh").collect())  # at most head_words
    first = int(np.uint64(xxhash.xxh3_64_intdigest(START)).view(np.int64)) >> 8
    start = room.where(_stem("before") == first).first()
    leaf = np.log10([found.get(h, 1.0) for h in hashes.tolist()] + [start["fresh"] if start else 1.0])
    turned = F.shiftleft("before", 1).bitwiseOR(F.shiftrightunsigned("before", 63))
    rho = F.col("rho").cast("float").alias("rho")
    frequent = seated.join(top, "hash", "left_semi").select(F.col("hash").bitwiseXOR(turned).alias("key"), "n", rho)
    least, keys, rhos = _top(frequent, TOP_PAIRS)
    # a rare word has fewer dishes in leaves than the head's last word has tokens
    lists = seated.join(top, "hash", "left_anti").groupBy("hash").agg(F.collect_list(F.struct("before", rho)).alias("x"))
    lists = lists.select("hash", F.col("x.before").alias("us"), F.col("x.rho").alias("rhos"))
    words = model.join(top, "hash", "left_anti").join(lists, "hash", "left")
    words = durable(words.withColumnRenamed("hash", "key").withColumnRenamed("p2", "p2s"), "rare-words", tidy=True)
    discard(model)
    frequent = durable(frequent.where(F.col("n") < least).select("key", "rho"), "pairs-of-leaves", tidy=True)
    # once for all rounds, as every executor keeps a copy; bounded by head_words and TOP_PAIRS
    shared = spark.sparkContext.broadcast((hashes, np.log10(counts + 0.5) - _norm(totals), logs, leaf, keys, rhos))
    return Lookup(shared, words, frequent)


def _norm(totals: Totals) -> float:
    return float(np.log10(totals.tokens + 0.5 * (totals.vocabulary + 1)))


def score_texts(docs: DataFrame, lookup: Lookup, totals: Totals, contexts: Contexts) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row of docs (doc_id, body)."""
    v, norm, shared = totals.vocabulary, _norm(totals), lookup.shared
    names = ["row", "key", "before", "p2", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, base, logs, leaf, keys, rhos = shared.value
        index, done = ClassedIndex(contexts), 0
        head = np.zeros(0, dtype=np.int64)
        part = TaskContext.get().partitionId() << 40
        fields = [pa.field(c.split()[0], pa.int64() if c.endswith("long") else pa.float64()) for c in TEXT.split(", ")]
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                ids = batch.column(0)[k : k + 256]
                if len(index) > CACHE_WORDS:
                    index.clear()
                    head = head[:0]
                text, word, before = _tokens([x.as_py() for x in batch.column(1)[k : k + 256]], index)
                fresh = index.hashes()[len(head) : len(index)].view(np.int64)
                if len(fresh):
                    at = np.searchsorted(hashes, fresh)
                    known = np.append(hashes, 0)[at] == fresh if len(hashes) else np.zeros(len(fresh), dtype=bool)
                    known &= at < len(hashes)
                    head = np.concatenate([head, np.where(known, at, -1)])
                place, kind, size = head[word], index.classes[before], len(ids)
                on = place >= 0
                add = lambda at, x: np.bincount(text[at], weights=x, minlength=size).astype(np.float64)
                # the previous word's leaf: of a head word, or a text's start; a rare word brings its own along
                opens = np.flatnonzero((before == index[START]) | (head[before] >= 0))
                score = add(opens, leaf[np.where(before[opens] == index[START], -1, head[before[opens]])])
                plain = np.flatnonzero(on & (kind < OWN))
                score += add(plain, logs[place[plain], kind[plain]])
                codes, own = index.codes(), index.hashes()
                seated = np.flatnonzero(on & (kind >= OWN))
                key = _pair_key(own[word[seated]], codes[before[seated]])
                order = np.argsort(key)  # near keys are looked for together
                seated, key = seated[order], key[order]
                p2 = 10.0 ** logs[place[seated], kind[seated]].astype(float) if len(hashes) else np.ones(0)
                at = np.searchsorted(keys, key)
                top = np.append(keys, np.uint64(0))[at] == key
                top &= at < len(keys)
                score += add(seated[top], np.log10(p2[top] + rhos[at[top]]))
                off, rare = seated[~top], np.flatnonzero(~on)
                rows = pa.array(part + done + np.arange(size))
                columns = [ids, *map(pa.array, (np.bincount(text, minlength=size), np.bincount(text[on], minlength=size), add(on, base[place[on]]), score))]
                # a text's row goes anywhere
                whole = [rows, rows, pa.nulls(size, pa.int64()), pa.nulls(size, pa.float32()), pa.StructArray.from_arrays(columns, fields=fields)]
                yield pa.RecordBatch.from_arrays(whole, names=names)
                many = len(off) + len(rare)
                tokens = [
                    pa.array(part + done + text[np.concatenate([rare, off])]),
                    pa.array(np.concatenate([own[word[rare]], key[~top]]).view(np.int64)),
                    pa.concat_arrays([pa.array(codes[before[rare]].view(np.int64)), pa.nulls(len(off), pa.int64())]),
                    pa.concat_arrays([pa.nulls(len(rare), pa.float32()), pa.array(p2[~top].astype(np.float32))]),
                    pa.nulls(many, pa.struct(fields)),
                ]
                yield pa.RecordBatch.from_arrays(tokens, names=names)
                done += size

    tokens = docs.select("doc_id", "body").mapInArrow(run, TOKENS)
    rest = lookup.words.unionByName(lookup.pairs, allowMissingColumns=True)
    fresh = lambda level: F.array(*[F.lit(float(x)) for x in totals.fresh(level)])
    at = _class()
    coarse = F.get(F.array(*[F.lit(int(x)) for x in totals.parents]), at)
    pick = lambda keys, values, key: F.get(values, F.array_position(keys, key).cast("int") - 1)
    # in fixed point, so that the order of a sum makes no difference
    fixed = lambda x: F.round(x * F.lit(2.0**FIXED)).cast("long")
    unseen = float(totals.fresh(0)[0]) * totals.unseen if v else 1.0
    p0 = F.coalesce(F.col("p0").cast("double"), F.lit(unseen))
    p1 = F.coalesce(pick("coarse", "p1", coarse).cast("double"), F.get(fresh(1), coarse) * p0)
    text, rare = F.col("text").isNotNull(), F.col("before").isNotNull()
    p2 = F.when(rare, F.coalesce(pick("ctx", "p2s", at).cast("double"), F.get(fresh(2), at) * p1)).otherwise(F.col("p2").cast("double"))
    rho = F.coalesce(F.when(rare, pick("us", "rhos", F.col("before"))).otherwise(F.col("rho")), F.lit(0.0))
    opened = F.when(rare, F.coalesce(F.log10("fresh"), F.lit(0.0))).otherwise(0.0)
    # the other side has a row a key, so that a task's share of it fits its memory
    parts = tokens.join(rest.hint("shuffle_hash"), "key", "left").select(
        "row",
        F.col("text.doc_id").alias("doc_id"),
        F.col("text.n_tokens").alias("n_tokens"),
        F.when(text, F.col("text.n_known")).otherwise((rare & F.col("total").isNotNull()).cast("long")).alias("n_known"),
        fixed(F.when(text, F.col("text.base")).when(rare, F.log10(F.coalesce("total", F.lit(0)) + 0.5) - F.lit(norm)).otherwise(0.0)).alias("base"),
        fixed(F.when(text, F.col("text.score")).otherwise(F.log10(p2 + rho) + opened)).alias("score"),
    )
    whole = [(F.sum(c) / F.lit(2.0**FIXED)).alias(name) for c, name in (("base", "base_score"), ("score", "score"))]
    sums = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), *whole)
    return sums.drop("row")


def score_documents(docs: DataFrame, training: Column, sampling: Sampling = Sampling(), head_words: int = HEAD_WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Learn from the rows where ``training`` holds, score all.

    A-Z count as a-z; tokens are the words and one end a text, so null, empty and blank
    texts have one token.  Returns doc_id, n_tokens, n_known, train_tokens, base_score and
    score (log10, summed).  Repeated rows each have a row; null ids stay; with no training
    rows no word is known and the model gives every token the whole mass (score 0); an empty
    table gives no rows; other columns are not looked at.
    """
    bodies = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("body"), F.coalesce(training, F.lit(False)).alias("training"))
    learned = bodies.where("training")
    contexts = find_contexts(learned)
    pairs = pair_counts(learned, contexts)
    room, seated = leaves(pairs, sampling.strength)
    # a context differs from its word's hash in the last byte
    fresh = room.select(_stem("before").alias("stem"), "fresh")
    counts = word_counts(learned, contexts, pairs)
    words = durable(counts.join(fresh, _stem("hash") == F.col("stem"), "left").drop("stem"), "word-counts", tidy=True)
    history, mean = fit_totals(words, contexts.parents, sampling)
    model = durable(word_probabilities(words, history, mean, sampling), "word-model")
    discard(words)
    lookup = find_lookup(model, room, seated, mean, head_words)
    discard(pairs)
    turn = F.pmod(F.xxhash64("doc_id", "body"), F.lit(ROUNDS))
    scored = [durable(score_texts(bodies.where(turn == k), lookup, mean, contexts), "scores", tidy=True) for k in range(ROUNDS)]
    discard(lookup.words, lookup.pairs)
    lookup.shared.destroy()
    return reduce(DataFrame.unionAll, scored).withColumn("train_tokens", F.lit(mean.tokens).cast("long"))
