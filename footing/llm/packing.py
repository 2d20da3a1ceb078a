"""Best-fit packing of token sequences by a configuration linear program.

Only the histogram of piece lengths (at most ``capacity`` bins, whatever the input) goes to
the driver.  There the configuration program

    minimise the number of sequences, each filled by a pattern of lengths, so that every
    length's count is covered

is solved by multiplicative weights: lengths carry weights, a bounded knapsack dynamic program
prices the best pattern through every length under the present weights, and covered lengths
lose weight, until the solution is within a gap of the dual bound.  The fractional solution is
rounded in several ways: patterns that are worth a share of its mean or more under the dual solution are rounded up, or down, while
the counts last; what is left is the next program, a few times or until no pattern is left; best fit places
the rest.  The rounding with the fewest sequences stands; one that keeps no pattern is among them, so that
there are never more than plain best fit needs.  The plan, whose size depends on the capacity only, is
broadcast; pieces look up their place by rank among the pieces of their length.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from footing.llm.common import durable
from footing.llm.words import give_back, held

#: Words whose ids a task keeps; beyond that, and from task to task, only those learned first, which are the frequent ones.
#: A cache: no result depends on it.
CACHE_WORDS, KEPT_WORDS = 400_000, 131_072
#: Documents that are encoded together.
GROUP = 128
#: Rank buckets, so that no length's pieces are numbered by one task.
RANK_BUCKETS = 64

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


class WordEncoder:
    """Ids as little-endian unsigned 32-bit bytes, word by word, with caches of words and pieces.

    The vocabulary's normaliser and splitter never look across white space, so a text's
    ids are those of its words in order.  Python's split also parts at four control
    characters that the vocabulary does not take for white space; texts that hold one
    are encoded whole.  Words of Latin letters are cut into the splitter's pieces here, as
    many words differ in marks or case only; all others go to the tokenizer as they are.
    """

    ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
    # Fixed value: the pattern in the vocabulary file.
    PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: Below this character lower case and composition are the same everywhere.
    PLAIN = "\u0130"

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core's work
        self.tokenizer = Tokenizer.from_file(path)
        self.split = regex.compile(self.PIECE).findall
        self.marks = re.compile(r"[^\w\s][,.](?=\s)|_[,.](?=\s)").search
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[k for word, k in vocabulary.items() if word.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        out = []
        for k in range(0, len(texts), 1024):
            out += [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts[k : k + 1024], add_special_tokens=False)]
        return out

    def _each(self, some: list[str]) -> list[bytes]:
        """Ids of pieces, encoded in one go; each ends in the only id of its that ends a word."""
        out: list[bytes] = []
        for k in range(0, len(some), 4096):
            part = some[k : k + 4096]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part):
                body, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
                out += [body[x:y] for x, y in zip(at, at[1:])]
            else:
                out += self._whole(part)
        return out

    def _learn(self, new: list[str]) -> None:
        whole, cut, rest, known = [], {}, [], self.pieces
        for w in new:
            if w.isalpha() and w.isascii() and w.islower():
                whole.append(w)
            elif max(w) < self.PLAIN and "<|" not in w:  # special tokens hold this
                cut[w] = self.split(w.lower())
            else:
                rest.append(w)
        self.words.update(zip(whole, self._each(whole)))
        pieces = [*{p for own in cut.values() for p in own if p not in known}]
        known.update(zip(pieces, self._each(pieces)))
        self.words.update({w: b"".join([known[p] for p in own]) for w, own in cut.items()})
        self.words.update(zip(rest, self._whole(rest)))

    def _levelled(self, text: str) -> str:
        """The text in lower case, commas and stops apart from their words: fewer distinct words.

        Only of Latin texts in which no other mark stands before such a comma or stop, as
        the splitter keeps marks together.
        """
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text
        if "<|" in text or self.marks(text):
            return text
        return text.lower().replace(", ", " , ").replace(". ", " . ").replace(".\n", " .\n")

    def forget(self) -> None:
        self.words, self.pieces = (dict(islice(x.items(), KEPT_WORDS)) for x in (self.words, self.pieces))

    def rest(self) -> None:
        """At a task's end: a worker that may stay idle keeps little."""
        if len(self.words) > KEPT_WORDS:
            self.forget()
        give_back()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; new words of all of them are learned together."""
        if len(self.words) > CACHE_WORDS:
            self.forget()
        parts = [None if any(c in t for c in self.ODD) else self._levelled(t).split() for t in texts]
        get = self.words.get
        found = [[*map(get, p)] if p is not None else [] for p in parts]
        short = {k: [i for i, x in enumerate(own) if x is None] for k, own in enumerate(found) if None in own}
        self._learn([*{parts[k][i] for k, missing in short.items() for i in missing}])
        for k, missing in short.items():
            for i in missing:
                found[k][i] = get(parts[k][i])
        return [b"".join(own) if p is not None else self._whole([t])[0] for t, p, own in zip(texts, parts, found)]


def encoder(path: str) -> WordEncoder:
    """A worker's encoder, kept from task to task."""
    return held(f"encoder {path}", lambda: WordEncoder(path))


def _cutter(vocabulary: str, capacity: int, end_id: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tail = encoder(vocabulary), np.asarray([end_id], dtype="<u4").tobytes()
        width = 4 * capacity
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for first in range(0, batch.num_rows, GROUP):
                some = batch.slice(first, GROUP)
                for doc, own in zip(some.column(0).to_pylist(), words.encode(some.column(1).to_pylist())):
                    ids = own + tail
                    for k in range(0, len(ids), width):
                        part = ids[k : k + width]
                        for column, value in zip(out, (doc, k // width, k // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=PIECES.names)
        words.rest()

    return run


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 0, keep_ids: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32, ids (if kept)."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return own.mapInArrow(_cutter(vocabulary, capacity, end_id, keep_ids), PIECES)


class Fillings:
    """The most valuable filling of every room up to the capacity: a bounded knapsack.

    Dynamic programming over lots of 1, 2, 4, ... pieces of a length; ``value`` and ``counts``
    go by ``lengths``.
    """

    def __init__(self, value: np.ndarray, lengths: np.ndarray, counts: np.ndarray, capacity: int) -> None:
        self.lots: list[tuple[int, int, int]] = []
        for i in range(len(lengths) - 1, -1, -1):
            most, lot = int(min(counts[i], capacity // lengths[i])), 1
            while most > 0:
                lot = min(lot, most)
                self.lots.append((i, lot, lot * int(lengths[i])))
                most -= lot
                lot *= 2
        self.best = np.zeros(capacity + 1)
        self.last = np.zeros((len(self.lots) + 1, capacity + 1), dtype=np.int32)  # the last lot used, of the first k
        for k, (i, lot, size) in enumerate(self.lots, 1):
            row = self.last[k]
            row[:] = self.last[k - 1]
            gain = self.best[: capacity + 1 - size] + lot * value[i]
            better = gain > self.best[size:] + 1e-9
            row[size:][better] = k
            np.copyto(self.best[size:], gain, where=better)

    def of(self, room: int) -> dict[int, int]:
        """index of a length -> pieces of it."""
        out: dict[int, int] = {}
        k = len(self.lots)
        while k := int(self.last[k, room]):
            i, lot, size = self.lots[k - 1]
            out[i] = out.get(i, 0) + lot
            room -= size
            k -= 1
        return out


#: Share of a length's count below which a program leaves it to the next one.
LITTLE = 0.02
#: Sequences beyond the dual bound, as a share of it, at which the weights stop.
GAP = 0.002


def solve_program(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 40, step: float = 0.5) -> tuple[dict[tuple, float], np.ndarray]:
    """Patterns ((index, pieces), ...) with how often each is used, fractional, and the dual solution.

    Multiplicative weights: a length weighs its share of a sequence, less the more of it is
    covered.  Each round prices a pattern through every length and uses it for ``step`` of what its
    scarcest length has left, so that no count is exceeded.  The dual solution is the best of
    the rounds' weights, scaled so that no pattern is worth more than one: what all counts are worth
    is a lower bound on the sequences.  Rounds end when what is left over adds less than GAP to it.
    """
    left, chosen, dual = counts.astype(float), {}, np.zeros(len(lengths))
    for _ in range(rounds):
        on = left >= LITTLE * counts
        if not on.any():
            break
        weight = lengths / capacity * np.exp(left / counts - 1)
        fillings = Fillings(weight, lengths, np.where(on, counts, 0), capacity)
        if on.all():
            dual = max(dual, weight / fillings.best[capacity], key=lambda y: float((y * counts).sum()))
        for i in np.flatnonzero(on)[::-1].tolist():
            shape = fillings.of(capacity - int(lengths[i]))
            shape[i] = shape.get(i, 0) + 1
            if shape[i] > counts[i]:
                continue
            size = step * min(left[j] / n for j, n in shape.items())
            key = tuple(sorted(shape.items()))
            chosen[key] = chosen.get(key, 0.0) + size
            for j, n in shape.items():
                left[j] -= size * n
        bound = float((dual * counts).sum())
        if sum(chosen.values()) + float((dual * left).sum()) <= (1 + GAP) * bound and float((left * lengths).sum()) < GAP * capacity * bound:
            break
    return chosen, dual


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pattern, sequences): every piece, longest first, into the fullest that takes it.

    Sequences of one content are handled together: the fullest that takes a piece goes on taking
    pieces of its length until none fits, so each of a kind takes the same number.
    """
    rooms: list[int] = []  # ascending
    kinds: dict[int, list[tuple[dict[int, int], int]]] = {}

    def keep(room: int, pattern: dict[int, int], times: int) -> None:
        if room not in kinds:
            insort(rooms, room)
            kinds[room] = []
        kinds[room].append((pattern, times))

    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                pattern, times = kinds[room].pop()
                if not kinds[room]:
                    del kinds[room]
                    rooms.pop(at)
            else:
                room, pattern, times = capacity, {}, -(-n // (capacity // length))
            per = room // length
            full = min(times, n // per)
            if full:
                keep(room - per * length, pattern | {length: pattern.get(length, 0) + per}, full)
            n -= full * per
            if full < times:  # fewer pieces are left than the next one holds
                if n:
                    keep(room - n * length, pattern | {length: n}, 1)
                if times - full - bool(n):
                    keep(room, pattern, times - full - bool(n))
                n = 0
    return [x for own in kinds.values() for x in own if x[0]]


def _round_off(left: dict[int, int], capacity: int, rounds: int, floor: float, up: bool, programs: int | None) -> list[tuple[dict[int, int], int]]:
    """(pattern, sequences) of one way to round: patterns worth ``floor`` of the mean, up or down, for so many programs, then best fit."""
    left, out, done = dict(left), [], 0
    while (programs is None or done < programs) and any(left.values()):
        done += 1
        live = sorted(k for k, n in left.items() if n)
        chosen, dual = solve_program(np.asarray(live), np.asarray([left[k] for k in live]), capacity, rounds)
        worth = {key: float(sum(dual[i] * n for i, n in key)) for key in chosen}
        mean = sum(x * worth[key] for key, x in chosen.items()) / max(sum(chosen.values()), 1e-9)
        before = len(out)
        for key, x in sorted(chosen.items(), key=lambda s: -s[1]):
            if worth[key] < floor * mean - 1e-9:
                continue  # poor patterns only fill up the fractional solution; their pieces are for the next program
            times = min(int(x) + up, *(int(left[live[i]] // n) for i, n in key))
            if times:
                out.append(({live[i]: n for i, n in key}, times))
                for i, n in key:
                    left[live[i]] -= n * times
        if len(out) == before:
            break
    return out + best_fit({k: n for k, n in left.items() if n}, capacity)


#: Ways to round a solution: share of the mean worth that a pattern must have, up or down, programs (None: until no pattern is left).
WAYS = ((1.0, True, None), (1.0, False, 1), (1.0, False, 3), (0.0, False, 1), (0.0, False, 0))


def plan_bins(histogram: dict[int, int], capacity: int, rounds: int = 40) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, rank_from, rank_to, per_bin, first_bin, offset): where ranks of a length go.

    The ranks [rank_from, rank_to) of ``length`` fill bins from ``first_bin`` on, ``per_bin``
    to a bin, starting at ``offset`` in each.
    """
    left = {int(k): int(n) for k, n in histogram.items() if n}
    rank = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int, int]] = []
    bins = 0
    whole = [({capacity: 1}, left.pop(capacity))] if left.get(capacity) else []
    least = -(-sum(k * n for k, n in left.items()) // capacity)
    best: list[tuple[dict[int, int], int]] | None = None
    for floor, up, programs in WAYS:
        found = _round_off(left, capacity, rounds, floor, up, programs)
        if best is None or sum(n for _, n in found) < sum(n for _, n in best):
            best = found
        if sum(n for _, n in best) <= least:
            break  # no sequence is less than full but one
    for pattern, times in whole + best:
        offset = 0
        for length, per in sorted(pattern.items(), reverse=True):
            rows.append((length, rank[length], rank[length] + per * times, per, bins, offset))
            rank[length] += per * times
            offset += per * length
        bins += times
    return rows


def _blocks(plan: list[tuple[int, int, int, int, int, int]], histogram: dict[int, int]) -> tuple[dict[int, int], list[tuple]]:
    """Per length the ranks in a block, and the plan's rows by the blocks that they touch.

    A length of n pieces and q rows has q blocks, so that a row touches two more than it fills
    and a block holds few rows: at most twice the plan in all.
    """
    rows_of: dict[int, int] = {}
    for r in plan:
        rows_of[r[0]] = rows_of.get(r[0], 0) + 1
    size = {k: -(-histogram[k] // q) for k, q in rows_of.items()}
    return size, [(r[0], k, *r[1:]) for r in plan for k in range(r[1] // size[r[0]], (r[2] - 1) // size[r[0]] + 1)]


def pack_pieces(pieces: DataFrame, capacity: int = 2048, rounds: int = 40) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ids_crc32, ...); see the module's text.

    Pieces must not be longer than capacity and be durable: they are read three times.
    An empty table gives no rows; repeated rows are pieces of their own; other columns stay,
    but for any named sequence_id or offset, and names that start with ``_pack_``.
    """
    spark = pieces.sparkSession
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_BUCKETS)).cast("int")
    keyed = pieces.drop("sequence_id", "offset").withColumn("_pack_bucket", bucket)
    counts = keyed.groupBy("length", "_pack_bucket").agg(F.count(F.lit(1)).alias("n"))
    found = counts.collect()  # at most capacity * RANK_BUCKETS rows
    histogram: dict[int, int] = {}
    starts = []
    for r in sorted(found, key=lambda r: (r["length"], r["_pack_bucket"])):
        starts.append((r["length"], r["_pack_bucket"], histogram.get(r["length"], 0)))
        histogram[r["length"]] = histogram.get(r["length"], 0) + r["n"]
    size, blocks = _blocks(plan_bins(histogram, capacity, rounds), histogram)
    start_rows = spark.createDataFrame([(*s, size[s[0]]) for s in starts], "length long, _pack_bucket int, _pack_before long, _pack_size long")
    names = ("length", "_pack_block", "lo", "hi", "per_bin", "first_bin", "at")
    columns = [pa.array(c, pa.int64()) for c in zip(*blocks)] or [pa.array([], pa.int64())] * len(names)
    plan_rows = spark.createDataFrame(pa.Table.from_arrays(columns, names=list(names)))
    by_block = plan_rows.groupBy("length", "_pack_block").agg(F.collect_list(F.struct(*names[2:])).alias("_pack_plan"))
    within = F.row_number().over(Window.partitionBy("length", "_pack_bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = keyed.withColumn("_pack_within", within).join(F.broadcast(start_rows), ["length", "_pack_bucket"])
    ranked = ranked.withColumn("_pack_rank", F.col("_pack_before") + F.col("_pack_within")).withColumn("_pack_block", F.floor(F.col("_pack_rank") / F.col("_pack_size")))
    placed = ranked.join(F.broadcast(by_block), ["length", "_pack_block"])
    rank = F.col("_pack_rank")
    spot = F.filter("_pack_plan", lambda p: (p["lo"] <= rank) & (rank < p["hi"]))[0]
    nth = rank - spot["lo"]
    sequence = spot["first_bin"] + F.floor(nth / spot["per_bin"])
    offset = spot["at"] + (nth % spot["per_bin"]) * F.col("length")
    return placed.select(*[c for c in keyed.columns if c != "_pack_bucket"], sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, rounds: int = 40, keep_ids: bool = False) -> DataFrame:
    """Tokenise (null text: empty), cut what is longer than capacity, and pack.  Other columns are not looked at.

    Every document, the empty one too, has at least its end id, so it is a piece.
    Returns doc_id, piece, start, length, ids_crc32, ids (null unless kept), sequence_id, offset.
    """
    pieces = durable(token_pieces(docs, vocabulary, capacity, keep_ids=keep_ids), "pieces")
    return pack_pieces(pieces, capacity, rounds)
