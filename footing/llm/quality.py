"""Quality rules with exact repetition found by suffix arrays over words.

The documents of a batch are laid end to end with a separator each; suffixes are ordered
by prefix doubling, in which only still tied suffixes are sorted again, and ranks are kept
for every doubling so that common prefixes of neighbours follow by binary lifting.
A place's longest common prefix with its neighbours is the longest run from there that
occurs again in the document; the places where such a run cannot be extended to the left
start the maximal repeated runs.  Their spans are united.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footing.llm.common import text_bytes
from footing.llm.words import CACHE_WORDS, WordIndex, resting

#: Words laid out in one suffix array at most, unless a single document is longer.
CHUNK_WORDS = 400_000
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Limits; a document that meets all is kept.

    min_words, max_repeat_share (words in 3-word windows found twice or more): the base
    rules.  run_words: repeated runs shorter than this are not spans.  max_covered: most
    of the words that repeated spans may cover.  max_run: longest repeated run in words.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    run_words: int = 8
    max_covered: float = 0.4
    max_run: int = 100


def suffix_repeats(doc: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Per place the length of the longest run of words from there that its document repeats.

    ``doc``: ascending document numbers; ``word``: word numbers.
    """
    n = len(word)
    if not n:
        return np.zeros(0, dtype=np.int64)
    # every document ends in a separator of its own, so no run crosses it
    ends = np.flatnonzero(np.concatenate([doc[1:] != doc[:-1], [True]]))
    place = np.arange(n) + np.searchsorted(ends, np.arange(n))
    size = n + len(ends)
    key = np.empty(size, dtype=np.int64)
    stop = np.ones(size, dtype=bool)
    stop[place] = False
    key[place] = (doc << np.int64(32)) | (word + 1)
    key[stop] = doc[ends] << np.int64(32)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    rank = np.empty(size, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(size), 0))
    levels = [rank.astype(np.int32)]

    def tied(new: np.ndarray) -> np.ndarray:
        """Which of consecutive group starts belong to groups of several."""
        same = ~new
        return same | np.concatenate([same[1:], [False]])

    where = np.flatnonzero(tied(fresh))  # places in the suffix array
    step = 1
    while len(where):
        held = order[where]
        first = rank[held]
        by = np.lexsort((rank[held + step], first))
        held, first = held[by], first[by]
        second = rank[held + step]
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        order[where] = held
        rank = rank.copy()
        rank[held] = np.maximum.accumulate(np.where(new, where, 0))
        levels.append(rank.astype(np.int32))
        where = where[tied(new)]
        step *= 2
    # common prefixes of neighbours: each level that agrees adds its length
    a, b = order[:-1], order[1:]
    common = np.zeros(size - 1, dtype=np.int64)
    live = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[live].copy(), b[live].copy()
    got = np.zeros(len(live), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        agree = levels[k][np.minimum(a, size - 1)] == levels[k][np.minimum(b, size - 1)]
        agree &= a != b
        got[agree] += 1 << k
        a[agree] += 1 << k
        b[agree] += 1 << k
    common[live] = got
    longest = np.zeros(size, dtype=np.int64)
    longest[order[:-1]] = common
    longest[order[1:]] = np.maximum(longest[order[1:]], common)
    return longest[place]


def united(doc: np.ndarray, longest: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in repeated runs of at least ``least`` words."""
    n = len(longest)
    before = np.concatenate([[0], longest[:-1]])
    before[np.concatenate([[True], doc[1:] != doc[:-1]])] = 0
    starts = np.flatnonzero((longest >= least) & (before != longest + 1))  # not to be extended left
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + longest[starts], -1)
    return np.cumsum(step[:n]) > 0


MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_run long"
)
_NAMES = [c.split()[0] for c in MEASURES.split(", ")]


def _measure(bodies: list[bytes], index: WordIndex, rules: Rules) -> list[np.ndarray]:
    count = np.zeros(len(bodies), dtype=np.int64)
    chars, symbols, lines = count.copy(), count.copy(), count.copy()
    parts = []
    for k, body in enumerate(bodies):
        words = body.split()
        count[k] = len(words)
        parts.append(index.indexes(words))
        chars[k] = len(body.decode("utf-8", "replace")) - len(body) + len(b"".join(words))
        symbols[k] = len(body) - len(body.translate(None, SYMBOLS))
        filled = [x for x in body.split(b"\n") if x.strip()]
        lines[k] = len(filled) - len(set(filled))
    doc = np.repeat(np.arange(len(bodies)), count)
    longest = suffix_repeats(doc, np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64))
    sums = lambda flags: np.bincount(doc[flags], minlength=len(bodies))
    triple = longest >= 3
    for back in (1, 2):  # a window never leaves its document, so neither does the shift
        triple[back:] |= (longest >= 3)[:-back] if len(triple) > back else False
    repeated = sums(triple)
    covered = sums(united(doc, longest, rules.run_words))
    most = np.zeros(len(bodies), dtype=np.int64)
    np.maximum.at(most, doc, longest)
    failed = (count < rules.min_words) | (100 * repeated > rules.max_repeat_percent * count)
    kept = ~failed & (covered <= rules.max_covered * count) & (most <= rules.max_run)
    return [count, chars, symbols, lines, repeated, failed, kept, covered, most]


def measure_quality(docs: DataFrame, rules: Rules = Rules(), text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measures and verdict of every row, beside the columns in ``keep``.

    Null, empty and blank texts have no words: all measures 0, base_failed true, kept false.
    Texts are measured whole; rows are independent, so repeated rows and null ids need no
    care and an empty table gives no rows.  No shuffle.
    """
    own = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], text_bytes(text).alias("body"))

    names = [*own.columns[:-1], *_NAMES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = WordIndex()
        for batch in batches:
            bodies = batch.column(len(keep))
            start, total = 0, 0
            for end in range(1, len(bodies) + 1):
                total += len(bodies[end - 1].as_buffer()) // 6
                if total < CHUNK_WORDS and end < len(bodies):
                    continue
                if len(index) > CACHE_WORDS:
                    index.clear()
                found = _measure([x.as_py() for x in bodies[start:end]], index, rules)
                yield pa.RecordBatch.from_arrays([*batch.slice(start, end - start).columns[: len(keep)], *map(pa.array, found)], names=names)
                start, total = end, 0

    kept = ", ".join(f"k{i} {own.schema[i].dataType.simpleString()}" for i in range(len(keep)))
    out = own.mapInArrow(resting(run), f"{kept}, {MEASURES}")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *_NAMES)
