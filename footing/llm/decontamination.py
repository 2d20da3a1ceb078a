"""Benchmark items in documents, up to a share of edits, by the pigeonhole principle.

An item of n characters may differ by k = floor(share * n) edits.  Cut into k + 1 pieces,
at least one piece stands unchanged in any such copy.  All pieces are found in one pass by an
Aho-Corasick automaton; around each hit Myers' bit-parallel algorithm computes the least edit
distance between the item and any stretch of the text.  A refinement that loses nothing:
cut into k + s pieces, at least s stand unchanged and the starts they imply lie within k of each
other, so fewer places are verified.  Items and texts are whole words: the blanks at their
ends are part of them, and leaving one out is an edit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footing.llm.words import drop_held, resting

#: Share of an item's characters that edits may change.
SHARE = 0.1
#: Most pieces that are asked to stand unchanged (1: the plain rule), and least characters of a piece where it is more than one.
SPARE, LEAST = 3, 6
#: Characters of items in one automaton; more items make more passes.
BLOCK_CHARS = 4_000_000
_WORDS = re.compile(r"[^\W_]+")


def normal(text: str) -> str:
    """Lower case, words only, single spaces."""
    return " ".join(_WORDS.findall(text.lower()))


def bounded(text: str) -> str:
    """A normal form with the blanks around its first and last word."""
    return f" {text} "


def edits(item: str, share: float) -> int:
    """Edits that a bounded item may have: a share of its own characters."""
    return int(share * (len(item) - 2))


def spare(n: int, allowed: int, most: int = SPARE) -> int:
    """Pieces that must stand unchanged: up to ``most``, where pieces keep LEAST characters; else one."""
    return max(1, min(most, n // LEAST - allowed))


def pieces(item: str, share: float = SHARE, most: int = SPARE) -> list[tuple[int, str]]:
    """(offset, piece): as many pieces as edits and those that must stand unchanged, of near equal length."""
    allowed = edits(item, share)
    n = allowed + spare(len(item), allowed, most)
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for k, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << k
    return out


def myers(eq: dict[str, int], n: int, text: str) -> tuple[int, int]:
    """Least edit distance of a pattern of n characters to any stretch of text, and the stretch's end."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score = full, 0, n
    best, end = n, 0
    for k, c in enumerate(text):
        e = eq.get(c, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full  # the text's start is free
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, end = score, k + 1
    return best, end


class Matcher:
    """Finds a block of bounded items; built anew in each worker from the items."""

    def __init__(self, items: list[tuple[int, str]], share: float, most: int = SPARE) -> None:
        import ahocorasick

        self.items = {k: (t, masks(t), edits(t, share), spare(len(t), edits(t, share), most)) for k, t in items}
        where: dict[str, list[tuple[int, int]]] = {}
        for k, t in items:
            for offset, piece in pieces(t, share, most):
                where.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of the best stretch of a bounded text for each item within its edits."""
        hits: dict[int, list[tuple[int, int]]] = {}
        for last, (size, places) in self.automaton.iter(text):
            for k, offset in places:
                hits.setdefault(k, []).append((last + 1 - size - offset, offset))
        windows: dict[int, list[list[int]]] = {}
        for k, own in hits.items():
            item, _, allowed, least = self.items[k]
            if len(own) < least:
                continue
            own.sort()
            first = 0
            for at in range(len(own)):
                while own[at][0] - own[first][0] > allowed:
                    first += 1
                if at - first + 1 < least or len({offset for _, offset in own[first : at + 1]}) < least:
                    continue
                a, b = own[first][0] - allowed, own[at][0] + len(item) + allowed
                kept = windows.setdefault(k, [])
                if kept and a <= kept[-1][1]:  # starts are in order: one stretch of hits
                    kept[-1][1] = max(b, kept[-1][1])
                else:
                    kept.append([a, b])
        out = []
        for k, own in sorted(windows.items()):
            item, eq, allowed, _ = self.items[k]
            best = None
            for a, b in own:
                a = max(0, a)
                if best is not None and best[0] == 0:
                    break
                distance, end = myers(eq, len(item), text[a:b])
                if distance <= allowed and (best is None or distance < best[0]):
                    # the same backwards, from the end, gives the start
                    _, back = myers(masks(item[::-1]), len(item), text[a : a + end][::-1][: len(item) + allowed])
                    best = (distance, a + end - back, a + end)
            if best:
                out.append((k, *best))
        return out


def original(text: str, start: int, end: int) -> tuple[int, int]:
    """The words that a stretch of the bounded normal form touches, as places in the text itself."""
    lower = text.lower()
    first = last = None
    at = 1
    for m in _WORDS.finditer(lower):
        size = m.end() - m.start()
        if first is None and at + size > start:
            first = m.start()
        if at < end:
            last = m.end()
        at += size + 1
    if len(lower) != len(text):  # some characters have two when lowered
        where = [k for k, c in enumerate(text) for _ in c.lower()]
        first, last = where[first], where[last - 1] + 1
    return first, last


def _blocks(benchmark: DataFrame, most: int, ids: bool = True) -> Iterator[list[tuple[int, str, int | None]]]:
    """Distinct non-empty items (key, normal form, id) in blocks of bounded size, in order.

    An item is an id and a text: all texts of an id count.  Without ``ids`` a text alone is an
    item, whatever its id, and null ids count too.
    """
    rows = benchmark.where("text is not null")
    item_id = F.col("item_id").cast("long") if ids else F.lit(None).cast("long")
    rows = rows.select(item_id.alias("item_id"), "text")
    if ids:
        rows = rows.where("item_id is not null")
    block: list[tuple[int, str, int | None]] = []
    size, held, last = 0, set(), None
    for r in rows.distinct().orderBy("item_id", "text").toLocalIterator():
        if r["item_id"] != last:
            held, last = set(), r["item_id"]
        item = normal(r["text"])
        if not item or item in held:
            continue
        if ids:
            held.add(item)  # the texts of one id
        block.append((len(block), bounded(item), r["item_id"]))
        size += len(item)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


MATCHES = "item_id long, distance int, item_chars int, start long, end long"


def find_items(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, text: str = "text", keep: tuple[str, ...] = ("doc_id",), block_chars: int = BLOCK_CHARS, most: int = SPARE) -> DataFrame:
    """Pairs of a document row and an item that its text holds within the allowed edits.

    Texts and items are compared in lower case, words joined by single spaces.  Beside the
    columns in ``keep``: item_id, distance, item_chars, start and end (the whole words of the best
    place, in characters of the text as it stands) for each pair; texts that share an id are items
    of their own.  ``most``: see :func:`spare`.  The benchmark is a stated query set: it is taken in
    blocks of bounded size, each against all documents whole.  Items that are null,
    without an id, or without words match nothing, as do such texts; repeated documents have repeated rows.  No shuffle.
    """
    own = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text), F.lit("")).alias("body"))
    names = [*own.columns[:-1], *(c.split()[0] for c in MATCHES.split(", "))]
    kept = "".join(f"k{i} {own.schema[i].dataType.simpleString()}, " for i in range(len(keep)))
    out = None
    for block in _blocks(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # at most block_chars and one item

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            drop_held()
            matcher = Matcher([(k, t) for k, t, _ in shared.value], share, most)
            items = {k: (own, len(t) - 2) for k, t, own in shared.value}
            for batch in batches:
                rows, where = [], []
                for k, body in enumerate(batch.column(batch.num_columns - 1)):
                    text = body.as_py()
                    for item, distance, start, end in matcher.find(bounded(normal(text))):
                        where.append(k)
                        rows.append((items[item][0], distance, items[item][1], *original(text, start, end)))
                columns = [*zip(*rows)] if rows else [[]] * 5
                held = [c.take(pa.array(where, pa.int64())) for c in batch.columns[:-1]]
                types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([*held, *[pa.array(c, t) for c, t in zip(columns, types)]], names=names)

        part = own.mapInArrow(resting(run), f"{kept}{MATCHES}")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], f"{kept}{MATCHES}")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *names[len(keep) :])


def without_items(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, all columns, whose text holds no item; see :func:`find_items`.  Ids of items are not looked at."""
    schema, at = docs.schema, docs.columns.index(text)
    for block in _blocks(benchmark, block_chars, ids=False):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            drop_held()
            matcher = Matcher([(k, t) for k, t, _ in shared.value], share)
            for batch in batches:
                clean = [not matcher.find(bounded(normal(x.as_py() or ""))) for x in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(resting(run), schema)
    return docs
